"""A feed of frames as a source of Structured Streaming: offsets, subscriptions at the source, reconnecting.

A feed hands out numbered frames for the ids that it is asked for. ``source`` makes a data
source of a transport, which knows how to reach it; ``Log`` is the transport of a feed that
keeps its frames as files of lines. Spark asks for ranges of frames and keeps the offsets in
the query's progress, so a query that failed or stopped goes on without loss or repeats.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "place long, id string, value string"
#: Seconds before the feed is called again, at first and at most, and how often.
PAUSE, LONGEST_PAUSE, TRIES = 5.0, 60.0, 10
#: Frames that one task asks for.
FRAMES = 100_000


class Transport(Protocol):
    def end(self) -> int:
        """The number of frames so far."""

    def ids(self) -> tuple[int, Sequence[str] | None]:
        """The version of the set of ids that are subscribed, and the set; None is all."""

    def ids_of(self, version: int) -> Sequence[str] | None:
        """The set of that version."""

    def frames(self, start: int, end: int, ids: Sequence[str] | None) -> Iterator[tuple[int, str, str]]:
        """(place, id, value) of the frames in that range with one of the ids, in order; may fail at any time."""


class Log:
    """A feed as files of lines (JSON with an id) under a folder that every machine mounts, and versions of the ids.

    ``index`` has [file, number of lines] in the order of the feed, ``subscriptions`` a folder of files
    of ids, one for each version, a line each; without any, all frames pass.
    """

    def __init__(self, index: str, subscriptions: str | None = None, id_field: str = "id"):
        self.index, self.subscriptions, self.id_field = index, subscriptions, id_field

    def files(self) -> list[tuple[str, int]]:
        with open(self.index) as f:
            return [tuple(x) for x in json.load(f)]

    def end(self) -> int:
        return sum(n for _, n in self.files())

    def ids(self):
        names = [int(x) for x in os.listdir(self.subscriptions) if x.isdigit()] if self.subscriptions and os.path.isdir(self.subscriptions) else []
        version = max(names, default=-1)
        return version, self.ids_of(version)

    def ids_of(self, version: int):
        if version < 0:
            return None
        with open(f"{self.subscriptions}/{version}") as f:
            return f.read().split("\n")

    def frames(self, start: int, end: int, ids):
        wanted, first = None if ids is None else set(ids), 0
        for name, n in self.files():
            if first < end and first + n > start:
                with open(name) as f:
                    for place, line in enumerate(f, first):
                        if start <= place < end:
                            key = str(json.loads(line).get(self.id_field))
                            if wanted is None or key in wanted:
                                yield place, key, line.rstrip("\n")
            first += n


class Range(InputPartition):
    def __init__(self, start: int, end: int, version: int):
        self.start, self.end, self.version = start, end, version


class FeedReader(DataSourceStreamReader):
    def __init__(self, transport: Transport, options: dict):
        self.transport = transport
        self.pause, self.tries = float(options.get("pause", PAUSE)), int(options.get("tries", TRIES))
        self.size = int(options.get("frames", FRAMES))
        self.most = int(options.get("frames_per_batch", 0))
        self.done = 0

    def again(self, call):
        """The result of a call that may fail: it is made again after a pause that doubles."""
        for k in range(self.tries):
            try:
                return call()
            except (OSError, ValueError):
                if k + 1 == self.tries:
                    raise
                time.sleep(min(self.pause * 2**k, LONGEST_PAUSE))

    def initialOffset(self) -> dict:
        return {"place": 0, "version": self.again(self.transport.ids)[0]}

    def latestOffset(self) -> dict:
        # ids are part of the offset, so that a batch that is repeated asks for the same ones
        end = self.again(self.transport.end)
        self.done = min(end, self.done + self.most) if self.most else end
        return {"place": self.done, "version": self.again(self.transport.ids)[0]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.done = max(self.done, end["place"])
        return [Range(a, min(a + self.size, end["place"]), end["version"]) for a in range(start["place"], end["place"], self.size)] or [Range(0, 0, end["version"])]

    def read(self, partition: Range) -> Iterator[tuple]:
        """The range's frames, each once: after a failure the feed is asked from the frame after the last."""
        at, failed = partition.start, 0
        ids = self.again(lambda: self.transport.ids_of(partition.version))
        while at < partition.end:
            try:
                for row in self.transport.frames(at, partition.end, ids):
                    yield row
                    at, failed = row[0] + 1, 0
                return
            except (OSError, ValueError):
                failed += 1
                if failed >= self.tries:
                    raise
                time.sleep(min(self.pause * 2 ** (failed - 1), LONGEST_PAUSE))

    def commit(self, end: dict) -> None:
        pass


def source(name_: str, transport: Transport) -> type[DataSource]:
    """A data source of that name, to be registered with ``spark.dataSource.register``."""

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> FeedReader:
            return FeedReader(transport, dict(self.options))

    return Feed


def frames(spark: SparkSession, name: str, transport: Transport, **options) -> DataFrame:
    """The feed as a stream of SCHEMA. Options: pause, tries, frames (for a task), frames_per_batch."""
    spark.dataSource.register(source(name, transport))
    return spark.readStream.format(name).options(**options).load()


def keep_log(frames_: DataFrame, order: str, path: str, index: str, files: int) -> None:
    """Write frames (with an ``order``) as the files of a ``Log``; Spark writes them, the index has a line for each file."""
    spark = frames_.sparkSession
    frames_.repartitionByRange(files, order).sortWithinPartitions(order).select(F.to_json(F.struct(*frames_.columns)).alias("value")).write.mode("append").text(path)
    counts = spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each file
    known = {}
    if os.path.exists(index):
        with open(index) as f:
            known = dict(json.load(f))
    local = {"/" + r["file"].removeprefix("file:").lstrip("/"): r["n"] for r in counts}
    told = [*known.items(), *sorted((k, n) for k, n in local.items() if k not in known)]
    with open(f"{index}.new", "w") as f:
        json.dump(told, f)
    os.replace(f"{index}.new", index)
