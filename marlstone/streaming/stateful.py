"""Streams with state for each key: latest row, seen ids and history, subscriptions that change.

State lives in Spark's store under the stream's progress, a key at a time: a batch reads and
writes the keys that it has, whatever the state has grown to, and a query that is started
again goes on with it. ``held`` reads the state as a table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from marlstone.streaming import feeds

#: The store that holds state key by key, which saves a batch's changes and not all it holds; and no batches without
#: rows, which times to live would ask for without end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """SETTINGS for queries begun inside; a query keeps what it began with."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ddl(df: DataFrame, columns: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def rank(row, by: Sequence[str]) -> tuple:
    """Nulls first."""
    return tuple((row[c] is not None, row[c]) for c in by)


class Latest(StatefulProcessor):
    """Of each key the last row by some columns; tells a key's row when it changes."""

    def __init__(self, schema: str, columns: Sequence[str], by: Sequence[str]):
        self.schema, self.columns, self.by = schema, list(columns), list(by)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = dict(zip(self.columns, self.last.get(), strict=True)) if self.last.exists() else None
        changed = False
        for row in rows:
            if best is None or rank(row, self.by) > rank(best, self.by):
                best, changed = row.asDict(), True
        if changed:
            self.last.update(tuple(best[c] for c in self.columns))
            yield Row(**{c: best[c] for c in self.columns})

    def close(self) -> None:
        pass


def latest(stream: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Changes of each key's last row, as a stream in update mode; equal ones of ``by`` change nothing."""
    schema = ddl(stream, stream.columns)
    return stream.groupBy(*keys).transformWithState(Latest(schema, stream.columns, by), schema, "Update", "None")


class History(StatefulProcessor):
    """Of each key the ids seen, which are forgotten after a time, and its newest rows."""

    def __init__(self, schema: str, columns: Sequence[str], id_: str, id_schema: str, by: Sequence[str], most: int, within_ms: int | None):
        self.schema, self.columns, self.id, self.id_schema, self.by, self.most, self.within = schema, list(columns), id_, id_schema, list(by), most, within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", self.id_schema, "one boolean", self.within)
        self.newest = handle.getListState("newest", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = []
        for row in sorted(rows, key=lambda r: rank(r, self.by)):
            if not self.seen.containsKey((row[self.id],)):
                self.seen.updateValue((row[self.id],), (True,))
                fresh.append(row.asDict())
        if fresh:
            held = [dict(zip(self.columns, x, strict=True)) for x in self.newest.get()] + fresh
            held = sorted(held, key=lambda r: rank(r, self.by), reverse=True)[: self.most]
            self.newest.put([tuple(r[c] for c in self.columns) for r in held])
        for r in fresh:
            yield Row(**{c: r[c] for c in self.columns})

    def close(self) -> None:
        pass


class Newest(StatefulProcessor):
    """Of each key its newest rows; all rows pass, or with ``tell`` off none."""

    def __init__(self, schema: str, columns: Sequence[str], by: Sequence[str], most: int, tell: bool = True):
        self.schema, self.columns, self.by, self.most, self.tell = schema, list(columns), list(by), most, tell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        places = [self.columns.index(c) for c in self.by]
        order = lambda r: tuple((r[p] is not None, r[p]) for p in places)
        held = [(order(r), n, r) for n, r in enumerate(map(tuple, self.newest.get()))]
        for n, row in enumerate(rows, len(held)):
            # rows may be many: no more than twice the history is held at a time
            held.append((order(row), n, tuple(row)))
            if len(held) > 2 * self.most:
                held = heapq.nsmallest(self.most, held, key=_Last)
            if self.tell:
                yield row
        self.newest.put([r for *_, r in heapq.nsmallest(self.most, held, key=_Last)])

    def close(self) -> None:
        pass


class _Last:
    """The highest order first, of equal ones the row that came first."""

    def __init__(self, row: tuple):
        self.row = row

    def __lt__(self, other) -> bool:
        return self.row[0] > other.row[0] or (self.row[0] == other.row[0] and self.row[1] < other.row[1])


def first_seen(stream: DataFrame, key: str, id_: str, by: Sequence[str], most: int = 50, within_ms: int | None = None, tell: bool = True) -> DataFrame:
    """Rows whose id is new to their key, each once; an id counts as new again ``within_ms`` after it was seen.

    Each key keeps its ``most`` newest rows by ``by`` beside the ids (state ``newest``), which
    is no more than that many rows; ids are bounded by the time that they are kept. Ids that
    are kept for good are Spark's own deduplication, dealt by key and id, and the history has
    a state of its own behind it; of several rows of an id in one batch any may pass. With
    ``most`` 0 there is no history, and with ``tell`` off the history alone is kept: no row
    is handed on.
    """
    schema = ddl(stream, stream.columns)
    if not within_ms:
        fresh = stream.dropDuplicates([key, id_])
        return fresh.groupBy(key).transformWithState(Newest(schema, stream.columns, by, most, tell), schema, "Append", "None") if most else fresh
    processor = History(schema, stream.columns, id_, ddl(stream, [id_]), by, most, within_ms)
    return stream.groupBy(key).transformWithState(processor, schema, "Append", "ProcessingTime")


class Subscribed(StatefulProcessor):
    """Frames of a key pass once a control row has named it."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.on = handle.getValueState("on", "on boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        on, frames = self.on.get()[0] if self.on.exists() else False, []
        for row in rows:
            if row["__on"] is None:
                frames.append(row)
            else:
                on = row["__on"]
                self.on.update((on,))
        # within a batch control rows count first, as they come with the batch's beginning
        if on:
            for row in frames:
                yield Row(**{c: row[c] for c in self.columns})

    def close(self) -> None:
        pass


def subscribed(frames: DataFrame, control: DataFrame, key: str) -> DataFrame:
    """Frames whose key is subscribed when they come. ``control``: key, and ``on`` (false ends it), a stream too.

    Of several control rows of a key in one batch the last that comes counts. Frames are
    dealt by key, so a key that has a third of all frames is one task's; without control rows
    in flight ``feeds.subscribed`` needs no such dealing.
    """
    told = control.select(F.col(key), F.col("on").alias("__on"))
    both = frames.withColumn("__on", F.lit(None).cast("boolean")).unionByName(told, allowMissingColumns=True)
    return both.groupBy(key).transformWithState(Subscribed(frames.columns), ddl(frames, frames.columns), "Append", "None")


def start(stream: DataFrame, at: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Write a stateful stream's batches under ``at``, each to a folder of its own, which a repeated batch replaces."""
    with keyed_store(stream.sparkSession):
        out = stream.writeStream.outputMode(mode).foreachBatch(feeds.into(f"{at}/rows")).option("checkpointLocation", f"{at}/progress")
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def drain(stream: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """All that the stream has now; the rows of this and earlier drains to ``at`` as a batch, with their ``batch``."""
    start(stream, at, mode).awaitTermination()
    kinds = f"{ddl(stream, stream.columns)}, batch long"
    return stream.sparkSession.read.schema(kinds).parquet(f"{at}/rows")


def held(spark: SparkSession, at: str, state: str, kind: str | None = None) -> DataFrame:
    """The state of that name under ``at``, as a table of keys and values; reads the store, not the stream."""
    reader = spark.read.format("statestore").option("stateVarName", state)
    if kind == "list":
        reader = reader.option("flattenCollectionTypes", True)
    with keyed_store(spark):
        operators = spark.read.format("state-metadata").load(f"{at}/progress").where("operatorName like 'transformWithState%'")
        return reader.option("operatorId", operators.agg(F.min("operatorId")).first()[0]).load(f"{at}/progress")  # one number


def drain_latest(stream: DataFrame, keys: Sequence[str], by: Sequence[str], at: str) -> DataFrame:
    """The latest row of each key after all that the stream has now and had before: the state itself."""
    start(latest(stream, keys, by), at, "update").awaitTermination()
    return held(stream.sparkSession, at, "last").select("value.*").select(*stream.columns)


def drain_changes(totals: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """A streaming aggregate's value of each key after all that the stream has now and had before.

    Each batch writes the keys that it changed, under its number; a batch that is repeated
    writes the same again, so nothing counts twice.
    """
    told = drain(totals, at, "update")
    rest = [c for c in totals.columns if c not in keys]
    return told.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")
