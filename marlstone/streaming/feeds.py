"""Streaming forms of the signal operators, over any source of Structured Streaming.

A stream's output and its progress live under a path that the caller names. A query that
is started again with the same path goes on where the last one stopped, and no row is
written twice or left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators import markets
from marlstone.sources import schemas

Sink = Callable[[DataFrame, int], None]


def files(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def relay(frames: DataFrame, kind: str, schema: str, kind_column: str = "event_type", body: str = "props") -> DataFrame:
    """Frames of one kind with their JSON body parsed; malformed bodies give null fields. Stateless."""
    return frames.where(F.col(kind_column) == kind).withColumn("body", F.from_json(body, schema))


def first_seen(frames: DataFrame, keys: Sequence[str], ts: str | None = None, within: str | None = None) -> DataFrame:
    """One row for each key. With ``within`` a key counts as new again after that time, which bounds the state."""
    if within is None:
        return frames.dropDuplicates(list(keys))
    return frames.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def subscribed(frames: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Frames of the ids in the static table."""
    return frames.join(ids.select(key).distinct(), key, "left_semi")


def subscriptions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The ids of both, each once."""
    return old.unionByName(new).distinct()


def start(stream: DataFrame, write: Sink, at: str, every: str | None = None) -> StreamingQuery:
    """Hand each micro-batch to ``write``: every so often, or all that is there and then stop. Progress is kept under ``at``."""
    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/progress")
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def drain(stream: DataFrame, at: str) -> DataFrame:
    """All that the stream has now, appended to the table under ``at``; its rows as a batch."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start(f"{at}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def merging(schema, at: str, merge: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 3) -> Sink:
    """A batch writer that keeps a snapshot under ``at``: each batch merges into the version before it; ``keep`` versions stay.

    For states of a few rows: each batch writes the whole. See ``stateful`` for large ones.

    The version has the number of the batch, so a batch that is repeated after a failure
    starts from the same snapshot and gives the same one.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        old = schemas.read_snapshot(batch.sparkSession, f"{at}/state", schema, before=epoch)
        schemas.write_snapshot(merge(old, batch), f"{at}/state", epoch)
        schemas.prune_snapshot(batch.sparkSession, f"{at}/state", keep)

    return write


def snapshot(spark: SparkSession, at: str, schema) -> DataFrame:
    """What ``merging`` has under ``at`` now: for readers that poll while the stream runs, or after it."""
    return schemas.read_snapshot(spark, f"{at}/state", schema)


def drain_latest(stream: DataFrame, keys: Sequence[str], by: Sequence[str], at: str) -> DataFrame:
    """The latest row of each key after all that the stream has now and had before."""
    merge = lambda old, new: markets.latest(old.unionByName(new), keys, by).select(*stream.columns)
    start(stream, merging(stream.schema, at, merge), at).awaitTermination()
    return snapshot(stream.sparkSession, at, stream.schema)


def drain_newest(stream: DataFrame, keys: Sequence[str], ts: str, tie: str, at: str, most: int = 50) -> DataFrame:
    """A history of at most ``most`` rows, the newest first: rows whose key it holds already do not enter."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        # of equal keys in a batch the newest may enter; the state never has more than ``most`` rows
        return markets.recent(old.unionByName(markets.unseen(new, old, keys)), most, ts, tie).select(*stream.columns)

    start(stream, merging(stream.schema, at, merge), at).awaitTermination()
    return snapshot(stream.sparkSession, at, stream.schema)


def fan_out(sinks: Sequence[Sink]) -> Sink:
    """A batch writer that hands every batch to each sink; computed once."""

    def write(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, epoch)
        finally:
            held.unpersist()

    return write


def into(path: str) -> Sink:
    """A sink that writes each batch to a folder of its own under ``path``; a repeated batch replaces itself."""
    return lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
