"""Streams with keyed state: restarts, expiry, sizes, subscriptions, a source that fails."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from marlstone.sources import feed
from marlstone.streaming import feeds, stateful

FRAME = "k string, id long, ts long, v string"


def add(spark, path, rows):
    spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(path)
    return feeds.files(spark, path, FRAME, 100)


def test_latest_goes_on_and_costs_its_own_keys(spark, tmp_path):
    path, at = f"{tmp_path}/in", f"{tmp_path}/at"
    stream = add(spark, path, [(f"k{i}", i, i, "old") for i in range(50)] + [(None, 1, 1, None), ("k1", 99, 0, "late")])
    first = stateful.drain_latest(stream, ["k"], ["ts", "id"], at)
    assert first.count() == 51
    stream = add(spark, path, [("k1", 7, 500, "new"), ("k2", 7, 0, "older"), ("n", 1, None, "null")])
    got = {r["k"]: (r["id"], r["v"]) for r in stateful.drain_latest(stream, ["k"], ["ts", "id"], at).collect()}
    assert len(got) == 52 and got["k1"] == (7, "new") and got["k2"] == (2, "old") and got["n"] == (1, "null")
    told = spark.read.parquet(f"{at}/rows")
    assert {r["batch"]: r["count"] for r in told.groupBy("batch").count().collect()} == {0: 51, 1: 2}  # only what changed
    assert stateful.drain_latest(stream, ["k"], ["ts", "id"], at).count() == 52  # nothing new


def test_seen_ids_and_bounded_history(spark, tmp_path):
    path, at = f"{tmp_path}/in", f"{tmp_path}/at"
    run = lambda rows: stateful.drain(stateful.first_seen(add(spark, path, rows), "k", "id", ["ts"], 3), at)
    run([("a", i % 40, i, "x") for i in range(80)] + [("b", 1, 1, "y")])
    out = run([("a", 3, 999, "again"), ("a", 41, 0, "old"), ("b", 2, 5, "z")])
    assert sorted((r["k"], r["id"]) for r in out.collect()) == sorted([("a", i) for i in [*range(40), 41]] + [("b", 1), ("b", 2)])
    newest = stateful.held(spark, at, "newest", "list").select("list_element.*")
    assert sorted((r["k"], r["id"]) for r in newest.collect()) == [("a", 37), ("a", 38), ("a", 39), ("b", 1), ("b", 2)]  # three of a key at most


def test_seen_ids_are_no_calls_of_their_own(spark, tmp_path):
    """A key with many ids, told again in later batches, after a restart too: none by one asks Python's state."""
    path, at = f"{tmp_path}/in", f"{tmp_path}/at"
    rows = [("a", i, i // 2 if i % 7 else None, f"v{i}") for i in range(3000)] + [(None, 5, 1, "n"), (None, None, 2, "n")]
    for part in (rows[:1500] + rows[:700], rows, rows[-900:]):
        out = stateful.drain(stateful.first_seen(add(spark, path, part), "k", "id", ["ts", "id"], 4), at)
    assert sorted(((r["k"], r["id"], r["ts"], r["v"]) for r in out.collect()), key=repr) == sorted(rows, key=repr)
    newest = stateful.held(spark, at, "newest", "list").select("list_element.*").collect()
    assert sorted((r["k"] or "", r["id"] or 0) for r in newest) == [("", 0), ("", 5), *(("a", i) for i in range(2995, 3000) if i % 7)][:6]
    silent = f"{tmp_path}/silent"
    assert stateful.drain(stateful.first_seen(feeds.files(spark, path, FRAME, 100), "k", "id", ["ts", "id"], 4, tell=False), silent).count() == 0
    assert stateful.held(spark, silent, "newest", "list").count() == 6
    assert stateful.drain(stateful.first_seen(feeds.files(spark, path, FRAME, 100), "k", "id", ["ts", "id"], 0), f"{tmp_path}/none").count() == len(rows)
    told = spark.read.format("state-metadata").load(f"{at}/progress").select("operatorName").collect()
    assert {r[0] for r in told} >= {"dedupe"}  # ids are held by Spark's own deduplication


def test_seen_ids_expire(spark, tmp_path):
    path, at = f"{tmp_path}/in", f"{tmp_path}/at"
    run = lambda rows: stateful.drain(stateful.first_seen(add(spark, path, rows), "k", "id", ["ts"], 3, within_ms=3000), at).count()
    assert run([("a", 1, 1, ""), ("a", 1, 2, "")]) == 1
    time.sleep(4)
    assert run([("a", 1, 3, "")]) == 2  # forgotten, so new


def test_ids_added_while_the_stream_runs(spark, tmp_path):
    path, control, at = f"{tmp_path}/in", f"{tmp_path}/control", f"{tmp_path}/at"

    def step(rows, told):
        frames = add(spark, path, rows)
        spark.createDataFrame(told, "k string, on boolean").coalesce(1).write.mode("append").parquet(control)
        out = stateful.drain(stateful.subscribed(frames, feeds.files(spark, control, "k string, on boolean", 100), "k"), at)
        return sorted((r["k"], r["id"]) for r in out.collect())

    assert step([("a", 1, 1, ""), ("b", 1, 1, "")], [("a", True)]) == [("a", 1)]
    assert step([("a", 2, 1, ""), ("b", 2, 1, "")], [("b", True)]) == [("a", 1), ("a", 2), ("b", 2)]
    assert step([("a", 3, 1, ""), ("b", 3, 1, "")], [("a", False)]) == [("a", 1), ("a", 2), ("b", 2), ("b", 3)]


def test_statistics_after_a_restart(spark, tmp_path):
    path, at = f"{tmp_path}/in", f"{tmp_path}/at"
    rows = [(f"k{i % 5}", i, i, "") for i in range(60)]
    for part in (rows[:25], rows[25:]):
        stream = add(spark, path, part)
        totals = stream.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("s"))
        got = stateful.drain_changes(totals, ["k"], at)
    want = spark.read.parquet(path).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


class Shaky(feed.Log):
    """Breaks off after every third frame, and now and then does not answer; counts calls in a file."""

    def __init__(self, *args, calls, **more):
        super().__init__(*args, **more)
        self.calls = calls

    def end(self):
        with open(self.calls, "a") as f:
            f.write(".")
        if os.path.getsize(self.calls) % 3 == 1:
            raise OSError("closed")
        return super().end()

    def frames(self, start, end, ids):
        for k, row in enumerate(super().frames(start, end, ids)):
            if k == 3:
                raise OSError("closed")
            yield row


def keep(tmp_path, name, rows):
    with open(tmp_path / name, "w") as f:
        f.writelines(json.dumps({"id": i, "v": v}) + "\n" for i, v in rows)
    index = tmp_path / "index"
    told = json.loads(index.read_text()) if index.exists() else []
    index.write_text(json.dumps([*told, [str(tmp_path / name), len(rows)]]))


def test_a_failing_source_resumes_without_loss(spark, tmp_path):
    at, ids = f"{tmp_path}/at", tmp_path / "ids"
    ids.mkdir()
    keep(tmp_path, "one", [(k % 5, k) for k in range(40)])
    (ids / "0").write_text("1\n2")
    transport = Shaky(str(tmp_path / "index"), str(ids), calls=str(tmp_path / "calls"))
    run = lambda: sorted(json.loads(r["value"])["v"] for r in feeds.drain(feed.frames(spark, "shaky", transport, pause=0.01, frames=7), at).collect())
    assert run() == [k for k in range(40) if k % 5 in (1, 2)]
    keep(tmp_path, "two", [(k % 5, k) for k in range(40, 60)])
    (ids / "1").write_text("2\n3")  # subscribed anew: it holds for frames from now on
    assert run() == [k for k in range(40) if k % 5 in (1, 2)] + [k for k in range(40, 60) if k % 5 in (2, 3)]


def test_a_source_that_stays_away_fails(tmp_path):
    reader = feed.FeedReader(feed.Log(str(tmp_path / "nowhere")), {"pause": "0", "tries": "2"})
    with pytest.raises(OSError):
        reader.latestOffset()


def test_log_written_by_spark(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    for part in ("id < 60", "id >= 60"):
        feed.keep_log(rows.where(part), "id", f"file://{tmp_path}/frames", str(tmp_path / "index"), 3)
    log = feed.Log(str(tmp_path / "index"))
    assert log.end() == 100 and sorted(int(k) for _, k, _ in log.frames(0, 100, None)) == list(range(100))
    assert [p for p, *_ in log.frames(20, 25, None)] == list(range(20, 25))
