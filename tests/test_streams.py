"""Streams that stop and start again, bounded histories, and where tables may be kept."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import ledger, markets, strategies, weather
from marlstone.plans import scans
from marlstone.sources import schemas, scratch
from marlstone.streaming import feeds

ROWS = "k long, n long, ts timestamp"


def put(spark, path, rows):
    df = spark.createDataFrame([(k, n, None) for k, n in rows], ROWS).withColumn("ts", F.timestamp_seconds("n"))
    df.coalesce(1).write.mode("append").parquet(path)


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, [(1, 1), (2, 2)])
    stream = lambda: feeds.files(spark, source, ROWS)
    assert feeds.drain(stream(), f"{at}/rows").count() == 2
    assert {(r["k"], r["n"]) for r in feeds.drain_latest(stream(), ["k"], ["n"], f"{at}/latest").collect()} == {(1, 1), (2, 2)}
    seen = lambda: feeds.drain(feeds.first_seen(stream(), ["k"]).select("k"), f"{at}/seen").count()
    assert seen() == 2
    put(spark, source, [(2, 5), (3, 3)])
    # each started again under its path: old rows are not written twice, state is kept
    assert feeds.drain(stream(), f"{at}/rows").count() == 4
    assert {(r["k"], r["n"]) for r in feeds.drain_latest(stream(), ["k"], ["n"], f"{at}/latest").collect()} == {(1, 1), (2, 5), (3, 3)}
    assert seen() == 3
    assert {(r["k"], r["n"]) for r in feeds.snapshot(spark, f"{at}/latest", ROWS).collect()} == {(1, 1), (2, 5), (3, 3)}


def test_a_repeated_batch_gives_the_same_snapshot(spark, tmp_path):
    at = str(tmp_path)
    write = feeds.merging(schemas_of(), at, lambda old, new: old.unionByName(new))
    batch = spark.createDataFrame([(1, 1, None)], ROWS)
    write(batch, 0)
    write(batch, 1)
    write(batch, 1)
    assert feeds.snapshot(spark, at, ROWS).count() == 2


def schemas_of():
    return ROWS


def test_bounded_history(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, [(k, k) for k in range(10)])
    history = lambda: [r["k"] for r in feeds.drain_newest(feeds.files(spark, source, ROWS), ["k"], "ts", "k", at, most=4).orderBy(F.desc("n")).collect()]
    assert history() == [9, 8, 7, 6]
    put(spark, source, [(9, 99), (20, 20)])  # a key that it holds does not enter again
    assert history() == [20, 9, 8, 7]


def test_fan_out_and_intervals(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, [(1, 1)])
    running = feeds.start(feeds.files(spark, source, ROWS), feeds.fan_out([feeds.into(f"{at}/a"), feeds.into(f"{at}/b")]), at, every="1 second")
    try:
        running.processAllAvailable()
        put(spark, source, [(2, 2)])
        running.processAllAvailable()
    finally:
        running.stop()
    assert [spark.read.parquet(f"{at}/{name}").count() for name in "ab"] == [2, 2]


def test_snapshot_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert schemas.versions(spark, path) == []
    one = spark.createDataFrame([(1,)], "x long")
    assert schemas.write_snapshot(one, path) == 0 and schemas.write_snapshot(schemas.read_snapshot(spark, path, "x long").withColumn("x", F.col("x") + 1), path) == 1
    assert schemas.read_snapshot(spark, path, "x long").first()["x"] == 2
    (tmp_path / "t" / "2").mkdir()  # begun, not complete
    assert schemas.read_snapshot(spark, path, "x long").first()["x"] == 2
    assert schemas.read_snapshot(spark, path, "x long", before=1).first()["x"] == 1


class Session:
    def __init__(self, master):
        self.sparkContext = self
        self.conf = {}
        self.master = master

    def getCheckpointDir(self):
        return None


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session("spark://host:7077"))
    with pytest.raises(ValueError):
        scratch.shared_dir(Session("local-cluster[2,1,1024]"))


def test_old_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda session: str(tmp_path))
    assert scratch.table(spark.range(3), "a").count() == 3
    (tmp_path / "somebody-elses").mkdir()
    assert scratch.clear(spark) == 0 and scratch.clear(spark, -60) == 1
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["somebody-elses"]


def test_parameters():
    assert [S.parameter(x, 1.5) for x in (None, 0, "0", "", "abc", "2.5x", float("nan"), 3)] == [1.5, 1.5, 1.5, 1.5, 1.5, 2.5, 1.5, 3.0]


def test_pages_come_before_filters(spark):
    as_of = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    listed = spark.range(6).select(F.col("id").alias("ord"), F.col("id").alias("market_id"), F.lit("cpi above 5").alias("question"), F.when(F.col("id") < 3, F.lit('["0"]')).otherwise(F.lit('["0.95"]')).alias("outcome_prices"), F.lit(2000.0).alias("volume"), F.to_timestamp(F.lit("2024-01-11 00:00:00")).alias("end_date"))
    assert [strategies.economics(listed, 20, n).count() for n in (None, 4, 3)] == [3, 1, 0]
    assert [strategies.geopolitics(listed, as_of, 20, n).count() for n in (None, 4, 3)] == [3, 1, 0]
    legs = spark.range(6).select(F.lit(1).alias("group_key"), F.col("id").alias("ord"), F.lit("q").alias("question"), F.lit(0.125).alias("yes_price"))
    assert [strategies.negrisk(legs, 10, n).count() for n in (None, 3, 2)] == [1, 1, 0]
    spot = spark.createDataFrame([("BTC", 100.0), ("BTC", 100.0)], "symbol string, spot double")
    coins = listed.withColumn("question", F.lit("bitcoin above $500"))
    assert [strategies.crypto_lag(coins, spot, as_of, page=n).count() for n in (None, 4, 3)] == [3, 1, 0]


def test_slug_groups(spark):
    df = spark.createDataFrame([("a-b-c",), ("abc",), ("",), (None,), ("-x",)], "slug string")
    assert [r[0] for r in df.select(strategies.slug_group(F.col("slug"))).collect()] == ["a-b", None, None, None, None]


def test_prices_are_parsed_once(spark):
    listed = spark.createDataFrame([(1, 1, "q", '["0.95"]', 2000.0, None)], "ord long, market_id long, question string, outcome_prices string, volume double, end_date timestamp")
    for df in (strategies.geopolitics(listed, F.current_timestamp()), strategies.economics(listed), strategies.crypto_lag(listed, spark.createDataFrame([("BTC", 1.0)], "symbol string, spot double"), F.current_timestamp())):
        assert df._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


def test_stations(spark):
    names = spark.createDataFrame([("New York", "KLGA", "nyc"), ("New York", "KLGA", "l.a."), ("Rome", "R", "rome")], "city string, station_id string, alias string")
    listed = spark.createDataFrame([(1, "NYC or Rome"), (2, "lxax"), (3, None), (4, "L.A. and nyc")], "ord long, question string")
    assert sorted((r["ord"], r["station_id"]) for r in weather.match_markets(names, listed, None).collect()) == [(1, "KLGA"), (1, "R"), (4, "KLGA")]
    assert weather.match_markets(names.where("false"), listed).count() == 0


def test_changes_by_id(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, status string, pnl double")
    new = spark.createDataFrame([(2, None), (3, "x")], "id long, status string")
    assert sorted(map(tuple, markets.update(old, new, "id").collect())) == [(1, "a", 1.0), (2, None, 2.0)]
    assert markets.append(old, new).count() == 4 and markets.lookup(old, "id", 9).count() == 0
    assert [(r["place"], r["id"]) for r in markets.prepend(new, new.withColumn("id", F.lit(9)), 3, "id").collect()] == [(1, 2), (2, 3), (3, 9)]


def test_balance_with_resets(spark):
    rows = [(1, 1, -500, None), (1, 2, 100, None), (1, 3, 0, 7000), (1, 4, -50, None), (1, 5, 0, 0), (2, 6, 25, None)]
    df = spark.createDataFrame(rows, "a long, id long, change long, reset long").withColumn("ts", F.timestamp_seconds("id"))
    assert [r["balance"] for r in ledger.balance_with_resets(df, "a").orderBy("id").collect()] == [995.0, 996.0, 70.0, 69.5, 1000.0, 1000.25]


def test_stored_rows_of_flags_carry_no_market(spark):
    listed = spark.createDataFrame([(1, 77, "cpi above 5", '["0.5"]', 2000.0)], "ord long, market_id long, question string, outcome_prices string, volume double")
    row = scans.stored(scans.strategy_union({"economics": strategies.economics(listed)}), F.to_timestamp(F.lit("2024-01-10 00:00:00"))).first()
    assert row["marketId"] == "" and row["id"].startswith("economics_cpi_above_5_")
