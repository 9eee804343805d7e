"""Keyed tables that merge on read, names in texts, orders in cents."""

import os
import random
import string

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.operators import ledger, markets, names, strategies, weather
from marlstone.plans import catalog, cycles
from marlstone.sources import manifests, merged
from marlstone.streaming import feeds

ROW = "k long, s string, v double"


def files(at):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{at}/data") for f in fs if f.endswith(".parquet")}


def test_a_change_of_one_key_writes_one_bucket(spark, tmp_path):
    held = spark.createDataFrame([(k, f"s{k}", float(k)) for k in range(200)] + [(None, "none", 0.0)], ROW)
    table = merged.Table(spark, str(tmp_path), held.schema, ["k"], buckets=8, most_deltas=3)
    assert table.read().count() == 0
    table.upsert(held)
    want = {r["k"]: r["v"] for r in held.collect()}
    for step in range(6):
        before = files(tmp_path)
        table.upsert(spark.createDataFrame([(7, "x", 100.0 + step)], ROW))
        want[7] = 100.0 + step
        new = files(tmp_path) - before
        assert before <= files(tmp_path) and len({f.split("bucket=")[1].split("/")[0] for f in new}) == 1 and len(new) <= 2
        assert {r["k"]: r["v"] for r in table.read().collect()} == want
    assert max(map(len, table.manifest().values())) <= 3  # deltas are put together
    table.delete(spark.createDataFrame([(7,), (None,), (9999,)], "k long"))
    assert table.read().count() == 199 and table.read(table.versions()[0]).count() == 201


def test_old_versions_go_and_a_version_is_taken_once(spark, tmp_path):
    held = spark.createDataFrame([(k, "s", float(k)) for k in range(50)], ROW)
    table = merged.Table(spark, str(tmp_path), held.schema, ["k"], buckets=4, most_deltas=1)
    for step in range(5):
        table.upsert(held.withColumn("v", F.lit(float(step))))
    size = len(files(tmp_path))
    assert table.vacuum(keep=1) > 0 and len(files(tmp_path)) < size and table.versions() == [4]
    assert {r["v"] for r in table.read().collect()} == {4.0}
    with pytest.raises(manifests.Conflict):
        table.manifests.commit(4, {})
    assert {r["v"] for r in table.read().collect()} == {4.0}
    # a change that was not committed is not seen, and the next one takes its place
    table.write(held.withColumns({"v": F.lit(-1.0), "__version": F.lit(5).cast("long"), "__gone": F.lit(False), "bucket": table.bucket()}), 5)
    assert {r["v"] for r in table.read().collect()} == {4.0}
    table.upsert(held.where("k = 1").withColumn("v", F.lit(5.0)))
    assert sorted({r["v"] for r in table.read().collect()}) == [4.0, 5.0]


def test_names_in_texts(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [(k, word(rng.randint(0, 30))) for k in range(120)] + [(200, None), (201, "")]
    wanted = [(word(rng.choice([1, 2, 3, 4, 5, 8])),) for _ in range(60)] + [("",), (None,), ("zzzz",)]
    got = names.containing(spark.createDataFrame(texts, "id long, t string"), "t", spark.createDataFrame(wanted, "n string"), "n").select("id", "n").collect()
    want = [(i, n) for i, t in texts for (n,) in wanted if n and t is not None and n in t]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 500
    assert names.containing(spark.createDataFrame(texts, "id long, t string"), "t", spark.createDataFrame([], "n string"), "n").count() == 0


def test_names_of_many_lengths(spark):
    """Texts twice over, names with a copy, pieces that repeat in a text; whole names and pieces of them give the same."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab\u00e9\U0001f600") for _ in range(n))
    texts = [(k % 70, t) for k, t in enumerate([word(rng.randint(0, 40)) for _ in range(70)] * 2)] + [(99, "")]
    wanted = [(word(n), k) for n in range(1, 13) for k in range(6)] + [("ab", 50), ("ab", 51), ("abab", 52)]
    left, right = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(wanted, "n string, m long")
    want = sorted((i, t, n, m) for i, t in texts for n, m in wanted if n in t)
    for most in (names.LENGTHS, 99):
        assert sorted(map(tuple, names.containing(left, "t", right, "n", most_lengths=most).collect())) == want and len(want) > 500


def test_few_pieces_of_texts_reach_the_join(spark):
    texts = spark.range(500).select("id", F.concat(F.lit("Will it be above $"), (F.col("id") * 977).cast("string"), F.lit("?")).alias("t"))
    wanted = spark.range(100).select(F.concat(F.lit("$"), (F.col("id") * 977 * 5).cast("string")).alias("__piece"))
    assert names.text_pieces(texts, "t", wanted).count() < 500  # of more than 25,000


def test_a_hundred_thousand_names(spark):
    key = lambda k: "".join(string.ascii_lowercase[k // 26**p % 26] for p in range(5))
    stations = spark.range(100_000).select(F.concat(F.lit("station "), F.col("id").cast("string")).alias("city"), F.col("id").cast("string").alias("station_id"), F.concat(F.lit("town"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("alias"))
    listed = spark.createDataFrame([(k, f"Rain in Town{k * 37:06d} or town{k:06d} by {key(k)}?") for k in range(300)], "ord long, question string")
    got = weather.match_markets(stations, listed, None).select("ord", F.col("station_id").cast("long")).collect()
    assert sorted(map(tuple, got)) == sorted({(k, x) for k in range(300) for x in (k * 37, k)})
    assert weather.match_markets(stations, listed, 1).groupBy("station_id").count().where("count > 1").count() == 0


def fold(orders, start=100_000, least=50):
    balance, out = {}, []
    for account, _, id_, size in sorted(orders, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])):
        have = balance.get(account, start)
        take = min(size, have)
        fine = take >= least
        balance[account] = have - take if fine else have
        out.append((account, id_, take / 100 if fine else None, fine, balance[account] / 100))
    return sorted(out, key=repr)


def test_orders_in_cents(spark):
    rng = random.Random(8)
    orders = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randint(0, 40), k, rng.choice([10, 49, 50, 51, 900, 3000, 20_000, 99_950])) for k in range(300)]
    df = spark.createDataFrame([(a, s, i, c / 100) for a, s, i, c in orders], "account long, seq long, id long, size double")
    assert sorted(map(tuple, ledger.place_cents(df.repartition(7), "account").collect()), key=repr) == fold(orders)


def test_one_account_is_many_tasks(spark):
    """A third of all orders are one account's."""
    orders = [(0 if k % 3 == 0 else k, k, k, 1 + k % 90) for k in range(3000)]
    df = spark.createDataFrame([(a, s, i, c / 100) for a, s, i, c in orders], "account long, seq long, id long, size double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would be one range
    try:
        assert sorted(map(tuple, ledger.place_cents(df, "account").collect()), key=repr) == fold(orders)
        assert df.repartitionByRange("account", "seq", "id").withColumn("p", F.spark_partition_id()).where("account = 0").select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_orders_of_no_size_as_in_sql(spark, tmp_path):
    """A size of 0 is refused, a missing one takes all that is left."""
    sizes = {1: [20.0, 0.0, 30.0, 0.0], 2: [5.0, None, 7.0, None, 0.0], 3: [0.0], 4: [None, 1.0], 5: [1999.2, 0.0, 1.0, None, 3.0]}
    rows = [(100 * u + k, u, float(v) if v is not None else None) for u, vs in sizes.items() for k, v in enumerate(vs)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double").selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "user_id", "'purchase' AS event_type", "value", "'{\"k\": 1}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.SQL["ledger_place_cents"]).fetchall()
    got = catalog.ledger_place_cents(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) == len(rows)


def test_basket_without_a_question_is_named_by_its_key(spark):
    legs = spark.createDataFrame([("g", k, 0.2, q) for k, q in enumerate([None, "b", "c"])] + [("h", k, 0.2, "") for k in range(3)], "group_key string, ord long, yes_price double, question string")
    assert {(r["group_key"], r["question"]) for r in strategies.negrisk(legs).collect()} == {("g", "g"), ("h", "h")}


def test_unseen_of_a_huge_history(spark):
    rng = random.Random(5)
    new = [(rng.choice([None, *range(50)]), rng.choice("ab"), k) for k in range(300)]
    old = [(rng.choice([None, *range(25, 2000)]), rng.choice("ab"), k) for k in range(3000)]
    batch, seen = (spark.createDataFrame(x, "k long, s string, n long") for x in (new, old))
    got = sorted(map(tuple, markets.unseen_of_many(batch, seen, ["k", "s"]).collect()), key=repr)
    assert got == sorted(map(tuple, markets.unseen(batch, seen, ["k", "s"]).collect()), key=repr) and 0 < len(got) < 300
    hits = markets.possible(seen, markets.key_bits(batch, ["k", "s"], 1 << 15), ["k", "s"], 1 << 15)
    assert hits.count() < 200  # few but the seen keys of the batch go on
    assert markets.unseen_of_many(batch.where("false"), seen, ["k"]).count() == 0
    assert markets.unseen_of_many(batch, seen.where("false"), ["k"]).count() == 300


SIGNAL = "ord long, type string, strategy string, market_id long, question string, direction string, market_prob double, net_edge double"


def signals(spark, first, n=5):
    return spark.createDataFrame([(k, "crypto", "Crypto", k, f"q{k}", "BUY YES", 0.4, 3.0) for k in range(first, first + n)], SIGNAL)


def test_cycles_commit_whole(spark, tmp_path):
    store, as_of = cycles.Store(spark, str(tmp_path)), F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    assert cycles.run(store, 0, signals(spark, 0), as_of)
    assert store.settings()["paper_balance"] == "940.0" and store.read("trades").count() == 3
    state = lambda: [sorted(map(tuple, store.read(n).collect()), key=repr) for n in cycles.TABLES]
    before = state()
    assert not cycles.run(store, 0, signals(spark, 0), as_of) and state() == before  # run again: nothing changes
    # a batch that fails before its manifest leaves nothing that readers see
    signals(spark, 3).write.parquet(f"{tmp_path}/trades/1")
    assert state() == before
    assert cycles.run(store, 1, signals(spark, 3), as_of)
    assert [r["size"] for r in store.read("trades").where("batch = 1").collect()] == [18.8] * 3
    assert store.settings()["paper_balance"] == "883.6" and store.read("opportunities").count() == 8  # 3 and 4 were stored before
    assert store.settings(1)["paper_balance"] == "940.0"


def test_a_cycle_scans_once(spark, tmp_path):
    store, as_of, scanned = cycles.Store(spark, str(tmp_path)), F.to_timestamp(F.lit("2024-01-10 00:00:00")), spark.sparkContext.accumulator(0)

    def told(x):
        scanned.add(1)
        return x

    scan = signals(spark, 0, 40).withColumn("market_prob", F.udf(told, "double").asNondeterministic()("market_prob"))
    assert cycles.run(store, 0, scan, as_of) and scanned.value == 40
    assert store.read("opportunities").count() == 40 and store.read("trades").count() == 3


def test_a_cycle_in_a_stream(spark, tmp_path):
    """Batches of a stream as cycles; started anew after a stop it goes on, and a batch handed over twice counts once."""
    store, as_of = cycles.Store(spark, f"{tmp_path}/store"), F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    for k in range(2):
        signals(spark, 10 * k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

        def write(batch, epoch):
            cycles.run(store, epoch, batch, as_of)
            cycles.run(store, epoch, batch, as_of)

        feeds.start(feeds.files(spark, f"{tmp_path}/in", SIGNAL), write, f"{tmp_path}/at").awaitTermination()
    assert store.commits.numbers() == [0, 1] and store.read("opportunities").count() == 10 and store.read("trades").count() == 6
