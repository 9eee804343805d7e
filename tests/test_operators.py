"""Operators on small tables with both sides of each threshold."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.operators import ledger, markets, strategies, weather
from marlstone.plans import scans
from marlstone.sources import schemas



def now():
    return F.to_timestamp(F.lit("2024-01-10 00:00:00"))


MARKET = "ord long, market_id long, question string, outcome_prices string, volume double, end_date timestamp, token_id long"


def listed(spark, *rows):
    full = [(k, k, q, p, v, end, k) for k, (q, p, v, end) in enumerate(rows)]
    return spark.createDataFrame(full, MARKET)


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


FORECAST = dict(tmax_c=0.0, tmin_c=10.0, precip_mm=0.0, pop=0.0, snow=0.0, wind=0.0, wmo=0, humidity=0.0, unit="C")


@pytest.mark.parametrize(
    "change,column,want",
    [
        (dict(tmax_c=32.0), "hot", 0.88), (dict(tmax_c=31.9), "hot", 0.854), (dict(tmax_c=26.9), "hot", 0.04), (dict(tmax_c=60.0), "hot", 0.97), (dict(tmax_c=32.2, unit="F"), "hot", 0.88), (dict(tmax_c=32.19, unit="F"), "hot", 0.862),
        (dict(pop=80.0, precip_mm=13.0), "rain", 0.93), (dict(pop=60.0, precip_mm=6.0), "rain", 0.74), (dict(pop=10.0), "rain", 0.04), (dict(pop=11.0), "rain", 0.142), (dict(pop=500.0, precip_mm=13.0), "rain", 0.95),
        (dict(snow=10.1, tmin_c=-1.0), "snow_p", 0.92), (dict(snow=10.0, tmin_c=-1.0), "snow_p", 0.76), (dict(tmin_c=-1.0, pop=31.0), "snow_p", 0.22), (dict(), "snow_p", 0.02),
        (dict(wmo=95, humidity=60.0), "storm", 0.82), (dict(wmo=94, humidity=76.0, wind=31.0), "storm", 0.48), (dict(humidity=71.0, wind=21.0), "storm", 0.16), (dict(), "storm", 0.05),
    ],
)
def test_ladders(spark, change, column, want):
    row = FORECAST | change
    df = spark.createDataFrame([tuple(row.values())], "tmax_c double, tmin_c double, precip_mm double, pop double, snow double, wind double, wmo int, humidity double, unit string")
    assert weather.probabilities(df).first()[column] == pytest.approx(want)


def test_nested_forecast(spark):
    row = ("KLGA", ([30.0, 1.0], [None], [], [50.0], None, [9.0]), (20.0, None, 70.0, 1.0, 0.0, None))
    got = weather.flatten_forecast(spark.createDataFrame([row, ("X", None, None)], schemas.FORECAST)).collect()
    assert [tuple(r) for r in got] == [("KLGA", 30.0, 0.0, 0.0, 50.0, 0.0, 9.0, 0, 70.0)]


def test_ensemble(spark):
    df = spark.createDataFrame([("s", "hot", 0.2, 1.0), ("s", "hot", 0.4, 3.0)], "station_id string, outcome string, prob double, weight double")
    got = weather.ensemble(df, ["station_id"]).first()
    assert got["ensemble"] == pytest.approx(0.35) and got["spread"] == 10.0


def test_negrisk(spark):
    legs = [("a", k, p, f"q{k}") for k, p in enumerate([0.25, 0.25, 0.25])] + [("b", 0, 0.25, "x"), ("b", 1, 0.25, "y")] + [("c", k, p, "z") for k, p in enumerate([0.5, 0.25, None])] + [("d", k, 0.5, "w") for k in range(3)] + [(None, 0, 0.1, "n")]
    df = spark.createDataFrame(legs, "group_key string, ord long, yes_price double, question string")
    got = {r["group_key"]: r for r in strategies.negrisk(df).collect()}
    assert set(got) == {"a"} and got["a"]["net_edge"] == 24.5 and got["a"]["legs"] == "q0,q1,q2" and got["a"]["question"] == "q0"
    assert {r["group_key"]: r["net_edge"] for r in strategies.negrisk_v1(df).collect()} == {"a": 22.0, "b": 48.0, "c": 23.0}


def test_crypto(spark):
    spot = spark.createDataFrame([("BTC", 106000.0), ("ETH", 0.0)], "symbol string, spot double")
    rows = [("Will bitcoin be above $100,000?", '["0.5"]', 1.0, at(11)), ("Will btc reach below $100,000?", '["0.5"]', 1.0, at(11)), ("Will bitcoin hit $100,000?", '["0.5"]', 1.0, at(11)), ("Will bitcoin be above $100,000?", '["0.5"]', 1.0, at(13)), ("Will eth be above $1,000?", '["0.5"]', 1.0, at(11)), ("Will bitcoin be above $100,000?", '["0"]', 1.0, at(11))]
    got = strategies.crypto_lag(listed(spark, *rows), spot, now()).orderBy("ord").collect()
    assert [(r["ord"], r["model_prob"], r["net_edge"], r["direction"]) for r in got] == [(0, 0.92, 40.2, "BUY YES"), (1, 0.08, -43.8, "BUY NO")]
    old = strategies.crypto_lag_v1(listed(spark, *rows), spot, now()).collect()
    assert [(r["ord"], r["model_prob"], r["distance_pct"]) for r in old] == [(0, 0.95, 6.0), (1, 0.05, 6.0)]


def test_caps_come_before_filters(spark):
    spot = spark.createDataFrame([("BTC", 106000.0)], "symbol string, spot double")
    rows = [("bitcoin above nothing", '["0.5"]', 1.0, at(11))] * 8 + [("Will bitcoin be above $100,000?", '["0.5"]', 1.0, at(11))]
    assert strategies.crypto_lag(listed(spark, *rows), spot, now()).count() == 0
    assert strategies.crypto_lag(listed(spark, *rows), spot, now(), most=None).count() == 1


def test_per_group_caps_are_parameters(spark):
    spot = spark.createDataFrame([("BTC", 106000.0)], "symbol string, spot double")
    old = listed(spark, *[("bitcoin above nothing", '["0.5"]', 1.0, at(11))] * 5, ("Will bitcoin be above $100,000?", '["0.5"]', 1.0, at(11)))
    assert [strategies.crypto_lag_v1(old, spot, now(), most=n).count() for n in (5, 6, None)] == [0, 1, 1]
    stations = spark.createDataFrame([("Paris", "LFPO", "paris")], "city string, station_id string, alias string")
    rows = listed(spark, *[("Paris news", '["0.5"]', 1.0, None)] * 8, ("Paris rain", '["0.1"]', 1.0, None))
    forecast = spark.createDataFrame([("LFPO", 20.0, 10.0, 20.0, 90.0, 0.0, 0.0, 0, 0.0, "C")], "station_id string, tmax_c double, tmin_c double, precip_mm double, pop double, snow double, wind double, wmo int, humidity double, unit string")
    book = spark.createDataFrame([], "token_id long, price double")
    assert [[r["market_id"] for r in scans.weather_signals(forecast, stations, rows, book, most=n).collect()] for n in (8, 9, None)] == [[], [8], [8]]


def test_combinatorial(spark):
    rows = [("bitcoin above 100", '["0.5"]', 2000.0, None), ("bitcoin above 200", '["0.6"]', 2000.0, None), ("bitcoin above 300", '["0.62"]', 2000.0, None), ("bitcoin below 400", '["0.9"]', 2000.0, None), ("cpi above 500", '["0.9"]', 2000.0, None), ("bitcoin above 600", '["0.9"]', 10.0, None)]
    got = strategies.combinatorial(listed(spark, *rows)).collect()
    assert {(r["hi_ord"], r["lo_ord"]) for r in got} == {(1, 0), (2, 0)}


def test_combinatorial_beyond_the_listing_limit(spark):
    rng = random.Random(3)
    rows = [(f"{rng.choice(['bitcoin', 'cpi', 'bitcoin cpi'])} above {rng.randrange(1, 90)}", f'["{rng.randrange(0, 30) / 30}"]', 2000.0, None) for _ in range(700)]
    df = listed(spark, *rows)
    assert strategies.combinatorial(df, most=7).agg(F.max("hi_ord")).first()[0] < 7  # the limit stays a parameter
    want = {}
    for r in strategies.combinatorial(df, most=None).collect():
        n, best = want.get((r["topic"], r["hi_ord"]), (0, (9, 0)))
        want[r["topic"], r["hi_ord"]] = n + 1, min(best, (r["lo_price"], r["lo_ord"]))
    got = {(r["topic"], r["hi_ord"]): (r["violations"], (r["lo_price"], r["lo_ord"])) for r in strategies.combinatorial_best(df).collect()}
    assert got == want and max(o for _, o in got) >= 300
    assert strategies.combinatorial_best(df.where("false")).count() == 0


def test_flags(spark):
    eco = listed(spark, ("CPI", '["0.4"]', 500.0, None), ("CPI", '["0.4"]', 501.0, None), ("CPI", '["0.4"]', 50000.0, None), ("CPI", '["0"]', 600.0, None), ("other", '["0.4"]', 600.0, None))
    assert [r["ord"] for r in strategies.economics(eco).collect()] == [1]
    geo = listed(spark, ("g", '["0.9"]', 1001.0, at(12)), ("g", '["0.88"]', 1001.0, at(12)), ("g", '["0.1"]', 1001.0, at(12)), ("g", '["0.9"]', 1001.0, at(17)), ("g", '["0.9"]', 1001.0, at(10)), ("g", '["0.9"]', 1000.0, at(12)), ("g", '["0.9"]', 2000.0, None))
    assert [(r["ord"], r["direction"], r["net_edge"]) for r in strategies.geopolitics(geo, now()).collect()] == [(0, "BUY YES", 10.0), (2, "BUY NO", 10.0)]


def test_union_first_and_prices(spark):
    a = spark.createDataFrame([(0, "k1", "a"), (1, None, "b"), (2, "k1", "c")], "ord long, key string, q string")
    b = spark.createDataFrame([(0, "k2", "d"), (1, "k1", "e"), (2, "", "f")], "ord long, key string, q string")
    got = markets.union_first([a, b], markets.market_key("key")).orderBy("src", "ord").collect()
    assert [(r["src"], r["q"]) for r in got] == [(0, "a"), (1, "d")]
    book = spark.createDataFrame([(0, 0.0)], "token_id long, price double")
    rows = markets.with_price(listed(spark, ("q", '["0.3"]', 1.0, None), ("q", '["0.4"]', 1.0, None), ("q", "bad", 1.0, None)), book).orderBy("ord").collect()
    assert [(r["price"], r["price_source"]) for r in rows] == [(0.0, "book"), (0.4, "listing"), (None, None)]


def test_envelopes(spark):
    bodies = spark.createDataFrame([('[{"id":"1","question":"a"}]',), ('{"data":[{"id":"2"}]}',), ('{"markets":[{"id":"3"},{"id":"4"}]}',), ("{}",), ("broken",), (None,)], "value string")
    assert sorted(r["id"] for r in schemas.listings(bodies).collect()) == ["1", "2", "3", "4"]


def test_weather_edges_use_the_first_market(spark):
    stations = spark.createDataFrame([("Paris", "LFPO", "paris"), ("Paris", "LFPO", "lfpo")], "city string, station_id string, alias string")
    rows = listed(spark, ("Snow in Rome", '["0.1"]', 1.0, None), ("Will PARIS (lfpo) temperature be 14 or below?", '["0.2"]', 1.0, None), ("Paris temp", '["0.9"]', 1.0, None), ("Paris rain", "bad", 1.0, None), ("Paris rain", '["0.9"]', 1.0, None))
    forecast = spark.createDataFrame([("LFPO", 0.3, 0.3, 0.3, 0.3)], "station_id string, hot double, rain double, snow_p double, storm double")
    probs = weather.by_outcome(forecast, ["station_id"]).withColumn("spread", F.lit(0.0))
    priced = markets.with_price(weather.match_markets(stations, rows), spark.createDataFrame([], "token_id long, price double"))
    got = weather.edges(probs, priced).collect()
    assert [(r["outcome"], r["market_id"], r["model_aligned"], r["net_edge"], r["yes_direction"]) for r in got] == [("hot", 1, 0.7, 48.75, "inverted")]


def trades(spark, *rows):
    return spark.createDataFrame([(k, at(1 + k), *r) for k, r in enumerate(rows)], "id long, ts timestamp, size double, price double, direction string, resolved_yes boolean, is_open boolean")


def test_ledger(spark):
    done = ledger.resolve(trades(spark, (10.0, 0.5, "BUY YES", True, False), (10.0, 0.25, "BUY NO", False, False), (5.0, 0.5, "BUY YES", False, False), (5.0, 0.0, "BUY YES", True, False), (7.0, 0.5, "BUY YES", True, True)))
    assert [(r["status"], r["pnl"]) for r in done.orderBy("id").collect()] == [("won", 10.0), ("won", 30.0), ("lost", -5.0), ("won", None), ("open", None)]
    side = ledger.resolve(trades(spark, (9.0, 0.25, "BUY NO", False, False)), "side").first()
    assert side["pnl"] == 3.0 and side["shares"] == 12.0
    few = done.where("id <> 3")
    got = ledger.statistics(few).first()
    assert (got["total_trades"], got["open_trades"], got["won_trades"], got["win_rate"], got["total_pnl"], got["roi_ref"], got["roi_on_initial"]) == (4, 1, 2, 66.7, 35.0, 100.0, 3.5)
    days = [r["balance"] for r in ledger.daily_balance(few).orderBy("day").collect()]
    assert days == [1010.0, 1040.0, 1035.0, 1028.0]
    running = [r["balance"] for r in ledger.running_balance(few.withColumn("account", F.lit(1)), "account").orderBy("id").collect()]
    assert running == days
    empty = ledger.statistics(done.where("false")).first()
    assert (empty["total_trades"], empty["win_rate"], empty["roi_ref"], empty["total_pnl"]) == (0, 0.0, 0.0, 0.0)


def test_place_is_a_fold(spark):
    orders = spark.createDataFrame([("a", 1, 1, 600.0), ("a", 2, 2, 600.0), ("a", 3, 3, 5.0), ("b", 1, 4, None), ("b", 2, 5, 0.4)], "account string, seq long, id long, size double")
    got = {r["id"]: (r["size"], r["accepted"], r["balance"]) for r in ledger.place(orders, "account").collect()}
    assert got == {1: (600.0, True, 400.0), 2: (400.0, True, 0.0), 3: (None, False, 0.0), 4: (10.0, True, 990.0), 5: (None, False, 990.0)}


def test_place_streams_a_large_account(spark):
    n = 100_000
    size = F.when(F.col("id") % 3 == 0, 0.4).otherwise(F.pmod(F.col("id") * 7919, F.lit(1000)) / 70)
    orders = spark.range(n, numPartitions=8).select(F.when(F.col("id") % 10 == 0, F.lit("b")).when(F.col("id") % 10 == 1, None).otherwise(F.lit("a")).alias("account"), (n - F.col("id")).alias("seq"), "id", size.alias("size"))
    placed = ledger.place(orders, "account", start=200_000.0)
    assert "collect_list" not in placed._jdf.queryExecution().toString()  # no account is one row
    want, balance = {}, {}
    for r in sorted(orders.collect(), key=lambda r: r["seq"]):
        left = balance.get(r["account"], 200_000.0)
        size = min(r["size"] or 10.0, left)
        fine = size >= 0.5
        if fine:
            balance[r["account"]] = left = math.floor((left - size) * 100 + 0.5) / 100
        want[r["id"]] = (r["account"], size if fine else None, fine, left)
    assert {r["id"]: (r["account"], r["size"], r["accepted"], r["balance"]) for r in placed.collect()} == want


def test_intents(spark):
    rows = spark.createDataFrame([(k, m, "BUY YES", 0.0 if k == 2 else 0.3, e) for k, (m, e) in enumerate([(1, 1.9), (None, 9.0), (3, -2.0), (4, 5.0), (5, 5.0), (6, 5.0)])], "ord long, market_id long, direction string, market_prob double, net_edge double")
    got = ledger.intents(rows, 1000.0).orderBy("ord").collect()
    assert [(r["ord"], r["price"], r["size"]) for r in got] == [(2, 0.5, 20.0), (3, 0.3, 20.0), (4, 0.3, 20.0)]
    assert ledger.intents(rows, 10.0).count() == 0 and ledger.intents(rows, 1000.0, enabled=False).count() == 0


def test_tables(spark):
    settings = schemas.default_settings(spark)
    new = spark.createDataFrame([("min_edge", "3")], schemas.SETTINGS)
    assert dict(markets.upsert(settings, new, ["key"]).collect())["min_edge"] == "3"
    assert dict(markets.insert_or_ignore(settings, new, ["key"]).collect())["min_edge"] == "1.5"
    batch = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "k long, v string")
    assert markets.unseen(batch, batch.where("k = 1"), ["k"]).count() == 2
    assert [r["v"] for r in markets.latest(batch, ["k"], ["v"]).orderBy("k").collect()] == ["x", "y"]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert schemas.read_snapshot(spark, path, schemas.SETTINGS).count() == 0
    schemas.write_snapshot(schemas.default_settings(spark), path)
    assert schemas.read_snapshot(spark, path, schemas.SETTINGS).count() == 6


def test_stored_defaults(spark):
    signals = scans.strategy_union({"negrisk": spark.createDataFrame([("q" * 300, 2.0)], "question string, net_edge double"), "economics": spark.createDataFrame([("e", 7)], "question string, market_id long")})
    got = {r["stationId"]: r for r in scans.stored(signals, now()).collect()}
    assert len(got["negrisk"]["question"]) == 200 and got["negrisk"]["modelProb"] == 0.0 and got["negrisk"]["marketId"] == ""
    assert got["economics"]["netEdge"] == 0.0 and got["economics"]["id"] == "economics_7_1704844800000" and got["economics"]["outcome"] == "Economics / Macro"
    after, _ = scans.cycle(signals.withColumns({"direction": F.lit(""), "market_prob": F.lit(0.0), "ord": F.lit(0)}), spark.createDataFrame([], schemas.OPPORTUNITIES), now(), 1000.0, dict(schemas.default_settings(spark).collect()))
    assert after.count() == 2
