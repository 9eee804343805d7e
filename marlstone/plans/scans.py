"""Scan plans: strategies combined into one signal table, its stored form and its summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.scalars import first_text, number_or, parameter, row_id, text_or
from marlstone.operators import ledger, markets, strategies, weather
from marlstone.sources import scratch

#: Strategy names by type, in the order in which a cycle lists them.
STRATEGIES = [("economics", "Economics / Macro"), ("geopolitics", "Geopolitics (0% fee)"), ("negrisk", "NegRisk Rebalancing"), ("crypto", "Crypto Price Lag"), ("combinatorial", "Combinatorial Arbitrage")]


def weather_signals(forecasts: DataFrame, stations: DataFrame, listed: DataFrame, book: DataFrame, min_edge: float = 1.0, most: int | None = weather.MARKETS_PER_STATION, probs: DataFrame | None = None) -> DataFrame:
    """Edges of each station's forecast over the prices of its markets, of the first ``most`` of them.

    ``probs``: (station_id, outcome, prob, spread) of several models, in place of the one
    forecast, whose spread is 0. A ``min_edge`` of 0 is the default.
    """
    min_edge = parameter(min_edge, 1.0)
    if probs is None:
        probs = weather.by_outcome(weather.probabilities(forecasts), ["station_id"]).withColumn("spread", F.lit(0.0))
    matched = markets.with_price(weather.match_markets(stations, listed, most), book).select("station_id", "city", "ord", "market_id", "question", "price")
    return weather.edges(probs, matched, min_edge)


def strategy_union(parts: dict[str, DataFrame]) -> DataFrame:
    """The strategies' rows under one schema, in the order of STRATEGIES; missing columns are null."""
    rank = {key: k for k, (key, _) in enumerate(STRATEGIES)}
    names = dict(STRATEGIES)
    tagged = [df.withColumns({"type": F.lit(key), "strategy": F.lit(names[key]), "strategy_rank": F.lit(rank[key])}) for key, df in sorted(parts.items(), key=lambda x: rank[x[0]])]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def stored(signals: DataFrame, as_of: Column) -> DataFrame:
    """Signals as rows of the stored opportunities: absent numbers are 0, absent texts empty.

    The id is made of the station or type, the market or the start of the question, and the time.
    """
    text = lambda c: column_or_null(signals, c, "string")
    number = lambda c: column_or_null(signals, c, "double")
    place, market = first_text(text("station_id"), text("type")), first_text(text("market_id"), F.substring(text("question"), 1, 20))
    return signals.select(
        row_id(place, market, F.unix_millis(as_of).cast("string")).alias("id"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), text_or(text("city"), "").alias("city"), text_or(place, "").alias("stationId"),
        text_or(first_text(text("outcome"), text("strategy")), "").alias("outcome"), F.substring(text_or(text("question"), ""), 1, 200).alias("question"), number_or(F.coalesce(number("model_prob"), number("model_aligned")), 0.0).alias("modelProb"),
        number_or(number("market_prob"), 0.0).alias("marketProb"), number_or(number("net_edge"), 0.0).alias("netEdge"), text_or(text("direction"), "").alias("direction"), text_or(text("market_id"), "").alias("marketId"), text_or(text("strategy"), "weather").alias("strategy"), F.lit(0).alias("acted"),
    )


def breakdown(signals: DataFrame) -> DataFrame:
    return signals.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def all_strategies(legs: DataFrame, listed: DataFrame, spot: DataFrame, as_of: Column, most: int | None = None) -> DataFrame:
    """One cycle's strategies; ``most`` caps the listings of each as a single scan does."""
    return strategy_union({
        "economics": strategies.economics(listed, most), "geopolitics": strategies.geopolitics(listed, as_of, most), "negrisk": strategies.negrisk(legs, most),
        "crypto": strategies.crypto_lag(listed, spot, as_of), "combinatorial": strategies.combinatorial(listed),
    })


def all_signals(legs: DataFrame, listed: DataFrame, spot: DataFrame, as_of: Column) -> DataFrame:
    """Every strategy over its whole table: (type, strategy, key, net_edge, direction), the key a market's or group's; absent numbers are 0, absent texts empty.

    In place of the first markets of a symbol and the first listed ones of a topic all are
    looked at; of the pairs of a market the best.
    """
    signals = strategy_union({
        "economics": strategies.economics(listed, None), "geopolitics": strategies.geopolitics(listed, as_of, None), "negrisk": strategies.negrisk(legs, None).withColumnRenamed("group_key", "ord"),
        "crypto": strategies.crypto_lag(listed, spot, as_of, None), "combinatorial": strategies.combinatorial_best(listed).withColumnRenamed("hi_ord", "ord"),
    })
    return signals.select("type", "strategy", F.col("ord").alias("key"), number_or(F.col("net_edge"), 0.0).alias("net_edge"), text_or(F.col("direction"), "").alias("direction"))


def listing_table(listed: DataFrame) -> DataFrame:
    """The listing as a table with its price parsed, for the several strategies that read it."""
    return scratch.table(strategies.with_listed_price(listed).drop("outcome_prices"), "listing")


def latest_composite(stations: DataFrame, multi: DataFrame, trades: DataFrame, settings: DataFrame) -> DataFrame:
    """One row of what a screen polls: stations with a result, the last of their scans, signals by type, open trades, settings.

    stations: station_id, scanned_at and others, a row for each scan; multi: type.
    """
    now = markets.latest(stations.select("station_id", "scanned_at"), ["station_id"], ["scanned_at"]).agg(F.count(F.lit(1)).alias("count"), F.max("scanned_at").alias("last_scan"))
    # a few types and keys: one row of text each
    kinds = breakdown(multi).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n"))))).alias("signals"))
    return now.crossJoin(kinds).crossJoin(ledger.overview(trades, settings))


def as_json(df: DataFrame) -> DataFrame:
    """A response body for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def cycle(signals: DataFrame, old: DataFrame, as_of: Column, balance: float, settings: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(opportunities after the cycle, trades to place), by the settings table's values."""
    after = markets.insert_or_ignore(old, stored(signals, as_of).dropDuplicates(["id"]), ["id"])
    on = lambda key: settings.get(key) == "true"
    return after, ledger.intents(signals, balance, float(settings.get("max_position") or 50), float(settings.get("min_edge") or 1.5), on("paper_enabled"), on("scan_active"))


def for_display(signals: DataFrame) -> DataFrame:
    """Signals by type in a fixed order, newest strategies' order inside; unknown types last."""
    place = {"geopolitics": 0, "negrisk": 1, "economics": 2, "crypto": 3, "weather": 4}
    rank = F.coalesce(*(F.when(F.col("type") == k, F.lit(v)) for k, v in place.items()), F.lit(len(place)))
    return signals.withColumn("display_rank", rank)
