"""Forecasts to outcome probabilities, ensembles and edges over market prices."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import text as T
from marlstone.functions import vocabulary as V
from marlstone.functions.scalars import clamp, number_or, once, round_half_away, to_fahrenheit
from marlstone.operators.names import containing

FEE = 1.25
MOST_SPREAD = 15
MARKETS_PER_STATION = 8
MOST_ALIASES = 1000
MM_TO_INCH = 0.03937


def ladder(steps: list[tuple[Column, Column | float]], otherwise: float) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(float(otherwise))
    for condition, value in reversed(steps):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(float(value))).otherwise(out)
    return out


def flatten_forecast(forecast: DataFrame) -> DataFrame:
    """One row per station of the nested forecast: today's values, missing ones 0."""
    today = lambda name: number_or(F.get(F.col(f"daily.{name}"), F.lit(0)), 0.0)
    now = lambda name: number_or(F.col(f"current.{name}").cast("double"), 0.0)
    return forecast.where("current.temperature_2m is not null").select(
        "stationId", today("temperature_2m_max").alias("tmax_c"), today("temperature_2m_min").alias("tmin_c"), today("precipitation_sum").alias("precip_mm"), today("precipitation_probability_max").alias("pop"),
        today("snowfall_sum").alias("snow"), today("wind_speed_10m_max").alias("wind"), now("weather_code").cast("int").alias("wmo"), now("relative_humidity_2m").alias("humidity"),
    )


def probabilities(forecasts: DataFrame) -> DataFrame:
    """Add ``hot, rain, snow_p, storm`` to rows of tmax_c, tmin_c, precip_mm, pop, snow, wind, wmo, humidity and unit."""
    f, c, p = to_fahrenheit(F.col("tmax_c")), F.col("tmax_c"), clamp(F.col("pop") / 100, 0, 1)
    inch, low, snow, wind, code, wet = F.col("precip_mm") * MM_TO_INCH, F.col("tmin_c"), F.col("snow"), F.col("wind"), F.col("wmo"), F.col("humidity")
    hot_f = ladder([(f >= 90, 0.88 + (f - 90) * 0.015), (f >= 86, 0.55 + (f - 86) * 0.08), (f >= 80, 0.20 + (f - 80) * 0.06)], 0.04)
    hot_c = ladder([(c >= 32, 0.88 + (c - 32) * 0.02), (c >= 30, 0.55 + (c - 30) * 0.16), (c >= 27, 0.20 + (c - 27) * 0.11)], 0.04)
    rain = ladder([((p > 0.7) & (inch > 0.5), 0.85 + p * 0.10), ((p > 0.5) & (inch > 0.2), 0.65 + p * 0.15), ((p > 0.3) & (inch > 0.05), 0.38 + p * 0.22), (p > 0.1, 0.12 + p * 0.20)], 0.04)
    snowy = ladder([((snow > 10) & (low < 0), 0.92), ((snow > 5) & (low < 2), 0.76), ((snow > 1) & (low < 4), 0.55), ((snow > 0) & (low < 6), 0.34), ((low < 0) & (p > 0.3), 0.22)], 0.02)
    storm = ladder([(code >= 95, 0.82 + (wet - 60) * 0.003), ((code >= 80) & (wet > 75) & (wind > 30), 0.48), ((wet > 80) & (wind > 25) & (p > 0.5), 0.32), ((wet > 70) & (wind > 20), 0.16)], 0.05)
    return forecasts.withColumns({"hot": F.when(F.col("unit") == "F", clamp(hot_f, 0.02, 0.97)).otherwise(clamp(hot_c, 0.02, 0.97)), "rain": clamp(rain, 0.03, 0.96), "snow_p": clamp(snowy, 0.01, 0.97), "storm": clamp(storm, 0.02, 0.95)})


def by_outcome(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row (outcome, prob) for each outcome of each row."""
    return rows.select(*keep, F.expr("stack(4, 'hot', hot, 'rain', rain, 'snow', snow_p, 'storm', storm) as (outcome, prob)"))


def ensemble(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of ``prob`` over models, and the spread: unweighted population deviation in points."""
    spread = round_half_away(F.stddev_pop("prob") * 100, 1)
    return rows.groupBy(*keys, "outcome").agg((F.sum(F.col("prob") * F.col("weight")) / F.sum("weight")).alias("ensemble"), spread.alias("spread"))


def match_markets(stations: DataFrame, markets: DataFrame, most: int | None = MARKETS_PER_STATION) -> DataFrame:
    """The first markets in order whose question names the station, all with None; ``stations``: city, station_id, alias rows.

    Up to MOST_ALIASES names become one condition each, and every market is looked at once, in
    generated code; more are found by a join on their rarest pieces (see ``names``). The
    names are lower case.
    """
    rows = stations.select("city", "station_id", "alias").limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        lowered = markets.withColumn("__low", F.lower("question"))
        found = containing(lowered, "__low", stations.select("city", "station_id", F.col("alias").alias("__alias")), "__alias")
        return first_of_station(found.drop("__low", "__alias").dropDuplicates(["ord", "station_id"]), most)
    names: dict[tuple, list[str]] = {}
    for r in rows:
        names.setdefault((r["city"], r["station_id"]), []).append(r["alias"])
    if not names:
        return markets.withColumns({"city": F.lit(None).cast("string"), "station_id": F.lit(None).cast("string")}).where("false")
    low, any_of = F.col("__low"), lambda words: "|".join(re.escape(w) for w in words)
    found = [F.when(low.rlike(any_of(words)), F.struct(F.lit(city).alias("city"), F.lit(station).alias("station_id"))) for (city, station), words in names.items()]
    some = once(markets, "__low", F.lower("question")).where(low.rlike(any_of(sum(names.values(), []))))
    named = some.withColumn("s", F.explode(F.array_compact(F.array(*found)))).select("*", "s.city", "s.station_id").drop("s", "__low")
    return first_of_station(named, most)


def first_of_station(named: DataFrame, most: int | None) -> DataFrame:
    if most is None:
        return named
    place = F.row_number().over(Window.partitionBy("station_id").orderBy("ord"))
    return named.withColumn("place", place).where(F.col("place") <= most).drop("place")


def edges(probs: DataFrame, matched: DataFrame, min_edge: float = 1.0, fee: float = FEE) -> DataFrame:
    """Opportunities: each outcome against the station's first market about it.

    probs: station_id, outcome, prob, spread. matched: station_id, ord, market_id, question,
    price. The first market counts even without a price; then there is no opportunity.
    """
    about = F.lit(False)
    for key, *_ in V.OUTCOMES:
        about = about | ((F.col("outcome") == key) & T.outcome_matches(F.col("question"), key))
    pairs = probs.join(matched, "station_id").where(about)
    first = pairs.groupBy("station_id", "outcome").agg(F.min_by(F.struct("prob", "spread", "market_id", "question", "price", "city"), "ord").alias("m")).select("station_id", "outcome", "m.*").where("price is not null")
    way = T.yes_orientation(F.col("question"), F.col("outcome"))
    aligned = F.when(F.col("way") == "inverted", 1 - F.col("prob")).otherwise(F.col("prob"))
    raw = (F.col("aligned") - F.col("price")) * 100
    scored = first.withColumn("way", way).withColumn("aligned", aligned).withColumn("raw", raw).withColumn("net", F.col("raw") - fee)
    kept = scored.where((F.abs("net") > min_edge) & (F.col("spread") < MOST_SPREAD))
    return kept.select(
        "city", "station_id", "outcome", round_half_away(F.col("prob"), 3).alias("model_prob"), round_half_away(F.col("aligned"), 3).alias("model_aligned"), round_half_away(F.col("price"), 3).alias("market_prob"),
        round_half_away(F.col("raw"), 2).alias("raw_edge"), round_half_away(F.col("net"), 2).alias("net_edge"), F.when(F.col("net") > 0, F.lit("BUY YES")).otherwise(F.lit("BUY NO")).alias("direction"),
        F.col("way").alias("yes_direction"), "market_id", "question",
    )
