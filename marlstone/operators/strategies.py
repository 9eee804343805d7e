"""Scans that turn market listings into signals.

Every scan is a function of DataFrames and plain parameters. Rows arrive in the order of
``ord``; caps take the first rows in that order and are off with None. ``page`` caps what
is looked at, as a listing of that many rows does, ``most`` what is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import text as T
from marlstone.functions import vocabulary as V
from marlstone.functions.scalars import first_price, first_text, hours_until, once, parameter, round_half_away
from marlstone.operators import dominance
from marlstone.operators.weather import ladder
from marlstone.sources import scratch


def capped(df: DataFrame, most: int | None, *order: str) -> DataFrame:
    return df if most is None else df.orderBy(*order).limit(most)


def with_listed_price(markets: DataFrame) -> DataFrame:
    """Add ``price``, the listing's own, parsed once; a listing that has it already stays as it is."""
    return markets if "price" in markets.columns else once(markets, "price", first_price(F.col("outcome_prices")))


def baskets(legs: DataFrame, min_legs: int, buffer: float, fee_per_leg: float, min_edge: float, most: int | None) -> DataFrame:
    """Groups whose YES prices sum to less than 1: (group_key, question, outcomes, total_cost, raw_edge, net_edge, legs).

    legs: group_key, ord, yes_price, question. Legs without a price count for the group's
    size, not for its cost. Sums are exact in any order where prices are binary fractions. A
    first leg without a question is named by the group's key.
    """
    valid = F.col("yes_price").isNotNull() & ~F.isnan("yes_price")
    leg = F.when(valid, F.struct("ord", "question", "yes_price"))
    groups = legs.where("group_key is not null").groupBy("group_key").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(valid).alias("outcomes"), F.sum(F.when(valid, F.col("yes_price"))).alias("total"),
        F.min_by("question", "ord").alias("question"), F.min("ord").alias("first"), F.array_sort(F.collect_list(leg)).alias("legs"),
    )
    raw = (1 - F.col("total")) * 100
    net = raw - F.lit(buffer) - F.col("outcomes") * F.lit(fee_per_leg)
    kept = groups.where((F.col("size") >= min_legs) & (F.col("outcomes") >= min_legs)).withColumns({"raw": raw, "net": net}).where(F.col("net") > min_edge)
    return capped(kept, most, "first").select(
        "group_key", F.substring(first_text(F.col("question"), F.col("group_key").cast("string")), 1, 80).alias("question"), "outcomes", round_half_away(F.col("total"), 4).alias("total_cost"), F.lit(1.0).alias("payout"), round_half_away(F.col("raw"), 2).alias("raw_edge"),
        round_half_away(F.col("net"), 2).alias("net_edge"), F.lit("BUY ALL YES").alias("direction"), F.array_join(F.transform("legs", lambda x: x["question"]), ",").alias("legs"),
    )


def negrisk(legs: DataFrame, most: int | None = 10, page: int | None = None) -> DataFrame:
    """Three legs or more, half a point of slippage."""
    return baskets(capped(legs, page, "ord"), 3, 0.5, 0.0, 0.5, most)


def negrisk_v1(legs: DataFrame, min_edge: float = 0.5, most: int | None = None, page: int | None = None) -> DataFrame:
    """Two legs or more, a point of fee for each leg. A ``min_edge`` of 0 is the default."""
    return baskets(capped(legs, page, "ord"), 2, 0.0, 1.0, parameter(min_edge, 0.5), most)


def slug_group(slug: Column) -> Column:
    """The group that a market's slug names: all but its last part; null without one."""
    return F.nullif(F.regexp_extract(slug, "^(.*)-[^-]*$", 1), F.lit(""))


def symbol_markets(markets: DataFrame, spot: DataFrame, symbols: list, relations: list[str], most: int | None) -> DataFrame:
    """Markets that name a symbol and a relation, with its spot price; the first ``most`` of each symbol."""
    # one pass over the markets: each comes with the symbols that it names
    found = F.filter(F.array(*(F.when(T.contains_any(F.col("question"), words), F.lit(s)) for s, words in symbols)), lambda s: s.isNotNull())
    named = markets.where(T.contains_any(F.col("question"), relations)).withColumn("symbol", F.explode(found))
    if most is not None:
        named = named.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy("ord"))).where(F.col("__n") <= most).drop("__n")
    wanted = spot.where(F.col("symbol").isin([s for s, _ in symbols]) & (F.col("spot") != 0))
    return named.join(F.broadcast(wanted.groupBy("symbol").agg(F.max("spot").alias("spot"))), "symbol")  # a row for each symbol of the list


def step_confidence(way: Column, d: Column) -> Column:
    """Probability of YES by the distance of spot from the threshold, as a fraction of it."""
    steps = (0.92, 0.80, 0.65, 0.35, 0.20)
    above = ladder(list(zip([d > 0.05, d > 0.02, d > 0, d > -0.02, d > -0.05], steps, strict=True)), 0.08)
    below = ladder(list(zip([d < -0.05, d < -0.02, d < 0, d < 0.02, d < 0.05], steps, strict=True)), 0.08)
    return F.when(way == "above", above).otherwise(below)


def crypto_steps(markets: DataFrame, spot: DataFrame, most: int | None) -> DataFrame:
    """Candidates with ``threshold, way, distance, model`` of markets that have a large number and a direction."""
    rows = symbol_markets(markets, spot, V.SYMBOLS, V.RELATION_WORDS, most).withColumn("way", T.direction(F.col("question"))).where("way is not null")
    rows = with_listed_price(once(rows, "threshold", T.last_large_number(F.col("question")))).where("threshold is not null")
    rows = rows.withColumn("distance", (F.col("spot") - F.col("threshold")) / F.col("threshold"))
    return rows.withColumn("model", step_confidence(F.col("way"), F.col("distance")))


def crypto_lag(markets: DataFrame, spot: DataFrame, as_of: Column, most: int | None = 8, hours: float = 48, fee: float = 1.80, min_edge: float = 3.0, page: int | None = None) -> DataFrame:
    """Spot against listed prices, short-dated. Markets without an end are not; unreadable ends are dropped."""
    left = hours_until(F.col("end_date"), as_of)
    rows = crypto_steps(capped(markets, page, "ord"), spot, most).withColumn("hours", left).where((F.col("hours") >= 0) & (F.col("hours") <= hours) & (F.col("price") != 0))
    rows = rows.withColumn("raw", (F.col("model") - F.col("price")) * 100).withColumn("net", F.col("raw") - fee).where(F.abs("net") > min_edge)
    return rows.select(
        "symbol", "ord", F.substring("question", 1, 100).alias("question"), "spot", "threshold", round_half_away(F.col("distance") * 100, 2).alias("distance_pct"), round_half_away(F.col("hours"), 1).alias("hours_left"),
        round_half_away(F.col("model"), 3).alias("model_prob"), round_half_away(F.col("price"), 3).alias("market_prob"), round_half_away(F.col("raw"), 2).alias("raw_edge"), round_half_away(F.col("net"), 2).alias("net_edge"),
        F.when(F.col("net") > 0, F.lit("BUY YES")).otherwise(F.lit("BUY NO")).alias("direction"),
    )


def crypto_lag_v1(markets: DataFrame, spot: DataFrame, as_of: Column, most: int | None = 5, hours: float = 24, fee: float = 1.25, min_edge: float = 1.5) -> DataFrame:
    """Linear confidence: half, and three points for each percent of distance, within 0.05 and 0.95."""
    low = F.lower("question")
    above = low.rlike("above|over|exceed")
    rows = symbol_markets(markets, spot, V.SYMBOLS_V1, V.RELATION_WORDS_V1, most).withColumns({"above": above, "below": low.rlike("below|under"), "hours": hours_until(F.col("end_date"), as_of)})
    rows = rows.where("above or below").where((F.col("hours") >= 0) & (F.col("hours") <= hours))
    rows = with_listed_price(once(rows, "threshold", T.last_number_k(F.col("question")))).where("threshold is not null and price <> 0")
    far = F.abs(F.col("spot") - F.col("threshold")) / F.col("threshold") * 100
    rows = rows.withColumn("far", far)
    sure = F.when(F.col("above"), F.col("spot") > F.col("threshold")).otherwise(F.col("spot") < F.col("threshold"))
    model = F.when(sure, F.least(F.lit(0.95), 0.5 + F.col("far") * 3)).otherwise(F.greatest(F.lit(0.05), 0.5 - F.col("far") * 3))
    rows = rows.withColumn("model", model).withColumn("raw", (F.col("model") - F.col("price")) * 100).withColumn("net", F.col("raw") - fee)
    return rows.where((F.abs("net") > min_edge) & (F.col("far") > 1)).select(
        "symbol", "ord", F.substring("question", 1, 80).alias("question"), "spot", "threshold", round_half_away(F.col("hours"), 1).alias("hours_left"), round_half_away(F.col("far"), 2).alias("distance_pct"),
        round_half_away(F.col("model"), 3).alias("model_prob"), round_half_away(F.col("price"), 3).alias("market_prob"), round_half_away(F.col("raw"), 2).alias("raw_edge"), round_half_away(F.col("net"), 2).alias("net_edge"),
        F.when(F.col("net") > 0, F.lit("BUY YES")).otherwise(F.lit("BUY NO")).alias("direction"),
    )


def threshold_markets(markets: DataFrame, most: int | None, min_volume: float) -> DataFrame:
    """(topic, ord, question, price, threshold) of the listed markets whose question says "above"."""
    listed = capped(markets.where(F.col("volume") >= min_volume), most, "ord").where(F.lower("question").contains("above"))
    able = once(with_listed_price(listed).where("price <> 0"), "threshold", T.first_number_k(F.col("question"))).where("threshold is not null")
    topics = F.filter(F.array(*[F.when(F.col("question").rlike(f"(?i){t}"), F.lit(t)) for t in V.TOPICS]), lambda t: t.isNotNull())
    return able.select("ord", "question", "price", "threshold", F.explode(topics).alias("topic"))


def combinatorial(markets: DataFrame, min_edge: float = 1.0, least: float = 0.03, fee: float = 2.5, most: int | None = 300, min_volume: float = 1000) -> DataFrame:
    """Pairs of a topic where the higher threshold has the higher price.

    Both questions say "above". The listing gives the first ``most`` markets with volume;
    pairs of a topic grow with the square of that limit and so does the result.
    ``combinatorial_best`` has the whole table.
    """
    able = threshold_markets(markets, most, min_volume)
    hi, lo = (able.select("topic", *(F.col(c).alias(f"{k}_{c}") for c in ("ord", "question", "price", "threshold"))) for k in ("hi", "lo"))
    pairs = hi.join(lo, "topic").where((F.col("hi_threshold") > F.col("lo_threshold")) & (F.col("hi_price") - F.col("lo_price") > least))
    diff = F.col("hi_price") - F.col("lo_price")
    pairs = pairs.withColumn("net", diff * 100 - fee).where(F.col("net") > min_edge)
    return pairs.select("topic", "hi_ord", "lo_ord", F.concat_ws(" vs ", F.substring("hi_question", 1, 50), F.substring("lo_question", 1, 50)).alias("question"), "hi_price", "lo_price", round_half_away(diff, 3).alias("price_diff"), round_half_away(F.col("net"), 2).alias("net_edge"))


def combinatorial_best(markets: DataFrame, min_edge: float = 1.0, least: float = 0.03, fee: float = 2.5, most: int | None = None, min_volume: float = 1000, held: int = dominance.HELD) -> DataFrame:
    """For each market with a pair in ``combinatorial``: how many it has as the higher threshold, and the best.

    The best counterpart has the lowest price, then the first place. Every market of the
    table is compared with all of its topic, by ranges of thresholds and of prices (see
    ``dominance``): no task holds a topic. Markets of equal threshold and price are one point
    with a weight.
    """
    able = scratch.table(threshold_markets(markets, most, min_volume).select("topic", "ord", F.col("price").cast("double").alias("price"), F.col("threshold").cast("double").alias("threshold")), "able-markets")
    points = able.groupBy(F.col("topic").alias("grp"), F.col("threshold").alias("place"), F.col("price").alias("height")).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    fine = lambda diff: (diff > least) & (diff * 100 - fee > min_edge)
    found = dominance.dominated(scratch.table(points, "points"), fine, max(least, (fee + min_edge) / 100), held)
    found = found.select(F.col("grp").alias("topic"), F.col("place").alias("threshold"), F.col("height").alias("price"), "violations", F.col("low_height").alias("lo_price"), F.col("low_ord").alias("lo_ord"))
    rows = able.join(found, ["topic", "threshold", "price"]).select("topic", F.col("ord").alias("hi_ord"), "lo_ord", "violations", F.col("price").alias("hi_price"), "lo_price")
    diff = F.col("hi_price") - F.col("lo_price")
    return rows.withColumns({"price_diff": round_half_away(diff, 3), "net_edge": round_half_away(diff * 100 - fee, 2)})


def economics(markets: DataFrame, most: int | None = 20, page: int | None = None) -> DataFrame:
    """Thinly traded markets about economic releases. They carry a condition, not a market to trade."""
    rows = once(capped(markets, page, "ord").where("volume > 500 and volume < 50000"), "tag", T.economy_tag(F.col("question")))
    rows = with_listed_price(rows.where("tag is not null")).where("price <> 0")
    return capped(rows, most, "ord").select("ord", "tag", F.substring("question", 1, 100).alias("question"), round_half_away(F.col("price"), 3).alias("yes_price"), round_half_away(1 - F.col("price"), 3).alias("no_price"), "volume", F.lit(0.0125).alias("fee"), F.col("market_id").alias("condition_id"))


def geopolitics(markets: DataFrame, as_of: Column, most: int | None = 20, page: int | None = None) -> DataFrame:
    """Near-certain markets that end within a week; without a fee the whole edge is kept. They carry a condition, not a market to trade."""
    rows = capped(markets, page, "ord").withColumn("days", hours_until(F.col("end_date"), as_of) / 24).where("days < 7 and days > 0 and volume > 1000")
    rows = with_listed_price(rows).where("price <> 0 and (price > 0.88 or price < 0.12)")
    side = F.when(F.col("price") > 0.88, F.col("price")).otherwise(1 - F.col("price"))
    return capped(rows, most, "ord").select(
        "ord", F.substring("question", 1, 100).alias("question"), round_half_away(F.col("price"), 3).alias("yes_price"), F.when(F.col("price") > 0.88, F.lit("BUY YES")).otherwise(F.lit("BUY NO")).alias("direction"),
        round_half_away(F.col("days"), 1).alias("days_left"), round_half_away((1 - side) * 100, 2).alias("net_edge"), "volume", F.lit(0.0).alias("fee"), F.col("market_id").alias("condition_id"),
    )
