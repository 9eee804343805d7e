"""Views of the test tables in the shapes that the signal operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import vocabulary as V
from marlstone.sources import pieces

AS_OF = "1998-06-15 00:00:00"
SUBJECTS = ["bitcoin", "ethereum", "solana", "xrp", "temperature", "rain", "snow", "storm", "cpi inflation", "fed interest rate", "unemployment jobs", "gdp recession"]
RELATIONS = ["above", "below", "or below"]
SPOT = [("BTC", 250000.0), ("ETH", 120000.0), ("SOL", 60000.0), ("XRP", 300000.0)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def div(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("long")


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_key, ord, yes_price, question): order lines as legs of a basket, priced by quantity / 64."""
    line = pieces.spread(read(spark, sf_dir, "lineitem"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return line.select(F.col("l_orderkey").alias("group_key"), order.alias("ord"), (F.col("l_quantity") / 64).alias("yes_price"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("question"))


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, market_id, question, yes_price, outcome_prices, volume, end_date, token_id) from orders."""
    k = F.col("o_orderkey")
    place = F.when((k % 12 >= 4) & (k % 12 <= 7), F.concat(F.lit(" in "), pick([s[0] for s in V.STATIONS], div(k, 36) % 20))).otherwise(F.lit(""))
    question = F.concat(F.lit("Will "), pick(SUBJECTS, k % 12), place, F.lit(" be "), pick(RELATIONS, (div(k, 12) + div(k, 36)) % 3), F.lit(" $"), F.floor("o_totalprice").cast("long").cast("string"), F.lit("?"))
    thousandths = (k * 37) % 1000
    prices = F.format_string('["%d.%03d","%d.%03d"]', div(thousandths, 1000), thousandths % 1000, div(1000 - thousandths, 1000), (1000 - thousandths) % 1000)
    end = F.timestamp_micros((F.unix_micros(as_of()) + ((k * 29) % 240 - 24) * 3_600_000_000).cast("long"))
    return pieces.spread(read(spark, sf_dir, "orders")).select(k.alias("ord"), k.alias("market_id"), question.alias("question"), (thousandths / F.lit(1000.0)).alias("yes_price"), prices.alias("outcome_prices"), (F.col("o_totalprice") / 5).alias("volume"), end.alias("end_date"), F.when(k % 4 != 0, k).alias("token_id"))


def spot(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPOT, "symbol string, spot double")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token_id, price): the order book, which lacks every fifth token."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").where(k % 5 != 0).select(k.alias("token_id"), ((k * 53) % 1000 / F.lit(1000.0)).alias("price"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forecast for each event, at the station of its user."""
    i = F.col("event_id")
    warm = (i * 13) % 450 / F.lit(10.0) - 2
    station = F.col("user_id") % 20
    return read(spark, sf_dir, "events").select(
        i.alias("forecast_id"), pick([s[0] for s in V.STATIONS], station).alias("city"), pick([s[2] for s in V.STATIONS], station).alias("station_id"), pick([s[7] for s in V.STATIONS], station).alias("unit"),
        warm.alias("tmax_c"), (warm - 9).alias("tmin_c"), ((i * 7) % 300 / F.lit(10.0)).alias("precip_mm"), ((i * 11) % 101).cast("double").alias("pop"), ((i * 3) % 140 / F.lit(10.0)).alias("snow"),
        ((i * 17) % 50).cast("double").alias("wind"), ((i * 19) % 100).cast("int").alias("wmo"), ((i * 23) % 101).cast("double").alias("humidity"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ts, size, price, direction, resolved_yes, is_open) from purchases."""
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("double")
    return read(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        i.alias("id"), F.col("user_id"), F.col("ts"), (F.col("value") / 100).alias("size"), ((k + 1) / 101).alias("price"), F.when(i % 2 == 0, F.lit("BUY YES")).otherwise(F.lit("BUY NO")).alias("direction"), (i % 3 == 0).alias("resolved_yes"), (i % 5 == 0).alias("is_open"),
    )
