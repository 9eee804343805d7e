"""Schemas of the domain tables, and tables of fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import vocabulary as V

STATIONS = "city string, country string, stationId string, stationName string, lat double, lon double, tz string, unit string"
FORECAST = (
    "stationId string, daily struct<temperature_2m_max: array<double>, temperature_2m_min: array<double>, precipitation_sum: array<double>, "
    "precipitation_probability_max: array<double>, snowfall_sum: array<double>, wind_speed_10m_max: array<double>>, "
    "current struct<temperature_2m: double, apparent_temperature: double, relative_humidity_2m: double, wind_speed_10m: double, precipitation: double, weather_code: int>"
)
MARKET = (
    "conditionId string, id string, questionID string, groupItemTitle string, slug string, question string, title string, outcomePrices string, volume double, volumeNum double, "
    "endDate string, end_date_iso string, clobTokenIds array<string>, tokens array<struct<token_id: string>>"
)
OPPORTUNITIES = (
    "id string, ts string, city string, stationId string, outcome string, question string, modelProb double, marketProb double, netEdge double, direction string, marketId string, strategy string, acted int"
)
TRADES = (
    "id string, ts string, oppId string, mode string, direction string, marketId string, question string, price double, size double, outcome string, resolvedAt string, pnl double, status string, notes string"
)
SETTINGS = "key string, value string"


def stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.STATIONS, STATIONS)


def station_aliases(spark: SparkSession) -> DataFrame:
    """(city, stationId, alias): the names that a station goes by in questions; a few rows of fixed values."""
    rows = [(city, station, alias) for city, _, station, *_ in V.STATIONS for alias in V.CITY_ALIASES.get(city.lower(), [city.lower(), station.lower()])]
    return spark.createDataFrame(rows, "city string, stationId string, alias string")


def default_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.SETTINGS, SETTINGS)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a snapshot: those that Spark has marked as written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def read_snapshot(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """The last complete version at ``path`` (the last below ``before``); empty where there is none."""
    found = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{path}/{found[-1]}") if found else spark.createDataFrame([], schema)


def write_snapshot(df: DataFrame, path: str, version: int | None = None) -> int:
    """Add a version of the snapshot at ``path``, by default the next; readers see the old one until it is complete.

    ``df`` may read from an older version. A version that is written again is replaced.
    """
    if version is None:
        version = max(versions(df.sparkSession, path), default=-1) + 1
    df.write.mode("overwrite").parquet(f"{path}/{version}")
    return version


def prune_snapshot(spark: SparkSession, path: str, keep: int) -> int:
    """Remove all but the last ``keep`` complete versions; how many went. Readers of older ones must be done."""
    old = versions(spark, path)[:-keep]
    for v in old:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{v}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(old)


def listings(bodies: DataFrame, value: str = "value", item: str = "markets") -> DataFrame:
    """Markets of JSON response bodies: an array, or an object that holds one in data or in ``item``.

    Bodies that are neither give no rows. ``ord`` is the place within a body.
    """
    array = f"array<struct<{', '.join(': '.join(f.split(' ', 1)) for f in split_fields(MARKET))}>>"
    wrapped = F.from_json(value, f"struct<data: {array}, {item}: {array}>")
    found = F.when(F.ltrim(F.col(value)).startswith("["), F.from_json(value, array)).otherwise(F.coalesce(wrapped["data"], wrapped[item]))
    return bodies.select(F.posexplode(found).alias("ord", "m")).select(F.col("ord").cast("long").alias("ord"), "m.*")


def split_fields(schema: str) -> list[str]:
    """The fields of a schema text, split at its outer commas."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:k].strip())
            at = k + 1
    return out
