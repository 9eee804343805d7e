"""Column helpers for the arithmetic of the signals.

Listings come from loosely typed feeds, where 0, empty, NaN and null all count as missing
and numbers are rounded half away from zero. These helpers state those rules once. All
are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER_PREFIX = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` between the bounds; null stays null (least and greatest would skip it)."""
    return F.when(x.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))


def round_half_away(x: Column, digits: int) -> Column:
    """Rounded on the binary value with plain IEEE steps, the same in any engine."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def number_or(x: Column, default) -> Column:
    """``default`` where the number is null, NaN or 0."""
    return F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit(default)).otherwise(x)


def text_or(x: Column, default) -> Column:
    """``default`` where the text is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def first_text(*columns: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def known(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def to_fahrenheit(celsius: Column) -> Column:
    """Rounded to a tenth, as it is compared with thresholds."""
    return round_half_away(celsius * 9 / 5 + 32, 1)


def number_prefix(text: Column) -> Column:
    """The number at the start of a text, null without one."""
    return F.regexp_extract(F.trim(text), NUMBER_PREFIX, 0).try_cast("double")


def first_price(prices: Column) -> Column:
    """The first of a JSON array of prices, given as texts or numbers; null if malformed."""
    return number_prefix(F.get(F.from_json(prices, "array<string>"), F.lit(0)))  # digits only, so never NaN


def hours_until(end: Column, as_of: Column) -> Column:
    """Hours with fractions; negative in the past."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / F.lit(3.6e9)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is worked out once for each row, however often it is used later.

    Spark copies a plain column's expression into each of its uses; a generator of one row
    it does not. Filters on other columns still move below it.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def parameter(value, default: float) -> float:
    """A request parameter as a number: ``default`` where it is missing, unreadable, NaN or 0."""
    found = re.match(NUMBER_PREFIX, str(value).strip()) if value is not None else None
    return (float(found[0]) if found else 0.0) or default


def fixed_text(x: Column, digits: int) -> Column:
    """With so many decimals, rounded half away from zero on the binary value."""
    return F.format_string(f"%.{digits}f", round_half_away(x, digits))


def minutes_text(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.pmod(seconds, F.lit(60)))


def row_id(*parts: Column) -> Column:
    """A key made of the parts, with anything but letters, digits and _ replaced."""
    return F.regexp_replace(F.concat_ws("_", *parts), "[^a-zA-Z0-9_]", "_")


def trade_id(ts: Column, place: Column) -> Column:
    """A trade's key: its time in milliseconds and four characters that tell trades of one time apart."""
    return F.concat_ws("_", F.lit("trade"), F.unix_millis(ts.cast("timestamp")).cast("string"), F.substring(F.md5(place.cast("string")), 1, 4))


def grouped_text(x: Column, digits: int = 0) -> Column:
    """With thousands separators."""
    return F.format_number(x, digits)
