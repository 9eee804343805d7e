"""Hand-worked rows for the scalar and text rules."""

import math

import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x,digits,want", [(2.345, 2, 2.35), (-2.345, 2, -2.35), (0.0, 2, 0.0), (1.04, 1, 1.0), (None, 2, None)])
def test_round_half_away(spark, x, digits, want):
    assert one(spark, S.round_half_away(F.lit(x).cast("double"), digits)) == want


@pytest.mark.parametrize("x,want", [(-1.0, 0.0), (0.5, 0.5), (2.0, 1.0), (None, None)])
def test_clamp(spark, x, want):
    assert one(spark, S.clamp(F.lit(x).cast("double"), 0, 1)) == want


@pytest.mark.parametrize("x,want", [(0.0, 7.0), (None, 7.0), (math.nan, 7.0), (3.0, 3.0)])
def test_number_or(spark, x, want):
    assert one(spark, S.number_or(F.lit(x).cast("double"), 7.0)) == want


@pytest.mark.parametrize("x,want", [("1000,000", 1000.0), ("5.", 5.0), ("95k", 95.0), (".5x", 0.5), ("x", None), ("", None), ("-2e3", -2000.0)])
def test_number_prefix(spark, x, want):
    assert one(spark, S.number_prefix(F.lit(x))) == want


@pytest.mark.parametrize("x,want", [('["0.12","0.88"]', 0.12), ("[0.5, 0.5]", 0.5), ("[]", None), ("not json", None), (None, None), ('["NaN"]', None)])
def test_first_price(spark, x, want):
    assert one(spark, S.first_price(F.lit(x).cast("string"))) == want


def test_text_forms(spark):
    assert one(spark, S.fixed_text(F.lit(2.5), 2)) == "2.50"
    assert one(spark, S.minutes_text(F.lit(125))) == "02:05"
    assert one(spark, S.row_id(F.lit("K-1"), F.lit("a b"))) == "K_1_a_b"
    assert one(spark, S.to_fahrenheit(F.lit(30.0))) == 86.0


@pytest.mark.parametrize(
    "q,large,k,first",
    [
        ("Will BTC be above $95,000 on June 5, 2026?", 2026.0, 2026.0, 95000.0),
        ("Will BTC hit $150k?", 150.0, 150000.0, 150000.0),
        ("above 1,000,000", 1000000.0, 1000000.0, 1000.0),
        ("no number", None, None, None),
        ("only 50", None, 50.0, 50.0),
    ],
)
def test_numbers(spark, q, large, k, first):
    q = F.lit(q)
    got = spark.range(1).select(T.last_large_number(q), T.last_number_k(q), T.first_number_k(q)).first()
    assert got[0] == large and got[1] == k
    assert got[2] == first or (first is None and got[2] is None)


@pytest.mark.parametrize("q,outcome,want", [("14C or below?", "hot", "inverted"), ("above 90?", "hot", "normal"), ("Will it rain or stay dry?", "rain", "normal"), ("no rain in Paris", "rain", "inverted"), ("below?", "snow", "normal"), (None, "hot", "normal")])
def test_orientation(spark, q, outcome, want):
    assert one(spark, T.yes_orientation(F.lit(q).cast("string"), F.lit(outcome))) == want


@pytest.mark.parametrize("q,want", [("CPI and jobs", "cpi"), ("Fed unemployment", "jobs"), ("Fed cut", "fed"), ("recession", "gdp"), ("Ukraine", None)])
def test_economy_tag(spark, q, want):
    assert one(spark, T.economy_tag(F.lit(q))) == want


def test_keywords_are_substrings(spark):
    assert one(spark, T.contains_any(F.lit("Ukraine"), ["rain"]))
    assert not one(spark, T.contains_any(F.lit(None).cast("string"), ["rain"]))


@pytest.mark.parametrize("q,want", [("Above or below", "above"), ("less than 5", "below"), ("exactly", None)])
def test_direction(spark, q, want):
    assert one(spark, T.direction(F.lit(q))) == want
