"""Text rules of market questions: keywords, orientation, taxonomy, numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import vocabulary as V
from marlstone.functions.scalars import first_text, number_prefix


def contains_any(text: Column, words: list[str]) -> Column:
    """Any of the words as a substring, whatever the case; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def listing_text(question: Column, title: Column) -> Column:
    """The question, or the title where there is none."""
    return first_text(question, title)


def outcome_matches(question: Column, outcome: str) -> Column:
    return contains_any(question, next(words for key, _, words in V.OUTCOMES if key == outcome))


def economy_tag(question: Column) -> Column:
    """The first tag whose words the question has; null without."""
    out = F.lit(None).cast("string")
    for tag, words in reversed(V.ECONOMY_TAGS):
        out = F.when(contains_any(question, words), F.lit(tag)).otherwise(out)
    return out


def yes_orientation(question: Column, outcome: Column) -> Column:
    """``inverted`` where YES means that the outcome did not happen."""
    low = F.lower(F.coalesce(question, F.lit("")))
    cold = (outcome == "hot") & low.rlike(V.YES_IS_COLD)
    dry = (outcome == "rain") & ~low.rlike(V.YES_IS_RAIN) & low.rlike(V.YES_IS_DRY)
    return F.when(cold | dry, F.lit("inverted")).otherwise(F.lit("normal"))


def direction(question: Column) -> Column:
    """``above`` or ``below``, above first; null for neither."""
    return F.when(question.rlike(V.ABOVE), F.lit("above")).when(question.rlike(V.BELOW), F.lit("below"))


def plain_number(text: Column) -> Column:
    return number_prefix(F.replace(text, F.lit(","), F.lit("")))


def last_large_number(question: Column) -> Column:
    """The last number over 100, commas removed; suffixes are ignored."""
    numbers = F.transform(F.regexp_extract_all(question, F.lit(r"([0-9,]+\.?[0-9]*)"), 1), plain_number)
    return F.try_element_at(F.filter(numbers, lambda x: x > 100), F.lit(-1))


def last_number_k(question: Column) -> Column:
    """The last number, times 1000 with a k behind it; 0 and malformed numbers are null."""
    last = F.try_element_at(F.regexp_extract_all(question, F.lit(r"(\$?[0-9,]+(?:\.[0-9]+)?[kK]?)"), 1), F.lit(-1))
    value = number_prefix(F.regexp_replace(last, "[$,]", ""))
    return F.nullif(value * F.when(F.lower(last).contains("k"), F.lit(1000.0)).otherwise(F.lit(1.0)), F.lit(0.0))


def first_number_k(question: Column) -> Column:
    """The first number with its first comma removed, as far as it can be read; times 1000 if any k occurs."""
    low = F.lower(question)
    first = F.nullif(F.regexp_extract(low, "([0-9,]+)", 1), F.lit(""))
    comma = F.instr(first, ",")
    cut = F.when(comma > 0, F.concat(F.substring(first, F.lit(1), comma - 1), F.substring(first, comma + 1, F.length(first)))).otherwise(first)
    return number_prefix(cut) * F.when(low.contains("k"), F.lit(1000.0)).otherwise(F.lit(1.0))
