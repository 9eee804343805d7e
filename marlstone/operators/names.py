"""Texts that contain names, for any number of either: an index join by whole names, or by the rarest piece of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators import markets
from marlstone.sources import scratch

#: Letters of a piece; a shorter name is a piece of its own length.
PIECE = 4
#: Names of so many different lengths (in bytes) at most are looked for whole.
LENGTHS = 8
#: Bits of the filter of pieces for each name, as far as ``markets.MOST_BITS`` goes.
BITS = 256
#: Bits of a page of the filter, as ``bitmap_construct_agg`` has them.
PAGE = 32_768
#: Rows, and bytes of their texts, that are cut at a time.
ROWS, BYTES = 10_000, 1 << 21


_STEP, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends); null is empty."""
    held = texts.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


class _Windows:
    """Hashes of any stretch of some bytes, the same wherever equal bytes stand: sums of powers, which wrap."""

    def __init__(self, data: np.ndarray):
        powers = np.full(len(data) + 1, _STEP)
        powers[0] = 1
        self.forth = np.cumprod(powers)
        powers[1:] = _BACK
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)[: len(data)], out=self.sums[1:])

    def places(self, start: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.forth[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return (h & np.uint64(bits - 1)).astype(np.int64)


def _marks(bits: int):
    """The page and bit of each text as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = _bytes_of(b.column(0))
            at = _Windows(data).places(ends[:-1], ends[1:], bits)
            yield pa.record_batch([pa.array(at // PAGE), pa.array(at % PAGE)], names=["page", "bit"])

    return run


def _cut(column: int, sizes: list[int], bits: int, held):
    """Rows with each different piece that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(held.value, np.uint8)
        for whole in batches:
            first = 0
            while first < len(whole):
                # so many rows at a time that their texts hold a few MB, or one
                part = whole.slice(first, ROWS)
                b = part.slice(0, max(1, int(np.searchsorted(_bytes_of(part.column(column))[1][1:], BYTES))))
                first += len(b)
                yield from pieces_of(b, marks)

    def pieces_of(b: pa.RecordBatch, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        data, ends = _bytes_of(b.column(column))
        windows, end_of = _Windows(data), np.repeat(ends[1:], np.diff(ends))
        begins = np.append((data & 0xC0) != 0x80, True)  # a letter, not the inside of one
        row, raw, seen = np.repeat(np.arange(len(b)), np.diff(ends)), data.tobytes(), {}
        for n in sizes:
            start = np.flatnonzero((np.arange(len(data)) + n <= end_of) & begins[:-1])
            start = start[begins[start + n]]
            place = windows.places(start, start + n, bits)
            start = start[(marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
            seen |= dict.fromkeys((r, raw[i : i + n]) for r, i in zip(row[start].tolist(), start.tolist(), strict=True))
        if seen:
            rows = b.take(pa.array([r for r, _ in seen], pa.int64()))
            yield pa.record_batch([*rows.columns, pa.array([p for _, p in seen], pa.binary()).cast(pa.string())], names=[*b.schema.names, "__piece"])

    return run


def text_pieces(texts: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """Every row of ``texts`` with each of its different pieces that may be in ``wanted`` (__piece), and few others.

    Pieces are cut and filtered where the text is; only those that pass go on. The filter has
    a size of its own, ``markets.MOST_BITS`` at most, whatever the names.
    """
    sizes = lengths(wanted, "__piece", None)
    bits = min(markets.MOST_BITS, max(PAGE, 1 << (wanted.count() * BITS).bit_length()))
    pages = wanted.select("__piece").mapInArrow(_marks(bits), "page long, bit long").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    marks = np.zeros((bits // PAGE, PAGE // 8), np.uint8)
    for r in pages.toLocalIterator():
        marks[r["page"]] = np.frombuffer(r["bitmap"], np.uint8)
    held = texts.sparkSession.sparkContext.broadcast(marks.tobytes())
    return texts.mapInArrow(_cut(texts.columns.index(text), sizes, bits, held), T.StructType([*texts.schema.fields, T.StructField("__piece", T.StringType())]))


def own_pieces(names: DataFrame, name: str, size: int) -> DataFrame:
    """(name, __piece): each different name with all its pieces of ``size`` letters, or itself where it is shorter."""
    of = names.select(name).distinct().withColumn("__size", F.least(F.lit(size), F.length(name)))
    return of.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.length(name) - F.col("__size") + 1), lambda i: F.substring(F.col(name), i, F.col("__size")))).alias("__piece")).distinct()


def rarest_pieces(names: DataFrame, name: str, texts: DataFrame, text: str, size: int = PIECE) -> DataFrame:
    """(name, __piece): of each different name its piece that the fewest texts have.

    Texts' pieces are counted where they are first, each task its own.
    """
    own = own_pieces(names, name, size)
    counts = text_pieces(texts, text, own.select("__piece").distinct()).groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    told = own.join(counts, "__piece", "left").groupBy(name).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__piece")).alias("__best"))
    return told.select(name, F.col("__best.__piece").alias("__piece"))


def lengths(names: DataFrame, name: str, most: int | None) -> list[int]:
    """The different lengths of names in bytes, no more than ``most`` of them."""
    found = names.select(F.octet_length(name).alias("n")).distinct()
    return sorted(r["n"] for r in (found if most is None else found.limit(most)).collect())


def containing(texts: DataFrame, text: str, names: DataFrame, name: str, size: int = PIECE, most_lengths: int = LENGTHS) -> DataFrame:
    """Rows of ``texts`` with each row of ``names`` whose ``name`` stands in ``text``, as it is written.

    Names of few lengths are looked for whole, among the pieces of the text of those lengths.
    Of other names one piece is: the rarest, and texts that have it are searched for the name.
    Either is an equi-join of the pieces that pass a filter of the names', so work grows with
    such texts and not with texts times names; a piece that many texts have is split as any
    skewed key of a join is. Null and empty names stand nowhere. Columns of both must differ.
    """
    able = scratch.table(names.where(F.length(name) > 0), "names")
    found = lengths(able, name, most_lengths + 1)
    if not found:
        return texts.crossJoin(able).where("false")  # an empty table of both's columns
    if len(found) <= most_lengths:
        keyed = able.withColumn("__piece", F.col(name))
        return text_pieces(texts, text, keyed.select("__piece").distinct()).join(keyed, "__piece").drop("__piece")
    keyed = scratch.table(rarest_pieces(able, name, texts, text, size), "rarest-pieces")
    pieces = text_pieces(texts, text, keyed.select("__piece").distinct())
    return pieces.join(able.join(keyed, name), "__piece").where(F.contains(F.col(text), F.col(name))).drop("__piece")
