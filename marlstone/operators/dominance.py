"""Counts of dominated points at any size: for each point the weight of the points left of it and low enough.

Points of a group (topic) have a place (threshold), a height (price) and a weight. A point
sees those at lower places whose height is at most its bound. Three parts make the count:

- blocks, ranges of places: points of the same block are counted by the block's task;
- buckets, ranges of heights: a block's weight at each height is summed first, so that a
  bucket holds a row for each block and height, not for each point. Of the bucket in which
  a bound lies, the bucket's task counts what lower blocks have up to it;
- the grid of blocks and buckets: running sums over both give all lower buckets of lower
  blocks.

So a task holds a range of points or of sums, never a group. Points of equal place and
height are one point of their summed weight before anything is dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.sources import scratch

#: Points of a block, and sums and bounds of a bucket, about.
HELD = 1 << 18
BLOCKED = "grp string, place double, height double, ord long, n long, bound double, block int, inside long, low_height double, low_ord long"
COUNTED = "grp string, bound double, block int, bucket int, inside long"
CELLS = "grp string, height double, block int, n long, asks boolean"


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order."""
    k = x.view(np.int64)
    return np.where(k < 0, np.int64(-(2**63)) - k, k)


def back(k: np.ndarray) -> np.ndarray:
    return np.where(k < 0, np.int64(-(2**63)) - k, k).view(np.float64)


def bounds(height: np.ndarray, fine: Callable[[np.ndarray], np.ndarray], gap: float) -> np.ndarray:
    """The greatest double that is low enough for each height: ``fine`` tells by the difference, and turns about at ``gap``.

    Found by halving between doubles, since at the edge rounding decides.
    """
    height = height + 0.0  # no negative zero
    slack = 1e-9 * (1 + np.abs(height) + abs(gap))
    low, high = ordered(height - gap - slack), ordered(height - gap + slack)
    while (open_ := high - low > 1).any():
        mid = low + (high - low) // 2
        good = fine(height - back(mid))
        low, high = np.where(open_ & good, mid, low), np.where(open_ & ~good, mid, high)
    return back(low)


def weight_below(ranks: np.ndarray, weight: np.ndarray, first: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each k: the weight of those of ``ranks[:first[k]]`` that are less than ``below[k]``; ranks are a permutation (wavelet matrix)."""
    total, a, b = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), first.astype(np.int64)
    top = 1 << len(ranks).bit_length()
    below = np.minimum(below, top - 1)
    while top := top >> 1:
        ones = (ranks & top) != 0
        zeros, sums = (np.concatenate([[0], np.cumsum(x)]) for x in (~ones, weight[~ones]))
        za, zb, up = zeros[a], zeros[b], (below & top) != 0
        total += np.where(up, sums[zb] - sums[za], 0)
        a, b = np.where(up, zeros[-1] + a - za, za), np.where(up, zeros[-1] + b - zb, zb)
        ranks, weight = (np.concatenate([x[~ones], x[ones]]) for x in (ranks, weight))
    return total


def ranks_of(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def segments(grp: pa.ChunkedArray) -> list[tuple[int, int]]:
    """Runs of equal groups of a sorted partition."""
    names = grp.combine_chunks().dictionary_encode()
    code = (names.chunk(0) if isinstance(names, pa.ChunkedArray) else names).indices.to_numpy()
    cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
    return list(zip(cuts, cuts[1:]))


def block_rows(fine: Callable, gap: float):
    """A block's points (grp, place, height, ord, n), sorted, to BLOCKED: ``inside`` counts in the block, ``low_*`` is its lowest point at lower places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one range of points, HELD or so
        if not sum(b.num_rows for b in held):
            return
        table, block = pa.Table.from_batches(held), TaskContext.get().partitionId()
        for a, z in segments(table.column("grp")):
            part = table.slice(a, z - a)
            place, height, order, n = (part.column(c).to_numpy() for c in ("place", "height", "ord", "n"))
            bound = bounds(height, fine, gap)
            ranked = np.lexsort((order, height))
            rank, left = ranks_of(ranked), np.searchsorted(place, place, "left")
            inside = weight_below(rank, n, left, np.searchsorted(height[ranked], bound, "right"))
            lowest = ranked[np.minimum.accumulate(rank)[np.maximum(left - 1, 0)]]
            none = pa.array(left == 0)
            low = [pc.if_else(none, None, pa.array(x[lowest])) for x in (height, order)]
            columns = [*part.combine_chunks().columns, pa.array(bound), pa.array(np.full(z - a, block, np.int32)), pa.array(inside), *low]
            yield from pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=[x.split()[0] for x in BLOCKED.split(", ")]).to_batches(1 << 16)

    return run


def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's CELLS, sorted by height, sums before bounds, to COUNTED for the bounds; and rows without a bound with a block's whole weight in the bucket."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    table, bucket = pa.Table.from_batches(held), TaskContext.get().partitionId()
    for a, z in segments(table.column("grp")):
        part = table.slice(a, z - a)
        height, block, n, asks = (part.column(c).to_numpy(zero_copy_only=False) for c in ("height", "block", "n", "asks"))
        cells, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
        order = np.argsort(block[cells], kind="stable")
        inside = weight_below(ranks_of(order), n[cells], np.searchsorted(cells, asked), np.searchsorted(block[cells][order], block[asked], "left"))
        names, of = np.unique(block[cells], return_inverse=True)
        weight = np.bincount(of, weights=n[cells], minlength=len(names)).astype(np.int64)
        group = part.column("grp")[0].as_py()
        rows = len(asked) + len(names)
        yield pa.record_batch(
            [pa.array([group] * rows, pa.string()), pa.array([*height[asked].tolist(), *[None] * len(names)], pa.float64()), pa.array(np.concatenate([block[asked], names]).astype(np.int32)),
             pa.array(np.full(rows, bucket, np.int32)), pa.array(np.concatenate([inside, weight]))],
            names=[x.split()[0] for x in COUNTED.split(", ")],
        )


def ranges(df: DataFrame, held: int, *by: str) -> DataFrame:
    """Dealt to sorted ranges of about ``held`` rows; equal values of the first two columns stay together."""
    return df.repartitionByRange(max(1, -(-df.count() // held)), *by[:2]).sortWithinPartitions(*by)


def dominated(points: DataFrame, fine: Callable[[np.ndarray], np.ndarray], gap: float, held: int = HELD) -> DataFrame:
    """(grp, place, height, violations, low_height, low_ord) of the points that see any weight.

    points: grp, place, height, ord, n, one row for each place and height, written somewhere
    (they are read twice). ``violations``: the weight of points at lower places with a height
    for which ``fine(own height - height)``. ``low_*``: the lowest of them, then the first.
    """
    own = points.select("grp", F.col("place").cast("double").alias("place"), (F.col("height").cast("double") + 0.0).alias("height"), F.col("ord").cast("long").alias("ord"), F.col("n").cast("long").alias("n"))
    blocked = scratch.table(ranges(own, held, "grp", "place", "height").mapInArrow(block_rows(fine, gap), BLOCKED), "blocked-points")
    low = blocked.groupBy("grp", "block").agg(F.min(F.struct("height", "ord")).alias("low"))
    before = Window.partitionBy("grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    low = low.select("grp", "block", F.min("low").over(before).alias("earlier"))  # a row for each block
    sums = blocked.groupBy("grp", "height", "block").agg(F.sum("n").alias("n")).select("grp", "height", "block", "n", F.lit(False).alias("asks"))
    asked = blocked.select("grp", F.col("bound").alias("height"), "block").distinct().select("grp", "height", "block", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asks"))
    cells = scratch.table(sums.unionByName(asked), "cells")
    counted = scratch.table(ranges(cells, held, "grp", "height", "asks").mapInArrow(bucket_rows, COUNTED), "counted-bounds")
    # the grid: the weight of lower blocks in lower buckets, for each block and bucket that has a bound
    totals = counted.where("bound is null").groupBy("grp", "block", "bucket").agg(F.sum("inside").alias("n"))
    corners = counted.where("bound is not null").select("grp", "block", "bucket").distinct().withColumn("n", F.lit(0).cast("long"))
    all_blocks = totals.select("grp", "block").distinct()
    buckets = totals.select("grp", "bucket").unionByName(corners.select("grp", "bucket")).distinct()
    every = all_blocks.join(buckets, "grp").withColumn("n", F.lit(0).cast("long"))  # blocks times buckets: the grid
    grid = totals.unionByName(every).groupBy("grp", "block", "bucket").agg(F.sum("n").alias("n"))
    over_buckets = F.sum("n").over(Window.partitionBy("grp", "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    over_blocks = F.sum("n").over(Window.partitionBy("grp", "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    grid = grid.withColumn("n", F.coalesce(over_buckets, F.lit(0))).withColumn("corner", F.coalesce(over_blocks, F.lit(0))).drop("n")
    outside = counted.where("bound is not null").join(grid, ["grp", "block", "bucket"]).select("grp", "block", "bound", (F.col("inside") + F.col("corner")).alias("outside"))
    whole = blocked.join(outside, ["grp", "block", "bound"]).join(low, ["grp", "block"]).withColumn("violations", F.col("inside") + F.col("outside")).where("violations > 0")
    own_low = F.when(F.col("low_height").isNotNull(), F.struct(F.col("low_height").alias("height"), F.col("low_ord").alias("ord")))
    best = F.least(own_low, "earlier")
    return whole.withColumn("best", best).select("grp", "place", "height", "violations", F.col("best.height").alias("low_height"), F.col("best.ord").alias("low_ord"))
