"""Embedding near-dedup with a forest of random-projection trees.

Vectors of equal label are split again and again by random directions; a vector near a
split goes both ways (spill overlap; once on its way down), so close vectors seldom part. The trees differ in
their directions. Vectors of a leaf are compared by exact cosine in double precision, and
linked vectors are united. A pair that shares several leaves counts in the first of them,
so links are counted where they are found and pairs are never written out. Equal vectors
are one class and are compared once. Splits are fitted where few vectors lie near them, so
that a tight group, which any cut through it would send both ways again and again, stays
together; its leaf is compared in blocks, as any leaf of many close vectors is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources import scratch
from marlstone.llm.components import components

TREES = 6
#: Vectors that a leaf should have.
LEAF = 128
#: Directions that are tried for a split, the least share of the sample on either side, and the most that may go both ways: else the node stays a leaf.
TRIED, LEAST_SHARE, MOST_BOTH = 4, 0.1, 0.3
#: A leaf with more is compared in blocks of about this many.
BLOCK = 1536
#: Half the width of the overlap, for vectors of length one. A vector goes both ways once in
#: a tree, so that it is in twelve leaves at most.
SPILL = 0.03
#: Vectors that splits are fitted on; below their reach splits are at 0.
FITTED = 4096
FIT_LEAST = 64


@lru_cache(maxsize=8192)
def direction(tree: int, node: int, dim: int, tried: int = 0) -> np.ndarray:
    x = np.random.default_rng([tree, node, dim, tried]).standard_normal(dim)
    return x / np.linalg.norm(x)


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1)[:, None]  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1)[:, None]


def best_cut(x: np.ndarray, tree: int, node: int) -> tuple[int, float] | None:
    """The direction and the point at which least of the sample is near, both sides having their share; None where too much is near any."""
    best = None
    for tried in range(TRIED):
        at = np.sort(x @ direction(tree, node, x.shape[1], tried))
        cuts = at[int(LEAST_SHARE * len(at)) : max(int((1 - LEAST_SHARE) * len(at)), 1)]
        near = np.searchsorted(at, cuts + SPILL, side="right") - np.searchsorted(at, cuts - SPILL)
        # among points that few are near, the one that halves best
        uneven = np.abs(np.searchsorted(at, cuts) / len(at) - 0.5)
        cost = near / len(at) + 0.3 * uneven
        k = int(np.argmin(cost))
        if near[k] <= MOST_BOTH * len(at) and (best is None or cost[k] < best[0]):
            best = cost[k], tried, float(cuts[k])
    return best and best[1:]


def fit_splits(sample: list) -> dict[tuple[int, int, int], tuple[int, float] | None]:
    """(tree, node, dimensions) -> direction and point of its split, None where it has none; below the sample's reach splits are at 0."""
    splits = {}
    for dim in {len(x) for x in sample}:
        x = unit([v for v in sample if len(v) == dim])
        for tree in range(TREES):
            todo = [(1, x)]
            while todo:
                node, own = todo.pop()
                if len(own) >= FIT_LEAST:
                    cut = splits[tree, node, dim] = best_cut(own, tree, node)
                    if cut:
                        at = own @ direction(tree, node, dim, cut[0]) - cut[1]
                        todo += [(2 * node, own[at <= 0]), (2 * node + 1, own[at > 0])]
    return splits


def leaves_of(x: np.ndarray, depth: np.ndarray, splits: dict, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf code) of every leaf that each vector is in, two of a tree at most. depth: levels for each vector."""
    dim, out_row, out_code = x.shape[1], [], []
    for tree in range(trees):
        first = np.flatnonzero(depth > 0) if tree else np.arange(len(x))
        todo = [(1, first, np.zeros(len(first), dtype=bool), 0)]
        while todo:
            node, rows, spilled, level = todo.pop()
            cut = splits.get((tree, node, dim), (0, 0.0))
            ended = (depth[rows] <= level) | (cut is None)
            if ended.any():
                out_row.append(rows[ended])
                out_code.append(np.full(int(ended.sum()), (tree << 48) + node, dtype=np.int64))
                rows, spilled = rows[~ended], spilled[~ended]
            if len(rows):
                at = x[rows] @ direction(tree, node, dim, cut[0]) - cut[1]
                both = (np.abs(at) <= SPILL) & ~spilled
                for child, side in ((2 * node, (at <= 0) | both), (2 * node + 1, (at > 0) | both)):
                    todo.append((child, rows[side], (spilled | both)[side], level + 1))
    return np.concatenate(out_row), np.concatenate(out_code)


def leaf_rows(splits: dict):
    """Of (name, copies, label, dim, depth, embedding): a row for each leaf, with the leaves of the vector before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                dims = batch.column(3).to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    x = unit(part.column(5).to_pylist())
                    row, code = leaves_of(x, part.column(4).to_numpy(), splits)
                    order = np.lexsort((code, row))
                    row, code = row[order], code[order]
                    begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))])[row]
                    n = np.arange(len(row)) - begin  # leaves before this one
                    at = np.concatenate([[0], np.cumsum(n)])
                    before = code[np.repeat(begin - at[:-1], n) + np.arange(at[-1])]
                    earlier = pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), pa.array(before))
                    take = pa.array(row)
                    yield pa.record_batch([part.column(k).take(take) for k in (0, 1, 2, 3)] + [pa.array(code), earlier, part.column(5).take(take)], names=["name", "copies", "label", "dim", "leaf", "earlier", "embedding"])

    return run


def compare(least: float):
    """Of the vectors of one leaf, or of two of its blocks: links of each vector, and a forest that joins the linked."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        one, two = key[3].as_py(), key[4].as_py()
        ids, copies, block = (table.column(c).to_numpy() for c in ("name", "copies", "block"))
        order = np.argsort(ids)
        ids, copies, block = ids[order], copies[order], block[order]
        x = unit(table.column("embedding").take(pa.array(order)).to_pylist())
        link = x @ x.T >= least
        if one != two:
            link &= block[:, None] != block[None, :]
        np.fill_diagonal(link, False)
        some = np.flatnonzero(link.any(axis=1))
        link, ids, copies = link[np.ix_(some, some)], ids[some], copies[some]
        label = np.arange(len(some))
        while len(some):
            least_near = np.minimum(label, np.where(link, label[None, :], len(some)).min(axis=1))
            least_near = least_near[least_near]
            if (least_near == label).all():
                break
            label = least_near
        new = link.copy()
        leaves = table.column("earlier").take(pa.array(order)).take(pa.array(some)).to_pylist()
        earlier = {c: k for k, c in enumerate(sorted({c for own in leaves for c in own}))}
        if earlier and len(some):
            inside = np.zeros((len(some), len(earlier)), dtype=np.float32)
            for k, own in enumerate(leaves):
                inside[k, [earlier[c] for c in own]] = 1
            new &= ~(inside @ inside.T > 0)
        return pa.table({"name": ids, "n": new.astype(np.int64) @ copies, "lead": ids[label]}, schema=pa.schema([("name", pa.int64()), ("n", pa.int64()), ("lead", pa.int64())]))

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors without a label, null, empty, zero or with null or non-finite components link
    with nothing, and vectors of different length or label never link. Rows with equal
    vectors are linked with each other. ``component_id`` is the smallest id that links reach;
    ``kept`` marks the rows with that id. A null id links with nothing and is never kept.
    Rows that repeat an id each count as a vector, with links and a component of its own.
    Other columns are ignored; an empty table gives no rows.
    """
    kind = dict(vectors.dtypes)[embedding]
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good &= F.coalesce(F.forall("embedding", fine), F.lit(False)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    marked = own.withColumn("good", good)
    usable = marked.where("good").drop("good")
    classes = usable.groupBy("label", "embedding").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # a class has a name of its own, fixed by the table: an id may stand in several
    classes = scratch.table(classes.withColumns({"dim": F.size("embedding"), "name": F.monotonically_increasing_id()}), "vectors")
    sample = [r["embedding"] for r in classes.orderBy(F.xxhash64("least", "label"), "least", "name").select("embedding").limit(FITTED).collect()]
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF))).cast("int")
    levels = sizes.select("label", "dim", depth.alias("depth"))
    rows = classes.join(levels, ["label", "dim"]).select("name", "copies", "label", "dim", "depth", "embedding")
    element = dict(classes.dtypes)["embedding"]
    placed = scratch.table(rows.mapInArrow(leaf_rows(fit_splits(sample)), f"name long, copies long, label string, dim int, leaf long, earlier array<long>, embedding {element}"), "leaves")
    held = placed.groupBy("label", "dim", "leaf").agg(F.count(F.lit(1)).alias("held"))
    large = held.where(F.col("held") > BLOCK).select("label", "dim", "leaf", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(large, ["label", "dim", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    met = scratch.table(dealt.groupBy("label", "dim", "leaf", "one", "two").applyInArrow(compare(least), "name long, n long, lead long"), "met")
    grouped = components(met.where("name <> lead").select(F.col("name").alias("u"), F.col("lead").alias("v")))
    grouped = grouped.select(F.col("id").alias("name"), F.col("label").alias("lead"))
    found = met.groupBy("name").agg(F.sum("n").alias("n"))
    whole = classes.join(found, "name", "left").join(grouped, "name", "left")
    whole = scratch.table(whole.select(F.col("label").alias("k"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("lead", "name").alias("lead"), "least"), "classes")
    smallest = whole.groupBy("lead").agg(F.min("least").alias("component_id"))
    whole = whole.join(smallest, "lead").select("k", "e", "n_links", "component_id")
    linked = usable.join(whole, (usable["label"] == whole["k"]) & (usable["embedding"] == whole["e"])).select("id", "n_links", "component_id")
    alone = marked.where(~F.col("good")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
