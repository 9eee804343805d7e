"""Documents dealt to shards by content, so that related ones meet in the same shard.

A sample of documents gives the telling terms and the main directions of their weights.
Each document becomes a short vector, and a tree over a sample of the vectors cuts the
table into shards of equal size, each cut along the widest direction of its part. A small
share of a hash in each cut splits groups of equal vectors that are larger than a shard.
The tree has a bounded number of leaves. Where more shards are needed, its leaves are
regions, whose rows are sorted by Spark along the direction of the region's last cut and
sliced into shards, so that neither the driver nor a task holds more than that tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Documents that the directions are taken from, about so many bytes of them at most, and vectors for the tree for each leaf.
BASIS_SAMPLE = 4096
BASIS_BYTES = 64 << 20
TREE_SAMPLE = 32
#: Leaves of the tree at most: 34 MB of vectors on the driver, 1 MB of cuts in tasks.
REGIONS = 4096
#: Shards that a task slices regions into, about; the bits that number them, and tasks, so that shards have numbers below 2**31.
SLICED = 32
SLICE_BITS = 11
TASKS = 1 << 20
WIDTH = 64
TERMS = 1 << 16
#: The share of the hash in a cut; vectors have length 1.
SPREAD = 1e-3
#: Documents, and terms of documents, that are worked on at a time, for the memory of 64 numbers for each term of each.
LOT = 64
TURNED = 1 << 15


def weights(ids: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, weight) of the terms that have one; a document's weights have length 1."""
    n = len(ids)
    key = np.repeat(np.arange(n), [len(x) for x in ids]) * TERMS + np.concatenate(ids).astype(np.int64)
    key, tf = np.unique(key, return_counts=True)
    doc, term = key // TERMS, key % TERMS
    w = idf[term] * tf / (tf + 1.2)
    doc, term, w = doc[w > 0], term[w > 0], w[w > 0]
    norm = np.sqrt(np.bincount(doc, w * w, minlength=n))
    return doc, term, (w / norm[doc]).astype(np.float32)


def summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows by ``at``, which is sorted."""
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    if len(at):
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[starts]] = np.add.reduceat(rows, starts)
    return out


def basis(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(idf, directions) of a sample; terms of one document or of none have no weight."""
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=TERMS)
    idf = np.where(df > 1, np.log1p((len(ids) - df + 0.5) / (df + 0.5)), 0.0)

    def lot(a: int) -> tuple:
        doc, term, w = weights(ids[a : a + LOT], idf)
        return (doc + a).astype(np.int32), term.astype(np.int32), w

    doc, term, w = map(np.concatenate, zip(*map(lot, range(0, len(ids), LOT)), strict=True))
    turned = np.argsort(term, kind="stable").astype(np.int32)
    cut = np.searchsorted(doc, np.arange(0, len(ids) + LOT, LOT))

    def across(x: np.ndarray) -> np.ndarray:
        return np.concatenate([summed(x[term[a:b]] * w[a:b, None], doc[a:b] - k * LOT, LOT) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))])

    def back(y: np.ndarray) -> np.ndarray:
        out = np.zeros((TERMS, WIDTH), dtype=np.float32)
        for a in range(0, len(turned), TURNED):
            k = turned[a : a + TURNED]
            first = np.flatnonzero(np.r_[True, term[k][1:] != term[k][:-1]])
            out[term[k][first]] += np.add.reduceat(y[doc[k]] * w[k, None], first)
        return out

    drawn = np.random.default_rng(7)
    x = np.concatenate([drawn.standard_normal((TERMS // 16, WIDTH)).astype(np.float32) for _ in range(16)])
    for _ in range(3):
        x = np.linalg.qr(back(across(x)))[0].astype(np.float32)
    return idf.astype(np.float32), x.astype(np.float16)


def vectors(ids: list[np.ndarray], spread: np.ndarray, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A row of WIDTH numbers and the hash for each document."""
    out = np.zeros((len(ids), WIDTH + 1), dtype=np.float32)
    for a in range(0, len(ids), LOT):
        lot = ids[a : a + LOT]
        doc, term, w = weights(lot, idf)
        out[a : a + len(lot), :-1] = summed(directions[term].astype(np.float32) * w[:, None], doc, len(lot))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out /= np.where(norm > 0, norm, 1)
    out[:, -1] = spread
    return out


def tree(x: np.ndarray, size: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, bounds, children) of cuts into parts of equal size; a child below 0 is shard -1 - child."""
    cuts = max(1, shards - 1)
    direction, bound, child = np.zeros((cuts, x.shape[1]), np.float32), np.zeros(cuts, np.float32), np.full((cuts, 2), -1, np.int64)
    work, made, leaves = [(np.arange(len(x)), shards, None)], 0, 0
    while work:
        rows, k, place = work.pop()
        if k == 1:
            if place is not None:
                child[place] = -1 - leaves
            leaves += 1
            continue
        node, made = made, made + 1
        if place is not None:
            child[place] = node
        if len(rows) > 1:
            own = x[rows, :-1] - x[rows, :-1].mean(axis=0)
            direction[node, :-1] = np.linalg.eigh(own.T.astype(np.float64) @ own)[1][:, -1]
        direction[node, -1] = SPREAD
        value = x[rows] @ direction[node]
        by = np.argsort(value, kind="stable")
        if len(rows):
            filled = np.cumsum(size[rows][by])
            bound[node] = value[by][np.searchsorted(filled, filled[-1] * (k // 2) / k)]
        low = value < bound[node]
        work += [(rows[~low], k - k // 2, (node, 1)), (rows[low], k // 2, (node, 0))]
    return direction, bound, child


def leaf_of(x: np.ndarray, cuts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each row, and its place along the direction of the leaf's last cut."""
    direction, bound, child = cuts
    at, place = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.float32)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        place[inner] = np.einsum("ij,ij->i", x[inner], direction[node])
        at[inner] = child[node, (place[inner] >= bound[node]).astype(int)]
    return -1 - at, place


def as_ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint16) for b in column.to_pylist()]


def vector_rows(idf: np.ndarray, directions: np.ndarray):
    """(ids, spread, size) to (vector, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = vectors(as_ids(b.column(0)), b.column(1).to_numpy(), idf, directions)
                yield pa.record_batch([pa.array([r.tobytes() for r in x]), b.column(2)], names=["vector", "size"])

    return run


def leaf_rows(idf: np.ndarray, directions: np.ndarray, cuts: tuple, place: bool = False):
    """(doc_id, ids, spread, size) to (doc_id, ids, shard), or with ``place`` to (doc_id, ids, size, region, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf, at = leaf_of(vectors(as_ids(b.column(1)), b.column(2).to_numpy(), idf, directions), cuts)
                if place:
                    yield pa.record_batch([b.column(0), b.column(1), b.column(3), pa.array(leaf), pa.array(at)], names=["doc_id", "ids", "size", "region", "place"])
                else:
                    yield pa.record_batch([b.column(0), b.column(1), pa.array(leaf)], names=["doc_id", "ids", "shard"])

    return run


def slice_rows(shard_bytes: int):
    """(doc_id, ids, size, region, ...), sorted by region and place, to (doc_id, ids, shard): a shard is full at that size and lies in one region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, filled, last = TaskContext.get().partitionId() << SLICE_BITS, -1, 0, None
        for b in batches:
            shard = []
            for size, region in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if region != last or filled >= shard_bytes:
                    made, filled, last = made + 1, 0, region
                filled += size
                shard.append(first + made)
            if made >> SLICE_BITS:
                raise ValueError(f"a task of {made + 1} shards; their numbers would meet those of the next")
            yield pa.record_batch([b.column(0), b.column(1), pa.array(shard, type=pa.int64())], names=["doc_id", "ids", "shard"])

    return run
