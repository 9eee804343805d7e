"""Lexical retrieval packing: windows filled with the seed document's BM25 neighbours.

Texts are encoded once and dealt by content to shards of about SHARD_BYTES of text each
(see ``dealing``). A shard holds a BM25 inverted index over token ids. A document's full
windows stand alone. What remains of the documents seeds windows in turn: the index
returns the seed's unused neighbours in lots, the best first, which fill the window whole
where they fit; the best of a lot's others is cut to fill it up and stays in the index with
the rest. Documents that share no term follow only when no neighbour is left. So only the
last window of a shard needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import dealing, textkit
from marlstone.llm.encoder import encoder
from marlstone.sources import scratch

WINDOW = 2048
END_ID = 1
SHARD_BYTES = 4 << 20
#: The seed's terms that are looked up at a time, the most telling first, and the neighbours put in order at a time.
QUERY_TERMS = 24
NEIGHBOURS = 32
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Index:
    """BM25 over token ids; the documents of one shard."""

    def __init__(self, ids: list[np.ndarray]):
        n = len(ids)
        length = np.array([len(x) for x in ids], dtype=np.int64)
        key = np.concatenate(ids).astype(np.int64) * n + np.repeat(np.arange(n), length)
        key, tf = np.unique(key, return_counts=True)
        self.doc, term = key % n, key // n
        self.term, self.at = np.unique(term, return_index=True)
        self.at = np.append(self.at, len(key))
        df = np.diff(self.at)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(length.mean(), 1e-9))
        row = np.repeat(np.arange(len(df)), df)
        self.weight = (idf[row] * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        # each document's terms, the most telling first
        order = np.lexsort((-self.weight, self.doc))
        self.own, self.own_at = row[order], np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=n))])
        self.n = n

    def neighbours(self, seed: int, free: np.ndarray) -> Iterator[np.ndarray]:
        """Unused documents that share a term with the seed, in lots, the best first, ties by place.

        Those that share one of the most telling terms come first; while more is asked for,
        the rest of them, and then those that share only the next terms, to the last term.
        """
        own = self.own[self.own_at[seed] : self.own_at[seed + 1]]
        seen = ~free
        for first in range(0, len(own), QUERY_TERMS):
            score = np.zeros(self.n, dtype=np.float32)
            for t in own[first : first + QUERY_TERMS]:
                a, b = self.at[t], self.at[t + 1]
                score[self.doc[a:b]] += self.weight[a:b]
            score[seen] = 0
            found = np.flatnonzero(score)
            seen[found] = True
            if len(found) > NEIGHBOURS:
                top = np.sort(np.argpartition(-score[found], NEIGHBOURS)[:NEIGHBOURS])
                best = found[top]
                yield best[np.argsort(-score[best], kind="stable")]
                found = np.delete(found, top)
                found = found[np.argsort(-score[found], kind="stable")]
            else:
                found = found[np.argsort(-score[found], kind="stable")]
            for at in range(0, len(found), NEIGHBOURS):
                yield found[at : at + NEIGHBOURS]


def pack_documents(ids: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each id of each document once."""
    out, sequence = [], 0
    at = np.zeros(len(ids), dtype=np.int64)
    left = np.array([len(x) for x in ids], dtype=np.int64)
    for d in np.flatnonzero(left >= window):
        for _ in range(left[d] // window):
            out.append((d, at[d], window, sequence, 0))
            sequence, at[d] = sequence + 1, at[d] + window
        left[d] %= window
    free, queue = left > 0, 0
    if not free.any():
        return out
    index = Index(ids)

    def put(d: int, room: int) -> int:
        take = min(int(left[d]), room)
        out.append((d, at[d], take, sequence, window - room))
        at[d] += take
        left[d] -= take
        free[d] = left[d] > 0
        return room - take

    while True:
        while queue < len(ids) and not free[queue]:
            queue += 1
        if queue == len(ids):
            return out
        seed, room = queue, put(queue, window)
        if room:
            for lot in index.neighbours(seed, free):
                cut = None
                for d in lot:
                    if left[d] <= room:
                        room = put(d, room)
                    elif cut is None:
                        cut = d
                    if not room:
                        break
                if room and cut is not None:
                    room = put(cut, room)
                if not room:
                    break
            at_queue = queue
            while room and at_queue < len(ids):  # no unused document shares a term: the next in line
                if free[at_queue]:
                    room = put(at_queue, room)
                at_queue += 1
        sequence += 1


def encode_rows(path: str):
    """(doc_id, text) to (doc_id, ids, size, place): the ids with the end id, the bytes of text, and for null ids the place in the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(path), np.array([END_ID], dtype=np.uint16).tobytes()
        first = TaskContext.get().partitionId() << 40
        for b in batches:
            for part in textkit.pieces(b, "text"):
                flat, at = code(part.column(1))
                ids = [flat[x:y].tobytes() + end for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                size = pc.add(pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64()), 16)
                place = pc.if_else(pc.is_null(part.column(0)), pa.array(first + np.arange(part.num_rows)), pa.scalar(0, pa.int64()))
                first += part.num_rows
                yield pa.record_batch([part.column(0), pa.array(ids, type=pa.binary()), size, place], names=["doc_id", "ids", "size", "place"])

    return run


def pack_shard(window: int):
    def run(key: tuple, shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        ids = dealing.as_ids(shard.column("ids"))
        names = shard.column("doc_id").to_pylist()
        rows = []
        for d, start, length, sequence, offset in pack_documents(ids, window):
            crc = zlib.crc32(ids[d][start : start + length].astype("<u4").tobytes())
            rows.append((names[d], start, length, crc, len(ids[d]), (key[0].as_py() << 32) + sequence, offset))
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        return pa.table([pa.array(list(c), type=pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def deal(coded: DataFrame, shards: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Add ``shard`` to rows of doc_id, ids, size and place, by content; equal texts are told apart by id, without one by place."""
    if shards == 1:
        return coded.select("doc_id", "ids", F.lit(0).cast("long").alias("shard"))
    spread = (F.pmod(F.xxhash64("doc_id", "ids", "place"), F.lit(1 << 20)) / F.lit(1 << 20)).alias("spread")
    n, total = coded.agg(F.count(F.lit(1)), F.sum("size")).first()
    leaves = min(shards, dealing.REGIONS)

    def sample(most: int, seed: int, share: float = 1.0) -> DataFrame:
        # half as many again are drawn, so that chance leaves enough
        return coded.where(F.pmod(F.xxhash64("ids", "doc_id", "place", F.lit(seed)), F.lit(1 << 30)) < int(min(share, 1.5 * most / n) * (1 << 30)))

    drawn = sample(dealing.BASIS_SAMPLE, 1, min(1.0, dealing.BASIS_BYTES / total)).select("ids").limit(dealing.BASIS_SAMPLE).collect()
    drawn = drawn or coded.select("ids").limit(1).collect()
    idf, directions = dealing.basis([np.frombuffer(r["ids"], dtype=np.uint16) for r in drawn])
    points = sample(dealing.TREE_SAMPLE * leaves, 2).select("ids", spread, "size").mapInArrow(dealing.vector_rows(idf, directions), "vector binary, size long").toArrow()
    x = np.frombuffer(b"".join(points.column("vector").to_pylist()), dtype=np.float32).reshape(-1, dealing.WIDTH + 1)
    cuts = dealing.tree(x, points.column("size").to_numpy().astype(np.float64), leaves)
    rows = coded.select("doc_id", "ids", spread, "size")
    if leaves == shards:
        return rows.mapInArrow(dealing.leaf_rows(idf, directions, cuts), "doc_id long, ids binary, shard long")
    # more shards than the tree has leaves: each leaf is a region, sliced along its last cut
    placed = rows.mapInArrow(dealing.leaf_rows(idf, directions, cuts, place=True), "doc_id long, ids binary, size long, region long, place float")
    order = ["region", "place", "doc_id"]
    sorted_ = placed.repartitionByRange(min(-(-shards // dealing.SLICED), dealing.TASKS), *order).sortWithinPartitions(*order, "ids")
    return sorted_.mapInArrow(dealing.slice_rows(shard_bytes), "doc_id long, ids binary, shard long")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are those of its whole text and one end id; null text is empty. Every
    row is packed for itself, repeated ids and null ids too. A sequence is ``window`` ids
    but for the last of each shard. Documents are dealt to shards by content and neighbours
    are searched within a shard, so that a document is used once without shards waiting for
    each other; ties go by id, then text. Other columns are ignored; an empty table gives
    no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    coded = scratch.table(own.mapInArrow(encode_rows(tokenizer_path), "doc_id long, ids binary, size long, place long"), "packing-ids")
    total = coded.agg(F.sum("size").alias("n")).first()["n"] or 0
    dealt = deal(coded, max(1, -(-total // shard_bytes)), shard_bytes)
    return dealt.groupBy("shard").applyInArrow(pack_shard(window), SCHEMA)
