"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of all orders,

    p(w | u v) = m3 c(uvw)/c(uv) + m2 c(vw)/c(v) + m1 c(w)/N + m0 1/(V+1)

where the weights m depend on how often the context was seen (buckets of its frequency).
They are learned by expectation-maximisation on counts that are held out: the n-grams of
one fold of the training documents, seen with that fold's own counts deleted.

Every n-gram of every training document is counted. Documents are gathered into chunks of
text; a chunk sends the hashes and counts of its distinct n-grams to the buckets of the
hash space, which add them up over all chunks and answer each chunk with the totals of
what it asked for. So a frequent n-gram is one entry of each chunk, and no task sees more
than one chunk or one bucket. Chunks and buckets both grow with the square root of the
text, up to MOST_BYTES, so that the rows between them grow with the text and not with its
square.

The weights are learned on a histogram of the held-out tokens: one cell for each bucket of
context frequency and rounded probability of each order, with the sums of the logarithms,
so that a cell stands for its tokens' mean and not for its middle.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkit
from marlstone.sources import scratch

ORDER = 2
#: Documents of this remainder (crc32 of the id as text, modulo 7) are held out of training.
FOLDS, HELD_OUT = 7, 2
#: Training documents of this remainder have their counts deleted to learn the weights.
DELETED = 3
#: Text of a chunk for the first GB of input; a bucket has half as much. Both grow with the root of the input, up to MOST_BYTES.
CHUNK_BYTES = 8 << 20
MOST_BYTES = 64 << 20
#: Buckets of context frequency are powers of two.
FREQUENCIES = 48
#: Probabilities on held-out counts are told apart by 1/STEPS of a decade; DECADES of them.
STEPS, DECADES = 4, 20
ROUNDS = 60
START, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x7C0FFEE5DEADBE11)
CHUNK = "chunk long, deleted boolean, ids array<long>, folds array<int>, sizes array<long>, blob binary"
ASK = "bucket int, chunk long, deleted boolean, gram int, hashes binary, counts binary"
#: Of a bucket as a whole: n-grams that occur in training, those that do without the deleted fold, occurrences in all and in that fold.
SUMS = ("types", "types_left", "tokens", "tokens_deleted")
ANSWER = "chunk long, deleted boolean, bucket int, gram int, totals binary, " + ", ".join(f"{c} long" for c in SUMS)


def sized(text_bytes: int) -> tuple[int, int]:
    """Bytes of text of a chunk, and how many buckets."""
    chunk = int(min(MOST_BYTES, max(CHUNK_BYTES, CHUNK_BYTES * (text_bytes / (1 << 30)) ** 0.5)))
    return chunk, int(max(8, -(-2 * text_bytes // chunk)))


def chunk_rows(chunk_bytes: int):
    """Of (doc_id, fold, text): compressed chunks, gathered over the partition; the deleted fold has chunks of its own."""
    schema = pa.schema([("chunk", pa.int64()), ("deleted", pa.bool_()), ("ids", pa.list_(pa.int64())), ("folds", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(flag: bool) -> pa.RecordBatch:
            ids, folds, sizes, data = zip(*held[flag], strict=True)
            row = {"chunk": [uuid.uuid4().int >> 65], "deleted": [flag], "ids": [sum(ids, [])], "folds": [sum(folds, [])], "sizes": [sum(sizes, [])], "blob": [pack.compress(b"".join(data))]}
            held[flag], size[flag] = [], 0
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for whole in batches:
            deleted = whole.column(1).to_numpy() == DELETED
            for flag in (False, True):
                part = whole.filter(pa.array(deleted == flag))
                for batch in textkit.pieces(part, "text", chunk_bytes) if part.num_rows else ():
                    data, offsets = textkit.buffers(batch.column(2))
                    if held[flag] and size[flag] + len(data) > chunk_bytes:
                        yield flush(flag)
                    held[flag].append((batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.diff(offsets).tolist(), data.tobytes()))
                    size[flag] += len(data)
        for flag in (False, True):
            if held[flag]:
                yield flush(flag)

    return run


class Chunk:
    """A chunk's tokens: every document's words and an end."""

    def __init__(self, sizes: list[int], blob: bytes):
        data = zstandard.ZstdDecompressor().decompress(blob) if blob else b""
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))
        hashes, counts, at = [], [], 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + textkit.PIECE_BYTES, side="right")) - 1)
            h, where = textkit.words(texts[at:to])
            hashes.append(h)
            counts.append(np.diff(where))
            at = to
        words, n = np.concatenate(hashes), np.concatenate(counts)
        self.at = np.concatenate([[0], np.cumsum(n + 1)])
        self.tokens = np.full(self.at[-1], END, dtype=np.uint64)
        inner = np.ones(len(self.tokens), dtype=bool)
        inner[self.at[1:] - 1] = False
        self.tokens[inner] = words
        self.owner = np.repeat(np.arange(len(n)), n + 1)

    def grams(self, order: int) -> np.ndarray:
        """Hash of the n-gram that ends at each token; before a document stand starts."""
        place = np.arange(len(self.tokens)) - self.at[self.owner]
        out = self.tokens.copy()
        for k in range(1, order):
            before = np.full(len(out), START, dtype=np.uint64)
            before[k:] = self.tokens[:-k] if k < len(out) else before[k:]
            before[place < k] = START
            out = textkit.scramble(out + before * np.uint64(0xBF58476D1CE4E5B9 + 2 * k))
        return out


def pack_hashes(h: np.ndarray, order: int) -> bytes:
    """Eight bytes each, for any order."""
    return h.tobytes()


def unpack_hashes(raw: bytes, order: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64)


def squeeze(x: np.ndarray) -> bytes:
    """Counts in four bytes each, or eight where one needs them."""
    width = np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64
    return bytes([np.dtype(width).itemsize]) + zlib.compress(x.astype(width).tobytes(), 1)


def expand(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(memoryview(raw)[1:]), dtype=f"<u{raw[0]}").astype(np.int64)


def chunks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def ask_rows(order: int, buckets: int):
    """What each chunk sends: its distinct n-grams with their counts in its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("deleted", pa.bool_()), ("gram", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
        for row in chunks_in(batches):
            chunk = Chunk(row["sizes"], row["blob"])
            trained = (np.array(row["folds"]) != HELD_OUT)[chunk.owner]
            for gram in range(1, order + 1):
                h, back = np.unique(chunk.grams(gram), return_inverse=True)
                counts = np.bincount(back[trained], minlength=len(h))
                cuts = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
                full = np.flatnonzero(np.diff(cuts))
                for lot in np.array_split(full, -(-len(full) // 64)) if len(full) else ():
                    parts = [slice(cuts[b], cuts[b + 1]) for b in lot]
                    out = {"bucket": lot, "chunk": [row["chunk"]] * len(lot), "deleted": [row["deleted"]] * len(lot), "gram": [gram] * len(lot), "hashes": [pack_hashes(h[x], gram) for x in parts], "counts": [squeeze(counts[x]) for x in parts]}
                    yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def add_up(key: tuple, asked: pa.Table) -> pa.Table:
    """Totals of one bucket and order for each chunk that asked, and one row of SUMS without a chunk."""
    bucket, gram = (x.as_py() for x in key)
    rows = asked.select(["chunk", "deleted", "hashes", "counts"]).to_pylist()
    hashes, counts = [unpack_hashes(r["hashes"], gram) for r in rows], [expand(r["counts"]) for r in rows]
    names, back = np.unique(np.concatenate(hashes), return_inverse=True)
    flat, gone = np.concatenate(counts), np.repeat([r["deleted"] for r in rows], [len(h) for h in hashes])
    total, deleted = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    np.add.at(total, back, flat)
    np.add.at(deleted, back[gone], flat[gone])
    sums = dict(zip(SUMS, ((total > 0).sum(), (total > deleted).sum(), total.sum(), deleted.sum()), strict=True))
    out = [{"chunk": None, "deleted": False, "totals": None, **sums}]
    at = 0
    for r, h in zip(rows, hashes, strict=True):
        own = back[at : at + len(h)]
        at += len(h)
        told = np.concatenate([total[own], deleted[own]]) if r["deleted"] else total[own]
        out.append({"chunk": r["chunk"], "deleted": r["deleted"], "totals": squeeze(told)})
    kinds = [("chunk", pa.int64()), ("deleted", pa.bool_()), ("bucket", pa.int32()), ("gram", pa.int32()), ("totals", pa.binary()), *((c, pa.int64()) for c in SUMS)]
    return pa.Table.from_pylist([{"bucket": bucket, "gram": gram, **r} for r in out], schema=pa.schema(kinds))


def totals_of(chunk: Chunk, answers: list[dict], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: count of the n-gram at every token, and the deleted fold's part of it."""
    out = []
    for gram in range(1, order + 1):
        own = sorted((a for a in answers if a["gram"] == gram), key=lambda a: a["bucket"])
        both = [(x[: len(x) // 2], x[len(x) // 2 :]) if a["deleted"] else (x, np.zeros(len(x), dtype=np.int64)) for a in own for x in [expand(a["totals"])]]
        _, back = np.unique(chunk.grams(gram), return_inverse=True)
        total, gone = (np.concatenate([b[k] for b in both]) for k in (0, 1))
        out.append((total[back], gone[back]))
    return out


def estimates(counts: list[np.ndarray], first: np.ndarray, docs: int, tokens: int, types: int) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities by order (0: uniform) at every token, and the bucket of its context's frequency.

    counts: of the n-grams that end at each token. A context of k words was seen as often as
    the k-gram that ends one token earlier; at a document's start, once in each document.
    """
    p = np.zeros((len(counts) + 1, len(first)))
    p[0] = 1 / (types + 1)
    p[1] = counts[0] / max(tokens, 1)
    context = np.full(len(first), tokens, dtype=np.int64)
    for k in range(1, len(counts)):
        context = np.concatenate([[0], counts[k - 1][:-1]])
        context[first] = docs
        p[k + 1] = np.where(context > 0, counts[k] / np.maximum(context, 1), 0)
    return p, np.minimum(np.log2(context + 1).astype(np.int64), FREQUENCIES - 1)


def cells(p: np.ndarray, bucket: np.ndarray) -> dict[str, np.ndarray]:
    """The histogram of tokens: cell, tokens in it, and for each order the sum of log10 p (0 where p is 0)."""
    code, logs = bucket, [np.where(x > 0, np.log10(np.where(x > 0, x, 1)), 0) for x in p[1:]]
    for x, log in zip(p[1:], logs, strict=True):
        code = code * (STEPS * DECADES + 2) + np.where(x > 0, 1 + np.clip(np.round(-STEPS * log), 0, STEPS * DECADES), 0).astype(np.int64)
    code, back, n = np.unique(code, return_inverse=True, return_counts=True)
    return {"code": code, "n": n} | {f"log{k}": np.bincount(back, weights=x, minlength=len(code)) for k, x in enumerate(logs, 1)}


def learn_rows(order: int, docs: int, tokens: int, types: int):
    """Cells of the deleted fold's tokens, with that fold's counts deleted."""
    empty = np.zeros((order + 1, 0)), np.zeros(0, dtype=np.int64)

    def run(key: tuple, chunks: pa.Table, answers: pa.Table) -> pa.Table:
        found = answers.to_pylist()
        seen = [empty]
        for row in chunks.to_pylist():
            chunk = Chunk(row["sizes"], row["blob"])
            counts = [a - b for a, b in totals_of(chunk, found, order)]
            first = np.zeros(len(chunk.tokens), dtype=bool)
            first[chunk.at[:-1]] = True
            seen.append(estimates(counts, first, docs, tokens, types))
        return pa.table(cells(*(np.concatenate(x, axis=-1) for x in zip(*seen, strict=True))))

    return run


def learn_weights(bucket: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Weights (context bucket, order) by expectation-maximisation over rows of n tokens with probabilities p[order]."""
    overall = np.full(len(p), 1 / len(p))
    for _ in range(ROUNDS if len(n) else 0):
        part = overall[:, None] * p
        overall = (part / part.sum(axis=0) * n).sum(axis=1) + 1e-3
        overall /= overall.sum()
    weights = np.tile(overall, (FREQUENCIES, 1))
    for b in np.unique(bucket):
        own, m = bucket == b, overall
        for _ in range(ROUNDS):
            part = m[:, None] * p[:, own]
            m = (part / part.sum(axis=0) * n[own]).sum(axis=1) + overall  # one token of the overall mixture
            m /= m.sum()
        weights[b] = m
    return np.maximum(weights, 1e-9) / np.maximum(weights, 1e-9).sum(axis=1, keepdims=True)


def weights_of(held: pa.Table, order: int, types: int) -> np.ndarray:
    """The weights learned on a histogram."""
    code, n = held.column("code").to_numpy(), held.column("n").to_numpy().astype(np.float64)
    base, p = STEPS * DECADES + 2, np.full((order + 1, len(code)), 1 / (types + 1))
    for k in range(order, 0, -1):
        p[k] = np.where(code % base > 0, 10.0 ** (held.column(f"log{k}").to_numpy() / np.maximum(n, 1)), 0)
        code = code // base
    return learn_weights(code, n, p)


def score_rows(order: int, docs: int, tokens: int, types: int, weights: np.ndarray):
    def run(key: tuple, chunks: pa.Table, answers: pa.Table) -> pa.Table:
        found, out = answers.to_pylist(), []
        for row in chunks.to_pylist():
            chunk = Chunk(row["sizes"], row["blob"])
            counts = [a for a, _ in totals_of(chunk, found, order)]
            first = np.zeros(len(chunk.tokens), dtype=bool)
            first[chunk.at[:-1]] = True
            p, bucket = estimates(counts, first, docs, tokens, types)
            mixed = np.log10((weights[bucket].T * p).sum(axis=0))
            base = np.log10((counts[0] + 1) / (tokens + types + 1))
            at = chunk.at[:-1]
            sums = [np.add.reduceat(x, at) for x in ((counts[0] > 0).astype(np.int64), base, mixed)]
            out.append(pa.table({"doc_id": pa.array(row["ids"], type=pa.int64()), "held_out": np.array(row["folds"]) == HELD_OUT, "n_tokens": np.diff(chunk.at), "n_known": sums[0], "train_tokens": np.full(len(at), tokens), "base_score": sums[1], "score": sums[2]}))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every row of ``docs`` under the model learned from its training rows.

    Null text is empty (one end token). A null id counts as the empty text for the folds.
    Repeated rows count as often as they stand and are each scored. Without training rows
    all counts are 0 and every token has the uniform probability. An empty table gives no
    rows; other columns are ignored.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), fold.alias("fold"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunk_bytes, buckets = sized(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    chunks = scratch.table(own.mapInArrow(chunk_rows(chunk_bytes), CHUNK), "chunks")
    asked = chunks.mapInArrow(ask_rows(order, buckets), ASK)
    answers = scratch.table(asked.groupBy("bucket", "gram").applyInArrow(add_up, ANSWER), "answers")
    types, types_left, tokens, tokens_deleted = (x or 0 for x in answers.where("chunk is null and gram = 1").agg(*(F.sum(c) for c in SUMS)).first())
    trained = chunks.select("deleted", F.size(F.filter("folds", lambda f: f != HELD_OUT)).alias("docs"))
    n_docs, n_deleted = (x or 0 for x in trained.agg(F.sum("docs"), F.sum(F.when(F.col("deleted"), F.col("docs")).otherwise(0))).first())
    answered = answers.where("chunk is not null").select("chunk", "deleted", "bucket", "gram", "totals")
    part = chunks.where("deleted").groupBy("chunk").cogroup(answered.where("deleted").groupBy("chunk"))
    logs = [f"log{k}" for k in range(1, order + 1)]
    learned = part.applyInArrow(learn_rows(order, n_docs - n_deleted, tokens - tokens_deleted, types_left), "code long, n long, " + ", ".join(f"{c} double" for c in logs))
    # at most FREQUENCIES * (STEPS * DECADES + 2)**order rows, whatever the input
    held = learned.groupBy("code").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in logs)).toArrow().sort_by("code")
    weights = weights_of(held, order, types_left)
    whole = chunks.groupBy("chunk").cogroup(answered.groupBy("chunk"))
    return whole.applyInArrow(score_rows(order, n_docs, tokens, types, weights), SCORES)
