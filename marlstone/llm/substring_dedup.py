"""Substring dedup: words covered by a passage that a document with a smaller id has too are removed.

The reference is the whole corpus, so it is sharded by content. The windows of 13 words of a document are cut into
pieces: runs of windows whose least hash of four neighbouring words, their anchor, is the same. Equal windows have
equal anchors, so a shard, the pieces of some anchors, has all occurrences of its windows. In each shard a suffix
automaton is built of the different pieces in the order of their least document; a state knows the first document
that has its strings. The shard's pieces are streamed through it for matching statistics, and of each place where at
least 13 words match, the state of the last 13 tells the least document with this window. Windows with a smaller
document than their own are removed, and neighbouring ones make the maximal spans.

The automata of a corpus have no bounded size, so they are not broadcast: pieces go to the automaton of their shard.
Documents are held in chunks. A chunk sends its different anchors to buckets, which answer which of them other chunks
have too; then it sends its different pieces with repeated anchors, once each; the answer is a bit for each window.
Anchors with very many pieces (a passage in a third of all documents, in other surroundings each time) are cut to
single windows, dealt by their own hash. So no group grows with the copies of a passage, but for a row a chunk.

Words are told apart by 40 bits of hash in their place within 13, so only windows equal but for such words can be
mistaken. Null texts have no words. Documents with a null id have no smaller document and are none: nothing is removed
from them or because of them. Rows that share an id are no reason for each other. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkit
from marlstone.sources import scratch

WIDTH = 13
#: Words of an anchor, and the most windows of a piece.
ANCHOR, LONGEST = 4, 16
#: Bytes of text of a chunk, of anchors of a bucket, and symbols of a shard, about.
CHUNK_BYTES, BUCKET_BYTES, SHARD_SYMBOLS = 8 << 20, 16 << 20, 1 << 20
#: Pieces of an anchor from which on it is cut to windows.
HOT = 4096
SYMBOL_BYTES = 5
RESULT = "doc_id long, n_words long, n_removed long, text string"
_MESSAGE = "chunk long, bucket int, data binary"
MESSAGE = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
CODES, BITS = -1, -2


class Chunk:
    """Words of some documents, and their pieces."""

    def __init__(self, ids: pa.Array, texts: pa.Array, width: int = WIDTH):
        self.data, self.offsets = textkit.buffers(texts)
        solid = ~textkit._SPACE[self.data]
        self.h, self.starts, self.ends, self.at = textkit.units(self.data, self.offsets, textkit.word_starts(solid, self.offsets), solid, textkit.EXACT)
        self.known = np.array(ids.is_valid())
        self.ids = ids.fill_null(0).to_numpy()
        self.width, self.n = width, len(self.h)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.at))
        m = self.n - width + 1
        if m <= 0:
            self.start = self.size = self.doc = np.zeros(0, dtype=np.int64)
            self.anchor = np.zeros(0, dtype=np.uint64)
            return
        gram = np.zeros(self.n - ANCHOR + 1, dtype=np.uint64)
        for k in range(ANCHOR):
            gram = gram * textkit._STEP + self.h[k : k + len(gram)]
        least = sliding_min(textkit.scramble(gram), width - ANCHOR + 1)
        whole = (doc[:m] == doc[width - 1 :]) & self.known[doc[:m]]
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (doc[1:m] != doc[: m - 1]) | (least[1:] != least[:-1])
        # a run of windows with one anchor may be as long as its text: it is cut
        run = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        new |= whole & ((np.arange(m) - run) % LONGEST == 0)
        self.start = np.flatnonzero(new)
        stop = whole.copy()
        stop[:-1] &= new[1:] | ~whole[1:]
        self.size = np.flatnonzero(stop) + 1 - self.start
        self.anchor, self.doc = least[self.start], doc[self.start]

    def contents(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of each piece's words."""
        out = size.astype(np.uint64) * textkit.EMPTY
        for k in range(int(size.max(initial=0)) + self.width - 1):
            live = k < size + self.width - 1
            out[live] = textkit.scramble(out[live] * textkit._STEP + self.h[start[live] + k])
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different anchors in order, how many different pieces each has here, and whether documents of two ids have it."""
        _, one = np.unique(self.contents(self.start, self.size), return_index=True)
        names, count = np.unique(self.anchor[one], return_counts=True)
        ids, of = self.ids[self.doc], np.searchsorted(names, self.anchor)
        low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(low, of, ids)
        np.maximum.at(high, of, ids)
        return names, count, low < high

    def plan(self, codes: np.ndarray, shards: int) -> Plan:
        """What is sent to shards: the different pieces of repeated anchors; those of hot ones (code 2) window by window."""
        names, _, twice = self.anchors()
        codes = np.where(twice, np.maximum(codes, 1), codes)[np.searchsorted(names, self.anchor)] if len(names) else codes
        warm, hot = np.flatnonzero(codes == 1), np.flatnonzero(codes == 2)
        size = self.size[hot]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start = np.concatenate([self.start[warm], np.repeat(self.start[hot], size) + step])
        doc = np.concatenate([self.doc[warm], np.repeat(self.doc[hot], size)])
        sizes = np.concatenate([self.size[warm], np.ones(size.sum(), dtype=np.int64)])
        content = self.contents(start, sizes)
        key = np.concatenate([self.anchor[warm], content[len(warm) :]])
        return Plan(self, start, sizes, doc, content, (textkit.scramble(key) % np.uint64(max(shards, 1))).astype(np.int64))


class Plan:
    """Occurrences of pieces in a chunk, and the different ones in the order in which they are sent."""

    def __init__(self, chunk: Chunk, start, size, doc, content, shard):
        self.chunk, self.start, self.size, self.ids = chunk, start, size, chunk.ids[doc]
        _, one, self.of = np.unique(content, return_index=True, return_inverse=True)
        order = np.argsort(shard[one], kind="stable")
        rank = np.empty(len(one), dtype=np.int64)
        rank[order] = np.arange(len(one))
        self.one, self.of = one[order], rank[self.of]
        self.shard = shard[self.one]
        self.first = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.of, self.ids)

    def messages(self) -> Iterator[tuple[int, bytes]]:
        symbols = self.chunk.h.view(np.uint8).reshape(-1, 8)[:, :SYMBOL_BYTES]
        names, begin = np.unique(self.shard, return_index=True)
        for name, a, z in zip(names.tolist(), begin.tolist(), np.append(begin, len(self.shard))[1:].tolist(), strict=True):
            size, start = self.size[self.one[a:z]], self.start[self.one[a:z]]
            words = size + self.chunk.width - 1
            place = np.repeat(start - (np.cumsum(words) - words), words) + np.arange(words.sum())
            yield name, np.uint32(z - a).tobytes() + size.astype(np.uint8).tobytes() + self.first[a:z].astype("<i8").tobytes() + symbols[place].tobytes()

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Whether each word of the chunk goes; ``answers``: of each shard, the bits of the windows of what was sent."""
        size = self.size[self.one]
        bits = np.zeros(size.sum(), dtype=bool)
        at = np.concatenate([[0], np.cumsum(size)])
        for name, data in answers.items():
            a, z = np.searchsorted(self.shard, [name, name + 1])
            bits[at[a] : at[z]] = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=int(at[z] - at[a])).astype(bool)
        step = np.arange(self.size.sum()) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        later = np.repeat(self.ids > self.first[self.of], self.size)  # a smaller document of this chunk has the same piece
        gone = later | bits[np.repeat(at[self.of], self.size) + step]
        change = np.zeros(self.chunk.n + 1, dtype=np.int64)
        begin = (np.repeat(self.start, self.size) + step)[gone]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + self.chunk.width, -1)
        return np.cumsum(change)[:-1] > 0


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out, done = np.minimum(out[:-step], out[step:]), done + step
    return out


class Automaton:
    """Suffix automaton of sequences added in the order of their documents; a state knows the first document that has it."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def add(self, symbols: list[int], doc: int) -> None:
        last = 0
        for c in symbols:
            last = self.extend(last, c, doc)

    def state(self, length: int, doc: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        self.first.append(doc)
        return len(self.next) - 1

    def split(self, p: int, c: int, q: int) -> int:
        """A state for the strings of ``q`` that are no longer than those of ``p`` and one symbol."""
        copy = self.state(self.length[p] + 1, self.first[q], self.next[q].copy())
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def extend(self, p: int, c: int, doc: int) -> int:
        q = self.next[p].get(c)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self.split(p, c, q)
        new = self.state(self.length[p] + 1, doc, {})
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, c, q)
        return new

    def firsts(self, symbols: list[int], width: int) -> list[int | None]:
        """Matching statistics: for each place from the ``width``-th on, the first document whose text has the last ``width`` symbols."""
        v, matched, out = 0, 0, []
        next_, link, length, first = self.next, self.link, self.length, self.first
        for k, c in enumerate(symbols):
            while v and c not in next_[v]:
                v = link[v]
                matched = length[v]
            if c in next_[v]:
                v, matched = next_[v][c], matched + 1
            if matched > width:
                matched = width
                while length[link[v]] >= width:
                    v = link[v]
            if k + 1 >= width:
                out.append(first[v] if matched == width else None)
        return out


def held(docs: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Documents in lots of about so many bytes of text."""
    lot, size = [], 0
    for b in docs:
        for part in textkit.pieces(b, "text", min(most, textkit.PIECE_BYTES)):
            lot.append(part)
            size += int(textkit.buffers(part.column(1))[1][-1])
            if size >= most:
                yield pa.Table.from_batches(lot)
                lot, size = [], 0
    if lot:
        yield pa.Table.from_batches(lot)


def chunk_of(table: pa.Table, width: int) -> Chunk:
    table = table.combine_chunks()
    ids, texts = (x.chunk(0) if x.num_chunks else pa.array([], type=x.type) for x in table.columns)
    return Chunk(ids, texts, width)


def packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def chunk_rows(most: int, width: int):
    """(doc_id, text) to (chunk, docs, anchors, counts, own): chunks of documents, their anchors, how many pieces those have, and how many repeated pieces are known here."""
    kinds = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("anchors", pa.binary()), ("counts", pa.binary()), ("own", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for table in held(batches, most):
            names, count, twice = chunk_of(table, width).anchors()
            yield pa.record_batch([pa.array([x]) for x in (chunk, packed(table), names.tobytes(), np.minimum(count, 255).astype(np.uint8).tobytes(), int(count[twice].sum()))], schema=kinds)
            chunk += 1

    return run


def bucket_rows(buckets: int):
    """(chunk, anchors, counts) to a message for each bucket: anchors, then counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, anchors, counts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                anchors, counts = np.frombuffer(anchors, dtype=np.uint64), np.frombuffer(counts, dtype=np.uint8)
                of = (textkit.scramble(anchors) % np.uint64(buckets)).astype(np.int64)
                for k in np.unique(of):
                    yield message(chunk, k, anchors[of == k].tobytes() + counts[of == k].tobytes())

    return run


def message(chunk: int, bucket: int, data: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([chunk]), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], schema=MESSAGE)


def shared_anchors(hot: int):
    """A bucket's messages to (chunk, bucket, data, pieces): for each anchor that was sent 0, 1 (in several chunks) or 2 (and in very many pieces)."""

    def run(rows: pa.Table) -> pa.Table:
        data = rows.column("data").to_pylist()
        n = [len(x) // 9 for x in data]
        anchors = np.concatenate([np.frombuffer(x, dtype=np.uint64, count=k) for x, k in zip(data, n, strict=True)])
        counts = np.concatenate([np.frombuffer(x, dtype=np.uint8, offset=8 * k) for x, k in zip(data, n, strict=True)]).astype(np.int64)
        _, of, chunks = np.unique(anchors, return_inverse=True, return_counts=True)
        pieces = np.bincount(of, weights=counts)
        code = np.where(pieces > hot, 2, (chunks > 1).astype(np.int64)).astype(np.uint8)[of]
        at = np.concatenate([[0], np.cumsum(n)]).tolist()
        own = [code[a:z] for a, z in zip(at, at[1:])]
        total = [int(counts[a:z][code[a:z] > 0].sum()) for a, z in zip(at, at[1:])]
        return pa.table([rows.column("chunk"), rows.column("bucket"), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(total, pa.int64())], names=["chunk", "bucket", "data", "pieces"])

    return run


def codes_of(names: np.ndarray, rows: dict[int, bytes], buckets: int) -> np.ndarray:
    """The buckets' answers in the order of a chunk's anchors."""
    out = np.zeros(len(names), dtype=np.int64)
    of = (textkit.scramble(names) % np.uint64(buckets)).astype(np.int64)
    for k, data in rows.items():
        out[of == k] = np.frombuffer(data, dtype=np.uint8)
    return out


def answered(rows: pa.Table) -> tuple[dict[int, bytes], dict[int, bytes]]:
    """Answers of buckets and of shards, by their number."""
    out: tuple[dict, dict] = {}, {}
    for kind, k, data in zip(*(rows.column(c).to_pylist() for c in ("kind", "bucket", "data")), strict=True):
        out[kind == BITS][k] = data
    return out


def piece_rows(buckets: int, shards: int, width: int):
    """A chunk and its anchors' answers to messages for shards."""

    def run(chunk: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        for number, docs in zip(chunk.column("chunk").to_pylist(), chunk.column("docs").to_pylist(), strict=True):
            own = chunk_of(unpacked(docs), width)
            names = own.anchors()[0]
            out += [message(number, k, data) for k, data in own.plan(codes_of(names, answered(rows)[0], buckets), shards).messages()]
        return pa.Table.from_batches(out, MESSAGE)

    return run


def shard_answers(width: int):
    """A shard's messages to (chunk, bucket, data): for each window sent, whether a document smaller than the piece's first has it."""

    def run(rows: pa.Table) -> pa.Table:
        sent, least = [], {}
        for data in rows.column("data").to_pylist():
            n = int(np.frombuffer(data, dtype=np.uint32, count=1)[0])
            size = np.frombuffer(data, dtype=np.uint8, offset=4, count=n).astype(np.int64)
            first = np.frombuffer(data, dtype="<i8", offset=4 + n, count=n).tolist()
            to = np.cumsum(size + width - 1) * SYMBOL_BYTES + 4 + 9 * n
            pieces = [data[a:z] for a, z in zip([4 + 9 * n, *to[:-1].tolist()], to.tolist(), strict=True)]
            sent.append((pieces, first))
            for piece, doc in zip(pieces, first, strict=True):
                if least.get(piece, doc) >= doc:
                    least[piece] = doc
        symbols = {}
        for piece in least:
            raw = np.zeros((len(piece) // SYMBOL_BYTES, 8), dtype=np.uint8)
            raw[:, :SYMBOL_BYTES] = np.frombuffer(piece, dtype=np.uint8).reshape(-1, SYMBOL_BYTES)
            symbols[piece] = raw.view(np.int64)[:, 0].tolist()
        automaton = Automaton()
        for piece in sorted(least, key=least.get):
            automaton.add(symbols[piece], least[piece])
        found = {piece: automaton.firsts(x, width) for piece, x in symbols.items()}
        bits = [np.packbits([x < doc for piece, doc in zip(*one, strict=True) for x in found[piece]]).tobytes() for one in sent]
        return pa.table([rows.column("chunk"), rows.column("bucket"), pa.array(bits, pa.binary())], schema=MESSAGE)

    return run


def result_rows(buckets: int, shards: int, width: int):
    """A chunk and all answers to RESULT."""

    def run(chunk: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        for docs in chunk.column("docs").to_pylist():
            table = unpacked(docs)
            own = chunk_of(table, width)
            codes, bits = answered(rows)
            gone = own.plan(codes_of(own.anchors()[0], codes, buckets), shards).removed(bits)
            out.append(kept(own, table.column(0), gone))
        return pa.concat_tables(out) if out else pa.table([pa.array([], k) for k in (pa.int64(),) * 3 + (pa.string(),)], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def kept(chunk: Chunk, ids: pa.ChunkedArray, gone: np.ndarray) -> pa.Table:
    """Each document's words that stay, joined by one space."""
    stay = np.flatnonzero(~gone)
    size = chunk.ends[stay] - chunk.starts[stay] + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(to[-1], 32, dtype=np.uint8)
    place = np.arange(to[-1]) - np.repeat(to[:-1], size)
    inside = place < np.repeat(size - 1, size)
    out[inside] = chunk.data[(np.repeat(chunk.starts[stay], size) + place)[inside]]
    raw, cuts = out.tobytes(), to[np.searchsorted(stay, chunk.at)].tolist()
    texts = pa.array([raw[a : max(a, z - 1)] for a, z in zip(cuts, cuts[1:])], pa.binary()).cast(pa.string())
    before = np.concatenate([[0], np.cumsum(gone)])
    return pa.table([ids.combine_chunks(), pa.array(np.diff(chunk.at)), pa.array(np.diff(before[chunk.at])), texts], names=[x.split()[0] for x in RESULT.split(", ")])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, shard_symbols: int = SHARD_SYMBOLS, hot: int = HOT) -> DataFrame:
    """RESULT: each document's number of words, how many are removed, and the others joined by one space.

    A word is removed if ``width`` neighbouring words with it among them also stand in a
    document with a smaller id. All is judged on the input, not on what is left.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = scratch.table(own.mapInArrow(chunk_rows(chunk_bytes, width), "chunk long, docs binary, anchors binary, counts binary, own long"), "text-chunks")
    sums = chunks.agg(F.sum(F.length("anchors")).alias("anchors"), F.sum("own").alias("own")).first()
    buckets = max(1, -(-(sums["anchors"] or 0) // bucket_bytes))
    sent = chunks.select("chunk", "anchors", "counts").mapInArrow(bucket_rows(buckets), _MESSAGE)
    codes = scratch.table(sent.groupBy("bucket").applyInArrow(shared_anchors(hot), f"{_MESSAGE}, pieces long"), "anchor-codes")
    pieces = (codes.agg(F.sum("pieces").alias("n")).first()["n"] or 0) + (sums["own"] or 0)
    shards = max(1, -(-pieces * (width + LONGEST // 4) // shard_symbols))
    answers = codes.select("chunk", F.lit(CODES).alias("kind"), "bucket", "data")
    texts = chunks.select("chunk", "docs")
    asked = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(piece_rows(buckets, shards, width), _MESSAGE)
    bits = scratch.table(asked.groupBy("bucket").applyInArrow(shard_answers(width), _MESSAGE), "window-bits").select("chunk", F.lit(BITS).alias("kind"), "bucket", "data")
    return texts.groupBy("chunk").cogroup(answers.unionByName(bits).groupBy("chunk")).applyInArrow(result_rows(buckets, shards, width), RESULT)
