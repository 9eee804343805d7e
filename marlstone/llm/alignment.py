"""Alignment of two tokenizers' tokens by byte offsets, with corpus-wide counts of linked id pairs.

Texts are cut at white space behind an ordinary letter or sign, where neither vocabulary has
a token across the cut, so both tokens end there and a text's alignment is that of its
segments in order. A worker aligns each different segment once, many at a time.

One pass over the texts writes a table of their links, as packed keys (id of A above id of
B), and of the task's partial counts: the distinct keys of each text, added up with
``np.unique``. The partial counts are dealt by ranges of A's ids, sorted by key as 64-bit
numbers, and summed run by run into shards, each with the number of texts and whether that
is the highest of its A id. The shards are files of the shared folder; the tasks that read
the links map them into memory and find keys with ``np.searchsorted``. Where the shared
folder is no mounted path, the texts' distinct keys are joined with the counts instead.

Null and empty texts, and texts whose tokens do not spell them out again (B has no sign for
U+2581), have no tokens: zeros and an empty digest. Every row is a text of its own, with a
null or repeated id too. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkit
from marlstone.sources import scratch

#: Segments that a worker keeps aligned, and keys that a task holds before it adds them up.
CACHED = 200_000
PENDING = 4 << 20
#: Partial counts that one shard is made of, about.
SHARD_ROWS = 1 << 21
#: Bytes of a segment from which on the plainer tokenizer is used, whose memory does not grow with runs of one sign.
LONG = 2000
#: White space behind ASCII signs or Latin letters of two bytes.
CUT = re.compile(rb"(?<=[\x21-\x7e])(?=[ \t\n])|(?<=\xc3[\x80-\xbf])(?=[ \t\n])")
#: Fixed value: the pattern by which byte-level vocabularies of this kind split texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
ROWS = f"{COUNTS}, n_best long, count_sum long, groups_sha256 string"
_made: dict[tuple[str, str], "Aligner"] = {}


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def blank(c: str) -> bool:
    return c == "▁" or c.isspace()


def fast_encoder(tokenizer):
    """The byte-level vocabulary as ranks, if its ids are in the order of its merges; else None."""
    import json

    import tiktoken

    told = json.loads(tokenizer.to_str())
    vocab, merges, splits = told["model"]["vocab"], told["model"].get("merges", []), told["pre_tokenizer"] or {}
    letters = byte_letters()
    special = {x["content"] for x in told["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): k for token, k in vocab.items() if token not in special}
    ordered = all(vocab.get("".join(m if isinstance(m, list) else m.split(" "))) == 256 + k for k, m in enumerate(merges))
    plain = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space") and told["normalizer"] is None and not told["model"].get("ignore_merges")
    if not (ordered and plain and len(ranks) == 256 + len(merges)):
        return None
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Aligner:
    """Both tokenizers and the segments aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        letters, n = byte_letters(), self.b.get_piece_size()
        if max(self.a.get_vocab_size(), n) > 1 << 16:
            raise ValueError("ids are held in two bytes, so a vocabulary has at most 65,536 entries")
        self.fast = fast_encoder(self.a)
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = self.b.id_to_piece(list(range(n)))
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, self.b.is_byte(list(range(n))), strict=True)]
        self.size_a, self.size_b = (np.array([len(x) for x in of], dtype=np.int64) for of in (self.bytes_a, self.bytes_b))
        # a vocabulary of pieces with a cut inside gets whole texts
        self.cuts = not any(c in "▁\n\t" and not blank(p[k]) for p in pieces for k, c in enumerate(p[1:]))
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        #: of each segment: its links' keys, its groups, and its numbers of tokens of A and B and of groups; -1 where tokens do not spell it
        self.keys: list[bytes] = []
        self.groups: list[bytes] = []
        self.sizes = np.zeros((0, 3), dtype=np.int64)

    def segments(self, text: bytes) -> list[bytes]:
        """Of a space and the text."""
        return CUT.split(b" " + text) if self.cuts else [b" " + text]

    def numbers(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The segments of all texts as numbers of this worker, and where each text's begin; null and empty texts have none."""
        if len(self.known) > CACHED:
            self.clear()
        cut = [self.segments(t) if t else [] for t in texts]
        flat = [s for x in cut for s in x]
        known = self.known
        new = [s for s in dict.fromkeys(flat) if s not in known]
        for at in range(0, len(new), 4096):
            self.align(new[at : at + 4096])
        at = np.zeros(len(cut) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in cut], out=at[1:])
        return np.fromiter(map(known.__getitem__, flat), dtype=np.int64, count=len(flat)), at

    def align(self, segments: list[bytes]) -> None:
        said = [s.decode("utf-8", "replace") for s in segments]
        a, b = self.encode_a(said), self.encode_b(said)
        fine = [b"".join(map(self.bytes_a.__getitem__, x)) == s and b"".join(map(self.bytes_b.__getitem__, y)) == s for s, x, y in zip(segments, a, b, strict=True)]
        first = len(self.keys)
        self.known.update(zip(segments, range(first, first + len(segments)), strict=True))
        sizes = np.full((len(segments), 3), [-1, 0, 0], dtype=np.int64)
        keys, groups = [b""] * len(segments), [b""] * len(segments)
        good = [k for k, x in enumerate(fine) if x]
        if good:
            sizes[good], some_keys, some_groups = link([a[k] for k in good], [b[k] for k in good], self.size_a, self.size_b)
            for k, x, y in zip(good, some_keys, some_groups, strict=True):
                keys[k], groups[k] = x, y
        self.keys += keys
        self.groups += groups
        self.sizes = np.concatenate([self.sizes, sizes])

    def encode_a(self, said: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.a.encode_batch(said, add_special_tokens=False)]
        return [self.fast(s) if len(s) < LONG else self.a.encode(s, add_special_tokens=False).ids for s in said]

    def encode_b(self, said: list[str]) -> list[list[int]]:
        """B puts a space of its own before what it is given: one that stands there is left out, anything else is encoded behind a letter of its own."""
        space = [len(s) > 1 and s[0] == " " for s in said]  # nothing gets no space
        ids = self.b.encode([s[1:] if x else "a" + s for s, x in zip(said, space, strict=True)], num_threads=1)
        return [i if x else i[1:] for i, x in zip(ids, space, strict=True)]


def digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal signs of 0..n-1 in six places, and how many there are."""
    out, size = np.zeros((n, 6), dtype=np.uint8), np.zeros(n, dtype=np.int64)
    for k in range(n):
        said = str(k).encode()
        out[k, : len(said)], size[k] = list(said), len(said)
    return out, size


_digits = digits(0)


def link(a: list[list[int]], b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Of segments that both spell: numbers of tokens and groups, the keys of all overlapping occurrences, and the groups as ``a1,a2|b1;a3|b2,b3``.

    Between two neighbouring ends of either's tokens lies one overlap of one token of each.
    """
    global _digits
    if len(_digits[1]) < max(len(size_a), len(size_b)):
        _digits = digits(max(len(size_a), len(size_b)))
    n_a, n_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (a, b))
    ids_a, ids_b = (np.array([i for y in x for i in y], dtype=np.int64) for x in (a, b))
    ends_a, ends_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    bounds = ends_a[np.cumsum(n_a) - 1]
    ends = np.union1d(ends_a, ends_b)
    keys = ((ids_a[np.searchsorted(ends_a, ends)] << 16) | ids_b[np.searchsorted(ends_b, ends)]).astype("<u4").tobytes()
    to = (np.searchsorted(ends, bounds) + 1) * 4
    both = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
    # the signs behind tokens: a comma inside a group, a bar after its last of A, a semicolon after its last of B
    mark_a, mark_b = np.where(both[group_a] == ends_a, ord("|"), ord(",")), np.where(both[group_b] == ends_b, ord(";"), ord(","))
    order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
    ids, marks = np.concatenate([ids_a, ids_b])[order], np.concatenate([mark_a, mark_b])[order]
    signs, size = _digits[0][ids], _digits[1][ids]
    signs[np.arange(len(ids)), size] = marks
    said = signs[signs > 0].tobytes()
    said_to = np.cumsum(size + 1)[np.cumsum(n_a + n_b) - 1]
    n_groups = np.diff(np.searchsorted(both, bounds) + 1, prepend=0)
    cut = lambda raw, to, drop: [raw[x : y - drop] for x, y in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]
    return np.stack([n_a, n_b, n_groups], axis=1), cut(keys, to, 0), cut(said, said_to, 1)


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker and pair of vocabularies, so that tasks share its segments."""
    if (path_a, path_b) not in _made:
        _made[path_a, path_b] = Aligner(path_a, path_b)
    return _made[path_a, path_b]


def unpacked(keys: bytes) -> np.ndarray:
    return np.frombuffer(keys, dtype="<u4").astype(np.int64)


def totals(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at ``at``."""
    run = np.concatenate([[0], np.cumsum(x)])
    return run[at[1:]] - run[at[:-1]]


def link_rows(paths: tuple[str, str]):
    """(doc_id, text) to rows (COUNTS, groups_sha256, links) of the texts, and rows (a, key, n) of the task's counts."""
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def tables(rows: list[pa.Array], counts: list[pa.Array]) -> pa.RecordBatch:
        n = len(rows[0]) if rows else len(counts[0])
        kinds = [*[pa.int64()] * 5, pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        held = [*(rows or [None] * 7), *(counts or [None] * 3), pa.array([bool(counts)] * n)]
        return pa.record_batch([pa.nulls(n, k) if x is None else x for x, k in zip(held, kinds, strict=True)], names=[*names, "groups_sha256", "links", "a", "key", "n", "counted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            k, back = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(back, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)

        def count_rows(k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(k), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield tables([], [pa.array((k[s] >> 16).astype(np.int32)), pa.array(k[s]), pa.array(n[s])])

        of = aligner(*paths)
        for batch in batches:
            for part in textkit.pieces(batch, "text"):
                numbers, at = of.numbers([t.encode() if t else None for t in part.column(1).to_pylist()])
                sizes = of.sizes[numbers]
                spelled = (np.diff(at) > 0) & (totals(sizes[:, 0] < 0, at) == 0)
                columns = [np.where(spelled, totals(x, at), 0) for x in sizes.T]
                links, sha, n_links = [], [], np.zeros(part.num_rows, dtype=np.int64)
                for d, fine in enumerate(spelled.tolist()):
                    mine = numbers[at[d] : at[d + 1]].tolist() if fine else []
                    links.append(b"".join(map(of.keys.__getitem__, mine)))
                    sha.append(hashlib.sha256(b";".join(map(of.groups.__getitem__, mine))).hexdigest() if fine else "")
                    n_links[d] = len(links[-1]) // 4
                    keys.append(np.unique(unpacked(links[-1])))
                    counts.append(np.ones(len(keys[-1]), dtype=np.int64))
                    held += len(keys[-1])
                yield tables([part.column(0), *map(pa.array, columns), pa.array(n_links), pa.array(sha, pa.string()), pa.array(links, pa.binary())], [])
                if held > PENDING:
                    k, n = total()
                    keys, counts, held = [k], [n], len(k)
                    if held > PENDING // 2:
                        yield from count_rows(k, n)
                        keys, counts, held = [], [], 0
        if held:
            yield from count_rows(*total())

    return run


LINKED = f"{COUNTS}, groups_sha256 string, links binary, a int, key long, n long, counted boolean"


def sum_runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys each once, with the sum of its counts."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def with_best(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Twice the count, and one more where it is the highest of its A id; all keys of an A id are here."""
    a = keys >> 16
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    best = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(a))))
    return counts * 2 + (counts == best)


def run_lengths(folder: str | None):
    """Sorted (a, key, n) to shards: files under ``folder``, of which a row (shard, first, n) is told, or rows (key, n, 0) where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for b in batches:  # one partition is one shard, whose rows are bounded by its range
            k, n = sum_runs(b.column(1).to_numpy(), b.column(2).to_numpy())
            keys.append(k)
            counts.append(n)
        if not sum(map(len, keys)):
            return
        k, n = sum_runs(np.concatenate(keys), np.concatenate(counts))
        value = with_best(k, n)
        if folder is None:
            for at in range(0, len(k), 1 << 16):
                yield pa.record_batch([pa.array(k[at : at + (1 << 16)]), pa.array(value[at : at + (1 << 16)]), pa.array(np.zeros(len(k[at : at + (1 << 16)]), dtype=np.int64))], names=["key", "n", "rows"])
            return
        # a task that is repeated writes the same bytes; the name is taken in one step
        os.makedirs(folder, exist_ok=True)
        at, own = f"{folder}/{int(k[0])}.npy", f"{folder}/.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            np.save(f, np.stack([k, value]))
        os.replace(own, at)
        yield pa.record_batch([pa.array(k[:1]), pa.array(k[-1:]), pa.array([len(k)], type=pa.int64())], names=["key", "n", "rows"])

    return run


def mounted(folder: str) -> str | None:
    """The local path of a folder that every machine mounts; None for other stores."""
    if folder.startswith("file:"):
        return re.sub("^file:/*", "/", folder)
    return folder if folder.startswith("/") else None


class Shards:
    """Sorted counts in files, mapped into memory: pages are read as they are looked at."""

    def __init__(self, folder: str, firsts: np.ndarray):
        self.folder, self.firsts, self.maps = folder, firsts, {}

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.int64)
        of = np.searchsorted(self.firsts, keys, side="right") - 1
        for s in np.unique(of):
            if s not in self.maps:
                self.maps[s] = np.load(f"{self.folder}/{int(self.firsts[s])}.npy", mmap_mode="r")
            sorted_, value = self.maps[s]
            mine = np.flatnonzero(of == s)
            place = np.minimum(np.searchsorted(sorted_, keys[mine]), len(sorted_) - 1)
            out[mine] = np.where(sorted_[place] == keys[mine], value[place], 0)
        return out


def slices(b: pa.RecordBatch, column: str, most: int = textkit.PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of a column; a longer value is taken alone."""
    to = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(to, (to[at - 1] if at else 0) + most, side="right")))
        yield b.slice(at, end - at)
        at = end


def look_up(folder: str, firsts: list[int]):
    """Rows of LINKED of the texts to ROWS, counts looked up in the shards."""
    names = [x.split()[0] for x in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, np.array(firsts, dtype=np.int64))
        for b in batches:
            for part in slices(b, "links"):
                links = part.column(6).to_pylist()
                at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in links])]).astype(np.int64)
                value = shards(unpacked(b"".join(links)))
                yield pa.record_batch([*part.columns[:5], pa.array(totals(value & 1, at)), pa.array(totals(value >> 1, at)), part.column(5)], names=names)

    return run


def pair_counts(linked: DataFrame, folder: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The shards of corpus-wide counts: files under ``folder`` and a row (key, n, rows) for each, or rows (key, n)."""
    parts = linked.where("counted").select("a", "key", "n")
    shards = max(1, -(-parts.count() // shard_rows))
    # an A id has no more keys than B has ids, so a range of A's ids can be one task's
    dealt = parts.repartitionByRange(shards, "a").sortWithinPartitions("a", "key")
    return dealt.mapInArrow(run_lengths(folder), "key long, n long, rows long")


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", shard_rows: int = SHARD_ROWS, mapped: bool = True) -> DataFrame:
    """Each text's tokens, groups and links, and its links' counts over all texts: ROWS.

    A: byte-level vocabulary, which gets a space and the text. B: pieces, which add the space.
    n_best: links whose count is the highest of their A id, ties included. ``mapped`` False
    joins the counts even where the shared folder is mounted.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    linked = scratch.table(own.mapInArrow(link_rows((path_a, path_b)), LINKED), "links")
    texts = linked.where("not counted").drop("a", "key", "n", "counted")
    folder = mounted(scratch.place(docs.sparkSession, "pair-shards")) if mapped else None
    if folder is None:
        return joined(texts, pair_counts(linked, None, shard_rows).select("key", "n"))
    firsts = sorted(r["key"] for r in pair_counts(linked, folder, shard_rows).select("key").collect())  # a number for each shard
    return texts.mapInArrow(look_up(folder, firsts), ROWS)


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, links) to (row, key, times): each text's distinct keys."""
    for b in batches:
        for part in slices(b, "links"):
            for row, links in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                keys, times = np.unique(unpacked(links), return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(keys), row, dtype=np.int64)), pa.array(keys), pa.array(times.astype(np.int64))], names=["row", "key", "times"])


def joined(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """As ``look_up``, by a join on the keys: for shared folders that cannot be mapped into memory."""
    texts = texts.withColumn("row", F.monotonically_increasing_id())
    asked = texts.select("row", "links").mapInArrow(key_rows, "row long, key long, times long")
    found = asked.join(counts, "key").groupBy("row").agg(F.sum(F.col("times") * (F.col("n") % 2)).alias("best"), F.sum(F.col("times") * F.shiftright("n", 1)).alias("sum"))
    out = texts.drop("links").join(found, "row", "left").withColumns({"n_best": F.coalesce("best", F.lit(0)), "count_sum": F.coalesce("sum", F.lit(0))})
    return out.select(*(x.split()[0] for x in ROWS.split(", ")))
