"""Words, shingles and sets of whole texts, as numpy arrays over Arrow buffers.

Helpers for functions that Spark calls with Arrow batches: no text becomes a Python
object. Words are runs of anything but the bytes 0x20 and 0x09-0x0D; A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at a time, to bound a Python worker's memory; a longer text is taken alone.
PIECE_BYTES = 3 << 20
EMPTY = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xA0761D6478BD642F)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
EXACT = _LETTER
_LETTER = _LETTER[LOWER]
#: ASCII but for letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes that are hashed at a time; a longer word is taken alone.
SEGMENT = 1 << 16
_powers = np.ones((2, 1), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The powers of the base and those of its inverse, n of each."""
    global _powers
    if _powers.shape[1] < n:
        _powers = np.ones((2, max(n, SEGMENT)), dtype=np.uint64)
        _powers[:, 1:] = [[_BASE], [pow(int(_BASE), -1, 1 << 64)]]
        np.multiply.accumulate(_powers, axis=1, out=_powers)
    return _powers


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = buffers(column)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(texts: pa.Array, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words begin (one more entry than texts).

    gap: for each byte, whether it stands between words.
    """
    data, offsets = buffers(texts)
    solid = ~gap[data]
    h, _, _, at = units(data, offsets, word_starts(solid, offsets), solid)
    return h, at


def word_starts(solid: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each byte begins a word; no word goes on into the next text."""
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(solid)]
    first[cuts] = solid[cuts]  # a text's first byte begins a word whatever stands before it
    return first


def units(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, solid: np.ndarray, letter: np.ndarray = _LETTER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every unit, and where each text's units begin.

    A unit goes from a byte that is ``first`` to the next, or to one that is not ``solid``.
    ``letter``: EXACT tells upper from lower case.
    """
    starts = np.flatnonzero(first)
    at = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, starts, at
    last = solid.copy()
    last[:-1] &= first[1:] | ~solid[1:]
    ends = np.flatnonzero(last) + 1
    h, k = np.empty(len(starts), dtype=np.uint64), 0
    while k < len(starts):
        # sum of letter * base**place over a unit, from running sums over the segment
        to = max(k + 1, int(np.searchsorted(starts, starts[k] + SEGMENT)))
        a, z = int(starts[k]), int(ends[to - 1])
        up, down = powers(z - a)
        sums = np.zeros(z - a + 1, dtype=np.uint64)
        np.multiply(letter[data[a:z]], up[: z - a], out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        i, j = starts[k:to] - a, ends[k:to] - a
        h[k:to] = (sums[j] - sums[i]) * down[i]
        k = to
    return scramble(h + EMPTY), starts, ends, at


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Of a sequence of words, its length included."""
    with np.errstate(over="ignore"):
        out = np.uint64(len(h)) * EMPTY
        for x in h:
            out = scramble(np.array([out * _STEP + x], dtype=np.uint64))[0]
    return out


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes, and where each text's set begins.

    A text of fewer words than ``width`` has its whole sequence as one shingle; without
    words the set is empty.
    """
    h, at = words(texts)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    if len(h) >= width:
        m = len(h) - width + 1
        s = np.zeros(m, dtype=np.uint64)
        for k in range(width):
            s = s * _STEP + h[k : k + m]
        s = scramble(s)
        whole = doc[:m] == doc[width - 1 :]
        s, owner = s[whole], doc[:m][whole]
    else:
        s, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        s = np.concatenate([s, np.array([sequence_hash(h[at[i] : at[i + 1]]) for i in short], dtype=np.uint64)])
        owner = np.concatenate([owner, short])
    return distinct_in(s, owner, len(n))


def distinct_in(s: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each owner 0..n-1, and where each owner's begin."""
    if (owner[1:] < owner[:-1]).any():
        order = np.argsort(owner, kind="stable")
        s, owner = s[order], owner[order]
    s, at = s.copy(), np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(owner, minlength=n), out=at[1:])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        s[a:b].sort()  # far faster, one by one, than a sort of the whole by two keys
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    np.cumsum(np.bincount(owner, minlength=n), out=at[1:])
    return s, at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
