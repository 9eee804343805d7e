"""Token ids of whole texts, with bounded caches.

The word-level BPE vocabulary lower-cases, drops white space and never joins text across
it. Words of Latin letters and ASCII punctuation alone fall into runs of either, which are
one pre-token each; a word with anything else is taken whole. So a text's ids are those of
its runs and whole words in order. Of a lot of texts each different one is looked up once,
found by its hash within the lot, and its ids are copied to where it stands. A Python
worker keeps what it has looked up; only what it has not seen is given to the tokenizer.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from marlstone.llm import textkit

#: Entries from which on a worker keeps no more, of whole words and of runs.
CACHED_WORDS = 200_000
CACHED_PARTS = 500_000
TOGETHER = 64
LETTER, MARK, OTHER = 1, 2, 3
#: Of each byte: 0 for white space, letters, ASCII punctuation without the apostrophe, and the rest.
_KIND = np.array([0 if b in b"\t\n\v\f\r " else LETTER if b < 128 and chr(b).isalpha() else MARK if 33 <= b < 127 and not chr(b).isalnum() and b != 39 else OTHER for b in range(256)], dtype=np.uint8)
_made: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: ids are held in two bytes, so a vocabulary has at most 65,536 entries")
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def encode_parts(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of runs that are one pre-token each, many runs to a call."""
        out: dict[str, bytes] = {}
        lots = [runs[at : at + TOGETHER] for at in range(0, len(runs), TOGETHER)]
        for lot, e in zip(lots, self.tokenizer.encode_batch([" ".join(x) for x in lots], add_special_tokens=False), strict=True):
            ids, word = np.array(e.ids, dtype=np.uint16), np.array(e.word_ids)
            cuts = np.searchsorted(word, np.arange(len(lot) + 1)) * 2
            raw = ids.tobytes()
            for k, run in enumerate(lot):
                out[run] = raw[cuts[k] : cuts[k + 1]]
        return out

    def look_up(self, held: dict[bytes, bytes], wanted: list[bytes], most: int, encode) -> list[bytes]:
        """The ids of different runs or words, A-Z in lower case; what is new is encoded, and kept while there is room."""
        out = list(map(held.get, wanted))
        new = [k for k, x in enumerate(out) if x is None]
        if new:
            names = [wanted[k].decode() for k in new]
            found = encode(list(set(names)))
            for k, name in zip(new, names, strict=True):
                out[k] = found[name]
            if len(held) < most:
                held.update((wanted[k], out[k]) for k in new)
        return out

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        return {w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=np.uint16).tobytes() for w in words}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin; null is empty."""
        data, offsets = textkit.buffers(texts)
        kind = _KIND[data]
        # Latin letters of two bytes, C3 and 80 to BF, but for the signs of multiplication and division
        lead = np.flatnonzero(data[:-1] == 0xC3)
        follow = data[lead + 1]
        lead = lead[(follow != 0x97) & (follow != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        solid = kind > 0
        first = textkit.word_starts(solid, offsets)
        starts = np.flatnonzero(first)
        if len(starts):
            mixed = np.add.reduceat(kind == OTHER, starts) > 0
            of = np.cumsum(first) - 1
            kind[solid & mixed[np.maximum(of, 0)]] = OTHER
        first[1:] |= solid[1:] & (kind[1:] != kind[:-1])
        h, starts, ends, at = textkit.units(data, offsets, first, solid)
        _, one, back = np.unique(h, return_index=True, return_inverse=True)
        raw = textkit.LOWER[data].tobytes()
        one = np.concatenate([one[~(whole := kind[starts[one]] == OTHER)], one[whole]])  # runs, then whole words
        told = [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        runs = len(told) - int(whole.sum())
        pool = self.look_up(self.parts, told[:runs], CACHED_PARTS, self.encode_parts) + self.look_up(self.words, told[runs:], CACHED_WORDS, self.encode_words)
        place = np.empty(len(one), dtype=np.int64)
        place[np.concatenate([np.flatnonzero(~whole), np.flatnonzero(whole)])] = np.arange(len(one))
        back = place[back]
        size = np.fromiter(map(len, pool), dtype=np.int64, count=len(pool)) // 2
        begin = np.concatenate([[0], np.cumsum(size)])
        n = size[back]
        to = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(pool), dtype=np.uint16)[np.repeat(begin[back] - to[:-1], n) + np.arange(to[-1])]
        return ids, to[at]


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary, so that tasks share its caches."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
