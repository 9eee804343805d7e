"""Substring dedup against a plain version with a dictionary of windows."""

import random
import re

import numpy as np
import pytest

from marlstone.llm import substring_dedup as sd


def plain(rows, width=sd.WIDTH):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, ws in words:
        for i in range(len(ws) - width + 1):
            key = tuple(ws[i : i + width])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, ws in words:
        gone = set()
        for i in range(len(ws) - width + 1):
            if d is not None and first[tuple(ws[i : i + width])] < d:
                gone |= set(range(i, i + width))
        out.append((d, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=repr)


def table(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmno") + rng.choice(["", "x", "Y"])
    passages = [[word() for _ in range(rng.choice([12, 13, 14, 30, 80]))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "a " * 400), (4, "a " * 90 + "b " * 20), (5, " one two three " * 9), (6, " one two three " * 5)]
    for k in range(7, 160):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.2:
                text[rng.randrange(len(text))] = word()
        rows.append((rng.choice([k, k, k, k, 200 - k, None]), rng.choice([" ", "\n", "  \t"]).join(text)))
    rows += [rows[20], (999, rows[30][1]), (1000, " ".join(passages[4]).upper())]
    return rows


@pytest.mark.parametrize(("chunk", "shard", "hot"), [(1, 40, 4096), (300, 500, 2), (1 << 20, 1 << 20, 4096), (2000, 1 << 20, 0)])
def test_same_as_plain(spark, chunk, shard, hot):
    rows = table(chunk)
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, chunk long, bucket int, data string").repartition(3)
    got = sd.dedup(df, chunk_bytes=chunk, bucket_bytes=max(chunk, 9), shard_symbols=shard, hot=hot).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    assert sum(r["n_removed"] for r in got) > 100


def test_empty_table(spark, docs):
    assert sd.dedup(docs()).collect() == []
    assert [tuple(r) for r in sd.dedup(docs(None, "one word")).orderBy("doc_id").collect()] == [(0, 0, 0, ""), (1, 2, 0, "one word")]


def test_long_copies(spark, docs):
    text = " ".join(f"w{k * 7919 % 5003}" for k in range(60_000))
    got = {r["doc_id"]: r for r in sd.dedup(docs(text, "x " + text + " y", text, ids=[5, 9, 7]), chunk_bytes=1000).collect()}
    assert [(k, got[k]["n_removed"], got[k]["text"] if k != 5 else "") for k in (5, 7, 9)] == [(5, 0, ""), (7, 60_000, ""), (9, 60_000, "x y")]


def test_automaton():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randint(1, 15))] for _ in range(6)]
        automaton = sd.Automaton()
        for doc, x in enumerate(texts):
            automaton.add(x, doc)
        asked, width = [rng.randrange(3) for _ in range(25)], rng.randint(1, 4)
        want = [next((d for d, x in enumerate(texts) if any(x[j : j + width] == asked[i : i + width] for j in range(len(x)))), None) for i in range(len(asked) - width + 1)]
        assert automaton.firsts(asked, width) == want


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 40).astype(np.uint64)
    for width in (1, 2, 3, 10):
        assert sd.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]
