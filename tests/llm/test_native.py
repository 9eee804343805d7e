"""Quality rules, line dedup, mixing and chat formatting on small tables."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat, line_dedup, mixing, quality

GOOD = " ".join(f"word{k}" for k in range(60)) + "."


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(docs):
    texts = [GOOD, None, "", "a b c a b c a", "x\nx\n\n \nx ", "a|b #1\tthe the the the the", "é" * 5 + " x y", GOOD + "\n" + "w " * 20000, "one\x0btwo\x0cthree\r\nfour"]
    got = {r["doc_id"]: r for r in quality.measure(docs(*texts, extra=["kept", "n_words"])).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(t), t and t[:40]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])


@pytest.mark.parametrize(
    "line,fails",
    [("Home | About | Contact", True), ("Read more", True), ("All rights reserved by all of us.", True), ("###$$$ %%% a", True), ("ok", True), ("Yes.", False), ("A plain line without an end but long", False), ("Home is where the heart is.", False), ("*** --- ***", True), ("  Sign in  ", True)],
)
def test_line_rules(spark, line, fails):
    assert spark.createDataFrame([(line,)], "x string").select(quality.line_fails(F.col("x"))).first()[0] is fails


def test_quality_pipeline_form(docs):
    df = docs(GOOD + "\nHome | About | Contact\n" + GOOD, "too short", None, GOOD, extra=["clean_text"])
    got = {r["doc_id"]: r for r in quality.keep_clean(df).collect()}
    assert quality.keep_clean(df).columns == df.columns
    assert set(got) == {3}
    assert got[3]["text"] == GOOD and got[3]["clean_text"] == 7
    many = "\n".join(" ".join(f"w{j}x{k}" for k in range(12)) + "." for j in range(8))
    kept = quality.keep_clean(docs(many + "\nHome | About | Contact")).first()
    assert kept["text"] == many and kept["n_chars"] == len(many)
    assert quality.keep_clean(docs()).count() == 0


def brute_lines(rows, least):
    sites, first = {}, {}
    for d, text, site in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if key := line.strip(" \t\n\x0b\x0c\r"):
                sites.setdefault(key, set()).add(site or "")
                first[key] = min(first.get(key, (d, pos)), (d, pos))
    out = {}
    for d, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for pos, x in enumerate(lines) if not ((k := x.strip(" \t\n\x0b\x0c\r")) and len(sites[k]) >= least and first[k] != (d, pos))]
        out[d] = ("\n".join(kept) if text is not None else None, len(lines) - len(kept))
    return out


def test_line_dedup(docs):
    texts = [f"own {k}\nshared by all\n  tie of five \n\nshared by all" for k in range(7)] + [None, "", "shared by all", "own only\nrare"]
    sources = [f"s{k % 7}" for k in range(7)] + ["s1", "s2", None, "s3"]
    texts[5], texts[6] = texts[5].replace("  tie of five \n", ""), texts[6].replace("  tie of five \n", "")
    df = docs(*texts, sources=sources, extra=["n_lines"])
    for least in (2, 5, 6, 8, 9):
        want = brute_lines([(k, t, s) for k, (t, s) in enumerate(zip(texts, sources))], least)
        got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.remove_lines(df, least).collect()}
        assert got == want, least
    kept = line_dedup.dedup_corpus(df)
    assert kept.columns == df.columns and 9 not in {r["doc_id"] for r in kept.collect()}
    assert {r["n_lines"] for r in kept.collect()} == {7}
    assert line_dedup.remove_lines(docs(), 2).count() == 0


def test_line_dedup_repeated_and_null_ids(docs):
    df = docs(*["same line"] * 6, ids=[1, 1, None, 2, 3, 4], sources=[f"s{k}" for k in range(6)])
    got = sorted((r["doc_id"] or -1, r["text"]) for r in line_dedup.remove_lines(df, 5).collect())
    assert [x for x in got if x[1]] and len(got) == 6


def test_line_dedup_of_an_id_with_several_texts(docs):
    texts = ["shared\nown one", "own two\nshared"] + ["shared"] * 5
    df = docs(*texts, ids=[9, 9, 1, 2, 3, 4, 5], sources=[f"s{k}" for k in range(7)])
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.remove_lines(df, 5).collect())
    assert got == [(1, "shared"), (2, ""), (3, ""), (4, ""), (5, ""), (9, "own one"), (9, "own two")]
    # the first occurrence may be in one of two texts of an id, at the same place
    again = docs("shared\nx", "shared\ny", *["shared"] * 4, ids=[0, 0, 1, 2, 3, 4], sources=[f"s{k}" for k in range(6)])
    assert sorted(r["text"] for r in line_dedup.remove_lines(again, 5).collect() if r["doc_id"] == 0) in (["shared\nx", "y"], ["shared\ny", "x"])


def test_targets_stop_at_three_times():
    sizes = {"a": 10, "b": 1000, "c": 10, None: 10}
    got = mixing.fill_targets(sizes, {"a": 1, "b": 2, "c": 3, None: 1}, 1030)
    assert got["a"] == 30 and got["c"] == 30 and got[None] == 30 and got["b"] == pytest.approx(940)
    assert mixing.fill_targets({"a": 0}, {"a": 1}, 0) == {"a": 0}


def test_mix(docs):
    texts = [" ".join(["w"] * (1 + k * 7 % 40)) for k in range(400)] + [None, "", "x " * 3000]
    sources = [["a", "b", "b", "b", "c", None][k % 6] for k in range(400)] + ["a", None, "b"]
    df = docs(*texts, sources=sources, extra=["size", "target"])
    rows = mixing.mix_sources(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(rows) == len(texts) and sorted(rows) == sorted(mixing.mix_sources(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect())
    sizes = Counter()
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
    weights = {s: 1 + k % 3 for k, s in enumerate(["a", "b", "c", None])}
    want = mixing.fill_targets(dict(sizes), weights, sum(sizes.values()))
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert own[0]["source_size"] == sizes[s] and own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
    again = mixing.mixed_corpus(df)
    assert again.columns == df.columns and 401 not in {r["doc_id"] for r in again.collect()}
    assert mixing.mix_sources(docs()).count() == 0


def test_flow_of_overlapping_sources():
    supply = [(frozenset("a"), 10), (frozenset("ab"), 10), (frozenset("b"), 10), (frozenset("c"), 5)]
    assert mixing.groups_of([x for x, _ in supply]) == [[0, 1, 2], [3]]
    given = mixing.min_cost_flow(supply[:3], {"a": 25.0, "b": 15.0})
    assert sum(given) == pytest.approx(40) and max(g / 10 for g in given) <= 2 + 1e-6 and given[0] >= 10
    assert mixing.min_cost_flow(supply[3:], {"c": 15.0}) == [15.0]


def plain_flow(supply, quota):
    """Cost of the cheapest way to give as many words as can be, one word at a time along the cheapest path."""
    edges = {}
    for p, (members, words) in enumerate(supply):
        for use, cost in enumerate((0, 1, 3)):
            edges["from", ("use", p, use)] = [words, 0]
            edges[("use", p, use), ("pattern", p)] = [words, cost]
        edges.update({(("pattern", p), ("source", s)): [10**9, 0] for s in members})
    edges.update({(("source", s), "to"): [q, 0] for s, q in quota.items()})
    edges.update({(b, a): [0, -cost] for (a, b), (_, cost) in list(edges.items())})
    total = words = 0
    while True:
        far, back = {"from": 0}, {}
        for _ in range(len(edges)):
            moved = False
            for (a, b), (room, cost) in edges.items():
                if room and a in far and far[a] + cost < far.get(b, 10**9):
                    far[b], back[b], moved = far[a] + cost, a, True
            if not moved:
                break
        if "to" not in far:
            return words, total
        b = "to"
        while b != "from":
            edges[back[b], b][0] -= 1
            edges[b, back[b]][0] += 1
            b = back[b]
        words, total = words + 1, total + far["to"]


@pytest.mark.parametrize("seed", range(8))
def test_flow_against_a_plain_solver(seed):
    rng = random.Random(seed)
    names = "abcde"[: rng.randrange(2, 6)]
    supply = [(frozenset(m), rng.randrange(1, 9)) for m in {"".join(sorted(rng.sample(names, rng.randrange(1, len(names) + 1)))) for _ in range(7)}]
    quota = {s: rng.randrange(1, 25) for s in {s for m, _ in supply for s in m}}
    given = mixing.min_cost_flow(supply, {s: float(q) for s, q in quota.items()})
    cost = sum(max(0, min(g, 2 * w) - w) + 3 * max(0, g - 2 * w) for g, (_, w) in zip(given, supply, strict=True))
    assert (round(sum(given)), round(cost)) == plain_flow(supply, quota) and all(g <= 3 * w + 1e-6 for g, (_, w) in zip(given, supply, strict=True))


def test_mix_of_repeated_and_null_ids_in_any_order(spark, docs):
    import random

    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None, None, k]), "w " * rng.randint(0, 30) + rng.choice("abc"), "en", rng.choice("st"), 1) for k in range(400)]
    seen = []
    for n in (1, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        seen.append(sorted((tuple(r) for r in mixing.mix_sources(df).select("doc_id", "text", "source", "taken").collect()), key=repr))
    assert seen[0] == seen[1]


def test_overlapping_mix_of_many_documents(spark, docs):
    """Documents of one to three of six sources: each source's share is met, and no document goes beyond three uses."""
    rng = random.Random(4)
    own = [sorted(rng.sample("abcdef", rng.choice([1, 1, 2, 3]))) for _ in range(600)]
    texts = ["w " * rng.randrange(1, 60) for _ in own]
    df = docs(*texts).join(spark.createDataFrame(list(enumerate(own)), "doc_id long, m array<string>"), "doc_id")
    weights = dict(zip("abcdef", (1, 2, 3, 4, 5, 6), strict=True))
    total = sum(len(t.split()) for t in texts)
    rows = mixing.mix(df, F.col("m"), weights=weights, total=total).collect()
    supply = Counter()
    for t, m in zip(texts, own, strict=True):
        supply[frozenset(m)] += len(t.split())
    quota = mixing.fill_targets({s: sum(w for m, w in supply.items() if s in m) for s in weights}, weights, total)
    taken = Counter()
    for r in rows:
        taken[frozenset(r["m"])] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    flow = mixing.min_cost_flow(list(supply.items()), quota)
    # several ways may be as cheap
    cost = lambda given: sum(max(0, min(g, 2 * supply[m]) - supply[m]) + 3 * max(0, g - 2 * supply[m]) for m, g in given.items())
    assert abs(cost(taken) - cost(dict(zip(supply, flow, strict=True)))) <= 3 * len(supply)
    assert abs(sum(taken.values()) - sum(quota.values())) <= len(supply) and sum(quota.values()) == pytest.approx(total)


def test_mix_of_overlapping_sources(spark, docs):
    df = docs(*["w w w w w"] * 30).withColumn("m", F.when(F.col("doc_id") < 10, F.array(F.lit("a"))).when(F.col("doc_id") < 20, F.array(F.lit("b"), F.lit("a"))).when(F.col("doc_id") < 29, F.array(F.lit("b"))))
    rows = mixing.mix(df, F.col("m"), weights={"a": 3, "b": 1}, total=100).collect()
    assert sum(r["taken"] for r in rows) == 100 and [r["taken"] for r in rows if r["doc_id"] == 29] == [0]


PROBE = "</s>[INST] ok [/INST]"


def chat_rows(spark, rows):
    return {r["conv_id"]: r for r in chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumns({"turns": chat.parse(F.col("formatted")), "under": chat.loss_text(F.col("formatted"), F.col("loss"))}).collect()}


def test_chat_round_trip(spark):
    texts = [PROBE, "<|end|><|user|>&lt;", "&amp;|&#124;\\n\n", "", None, "日本 🙂 x" * 500]
    rows = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(texts)] + [(2, 0, None, "x"), (2, None, "a|b<c>", "y"), (3, 5, "assistant", "t"), (3, 5, "assistant", "t"), (3, 5, "assistant", "s")]
    got = chat_rows(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(["user", "assistant"][k % 2], t or "") for k, t in enumerate(texts)]
    assert got[1]["under"] == "".join(t or "" for t in texts[1::2])
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("a|b<c>", "y"), ("", "x")] and got[2]["under"] == ""
    assert got[3]["under"] == "stt"
    assert hashlib.sha256(got[3]["under"].encode()).hexdigest() == spark.range(1).select(F.sha2(F.lit("stt"), 256)).first()[0]
    assert chat_rows(spark, []) == {}


def test_chat_events(spark):
    log = [
        (1, 0, 1, "start", "user", None), (1, 1, 1, "delta", None, "Hel"), (1, 2, 1, "delta", None, "lo"),
        (1, 3, 2, "start", "assistant", None), (1, 4, 2, "delta", None, "bad"), (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "go"), (1, 7, 2, None, None, "od"),
        (1, 8, 1, "edit", None, "Hi"), (1, 9, 3, "start", "user", None), (1, 10, 3, "delete", None, None), (1, 11, 4, "delta", "tool", "x"), (1, 12, 4, "unknown", None, "zzz"),
    ]
    df = spark.createDataFrame(log[::-1], "conv_id long, seq long, msg long, kind string, role string, text string").withColumn("events", F.lit(1))
    got = [tuple(r) for r in chat.fold_events(df).orderBy("msg").collect()]
    assert got == [(1, 1, "user", "Hi"), (1, 2, "assistant", "good"), (1, 4, "tool", "x")]


def brute_fold(log):
    """A state machine over each conversation's events in sequence."""
    state = {}
    for conv, seq, msg, kind, role, text in sorted(log, key=lambda e: (e[0], e[1], e[3] or "delta", e[5] or "", e[4] is not None, e[4] or "")):
        m = state.setdefault((conv, msg), {"role": None, "text": "", "gone": False})
        kind, text = kind or "delta", text or ""
        m["role"] = role or m["role"]
        if kind == "delta":
            m["text"] += text if not m["gone"] else ""
        elif kind in ("start", "regenerate", "edit", "delete"):
            m["gone"] = kind == "delete"
            m["text"] = text if kind in ("edit", "start") else ""
    return sorted((c, k, m["role"], m["text"]) for (c, k), m in state.items() if not m["gone"])


@pytest.mark.parametrize("seed", range(3))
def test_chat_events_against_brute_force(spark, seed):
    rng = random.Random(seed)
    kinds = ["start", "delta", "delta", "delta", None, "edit", "regenerate", "delete", "other"]
    log = [(rng.randrange(6), rng.randrange(60), rng.randrange(4), rng.choice(kinds), rng.choice([None, "user", "tool"]), rng.choice([None, "", "a", "b c", "<|"])) for _ in range(400)]
    log = [(*e[:4], e[4], "" if e[3] in ("regenerate", "delete") else e[5]) for e in log]
    df = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string")
    got = sorted((r["conv_id"], r["msg"], r["role"], r["text"]) for r in chat.fold_events(df).collect())
    key = lambda rows: sorted(repr(r) for r in rows)
    assert key(got) == key(brute_fold(log))


def test_chat_log_holds_every_kind(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    log = chat.turn_events(turns).collect()
    assert {r["kind"] for r in log} == {"start", "delta", "regenerate", "edit"} and sum(r["kind"] == "delta" for r in log) == 8


def test_line_dedup_of_many_removed_lines(docs):
    text = "\n".join(f"line {k}" for k in range(30_000))
    began = time.time()
    got = line_dedup.remove_lines(docs(*[text] * 6, sources=[f"s{k}" for k in range(6)]), 5).select("doc_id", F.length("text").alias("n"), "n_removed").collect()
    assert sorted(r["n_removed"] for r in got) == [0] + [30_000] * 5 and time.time() - began < 60
