"""N-gram join, packing, embeddings, toxicity, HTML and language model on small tables, against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import dealing, embedding_dedup, lm_scoring, ngram_join, packing, textkit, toxicity
from marlstone.llm.components import components

try:
    import public_tokenizers

    VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
except ImportError:
    VOCABULARY = None
needs_vocabulary = pytest.mark.skipif(VOCABULARY is None, reason="the vocabularies are not here")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def smallest(ids, links):
    lead = {i: i for i in ids}

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        lead[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


ODD = [None, "", " \n\t ", "one", "ONE", "one two three four", "One two  three four", "one two three four five", "\x0bone\x0ctwo", "é É", "x " * 30_000]


def test_words_and_sets():
    texts = [*ODD, "a b c d e f a b c d e", "A B\tC d\n e f"]
    s, at = textkit.shingle_sets(pa.array(texts, type=pa.string()))
    assert list(np.diff(at)) == [len(shingles(t)) for t in texts]
    seen = {}
    for k, t in enumerate(texts):
        assert seen.setdefault(frozenset(s[at[k] : at[k + 1]].tolist()), frozenset(shingles(t))) == frozenset(shingles(t))
    assert textkit.shingle_sets(pa.array([], type=pa.string()))[1].tolist() == [0]


def test_words_hash_alike_wherever_they_stand():
    long = "y" * 200_000
    texts = [f"{'pad ' * k}{long} word" for k in range(0, 40_000, 9_999)] + [f"word\t{long}"]
    h, at = textkit.words(pa.array(texts))
    assert len({int(h[at[k + 1] - 1]) for k in range(4)} | {int(h[at[-2]])}) == 1  # "word"
    assert len({int(h[at[k + 1] - 2]) for k in range(4)} | {int(h[-1])}) == 1
    rng = random.Random(2)
    many = " ".join("".join(rng.choices("abAB", k=rng.randrange(1, 9))) for _ in range(60_000))
    h, _ = textkit.words(pa.array([many]))
    seen = {}
    assert all(seen.setdefault(w, x) == x for w, x in zip(words(many), h.tolist(), strict=True)) and len(set(seen.values())) == len(seen)


@needs_vocabulary
def test_encoder_against_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    from marlstone.llm import encoder

    rng = random.Random(6)
    made = ["".join(rng.choices("abcXYZéÉßñ×÷'’.,-0127日本ΣΑ", k=rng.randrange(1, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choices(made, k=rng.randrange(0, 60))) for _ in range(200)] + [None, "", " \t", "ΟΔΟΣ don't x²\x1cy <|endoftext|>", "é" * 70_000]
    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = True
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kept in (0, 100_000):  # a full cache changes nothing
        monkeypatch.setattr(encoder, "CACHED_PARTS", kept)
        monkeypatch.setattr(encoder, "CACHED_WORDS", kept)
        code = encoder.Encoder(VOCABULARY)
        for _ in range(2):
            ids, at = code(pa.array(texts, type=pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    ids = {x for a, b in links if a != b for x in (a, b)}
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: x for i, x in smallest({x for p in links for x in p}, links).items() if i in ids}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_groups(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    links = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links.append((a, b))
    return sets, smallest(sets, links)


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, docs, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "COSTLY", 4)  # so that prefixes are lengthened and hot entries split
    monkeypatch.setattr(ngram_join, "SEEN_IN_BATCH", 2)
    monkeypatch.setattr(ngram_join, "PER_HUB", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(seed)
    common = sentence(rng, 60)
    base = [sentence(rng, rng.choice([8, 30, 90, 200])) for _ in range(12)]
    texts = [*ODD, *base, *base[:4], *(f"{common} {sentence(rng, 12)}" for _ in range(25)), *(f"{sentence(rng, 100)} {common}" for _ in range(20))]
    texts += [edited(rng, rng.choice(base), rng.randrange(1, 5)) for _ in range(50)] + [edited(rng, base[3], k) for k in range(1, 12) for _ in range(4)]
    rng.shuffle(texts)
    sets, want = brute_groups(dict(enumerate(texts)))
    df = docs(*texts, extra=["n", "token"])
    got = {r["doc"]: r for r in ngram_join.similar_groups(df).collect()}
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(x) for k, x in sets.items()}
    assert {k: r["component"] for k, r in got.items()} == want
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_ngram_join_odd_rows(docs):
    text = "a b c d e f g"
    got = sorted((r["doc"] if r["doc"] is not None else -1, r["component"]) for r in ngram_join.similar_groups(docs(text, text, text, None, ids=[5, 5, None, None])).collect())
    assert got == [(-1, None), (-1, None), (5, 5), (5, 5)]
    assert ngram_join.similar_groups(docs()).count() == 0
    assert ngram_join.keep_one(docs(text, text, None, ids=[5, None, None])).count() == 3


def test_ngram_join_repeated_ids(docs):
    a, b = "a b c d e f g", "h i j k l m n"
    got = {tuple(r) for r in ngram_join.similar_groups(docs(a, b, a, b, ids=[5, 5, 3, 4])).select("doc", "component").collect()}
    assert got == {(5, 3), (3, 3), (4, 3)}
    assert {tuple(r) for r in ngram_join.similar_groups(docs(a, "", a, ids=[7, 7, 2])).select("doc", "component").collect()} == {(7, 2), (2, 2)}


@pytest.mark.parametrize("seed", [3, 4])
def test_ngram_join_repeated_ids_against_brute_force(docs, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "COSTLY", 4)
    monkeypatch.setattr(ngram_join, "SEEN_IN_BATCH", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(seed)
    base = [sentence(rng, rng.choice([8, 30, 90])) for _ in range(10)]
    texts = [edited(rng, rng.choice(base), rng.randrange(0, 6)) for _ in range(120)] + ["", None, "x"]
    ids = [rng.randrange(90) for _ in texts]
    sets, lead = brute_groups(dict(enumerate(texts)))
    rows = list(range(len(texts)))
    lead = smallest(rows, [(k, lead[k]) for k in rows] + [(k, ids.index(ids[k])) for k in rows])
    least = {}
    for k in rows:
        least[lead[k]] = min(least.get(lead[k], ids[k]), ids[k])
    got = sorted(map(tuple, ngram_join.similar_groups(docs(*texts, ids=ids)).collect()))
    assert got == sorted((ids[k], len(sets[k]), least[lead[k]]) for k in rows)


def check_pieces(rows, texts, window=2048):
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(VOCABULARY)
    code.encode_special_tokens = True
    at, room = collections.defaultdict(int), collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.array([*code.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids)
        at[r["doc_id"]] += r["length"]
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == room[r["sequence_id"]]
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= window and set(at) == set(texts)
    return room


@needs_vocabulary
def test_packing(docs):
    rng = random.Random(5)
    texts = [None, "", "don't it's 12ab x² <|endoftext|> 日本語", "word " * 5000, *(sentence(rng, rng.randrange(1, 900)) for _ in range(60))]
    rows = packing.pack(docs(*texts, extra=["shard"]), VOCABULARY, shard_bytes=60_000).collect()
    room = check_pieces(rows, dict(enumerate(texts)))
    shards = len({s >> 32 for s in room})
    assert shards > 1 and sum(n < 2048 for n in room.values()) <= shards
    assert packing.pack(docs(), VOCABULARY).count() == 0
    twice = packing.pack(docs("a b", "a b", "c", ids=[1, 1, None]), VOCABULARY).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in twice) == [(0, 2), (1, 3), (1, 3)]


@pytest.mark.parametrize("lonely", [0, 30])
def test_packing_fills_with_neighbours_to_the_last(lonely):
    """Short documents, more to a window than a lot; with terms of its own, rarer than the shared ones, in each."""
    topics = [np.arange(100, 110), np.arange(200, 210)]
    ids = [np.concatenate([topics[k % 2], 1000 + lonely * k + np.arange(lonely)]).astype(np.uint16) for k in range(200)]
    by = collections.defaultdict(list)
    for d, _, length, seq, _ in packing.pack_documents(ids, window=50 * len(ids[0])):
        by[seq].append((d % 2, length))
    assert len(by) == 4 and all(len({t for t, _ in own}) == 1 for own in by.values())


@needs_vocabulary
def test_packing_meets_neighbours_across_the_table(docs):
    rng = random.Random(8)
    words = [[f"{chr(97 + t)}{rng.choice('aeiou')}{chr(97 + rng.randrange(26))}{k}" for k in range(60)] for t in range(8)]
    texts = [" ".join(rng.choices(words[k % 8], k=90)) for k in range(320)]
    size = sum(map(len, texts)) + 16 * len(texts)
    rows = packing.pack(docs(*texts), VOCABULARY, shard_bytes=size // 8).collect()
    check_pieces(rows, dict(enumerate(texts)))
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        by[r["sequence_id"]].append((r["doc_id"] % 8, r["length"]))
    alike = sum(n for own in by.values() for t, n in own[1:] if t == own[0][0])
    assert alike > 0.8 * sum(n for own in by.values() for _, n in own[1:])


@needs_vocabulary
def test_packing_slices_regions_beyond_the_tree(docs, monkeypatch):
    """More shards than the tree has leaves: the same guarantees, and related documents still meet."""
    monkeypatch.setattr(dealing, "REGIONS", 2)
    monkeypatch.setattr(dealing, "SLICED", 4)
    rng = random.Random(8)
    words = [[f"{chr(97 + t)}{rng.choice('aeiou')}{chr(97 + rng.randrange(26))}{k}" for k in range(60)] for t in range(4)]
    texts = [None, "", *(" ".join(rng.choices(words[k % 4], k=90)) for k in range(2, 300)), *["one text that all of these share " * 9] * 200]
    size = sum(len(t or "") for t in texts) + 16 * len(texts)
    rows = packing.pack(docs(*texts), VOCABULARY, shard_bytes=size // 16).collect()
    room = check_pieces(rows, dict(enumerate(texts)))
    loads, kinds = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in rows:
        loads[r["sequence_id"] >> 32] += len(texts[r["doc_id"]] or "") + 16 if not r["start"] else 0
        kinds[r["sequence_id"] >> 32][4 if r["doc_id"] >= 300 else r["doc_id"] % 4] += 1
    assert len(loads) >= 16 and max(loads.values()) < 1.2 * (size // 16) + 1000
    assert sum(n < 2048 for n in room.values()) <= len(loads)
    assert sum(max(c.values()) for c in kinds.values()) > 0.6 * len(rows)


@needs_vocabulary
def test_packing_splits_a_group_of_copies(docs):
    texts = ["one text that all of these share"] * 300 + [f"other {k} text" for k in range(100)]
    rows = packing.pack(docs(*texts), VOCABULARY, shard_bytes=2000).collect()
    check_pieces(rows, dict(enumerate(texts)))
    loads = collections.Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(loads) >= 7 and max(loads.values()) < 150


def test_packing_takes_neighbours():
    rng = np.random.default_rng(1)
    topics = [rng.integers(100 * t, 100 * t + 80, 700) for t in range(4)]
    ids = [rng.permutation(topics[k % 4])[:500].astype(np.uint16) for k in range(16)]
    by = collections.defaultdict(list)
    for d, _, length, seq, _ in packing.pack_documents(ids):
        by[seq].append((d % 4, length))
    alike = sum(n for own in by.values() for t, n in own if t == own[0][0])
    assert alike > 0.9 * sum(map(len, ids))


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    rows = [(k, [float(x) for x in base[k % 30] + rng.standard_normal(16) * (0.02 if k >= 30 else 0) * (k % 9)], k % 2) for k in range(300)]
    rows += [(300 + k, rows[0][1], 0) for k in range(40)] + [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [math.nan] * 16, 0), (404, rows[0][1], None), (405, rows[0][1][:8], 0), (406, [None] * 16, 0), (407, [math.inf] + [0.0] * 15, 0), (408, [x * 1e-30 for x in rows[0][1]], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("copies", F.lit(1))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    able = [r for r in rows if r[0] is not None and (r[0] < 400 or r[0] in (405, 408))]
    links = [(a[0], b[0]) for a in able for b in able if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and embedding_dedup.unit([a[1]])[0] @ embedding_dedup.unit([b[1]])[0] >= 0.93]
    n = collections.Counter(x for p in links for x in p)
    want = smallest([r[0] for r in rows if r[0] is not None], links)
    assert {k: (r["n_links"], r["component_id"], r["kept"]) for k, r in got.items() if k is not None} == {k: (n[k], want[k], want[k] == k) for k in want}
    assert tuple(got[None])[1:] == (0, None, False)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_embeddings_with_repeated_ids(spark):
    """Every row is a vector of its own, whatever its id: against all pairs of rows."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, [1.0, 0.1, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    rng = np.random.default_rng(12)
    base = rng.standard_normal((12, 8))
    rows = [(int(rng.integers(0, 40)), [float(np.float32(x)) for x in base[k % 12] + rng.standard_normal(8) * rng.choice([0, 0.05, 0.2])], k % 2) for k in range(160)]
    for kind in ("double", "float"):
        got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()
        links = [(i, j) for i, x in enumerate(rows) for j, y in enumerate(rows) if i < j and x[2] == y[2] and embedding_dedup.unit([x[1]])[0] @ embedding_dedup.unit([y[1]])[0] >= 0.93]
        n, lead = collections.Counter(x for p in links for x in p), smallest(range(len(rows)), links)
        least = {}
        for i, r in enumerate(rows):
            least[lead[i]] = min(least.get(lead[i], r[0]), r[0])
        assert sorted(map(tuple, got)) == sorted((r[0], n[i], least[lead[i]], r[0] == least[lead[i]]) for i, r in enumerate(rows))


def test_forest_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 60)  # several levels and blocks on a small table
    monkeypatch.setattr(embedding_dedup, "BLOCK", 80)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((400, 64))
    near = base[rng.integers(0, 400, 500)] + rng.standard_normal((500, 64)) * 0.3
    group = base[0] + rng.standard_normal((300, 64)) * 0.05
    x = np.vstack([base, near, group])
    df = spark.createDataFrame([(k, [float(c) for c in v], 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = embedding_dedup.unit(x.astype(np.float32).tolist())
    link = u @ u.T >= 0.93
    np.fill_diagonal(link, False)
    n = np.array([r["n_links"] for r in embedding_dedup.near_duplicates(df).orderBy("vec_id").collect()])
    assert (n <= link.sum(axis=1)).all() and n.sum() >= 0.99 * link.sum()


def test_tight_group():
    """Around one centre, alone or as most of a table, vectors are in few leaves and meet the others of their group."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    for share in (1.0, 0.6):
        n = 3000
        tight = centre + rng.standard_normal((int(n * share), 64)) * 0.02
        x = embedding_dedup.unit(np.vstack([tight, rng.standard_normal((n - len(tight), 64))]).tolist())
        splits = embedding_dedup.fit_splits(list(x[:: 2]))
        for depth in (4, 14):
            row, code = embedding_dedup.leaves_of(x, np.full(len(x), depth), splits)
            assert np.bincount(row)[: len(tight)].max() <= 12
            inside = row < len(tight)
            met = np.zeros((200, len(tight)), dtype=bool)
            for leaf in np.unique(code[inside & (row < 200)]):
                own = row[(code == leaf) & inside]
                met[np.ix_(own[own < 200], own)] = True
            assert met.mean() >= 0.99


def test_forest_splits_and_finds(spark):
    """A label beyond a leaf is split, and hardly a link is lost."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((900, 64))
    x = np.vstack([base, base[:300] + rng.standard_normal((300, 64)) * 0.36])
    df = spark.createDataFrame([(k, [float(c) for c in v], 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = embedding_dedup.unit(x.tolist())
    link = u @ u.T >= 0.93
    np.fill_diagonal(link, False)
    row, code = embedding_dedup.leaves_of(u, np.full(len(u), 4), embedding_dedup.fit_splits(list(x)))
    assert len(np.unique(code)) > 6 * 4
    n = np.array([r["n_links"] for r in embedding_dedup.near_duplicates(df).orderBy("vec_id").collect()])
    assert link.sum() > 100 and (n <= link.sum(axis=1)).all() and n.sum() >= 0.99 * link.sum()


def test_toxicity_of_few_labels(spark, docs):
    df = docs("one two three", "four five", "", None, "word " * 200_000)
    kind = "doc_id long, low_quality int, toxic int"
    for rows in ([(0, 1, 1)], [(0, 1, 0), (1, 0, None)], [(0, None, 1)], [(0, 1, None), (1, 0, None)], [(0, 0, 1), (1, 1, 0), (2, 0, 0)]):
        got = toxicity.score(df, spark.createDataFrame(rows, kind)).collect()
        assert len(got) == 5 and all(0 <= r[c] <= 1 for r in got for c in ("p_low_quality", "p_toxic"))
        if all(r[2] is None for r in rows):
            assert {(r["p_toxic"], r["toxic"]) for r in got} == {(0.5, False)}


def toxic_table(docs, spark, n=600):
    rng = random.Random(7)
    insults = ["grobnak", "zurgle", "fimpot"]
    texts, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        text = sentence(rng, rng.randrange(20, 120), 3000)
        texts.append(text.replace("w1", rng.choice(insults), 2).replace("w2", f"{rng.choice(insults)}***", 1) if toxic else text)
        labels.append((k, 0 if k % 5 == 1 else 1, int(toxic)))
    return texts, docs(*texts, extra=["p"]), spark.createDataFrame([x for x in labels if x[0] % 2 == 0] + [(10**6, 1, 1), (None, 1, 0), (0, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs):
    texts, df, labels = toxic_table(docs, spark)
    labels = labels.withColumn("low_quality", 1 - F.col("quality"))
    got = {r["doc_id"]: r for r in toxicity.score(df, labels).collect()}
    unseen = [k for k in got if k % 2]
    assert np.mean([got[k]["toxic"] == (k % 5 == 0) for k in unseen]) > 0.98
    models, told = toxicity.train(df, labels, ("low_quality", "toxic"))
    assert told["toxic"] > 0.97 and len(models) == 2
    assert len(models[1].weights) == len(models[1].words) + toxicity.DENSE + 2  # the earlier category is an input
    again = docs(*texts, "other words", "other words too", ids=[*range(len(texts)), 0, 4])  # an id of two texts trains with one of them
    twice = [sorted(map(tuple, toxicity.score(x, labels).collect())) for x in (again, again.orderBy(F.desc("text")))]
    assert twice[0] == twice[1]
    odd = toxicity.score(docs(None, "", "x", "x", ids=[1, None, 2, 2]), labels.where("false"))
    assert [r["p_toxic"] for r in odd.collect()] == [0.5] * 4
    assert toxicity.score(docs(), labels).count() == 0


def brute_features(text):
    """Distinct words, cut at ASCII punctuation as well, and the three numbers."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)
    size = max(len((text or "").encode()), 1)
    # words are told apart by their hash, as the models are
    ids = {int(toxicity.word_ids(pa.array([w]))[0][0]) for w in set(found)}
    return ids, [math.log1p(len(found)), sum(c in "#*$%&|<>" for c in text or "") / size, len(ids) / max(len(found), 1)]


def brute_fit(rows, before, y):
    """Ridge logistic regression on the words that tell the classes apart; returns a predictor."""
    n, pos = len(y), max(sum(y), 1e-9)
    held, hits = collections.Counter(w for s, _ in rows for w in s), collections.Counter(w for (s, _), v in zip(rows, y, strict=True) if v for w in s)
    z = {}
    for w, k in held.items():
        if k >= toxicity.LEAST_DOCUMENTS:
            share = k / n
            z[w] = abs(hits[w] / pos - (k - hits[w]) / max(n - pos, 1e-9)) / (math.sqrt(share * (1 - share) * (1 / pos + 1 / max(n - pos, 1e-9))) + 1e-12)
    words_ = [w for w in z if z[w] >= toxicity.LEAST_Z]
    assert len(words_) < toxicity.MAX_WORDS
    d = np.array([x for _, x in rows])
    mean, scale = d.mean(axis=0), d.std(axis=0) + 1e-9
    row = lambda r, b: [*(float(w in r[0]) for w in words_), *((np.array(r[1]) - mean) / scale), *b, 1.0]
    x, y = np.array([row(r, b) for r, b in zip(rows, before, strict=True)]), np.array(y, dtype=float)
    ridge, w = np.array([toxicity.RIDGE] * (x.shape[1] - 1) + [1e-6]), np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T @ np.diag(p * (1 - p)) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
    return lambda r, b: 1 / (1 + math.exp(-float(np.dot(row(r, b), w))))


def test_toxicity_against_a_plain_chain(spark, docs):
    texts, df, labels = toxic_table(docs, spark, 400)
    labels = labels.withColumn("low_quality", 1 - F.col("quality"))
    known = {}
    for r in labels.where("doc_id is not null").collect():
        known.setdefault(r["doc_id"], []).append((r["low_quality"], r["toxic"]))
    mean = lambda xs: (lambda v: None if not v else float(sum(v) / len(v) >= 0.5))([x for x in xs if x is not None])
    y = {k: [mean([x[c] for x in v]) for c in (0, 1)] for k, v in known.items() if k < len(texts)}
    ids = sorted(y)
    feats = {k: brute_features(t) for k, t in enumerate(texts)}
    fold = {k: zlib.crc32(str(k).encode()) % toxicity.FOLDS for k in ids}
    chain, before = [], {k: [] for k in ids}
    for c in (0, 1):
        able = [k for k in ids if y[k][c] is not None]
        fitted = lambda rows: brute_fit([feats[k] for k in rows], [before[k] for k in rows], [y[k][c] for k in rows])  # noqa: B023, E731
        held_out = {}
        for f in range(toxicity.FOLDS):
            model = fitted([k for k in able if fold[k] != f])
            held_out |= {k: model(feats[k], before[k]) for k in ids if fold[k] == f}
        chain.append(fitted(able))
        before = {k: [*before[k], held_out[k]] for k in ids}
    got = {r["doc_id"]: r for r in toxicity.score(df, labels).collect()}
    for k in range(len(texts)):
        p = []
        for model in chain:
            p.append(model(feats[k], p))
        assert (got[k]["p_low_quality"], got[k]["p_toxic"]) == pytest.approx(tuple(p), abs=1e-6)


@needs_vocabulary
def test_packing_splits_rows_without_an_id(docs):
    texts = ["one text that all of these share"] * 300
    rows = packing.pack(docs(*texts, ids=[None] * 300), VOCABULARY, shard_bytes=2000).collect()
    loads = collections.Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) >= 300 and len(loads) >= 4 and max(loads.values()) < 150


@pytest.mark.parametrize("order", [2, 3])
def test_lm(docs, order):
    rng = random.Random(9)
    texts = [None, "", "A a", "ünï " * 50] + [" ".join(f"w{(k + j * j) % 40}" if rng.random() < 0.9 else f"z{rng.randrange(999)}" for j in range(rng.randrange(5, 80))) for k in range(300)]
    rows = {r["doc_id"]: r for r in lm_scoring.score(docs(*texts, extra=["chunk", "fold"]), order).collect()}
    tokens = {k: [*words(t), 0] for k, t in enumerate(texts)}
    out = {k for k in tokens if zlib.crc32(str(k).encode()) % 7 == 2}
    c = collections.Counter(w for k, t in tokens.items() if k not in out for w in t)
    total, types = sum(c.values()), len(c)
    for k, t in tokens.items():
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k in out, len(t), sum(c[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (total + types + 1)) for w in t))
    assert sum(rows[k]["score"] for k in out) > 0.95 * sum(rows[k]["base_score"] for k in out)


def test_lm_is_a_distribution(docs):
    """The probabilities of all next words after a context sum to one."""
    counts = [np.array([3, 1]), np.array([2, 1])]
    p, bucket = lm_scoring.estimates(counts, np.array([True, False]), 4, 8, 3)
    assert p[:, 0].tolist() == [0.25, 3 / 8, 0.5] and p[:, 1].tolist() == [0.25, 1 / 8, 1 / 3] and bucket.tolist() == [2, 2]
    weights = lm_scoring.learn_weights(np.array([], dtype=np.int64), np.array([]), np.zeros((3, 0)))
    assert np.allclose(weights.sum(axis=1), 1)


def test_lm_large_counts():
    """Beyond 2**32 occurrences."""
    big = np.array([5, (1 << 32) + 5, 1 << 50])
    assert lm_scoring.expand(lm_scoring.squeeze(big)).tolist() == big.tolist() and lm_scoring.expand(lm_scoring.squeeze(big[:1])).tolist() == [5]
    h = lm_scoring.pack_hashes(np.array([7, 9], dtype=np.uint64), 1)
    asked = pa.table({"chunk": [1, 2], "deleted": [False, True], "hashes": [h, h], "counts": [lm_scoring.squeeze(np.array([1 << 33, 1])), lm_scoring.squeeze(np.array([3, 0]))]})
    rows = lm_scoring.add_up((pa.scalar(0), pa.scalar(1)), asked).to_pylist()
    assert [rows[0][c] for c in lm_scoring.SUMS] == [2, 2, (1 << 33) + 4, 3]
    assert lm_scoring.expand(rows[1]["totals"]).tolist() == [(1 << 33) + 3, 1] and lm_scoring.expand(rows[2]["totals"]).tolist() == [(1 << 33) + 3, 1, 3, 0]
    assert lm_scoring.sized(0) == (8 << 20, 8) and lm_scoring.sized(1 << 47)[0] == 64 << 20


def brute_lm(texts, order):
    """Scores with plain dictionaries, and expectation-maximisation over every held-out token."""
    tokens = {k: [*words(t), 0] for k, t in enumerate(texts)}
    fold = {k: zlib.crc32(str(k).encode()) % 7 for k in tokens}

    def model(docs):
        c = collections.Counter()
        for k in docs:
            own = ["<"] * (order - 1) + tokens[k]
            c.update(tuple(own[i - n + 1 : i + 1]) for i in range(order - 1, len(own)) for n in range(1, order + 1))
        n_tokens, types = sum(v for g, v in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)

        def rows(k):
            own = ["<"] * (order - 1) + tokens[k]
            for i in range(order - 1, len(own)):
                p, seen = [1 / (types + 1), c[(own[i],)] / n_tokens], n_tokens
                for n in range(2, order + 1):
                    context = tuple(own[i - n + 1 : i])
                    # at a document's start the context of n - 1 words is counted with what stands before it
                    seen = len(docs) if i == order - 1 else c[context]
                    p.append(c[tuple(own[i - n + 1 : i + 1])] / seen if seen else 0)
                yield p, min(int(math.log2(seen + 1)), lm_scoring.FREQUENCIES - 1)

        return rows

    train = [k for k in tokens if fold[k] != 2]
    left = model([k for k in train if fold[k] != 3])
    held = [x for k in train if fold[k] == 3 for x in left(k)]
    p, bucket = np.array([x for x, _ in held]).T, np.array([b for _, b in held])
    weights = lm_scoring.learn_weights(bucket, np.ones(len(bucket)), p)
    whole = model(train)
    return {k: sum(math.log10(weights[b] @ np.array(x)) for x, b in whole(k)) for k in tokens}, weights


@pytest.mark.parametrize("order", [2, 3])
def test_lm_against_brute_force(docs, order):
    rng = random.Random(10 + order)
    texts = ["", None] + [" ".join(f"w{(k + j * j) % 40}" if rng.random() < 0.9 else f"z{rng.randrange(99)}" for j in range(rng.randrange(3, 60))) for k in range(250)]
    want, _ = brute_lm(texts, order)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs(*texts), order).collect()}
    assert got.keys() == want.keys()
    # the weights come from a histogram, so scores agree to its grain
    assert max(abs(got[k] - want[k]) / len([*words(texts[k]), 0]) for k in want) < 0.01
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.003)


def test_lm_odd_tables(docs):
    assert lm_scoring.score(docs()).count() == 0
    got = lm_scoring.score(docs("a b", "a b", "c", ids=[2, 2, None])).collect()
    assert len(got) == 3 and all(math.isfinite(r["score"]) for r in got)
    lone = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][0]
    r = lm_scoring.score(docs("a b", ids=[lone])).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0.0
