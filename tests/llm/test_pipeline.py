"""The pipeline's stages, each against a brute-force version on its own input, and the whole of run()."""

import hashlib
import random
from collections import Counter

import regex

import __spark_entry__
import corpus_pipeline
from marlstone.llm import mixing, quality
from tests.llm.test_free import brute_groups, check_pieces, edited, sentence
from tests.llm.test_native import brute_lines, brute_quality

def brute_fails(line):
    s = line.strip(" \t\n\x0b\x0c\r")
    n = len(regex.findall(r"[^\x20\x09-\x0D]+", s))
    ended = regex.search(r"[.!?:;…。！？][\"'”’)\]]*$", s) is not None
    led = any(s.lower().startswith(w) and not regex.match(r"[\pL\pN]", s[len(w) : len(w) + 1]) for w in quality.NAVIGATION)
    return not regex.search(r"[\pL\pN]", s) or sum(c in "#*$%&|<>" for c in s) * 10 > len(s) or (n < 3 and not ended) or sum(c in "|»›•·" for c in s) > 1 or (n <= 5 and led and not ended) or any(b in s.lower() for b in quality.BOILERPLATE)


def brute_clean(text):
    n, chars, _, _, repeated = brute_quality(text)
    lines = [x for x in (text or "").split("\n") if not (x.strip(" \t\n\x0b\x0c\r") and brute_fails(x))]
    left = sum(map(len, regex.findall(r"[^\x20\x09-\x0D]+", "\n".join(lines))))
    if n < 50 or 100 * repeated > 50 * n or (chars - left) * 100 > 50 * chars:
        return None
    return "\n".join(lines)


def brute_mix(rows):
    size = {k: len(regex.findall(r"[^\x20\x09-\x0D]+", t)) for k, t, _ in rows}
    total = Counter()
    for k, _, s in rows:
        total[s] += size[k]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    target = mixing.fill_targets(dict(total), {s: 1 + k % 3 for k, s in enumerate(names)}, sum(total.values()))
    out = Counter()
    for s in names:
        wanted = min(int(target[s] + 0.5), 3 * total[s])
        rest = wanted % total[s] if total[s] else 0
        for k, _, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"17:{r[0]}".encode()).hexdigest(), r[0])):
            taken = wanted // total[s] * size[k] + min(size[k], max(0, rest))
            rest -= size[k]
            if times := (2 * taken + size[k]) // (2 * size[k]) if size[k] else 0:
                out[k] = times
    return out


def corpus():
    rng = random.Random(11)
    line = lambda n: sentence(rng, n, 5000) + "."
    shared = [line(15) for _ in range(3)]
    texts = ["\n".join(line(rng.randrange(5, 40)) for _ in range(rng.randrange(2, 7))) for _ in range(120)]
    texts = [t + "\n" + shared[k % 3] if k % 4 else t for k, t in enumerate(texts)]
    texts += [edited(rng, texts[k].replace("\n", " "), 2) for k in range(1, 30)] + texts[:15]
    texts += [texts[3] + "\nHome | About | Contact\nAll rights reserved.", "short", "", None, "### $$$ *** " * 80, "same " * 400, texts[8] + "\nAlle Rechte vorbehalten. Datenschutz.\nPRÉCÉDENT ici\nMenú principal\nPolítica de privacidad de hoy.\nWeiter geht es.", texts[5] + "\n" + line(900) + "\n" + line(2500)]
    return [(k, t, "en", f"s{rng.choice([0, 0, 0, 1, 2, 3, 4, 5])}" if k % 31 else None, len(t or "")) for k, t in enumerate(texts)]


def test_stages_and_run(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda df: sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=lambda x: x[:2])
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        seen.append((docs, docs := spark.read.parquet(f"{tmp_path}/{k}")))
    before, after = seen[0]
    assert rows(after) == [(k, t, s) for k, t, s in ((k, brute_clean(t), s) for k, t, s in rows(before)) if t is not None]
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = seen[1]
    lines = brute_lines(rows(before), 5)
    full = {k: sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n")) for k, t, _ in rows(before)}
    assert any(gone for _, gone in lines.values())
    assert rows(after) == [(k, lines[k][0], s) for k, _, s in rows(before) if lines[k][1] == 0 or lines[k][1] < full[k]]
    before, after = seen[2]
    lead = brute_groups({k: t for k, t, _ in rows(before)})[1]
    assert rows(after) == [x for x in rows(before) if lead[x[0]] == x[0]] and len(rows(after)) < len(rows(before))
    before, after = seen[3]
    want = brute_mix(rows(before))
    assert Counter(k for k, _, _ in rows(after)) == want and max(want.values()) > 1
    before, after = seen[4]
    pieces = after.collect()
    texts, times = {k: t for k, t, _ in rows(before)}, Counter(k for k, _, _ in rows(before))
    assert sum(r["length"] for r in pieces) == sum(times[k] * next(r["doc_tokens"] for r in pieces if r["doc_id"] == k) for k in times)
    lone = {k: texts[k] for k in times if times[k] == 1}
    once = [r for r in pieces if r["doc_id"] in lone]
    by_sequence = Counter()
    for r in pieces:
        by_sequence[r["sequence_id"]] += r["length"]
    assert max(by_sequence.values()) <= 2048
    check_tiles(once, lone)
    whole = __spark_entry__.queries()["pipeline"](spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pieces))


def check_tiles(pieces, texts):
    """As check_pieces, without the sequences' other documents."""
    moved, at = [], Counter()
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        row = r.asDict()
        row["offset"] = at[row["sequence_id"]]
        at[row["sequence_id"]] += row["length"]
        moved.append(row)
    check_pieces(moved, texts)
