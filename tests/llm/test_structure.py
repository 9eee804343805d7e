"""Structure repair against a plain search over (cost, audit) pairs."""

import hashlib
import heapq
import random
import zlib

import pytest

from marlstone.llm import structure

SCHEMA = "conv_id long, turn long, role string, text string, seq long, cost long"
SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """Best first search for the least (cost, audit); rows are (role, text) in order."""
    seen, kinds = set(), []
    for role, text in rows:
        solid = text.strip(SPACE)
        kinds.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return kinds, cost, audit, "\n".join(out)

        def go(more, letter, i, role, text, cost=cost, audit=audit, out=out, last=last):
            kind = role[:1]
            if kind == "s" and last == "" or kind == "u" and last in ("", "s", "a") or kind == "a" and last == "u":
                heapq.heappush(heap, (cost + more, audit + letter, i, kind, (*out, f"{role}:{text}")))

        for role in ("user", "assistant"):
            go(5, "I", i, role, "")
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if kinds[i] in ("", "truncated"):
                more = 5 if kinds[i] else 0
                go(more, "K", i + 1, role, text)
                for new in ("user", "assistant"):
                    go(more + 1, "R", i + 1, new, text)


def expected(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = [(*r[:2], *(" " if x is None else x for x in r[2:4])) for r in table if r[0] == conv]
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.md5(f"{r[2]}\n{r[3]}".encode()).hexdigest()))
        said = [r[2:] for r in rows]
        kinds, cost, audit, text = plain(said)
        turns = {r[1] for r in rows} - {None}
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def table(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), None]:
        turn = 0
        for _ in range(rng.randint(1, most)):
            turn += rng.choice([0, 1, 1, 1, 2])
            text = rng.choice(["Yes.", "No!", "well", "", " ", None, "A longer answer, with a question?", f"t{rng.randint(0, 3)}.", "cut \n", "end. \t", "x" * 70 + rng.choice("ab")])
            rows.append((c, rng.choice([turn, turn, turn, turn, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "User", "tool", "", None]), text, 1, 1))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_same_as_plain(spark, chunk):
    rows = table(chunk, 60, 14)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in structure.summary(structure.repair(df, chunk_turns=chunk)).collect()}
    assert got == expected(rows)


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(7, k // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["one.", "two!", "three", f"{k}.", f"{k}"]), 1, 1) for k in range(3000)] + [(8, 0, "user", "alone.", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    parts = structure.repair(df, chunk_turns=50)
    assert parts.where("conv_id = 7").count() > 50
    got = {r["conv_id"]: tuple(r)[1:] for r in structure.summary(parts).collect()}
    assert got == expected(rows)
    turns = structure.repaired_turns(parts).where("conv_id = 7").orderBy("seq", "place").collect()
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest() == got[7][-1]
    initials = "".join(r["role"][0] for r in turns).removeprefix("s")
    assert initials == "ua" * (len(initials) // 2)


def test_walk_takes_the_least_letters():
    fine = structure.FINE
    for initials in (["u", "u", "a"], ["a", "a"], ["s", "s"], ["u"], ["a", "u"], []):
        dist = structure.distances([fine] * len(initials), initials, dict(enumerate(structure.LAST)))
        letters, _, end = structure.walk([fine] * len(initials), initials, dist, 0)
        _, cost, audit, _ = plain([({"u": "user", "a": "assistant", "s": "system"}[x], f"{k}.") for k, x in enumerate(initials)])
        assert (dist[0], letters + structure.last_edits(end)[0]) == (cost, audit)


def test_damage_and_empty(spark):
    rows = [(c, t, r, x, 1, 1) for c in range(40) for t, r, x in ((0, "user", "Hi! How?"), (1, "assistant", None), (None, None, "So."))]
    want = []
    for c, t, r, x, *_ in rows:
        way = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        x = "" if way == 1 else "".join(ch for ch in x if ch not in ".!?") if way == 2 else x
        want += [(c, t, "user" if way == 4 else r, x)] * (0 if way == 0 else 2 if way == 3 else 1)
    got = structure.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len({len(rows), len(want)}) == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert structure.summary(structure.repair(empty)).collect() == []
    long_ = spark.createDataFrame([(1, 0, "user", "word " * 500_000 + ".", 1, 1), (1, 1, "assistant", "Yes.", 1, 1)], SCHEMA)
    assert structure.summary(structure.repair(long_, chunk_bytes=1000)).first()["audit"] == "KK"
