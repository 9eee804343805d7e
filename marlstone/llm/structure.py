"""Conversation structure repair: the cheapest edits that give roles the order ``(s?(ua)+)?``.

A conversation's turns, by turn (nulls first, ties by role and text, and by a hash where texts share 64 characters), are a graph: a node for each place between
turns and each state of the order, an arc for each edit. Keep costs 0, rerole to user or assistant 1, delete 2
(blank and repeated turns only have this), insert an empty turn 5, and a truncated turn that stays 5 more. Since
costs are small integers, distances to the end come from Dial's buckets, a circle of lists as long as the dearest
arc; then a walk from the start takes, of the tight arcs, the one whose letter (D, I, K, R) comes first, which
gives the least audit of all cheapest ones.

Turns are sorted by ranges of (conversation, turn, role, text), so that a conversation may have any number, and cut
into chunks. A conversation that lies inside one chunk is solved at once. Of the others each chunk gives its 4 by 4
distances from state to state; a pass from the last chunk to the first adds them up, one back gives each chunk the
state it begins in, and every chunk is walked for itself. Both passes stream rows of some numbers a chunk.

Null roles and texts are one space; a null conversation is one conversation. Repeated rows are repeated turns. Very
long texts make chunks of their own. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources import scratch

#: Turns and bytes of text of a chunk.
CHUNK_TURNS, CHUNK_BYTES = 4096, 1 << 20
SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user's, after an assistant's. Where a turn of a kind leads from each.
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE = {2: "user", 3: "assistant"}
NAMES = {"u": "user", "a": "assistant"}
#: What is left to do in each state when the turns are over: nothing, a user and an assistant, an assistant, nothing.
LAST = [0, 2 * INSERT, INSERT, 0]
FAR = 1 << 60
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
PART = (
    "conv_id long, seq long, whole boolean, n_turns long, first_turn long, last_turn long, turns long, first_role string, last_role string, "
    "blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits array<string>, roles array<string>, texts array<string>"
)
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: Kinds of a turn by its first fault.
FINE, BLANK, REPEATED, CUT = range(4)


def distances(kinds: list[int], initials: list[str], after: dict[int, int]) -> list[int]:
    """Costs from each node (place * 4 + state) to the end of the turns, where ``after`` is the cost from there on (Dial's buckets)."""
    n = len(kinds)
    dist = [FAR] * (4 * n + 4)
    if not after:
        return dist
    base = min(after.values())
    size = max(INSERT, REROLE + TRUNCATED, max(after.values()) - base) + 1
    buckets: list[list[int]] = [[] for _ in range(size)]
    open_ = 0

    def reach(node: int, d: int) -> int:
        if d < dist[node]:
            dist[node] = d
            buckets[d % size].append(node)
            return 1
        return 0

    for q, x in after.items():
        open_ += reach(4 * n + q, x - base)
    d = 0
    while open_:
        bucket = buckets[d % size]
        while bucket:
            node = bucket.pop()
            open_ -= 1
            if dist[node] != d:
                continue  # found cheaper since
            place, q = divmod(node, 4)
            if place < n and q > 1:  # an inserted turn leads here, from the same place
                for p, to in MOVES["u" if q == 2 else "a"].items():
                    if to == q:
                        open_ += reach(4 * place + p, d + INSERT)
            if not place:
                continue
            kind, initial = kinds[place - 1], initials[place - 1]
            open_ += reach(node - 4, d + DELETE)
            if kind in (BLANK, REPEATED):
                continue
            more = TRUNCATED if kind == CUT else 0
            for letter in "sua":
                cost = more + (0 if initial == letter else REROLE if letter != "s" else FAR)
                if cost < FAR:
                    for p, to in MOVES[letter].items():
                        if to == q:
                            open_ += reach(4 * place - 4 + p, d + cost)
        d += 1
    return [x if x == FAR else x + base for x in dist]


def walk(kinds: list[int], initials: list[str], dist: list[int], state: int) -> tuple[str, list[int], int]:
    """The least letters of a cheapest way from ``state`` to the end of the turns, the state after each, and the last state."""
    n, place, letters, states = len(kinds), 0, [], []
    while place < n:
        here, kind, initial = dist[4 * place + state], kinds[place], initials[place]
        if here == DELETE + dist[4 * place + 4 + state]:
            place += 1
            letters.append("D")
            states.append(state)
            continue
        to = 3 if state == 2 else 2
        if here == INSERT + dist[4 * place + to]:
            state = to
            letters.append("I")
        else:
            more = TRUNCATED if kind == CUT else 0
            kept = MOVES.get(initial, {}).get(state)
            if kept is not None and here == more + dist[4 * place + 4 + kept]:
                state = kept
                letters.append("K")
            else:
                state = to
                letters.append("R")
            place += 1
        states.append(state)
    return "".join(letters), states, state


def last_edits(state: int) -> tuple[str, list[int]]:
    """The turns inserted behind the last one."""
    return {1: ("II", [2, 3]), 2: ("I", [3])}.get(state, ("", []))


def kinds_of(roles: list[str], texts: list[str], seen: set[int] = frozenset()) -> list[int]:
    """The first fault of each turn; ``seen``: places whose turn an earlier chunk has."""
    out, before = [], set()
    for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
        solid = text.rstrip(SPACE)
        if not solid:
            out.append(BLANK)
        elif k in seen or (role, text) in before:
            out.append(REPEATED)
        else:
            out.append(FINE if solid[-1] in ".!?" else CUT)
        before.add((role, text))
    return out


def illegal_pairs(initials: list[str]) -> int:
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))


def repaired(roles: list[str], texts: list[str], letters: str, states: list[int]) -> tuple[list[str], list[str]]:
    out, at = ([], []), 0
    for letter, state in zip(letters, states, strict=True):
        if letter == "I":
            out[0].append(ROLE[state])
            out[1].append("")
            continue
        if letter != "D":
            out[0].append(roles[at] if letter == "K" else ROLE[state])
            out[1].append(texts[at])
        at += 1
    return out


def solve(part: dict, state: int, after: list[int], last: bool, seen: set[int] = frozenset()) -> dict:
    """The part with its edits and repaired turns, from the state it begins in and the costs behind it."""
    roles, texts = part["roles"], part["texts"]
    kinds, initials = kinds_of(roles, texts, seen), [r[:1] for r in roles]
    dist = distances(kinds, initials, {q: x for q, x in enumerate(after) if x < FAR})
    letters, states, end = walk(kinds, initials, dist, state)
    cost = dist[state] - after[end]
    if last:
        more, inserted = last_edits(end)
        letters, states, cost = letters + more, states + inserted, cost + INSERT * len(more)
    fixed = repaired(roles, texts, letters, states)
    counts = {"blank": kinds.count(BLANK), "duplicate": kinds.count(REPEATED), "truncated": kinds.count(CUT), "illegal": illegal_pairs(initials)}
    return part | counts | {"cost": cost, "audit": letters, "edits": list(letters), "roles": fixed[0], "texts": fixed[1]}


def schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in PART.split(", "))])


def batch(parts: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(parts, schema=schema())


def cut(most_turns: int, most_bytes: int):
    """Sorted turns to PART rows: whole conversations solved, chunks of others (and of the first and last of the task) as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        conv, chunks, first = None, 0, True
        roles, texts, turns, size = [], [], [], 0
        out: list[dict] = []

        def chunk(whole: bool) -> dict:
            nonlocal seq, roles, texts, turns, size
            known = [t for t in turns if t is not None]
            part = {"conv_id": conv, "seq": seq, "whole": whole, "n_turns": len(roles), "first_turn": min(known, default=None), "last_turn": max(known, default=None), "turns": len(set(known)), "first_role": roles[0][:1], "last_role": roles[-1][:1], "roles": roles, "texts": texts}
            seq, roles, texts, turns, size = seq + 1, [], [], [], 0
            return solve(part, 0, LAST, True) if whole else part

        for b in batches:
            for c, turn, role, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if roles and (c != conv or len(roles) >= most_turns or size >= most_bytes):
                    # only a conversation that begins and ends here, in one chunk, is known to be whole
                    out.append(chunk(c != conv and not chunks and not first))
                    chunks, first = (0, False) if c != conv else (chunks + 1, first)
                conv = c
                roles.append(role)
                texts.append(text)
                turns.append(turn)
                size += len(text)
                if len(out) >= 256:
                    yield batch(out)
                    out = []
        if roles:
            out.append(chunk(False))
        if out:
            yield batch(out)

    return run


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts to (key, seq, place): each different turn of a part where it is first."""
    for b in batches:
        found: dict[tuple[bytes, int], int] = {}
        for p in b.to_pylist():
            for k, (role, text) in enumerate(zip(p["roles"], p["texts"], strict=True)):
                said = f"{p['conv_id']}\0{len(role)}\0{role}{text}".encode()
                found.setdefault((hashlib.blake2b(said, digest_size=16).digest(), p["seq"]), k)
        yield pa.record_batch([pa.array([k for k, _ in found], pa.binary()), pa.array([s for _, s in found], pa.int64()), pa.array(list(found.values()), pa.int32())], names=["key", "seq", "place"])


def repeats(parts: DataFrame) -> DataFrame:
    """(seq, seen): the places of each part whose turn an earlier part of its conversation has."""
    keys = parts.mapInArrow(key_rows, "key binary, seq long, place int")
    firsts = keys.groupBy("key").agg(F.min("seq").alias("first"), F.max("seq").alias("last")).where("first < last").select("key", "first")
    return keys.join(firsts, "key").where("seq > first").groupBy("seq").agg(F.collect_list("place").alias("seen"))  # no more than a chunk has turns


def matrix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts to (conv_id, seq, costs): those from each state before the part to each state behind it."""
    for b in batches:
        rows = []
        for p in b.to_pylist():
            kinds, initials = kinds_of(p["roles"], p["texts"], set(p["seen"] or ())), [r[:1] for r in p["roles"]]
            to = [distances(kinds, initials, {q: 0})[:4] for q in range(4)]
            rows.append({"conv_id": p["conv_id"], "seq": p["seq"], "costs": [to[q][p_] for p_ in range(4) for q in range(4)]})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("costs", pa.list_(pa.int64()))]))


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, seq, costs) from the last part of each conversation to the first, to (seq, after, last)."""
    conv, after = object(), LAST
    for b in batches:
        rows = []
        for c, seq, costs in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            last = c != conv
            conv, after = c, LAST if last else after
            rows.append({"seq": seq, "after": after, "last": last})
            after = [min(min(costs[4 * p + q] + after[q], FAR) for q in range(4)) for p in range(4)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("seq", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_())]))


def end_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts with the costs behind them to (conv_id, seq, ends): the state after the part for each state before it."""
    for b in batches:
        rows = []
        for p in b.to_pylist():
            kinds, initials = kinds_of(p["roles"], p["texts"], set(p["seen"] or ())), [r[:1] for r in p["roles"]]
            dist = distances(kinds, initials, {q: x for q, x in enumerate(p["after"]) if x < FAR})
            rows.append({"conv_id": p["conv_id"], "seq": p["seq"], "ends": [walk(kinds, initials, dist, q)[2] for q in range(4)]})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("ends", pa.list_(pa.int64()))]))


def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, seq, ends) from the first part of each conversation to the last, to (seq, state)."""
    conv, state = object(), 0
    for b in batches:
        rows = []
        for c, seq, ends in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            conv, state = c, 0 if c != conv else state
            rows.append({"seq": seq, "state": state})
            state = ends[state]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("seq", pa.int64()), ("state", pa.int64())]))


def solve_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield batch([solve({k: v for k, v in p.items() if k not in ("seen", "after", "last", "state")}, p["state"], p["after"], p["last"], set(p["seen"] or ())) for p in b.to_pylist()])


def streamed(rows: DataFrame, order, run, kind: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, kind)


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_turns: int = CHUNK_TURNS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """PART rows: of each conversation its parts in the order of ``seq``, with counts of faults, cost, edits and repaired turns.

    Most conversations are one part (``whole``). ``illegal`` of a part leaves out the pair
    with the part before it; ``summary`` adds it.
    """
    own = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    # equal rows may lie on either side of a cut; keys of a bounded size go to the driver's sample
    keys = {"__r": F.substring("role", 1, 32), "__t": F.substring("text", 1, 64), "__h": F.md5(F.concat_ws("\n", "role", "text")), "__n": F.monotonically_increasing_id()}
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", *keys)]
    sorted_ = own.withColumns(keys).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    parts = scratch.table(sorted_.mapInArrow(cut(chunk_turns, chunk_bytes), PART), "conversation-parts")
    raw = parts.where("not whole")
    raw = scratch.table(raw.join(repeats(raw), "seq", "left"), "conversation-chunks")
    after = scratch.table(streamed(raw.mapInArrow(matrix_rows, "conv_id long, seq long, costs array<long>"), F.desc("seq"), suffixes, "seq long, after array<long>, last boolean"), "costs-behind")
    behind = raw.join(after, "seq")
    states = streamed(behind.mapInArrow(end_rows, "conv_id long, seq long, ends array<long>"), "seq", prefixes, "seq long, state long")
    return parts.where("whole").unionByName(behind.join(states, "seq").mapInArrow(solve_rows, PART))


def repaired_turns(parts: DataFrame) -> DataFrame:
    """(conv_id, seq, place, role, text): the repaired turns, in the order of seq and place."""
    return parts.select("conv_id", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t")).select("conv_id", "seq", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts, each conversation's one after another, to SUMMARY; of a conversation a task holds its letters, not its texts."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    form = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SUMMARY.split(", "))])
    now, sha, low, high, turns, role, audit, said = None, None, None, None, 0, None, [], False
    total: dict[str, int] = {}

    def close() -> dict:
        gaps = 0 if low is None else high - low + 1 - turns
        return {"conv_id": now, "gaps": gaps, **total, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    for b in batches:
        rows = []
        for p in b.to_pylist():
            if sha is None or p["conv_id"] != now:
                if sha is not None:
                    rows.append(close())
                now, sha, low, high, turns, role, audit, said, total = p["conv_id"], hashlib.sha256(), None, None, 0, None, [], False, dict.fromkeys([*COUNTS, "cost"], 0)
            for k in total:
                total[k] += p[k]
            if role is not None:
                total["illegal"] += role + p["first_role"] not in ("su", "ua", "au")
            role = p["last_role"]
            audit.append(p["audit"])
            if p["first_turn"] is not None:
                turns += p["turns"] - (high == p["first_turn"])  # a turn that goes on in the next part counts once
                low, high = p["first_turn"] if low is None else low, p["last_turn"]
            for r, t in zip(p["roles"], p["texts"], strict=True):
                sha.update(f"{chr(10) if said else ''}{r}:{t}".encode())
                said = True
        yield pa.RecordBatch.from_pylist(rows, schema=form)
    if sha is not None:
        yield pa.RecordBatch.from_pylist([close()], schema=form)


def summary(parts: DataFrame) -> DataFrame:
    """SUMMARY: one row for each conversation of ``repair``."""
    whole = parts.where("whole").mapInArrow(digests, SUMMARY)
    return whole.unionByName(streamed(parts.where("not whole"), "seq", digests, SUMMARY))


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with faults, by a checksum of conversation and turn: rows go, are emptied, lose their sentence ends, are repeated, or are a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("way"))
    text = F.when(F.col("way") == 1, F.lit("")).when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("way") == 0, 0).when(F.col("way") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("__n")).drop("__n")
