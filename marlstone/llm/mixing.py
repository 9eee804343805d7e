"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they count for). The
flow routes each pattern's words to source quotas; a pattern's words may be used up to
three times, and each further use costs more (convex), so repetition is spread as evenly
as the quotas allow. The flow is solved per group of patterns that share sources: its size
depends on the number of patterns, not of documents. Documents are then selected by a
seeded hash: whole epochs for all, and the rest of the quota from the front of the order.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_USES = 3
#: Rows of a source that one window should order.
ROWS_EACH = 4096
#: Cost of the first, second and third use of a word: rising, so that the flow repeats evenly.
USE_COSTS = (0, 1, 3)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def fill_targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, most: float = MAX_USES) -> dict[str | None, float]:
    """Share ``total`` by weight; a target stops at ``most`` times its size, the excess is reshared."""
    done: dict[str | None, float] = {}
    left, open_ = float(total), [s for s in sizes]
    while open_:
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            return done | share
        for s in full:
            done[s] = float(most * sizes[s])
            left -= done[s]
        open_ = [s for s in open_ if s not in done]
    return done


def min_cost_flow(supply: Sequence[tuple[frozenset, int]], quota: dict) -> list[float]:
    """Words that each pattern gives; ``supply`` has (sources, words) of each pattern.

    Successive shortest paths with potentials over source node, patterns, quotas and sink.
    """
    n_p, names = len(supply), sorted({s for members, _ in supply for s in members}, key=lambda s: (s is None, s or ""))
    node = {s: 1 + n_p + k for k, s in enumerate(names)}
    sink = 1 + n_p + len(names)
    graph: list[list[list]] = [[] for _ in range(sink + 1)]  # to, room, cost, index of the reverse edge

    def edge(a: int, b: int, room: float, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0.0, -cost, len(graph[a]) - 1])

    for p, (members, words) in enumerate(supply):
        for cost in USE_COSTS:
            edge(0, 1 + p, float(words), cost)
        for s in sorted(members, key=node.get):
            edge(1 + p, node[s], float("inf"), 0)
    for s in names:
        edge(node[s], sink, float(quota.get(s, 0.0)), 0)
    least = 1e-6
    potential = [0] * len(graph)
    while True:
        dist, back = [float("inf")] * len(graph), [None] * len(graph)
        dist[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room > least and (new := d + cost + potential[a] - potential[b]) < dist[b]:
                    dist[b], back[b] = new, (a, k)
                    heapq.heappush(heap, (new, b))
        if back[sink] is None:
            break
        potential = [v + (d if d < float("inf") else 0) for v, d in zip(potential, dist, strict=True)]
        path, b = [], sink
        while b:
            path.append(back[b])
            b = back[b][0]
        push = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            e = graph[a][k]
            e[1] -= push
            graph[e[0]][e[3]][1] += push
    given = [0.0] * n_p
    for b, room, cost, _ in graph[0]:
        given[b - 1] += supply[b - 1][1] - room
    return given


def groups_of(patterns: Sequence[frozenset]) -> list[list[int]]:
    """Indexes of the patterns, grouped so that patterns of different groups share no source."""
    lead = list(range(len(patterns)))

    def top(i: int) -> int:
        while lead[i] != i:
            lead[i] = lead[lead[i]]
            i = lead[i]
        return i

    by_source: dict = {}
    for i, members in enumerate(patterns):
        for s in members:
            lead[top(i)] = top(by_source.setdefault(s, i))
    out = defaultdict(list)
    for i in range(len(patterns)):
        out[top(i)].append(i)
    return list(out.values())


def mix(docs: DataFrame, members: Column, weights=None, total: float | None = None, doc_id: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """Add ``size``, ``pattern``, ``source_size``, ``target`` and ``taken`` (words) to ``docs``.

    ``members``: array of the sources that a document counts for; a null element is a source
    of its own, an array without elements or null stands outside the mix (taken 0).
    ``weights``: source -> weight; by default sources in code point order, null last, weigh
    1, 2, 3, repeating. ``total``: words of the mix, by default those of all documents.
    ``source_size`` and ``target`` are sums over a document's sources. A null text has size
    0. Rows are selected in the order of a seeded hash of the id, of the text where there is
    none; rows that share an id go by a hash of their text. So reruns agree, in whatever order
    the rows come; of rows equal in id and text any may give the words. The document at the
    edge of a quota gives only the words still needed. An empty table gives no rows.
    Columns of ``docs`` with the names of added columns are replaced, others stay.
    The driver sees one row per membership pattern.
    """
    added = {"size", "pattern", "source_size", "target", "taken"} - {doc_id, text}
    pattern = F.array_sort(F.array_distinct(F.transform(members, lambda s: F.struct(s.isNull().alias("none"), F.coalesce(s, F.lit("")).alias("name")))))
    sized = docs.withColumn("__p", F.coalesce(pattern, F.expr("cast(array() as array<struct<none: boolean, name: string>>)")))
    sized = sized.drop(*added).withColumnRenamed("__p", "pattern").withColumn("size", word_count(F.col(text)))
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    supply = [(frozenset(None if x["none"] else x["name"] for x in r["pattern"]), int(r["words"] or 0)) for r in rows]
    names = sorted({s for own, _ in supply for s in own}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(words for own, words in supply if s in own) for s in names}
    share = weights or {s: 1 + k % 3 for k, s in enumerate(names)}
    quota = fill_targets(sizes, share, sum(words for _, words in supply) if total is None else total)
    given = [0.0] * len(supply)
    for own in groups_of([x for x, _ in supply]):
        for k, words in zip(own, min_cost_flow([supply[k] for k in own], quota), strict=True):
            given[k] = words
    plan = []
    for r, (own, words), flow in zip(rows, supply, given, strict=True):
        wanted = min(int(flow + 0.5), MAX_USES * words)
        epochs = min(wanted // words, MAX_USES) if words else 0
        plan.append((r["pattern"], float(sum(sizes[s] for s in own)), float(sum(quota[s] for s in own)), int(epochs), int(wanted - epochs * words)))
    kind = dict(sized.dtypes)["pattern"]
    planned = docs.sparkSession.createDataFrame(plan, f"pattern {kind}, source_size double, target double, epochs long, rest long")
    # the order in two steps: words of each start of the hash, then places inside; as many starts as keep each to some thousand rows
    digits = max(3, math.ceil(math.log(max((r["n"] for r in rows), default=1) / ROWS_EACH + 1, 16)))
    told = F.xxhash64(F.col(text))
    own = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), told.cast("string")))
    ranked = sized.withColumns({"__h": F.md5(F.concat_ws(":", F.lit(str(seed)), own)), "__t": told}).withColumn("__b", F.substring("__h", 1, digits))
    buckets = ranked.groupBy("pattern", "__b").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    edges = buckets.join(planned, "pattern")
    edges = edges.withColumn("room", F.col("rest") - F.coalesce(before, F.lit(0))).drop("words", "rest")
    inside = Window.partitionBy("pattern", "__b").orderBy("__h", doc_id, "__t", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("__before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(edges, ["pattern", "__b"])  # dealt out as the places were
    extra = F.least("size", F.greatest(F.lit(0), F.col("room") - F.col("__before")))
    return joined.withColumns({"source_size": F.col("source_size").cast("long"), "taken": (F.col("epochs") * F.col("size") + extra).cast("long")}).drop("__h", "__t", "__b", "__before", "room", "epochs")


def mix_sources(docs: DataFrame, source: str = "source", **more) -> DataFrame:
    """``mix`` for documents that belong to the one source in column ``source``."""
    return mix(docs, F.array(F.col(source).cast("string")), **more)


def mixed_corpus(docs: DataFrame) -> DataFrame:
    """The mix as documents: each as often as its words are taken, rounded; in the columns of ``docs``."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    held = docs.select("doc_id", "text", "source", F.struct(*rest).alias("__rest") if rest else F.lit(1).alias("__rest"))
    chosen = mix_sources(held).where("taken > 0")
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    repeated = chosen.where(times > 0).withColumn("__n", F.explode(F.array_repeat(F.lit(1), times)))
    return repeated.select(*(F.col(f"__rest.{c}") if c in rest else F.col(c) for c in docs.columns))
