"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

A document is the set of its distinct shingles, as 64-bit hashes in the order of the hash.
Two sets with 100 * |A and B| >= percent * |A or B| share a token within their prefixes of
n - ceil(percent * n / 100) + 1 tokens. A prefix is costly where many documents hold its
tokens: for each costly token it is lengthened by one, and the pair must share one token
more (l of the lengthened prefix). At most l - 1 of those are costly, so a cheap shared
token remains, and only cheap ones are indexed; documents made of costly tokens alone
index the last of them. The cost is estimated; a wrong estimate costs time, no links.

How many tokens a pair must share is counted on the index entries, before a text is read:
a pair that shares k of them has at most (tokens behind the prefix) + k in common, which
must be enough for the two sizes. Pairs that have as many are verified on whole sets, in
two rounds. First every document meets the smallest document of its index entries, the hub
that it shares most with. This finds most links at a cost in proportion to the index, and
groups of copies collapse into components. Then only pairs of different components that share an index entry are left,
and all of them are examined: of the holders of a token, those of its largest component
meet the others, never each other. So links inside a group of copies are not listed, and
none that joins components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm import textkit
from marlstone.llm.components import components
from marlstone.sources import scratch

#: A token is costly from so many documents on; it is counted where an Arrow batch repeats it.
#: A batch has thousands of rows, so what one text in 10,000 holds is found in nearly all
#: tables, and what no batch repeats stays a short list.
COSTLY = 16
SEEN_IN_BATCH = 3
#: The costliest tokens that tasks are told of: 8 bytes each, 1 MB in all. More would save time, not change results.
MOST_COSTLY = 1 << 17
#: Documents of a costly token that share one hub; more are split and their hubs meet in turn.
PER_HUB = 20_000
#: Documents of a token that stand in one row when all that hold it are compared.
BLOCK = 256


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def set_hashes(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each whole set."""
    out = []
    for salt in (0x1B873593CC9E2D51, 0x85EBCA6B27D4EB2F):
        total = np.zeros(len(s) + 1, dtype=np.uint64)
        np.cumsum(textkit.scramble(s ^ np.uint64(salt)), out=total[1:])
        out.append(textkit.scramble(total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def describe(width: int, percent: int):
    """Rows (costly, a, b, c, d): of documents (id, size, two set hashes), of tokens (token, documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            tokens = []
            for batch in textkit.pieces(whole, "text"):
                s, at = textkit.shingle_sets(batch.column(1), width)
                tokens.append(s)
                a, b = set_hashes(s, at)
                yield pa.record_batch([pa.array(np.zeros(len(a), dtype=bool)), batch.column(0), pa.array(np.diff(at)), pa.array(a), pa.array(b)], names=["costly", "a", "b", "c", "d"])
            s = np.sort(np.concatenate(tokens)) if tokens else np.zeros(0, dtype=np.uint64)
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, dtype=np.int64)
            n = np.diff(np.append(first, len(s)))
            often = n >= SEEN_IN_BATCH
            zero = np.zeros(int(often.sum()), dtype=np.int64)
            yield pa.record_batch([pa.array(zero == 0), pa.array(s[first[often]].view(np.int64)), pa.array(n[often]), pa.array(zero), pa.array(zero)], names=["costly", "a", "b", "c", "d"])

    return run


def rank_in(flags: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each element, how many flagged ones of its owner stand before it."""
    before = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=before[1:])
    return before[:-1] - before[at[owner]]


def chosen(s: np.ndarray, at: np.ndarray, costly: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexed elements (a mask), their costliness (a mask) and each set's number l of needed matches."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    hot = np.zeros(len(s), dtype=bool)
    if len(costly) and len(s):
        hot = costly[np.minimum(np.searchsorted(costly, s), len(costly) - 1)] == s
    length = prefix_length(n, percent)
    cheap_rank, hot_rank = rank_in(~hot, owner, at), rank_in(hot, owner, at)
    cheap = np.bincount(owner[~hot], minlength=len(n))
    taken = np.where(hot, hot_rank < (length - cheap)[owner], cheap_rank < length[owner])
    # costly tokens before the last cheap one that is taken
    last = np.zeros(len(n), dtype=np.int64)
    np.maximum.at(last, owner[~hot & taken], hot_rank[~hot & taken])
    needed = np.where(cheap >= length, last + 1, 1)
    return taken, hot, needed


def index_rows(width: int, percent: int, costly: np.ndarray, splits: np.ndarray):
    """Rows (token, part, doc); part is -1 for cheap tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textkit.pieces(whole, "text"):
                s, at = textkit.shingle_sets(batch.column(1), width)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                taken, hot, _ = chosen(s, at, costly, percent)
                docs = np.repeat(ids, np.diff(at))[taken]
                tokens, hot = s[taken], hot[taken]
                part = np.full(len(tokens), -1, dtype=np.int64)
                if hot.any():
                    mixed = textkit.scramble(docs[hot].astype(np.int64).view(np.uint64))
                    part[hot] = (mixed % splits[np.searchsorted(costly, tokens[hot])].astype(np.uint64)).astype(np.int64)
                yield pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(part), pa.array(docs.astype(np.int64))], names=["token", "part", "doc"])

    return run


def enough(n: Column, m: Column, k: Column, percent: int) -> Column:
    """Whether sets of n and m tokens that share k index entries can be similar enough.

    A pair that shares k entries has at most k tokens of one's prefix in the other, so that
    the rest of that prefix is not shared.
    """
    behind = [F.ceil(x * percent / 100) - 1 for x in (n, m)]
    return (F.greatest(*behind) + k) * (100 + percent) >= (n + m) * percent


def verify_rows(width: int, percent: int):
    """Of rows (u, v, a, b) with two texts: the pairs (u, v) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in textkit.pieces(whole, "a", textkit.PIECE_BYTES):
                for batch in textkit.pieces(part, "b"):
                    us, vs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    # rows come by u: its set is built once for all that stand together
                    texts = batch.column(2)
                    new = np.concatenate([[True], (us[1:] != us[:-1])]) if len(us) else np.zeros(0, dtype=bool)
                    new[1:] |= ~pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False) if len(us) > 1 else False
                    where, back = np.flatnonzero(new), np.cumsum(new) - 1
                    a, at_a = textkit.shingle_sets(texts.take(pa.array(where)), width)
                    b, at_b = textkit.shingle_sets(batch.column(3), width)
                    good = np.zeros(len(us), dtype=bool)
                    for k, i in enumerate(back):
                        x, y = a[at_a[i] : at_a[i + 1]], b[at_b[k] : at_b[k + 1]]
                        if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                            continue
                        both = shared(x, y)
                        good[k] = 100 * both >= percent * (len(x) + len(y) - both)
                    yield pa.record_batch([pa.array(us[good]), pa.array(vs[good])], names=["u", "v"])

    return run


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted arrays."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    left = docs.select(F.col("doc").alias("u"), F.col("text").alias("a"))
    right = docs.select(F.col("doc").alias("v"), F.col("text").alias("b"))
    rows = pairs.select("u", "v").join(right, "v").join(left, "u").select("u", "v", "a", "b")
    return rows.mapInArrow(verify_rows(width, percent), "u long, v long")


def count_shared(percent: int):
    """Of rows (doc, n, others) sorted by doc: the pairs that share enough index entries.

    ``others`` holds a pair once for each entry that it shares. A document that has several
    texts has a row for each of their sizes.
    """

    def pairs(doc: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((m, other, n, doc))
        rows = [x[order] for x in (doc, n, other, m)]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in rows], axis=0)
        first = np.flatnonzero(new)
        k = np.diff(np.append(first, len(doc)))
        doc, n, other, m = (x[first] for x in rows)
        most = np.maximum(n - prefix_length(n, percent), m - prefix_length(m, percent)) + k
        good = most * (100 + percent) >= (n + m) * percent
        return pa.record_batch([pa.array(np.minimum(doc, other)[good]), pa.array(np.maximum(doc, other)[good])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 4
        for batch in batches:
            others = batch.column(2)
            sizes = np.diff(others.offsets.to_numpy())
            values = others.flatten()
            new = [np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(batch.column(1).to_numpy(), sizes), values.field(0).to_numpy(), values.field(1).to_numpy()]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last document may go on
            yield pairs(*(x[:done] for x in held))
            held = [x[done:] for x in held]
        yield pairs(*held)

    return run


def apart(held: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of documents of different components that share enough entries of ``held`` (token, doc).

    own: doc, n, label (component). Components are ordered by their size, and a document
    meets those of smaller components only. So the holders of a token that are not of its
    largest component are laid out in blocks, and all holders meet these blocks: a token
    costs its holders times those outside the largest component.
    """
    sizes = own.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    told = held.select("token", "doc").join(own.join(sizes, "label"), "doc")
    by_label = told.groupBy("token", "size", "label").agg(F.count(F.lit(1)).alias("n"))
    sums = by_label.groupBy("token").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("size", "label", "n")).alias("top")).where("labels > 1")
    open_ = sums.select("token", F.col("top.label").alias("major"), F.ceil((F.col("held") - F.col("top.n")) / BLOCK).alias("blocks"))
    told = scratch.table(told.join(open_, "token"), "open")
    block = F.pmod(F.xxhash64("doc"), F.col("blocks"))
    blocks = told.where("label <> major").groupBy(F.col("token").alias("t"), block.alias("block")).agg(F.collect_list(F.struct("doc", "n", "size", "label")).alias("members"))
    smaller = lambda m: (m["size"] < F.col("size")) | ((m["size"] == F.col("size")) & (m["label"] < F.col("label")))
    close = lambda m: (m["n"] * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= m["n"] * percent)
    others = F.transform(F.filter("members", lambda m: smaller(m) & close(m)), lambda m: F.struct(m["doc"].alias("doc"), m["n"].alias("n")))
    met = told.join(blocks, told["token"] == blocks["t"]).select("doc", "n", others.alias("others")).where(F.size("others") > 0)
    pairs = met.repartition("doc").sortWithinPartitions("doc").mapInArrow(count_shared(percent), "u long, v long")
    return pairs.distinct()


def similar_groups(docs: DataFrame, percent: int = 75, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_shingles, component) for each row of ``docs``: whole texts, exact over all rows.

    ``component`` is the smallest id that similar pairs reach. A null or wordless text has
    an empty set and stays alone, as does a row with a null id (its component is null).
    Rows with the same id are one document: linked where any of its texts is, so that all of
    them have one component; ``n_shingles`` is that of the row. Equal sets are one class and
    are compared once. Other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    seen = scratch.table(source.mapInArrow(describe(width, percent), "costly boolean, a long, b long, c long, d long"), "sets")
    sets = seen.where(~F.col("costly")).select(F.col("a").alias("doc"), F.col("b").alias("n"), "c", "d")
    counted = seen.where("costly").groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("n")).where(F.col("n") >= COSTLY)
    rows = counted.orderBy(F.desc("n"), "token").limit(MOST_COSTLY).toArrow()
    costly = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(costly)
    costly, splits = costly[order], -(-rows.column("n").to_numpy()[order] // PER_HUB)
    usable = source.where("doc is not null and text is not null")
    filled = sets.where("doc is not null and n > 0")
    # a table, so that the join's two sides are plain shuffles and Spark splits a class that holds a third of all rows
    classes = scratch.table(filled.groupBy("n", "c", "d").agg(F.min("doc").alias("rep")), "classes")
    named = scratch.table(filled.join(classes, ["n", "c", "d"]).select("doc", "n", "rep"), "named")
    # documents of several texts join the classes that these are in
    several = named.groupBy("doc").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    same = named.join(several.select("doc"), "doc", "left_semi").where("doc <> rep").select(F.col("doc").alias("u"), F.col("rep").alias("v"))
    entries = usable.mapInArrow(index_rows(width, percent, costly, splits), "token long, part long, doc long")
    entry = Window.partitionBy("token", "part")
    entries = entries.withColumns({"hub": F.min("doc").over(entry), "held": F.count(F.lit(1)).over(entry)})
    # entries of one document say nothing, but hubs of split tokens go on to meet
    held = scratch.table(entries.where("held > 1 or part >= 0").drop("held"), "index")
    hubs = held.where("part >= 0 and doc = hub").select("token", "doc").distinct()
    tops = hubs.groupBy("token").agg(F.min("doc").alias("hub"))
    met = held.where("doc <> hub").select("hub", "doc").unionByName(hubs.join(tops, "token").where("doc <> hub").select("hub", "doc"))
    reps = classes.select(F.col("rep").alias("doc"), "n")
    counts = met.groupBy("hub", "doc").agg(F.count(F.lit(1)).alias("k"))
    # a first look at each document's best hub, where the two share enough
    best = counts.groupBy("doc").agg(F.max(F.struct("k", (-F.col("hub")).alias("hub"))).alias("x")).select("doc", "x.k", (-F.col("x.hub")).alias("hub"))
    best = best.join(reps, "doc").join(reps.select(F.col("doc").alias("hub"), F.col("n").alias("m")), "hub")
    first = scratch.table(best.where(enough(F.col("n"), F.col("m"), F.col("k"), percent)).select(F.col("hub").alias("u"), F.col("doc").alias("v")).distinct(), "first")
    links = scratch.table(verified(first, usable, width, percent).unionByName(same), "links")
    labels = components(links)
    # what is left: pairs of different components that share an entry
    own = reps.join(labels, reps["doc"] == labels["id"], "left").select("doc", "n", F.coalesce("label", "doc").alias("label"))
    pairs = apart(held, own, percent).join(first, ["u", "v"], "left_anti")
    more = verified(pairs, usable, width, percent)
    labels = components(links.unionByName(scratch.table(more, "links")))
    found = named.join(labels, named["rep"] == labels["id"], "left").select("doc", "n", F.coalesce("label", "rep").alias("component"))
    alone = sets.where("doc is null or n = 0").select("doc", "n", F.col("doc").alias("component"))
    # a wordless text of a document that has others is that document
    known = found.select("doc", F.col("component").alias("other")).join(alone.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.min("other").alias("other"))
    texts = alone.join(known, "doc", "left").select("doc", "n", F.coalesce("other", "component").alias("component"))
    return found.unionByName(texts).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """One document of each group: the smallest id; its columns as they were."""
    groups = similar_groups(docs, percent, width)
    others = groups.where("doc <> component").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
