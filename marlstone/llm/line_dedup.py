"""Line dedup by distinct-site spread.

A line is cross-site boilerplate when it stands in documents of at least ``min_sites``
different sites. One HyperLogLog sketch per line hash, merged by Spark's aggregation,
tells most lines apart; lines whose estimate is near the threshold get an exact distinct
count. Such a line stays where it occurs first (smallest document id, then position) and
is removed everywhere else. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.quality import let
from marlstone.sources import scratch

#: Sketches have 2**LG_K registers; their relative standard error is 1.04 / sqrt(2**LG_K), 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold, or one site, are counted exactly: five standard errors.
NEAR = 0.085
TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def exploded(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """A row for each line that has a word: document, hash of its text, site, position and hash of the trimmed line."""
    lines = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("d", "t", "site", "pos", F.xxhash64(F.regexp_replace("line", TRIM, "")).alias("h"))


def spread_lines(docs: DataFrame, min_sites: int, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """(h, first): hashes of the lines on at least ``min_sites`` sites, and where each occurs first."""
    lines = exploded(docs, doc_id, text, site)
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("d", "pos", "t")).alias("first"))
    judged = sketched.select("h", "first", F.hll_sketch_estimate("sketch").alias("n"))
    low, high = min(min_sites - 1, min_sites * (1 - NEAR)), max(min_sites + 1, min_sites * (1 + NEAR))
    sure = judged.where(F.col("n") > high).select("h", "first")
    near = judged.where((F.col("n") >= low) & (F.col("n") <= high)).select("h", "first")
    # one row for each line and site before the join: no line brings more rows than there are sites
    on_sites = lines.groupBy("h", "site").agg(F.lit(1).alias("one"))
    exact = near.join(on_sites, "h").groupBy("h").agg(F.sum("one").alias("n"), F.min("first").alias("first")).where(F.col("n") >= min_sites)
    return sure.unionByName(exact.select("h", "first"))


def remove_lines(docs: DataFrame, min_sites: int = 5, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` with cross-site boilerplate lines taken out of ``text``, and ``n_lines``, ``n_removed``.

    Lines are compared without the white space around them; lines without a word are
    never counted or removed. Null and empty sites are one site, a null text stays null
    (no lines), and rows with a null id keep their text. Rows that repeat an id and a text are
    the one document that they are; other texts of that id have lines of their own. Other
    columns stay as they are. A text of any length is one row; its lines are one row each.
    """
    # a table, so that the join below is planned by its size, and a line that stands in a third of all documents is split
    spread = scratch.table(spread_lines(docs, min_sites, doc_id, text, site), "spread")
    lines = exploded(docs, doc_id, text, site).where(F.col("d").isNotNull())
    hits = lines.join(spread, "h").where((F.col("d") != F.col("first.d")) | (F.col("pos") != F.col("first.pos")) | (F.col("t") != F.col("first.t")))
    gone = hits.groupBy(F.col("d").alias("__d"), F.col("t").alias("__t")).agg(F.collect_set("pos").alias("__gone"))
    out = docs.join(gone, (docs[doc_id] == F.col("__d")) & (F.xxhash64(docs[text]) == F.col("__t")), "left").drop("__d", "__t")
    parts = F.split(F.col(text), "\n", -1)
    # by sets of positions, so that a text of many lines takes time in proportion to them
    staying = lambda ps: F.array_except(F.sequence(F.lit(0), F.size(ps) - 1), F.col("__gone"))
    left = let(parts, lambda ps: F.array_join(F.transform(staying(ps), lambda i: F.get(ps, i)), "\n"))
    n_lines = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumns(
        {
            "n_lines": n_lines.cast("long"),
            "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
            text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left),
        }
    )
    return out.withColumn("n_removed", F.greatest("n_removed", F.lit(0)).cast("long")).drop("__gone")


def dedup_corpus(docs: DataFrame, min_sites: int = 5) -> DataFrame:
    """The documents without cross-site lines; those that had nothing else go. The columns of ``docs``; ``n_chars`` follows."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    held = docs.select("doc_id", "text", "source", F.struct(*rest).alias("__rest") if rest else F.lit(1).alias("__rest"))
    out = remove_lines(held, min_sites).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    new = {c: F.col(c) for c in ("doc_id", "text", "source")}
    if "n_chars" in rest:
        changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("__rest.n_chars"))
        new["n_chars"] = changed.alias("n_chars")
    return out.select(*(new.get(c, F.col(f"__rest.{c}")) for c in docs.columns))
