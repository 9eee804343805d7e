"""The corpus pipeline: from raw documents to packed training sequences in five stages.

Each stage is a function of (session, documents, folder of the tables) that works on all
its predecessor kept. ``run`` applies them in order; every stage is written as Parquet in
the shared folder and read again, so a lost executor never repeats an earlier stage.

Null texts have no words and go with the first stage. Rows with a null id are documents of
their own: their lines are compared but not removed, they are no near duplicate of another,
and they are mixed and packed. Rows that repeat an id are one document to the
third stage (its near copies are those of all its rows) and rows of their own to the
others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import line_dedup, mixing, ngram_join, packing, quality
from marlstone.sources import pieces, scratch

#: The vocabulary that packing counts tokens in.
VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject; nothing else changes."""
    return quality.keep_clean(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines stay only where they occur first; documents left without a line go."""
    return line_dedup.dedup_corpus(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document that is used twice has two rows."""
    return mixing.mixed_corpus(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the near-duplicate components and the retrieval packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in ``sf_dir``."""
    docs = pieces.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
