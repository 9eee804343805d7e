"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another. Each is a logistic regression over the words of
the text and the probabilities of the categories before it. For training, those are
out-of-fold predictions, so later models see them as they will be on unseen documents.

The models are fitted on a bounded sample of labelled rows; every document is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkit

#: Labelled rows that the models are fitted on, at most: those with the least hash of the id.
MAX_LABELLED = 8000
FOLDS = 5
HASH_BITS = 20
#: Words that a model keeps: those whose share differs most between the classes, by z score.
MAX_WORDS = 256
LEAST_Z = 4.0
LEAST_DOCUMENTS = 5
RIDGE = 1.0
DENSE = 3


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words of each text, where each text's begin, and dense features of the texts."""
    h, at = textkit.words(texts, textkit.PUNCTUATION)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    s, own_at = textkit.distinct_in(h >> np.uint64(64 - HASH_BITS), owner, len(n))
    data, offsets = textkit.buffers(texts)
    odd = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(np.isin(data, np.frombuffer(b"#*$%&|<>", dtype=np.uint8)), out=odd[1:])
    size = np.maximum(np.diff(offsets), 1)
    dense = np.column_stack([np.log1p(n), np.diff(odd[offsets]) / size, np.diff(own_at) / np.maximum(n, 1)])
    return s.astype(np.int64), own_at, dense


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textkit.pieces(whole, "text"):
            s, at, dense = word_ids(batch.column(1))
            words = pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), pa.array(s, type=pa.int32()))
            own = pa.FixedSizeListArray.from_arrays(pa.array(dense.ravel()), DENSE).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), words, own], names=["doc_id", "words", "dense"])


@dataclass
class Linear:
    """Chosen words, how to scale the dense features, and weights: words, dense, earlier categories, constant."""

    words: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def matrix(self, s: np.ndarray, at: np.ndarray, dense: np.ndarray, before: np.ndarray) -> np.ndarray:
        n, k = len(at) - 1, len(self.words)
        x = np.zeros((n, k + dense.shape[1] + before.shape[1] + 1))
        if k and len(s):
            place = np.minimum(np.searchsorted(self.words, s), k - 1)
            hit = self.words[place] == s
            x[np.repeat(np.arange(n), np.diff(at))[hit], place[hit]] = 1
        x[:, k : k + dense.shape[1]] = (dense - self.mean) / self.scale
        x[:, k + dense.shape[1] : -1] = before
        x[:, -1] = 1
        return x

    def probability(self, s, at, dense, before) -> np.ndarray:
        # each row is summed by itself: in a matrix product the order of sums follows the row's place
        return 1 / (1 + np.exp(-np.clip((self.matrix(s, at, dense, before) * self.weights).sum(axis=1), -30, 30)))


def rows_of(s: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [s[at[i] : at[i + 1]] for i in chosen]
    return np.concatenate([*parts, np.zeros(0, dtype=np.int64)]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def fit(s: np.ndarray, at: np.ndarray, dense: np.ndarray, before: np.ndarray, y: np.ndarray) -> Linear:
    """Ridge logistic regression by Newton steps over the words that tell the classes apart; without rows a model that says 1/2."""
    if not len(y):
        return Linear(np.zeros(0, dtype=np.int64), np.zeros(dense.shape[1]), np.ones(dense.shape[1]), np.zeros(dense.shape[1] + before.shape[1] + 1))
    n, owner = len(y), np.repeat(np.arange(len(y)), np.diff(at))
    held = np.bincount(s, minlength=1 << HASH_BITS)
    hits = np.bincount(s, weights=y[owner], minlength=1 << HASH_BITS)
    pos = max(y.sum(), 1e-9)
    p, share = hits / pos, held / max(n, 1)
    spread = np.sqrt(share * (1 - share) * (1 / pos + 1 / max(n - pos, 1e-9))) + 1e-12
    z = np.where(held >= LEAST_DOCUMENTS, np.abs(p - (held - hits) / max(n - pos, 1e-9)) / spread, 0)
    words = np.argsort(-z, kind="stable")[:MAX_WORDS]
    words = np.sort(words[z[words] >= LEAST_Z])
    model = Linear(words, dense.mean(axis=0), dense.std(axis=0) + 1e-9, np.zeros(len(words) + dense.shape[1] + before.shape[1] + 1))
    x = model.matrix(s, at, dense, before)
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    w = model.weights
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def fit_chain(s: np.ndarray, at: np.ndarray, dense: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[list[Linear], np.ndarray]:
    """One model for each column of ``y`` (nan: not labelled), and the out-of-fold probabilities."""
    before = np.zeros((len(y), 0))
    models, held_out = [], np.zeros(y.shape)
    for c in range(y.shape[1]):

        def fitted(rows: np.ndarray) -> Linear:
            return fit(*rows_of(s, at, rows), dense[rows], before[rows], y[rows, c])  # noqa: B023

        known = ~np.isnan(y[:, c])
        for k in range(FOLDS):
            away = np.flatnonzero(fold == k)
            if len(away):
                held_out[away, c] = fitted(np.flatnonzero(known & (fold != k))).probability(*rows_of(s, at, away), dense[away], before[away])
        models.append(fitted(np.flatnonzero(known)))
        before = held_out[:, : c + 1]
    return models, held_out


def score_rows(models: list[Linear]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textkit.pieces(whole, "text"):
                s, at, dense = word_ids(batch.column(1))
                before = np.zeros((batch.num_rows, 0))
                for model in models:
                    before = np.column_stack([before, model.probability(s, at, dense, before)])
                yield pa.record_batch([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(before.ravel()), len(models)).cast(pa.list_(pa.float64()))], names=["doc_id", "p"])

    return run


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], max_labelled: int = MAX_LABELLED) -> tuple[list[Linear], dict]:
    """The chain over ``categories``, 0/1 columns of ``labels`` in this order, and held-out measures.

    Several labels of a document are averaged, null ones ignored. Labelled ids without a
    document are ignored, and so are null ids. Of several documents with one id the one with
    the least features trains. A category without a labelled row says 1/2 everywhere, and so
    does a fold whose other folds have none.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in categories))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # at most max_labelled rows of a few numbers
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")
    features = texts.mapInArrow(feature_rows, "doc_id long, words array<int>, dense array<double>")
    found = features.groupBy("doc_id").agg(F.min(F.struct("words", "dense")).alias("x")).select("doc_id", "x.*").collect()  # at most max_labelled rows
    wanted = {r["doc_id"]: r for r in some.collect()}
    found = sorted((r["doc_id"], r) for r in found)
    s, at = rows_of(np.concatenate([np.array(r["words"], dtype=np.int64) for _, r in found] + [np.zeros(0, dtype=np.int64)]), np.concatenate([[0], np.cumsum([len(r["words"]) for _, r in found])]).astype(np.int64), np.arange(len(found)))
    dense = np.array([r["dense"] for _, r in found]).reshape(len(found), DENSE)
    y = np.array([[np.nan if wanted[i][c] is None else float(wanted[i][c] >= 0.5) for c in categories] for i, _ in found]).reshape(len(found), len(categories))
    if not len(found):
        zero = Linear(np.zeros(0, dtype=np.int64), np.zeros(DENSE), np.ones(DENSE), np.zeros(0))
        return [Linear(zero.words, zero.mean, zero.scale, np.zeros(DENSE + c + 1)) for c in range(len(categories))], {}
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i, _ in found])  # ids may follow a pattern
    models, held_out = fit_chain(s, at, dense, y, fold)
    known = ~np.isnan(y)
    told = {c: float(np.mean((held_out[:, k] >= 0.5)[known[:, k]] == y[known[:, k], k])) for k, c in enumerate(categories) if known[:, k].any()}
    return models, told


def score(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"), threshold: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the probability ``p_<category>`` of each category, and ``toxic``, for every row of ``docs``.

    ``toxic`` is true from ``threshold`` on for the last category, and false where nothing is
    labelled in it. Null text is empty, very long texts are scored whole. Every row is scored
    for itself, repeated and null ids too; extra columns are ignored; an empty table gives no
    rows.
    """
    models, told = train(docs, labels, categories, max_labelled)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = own.mapInArrow(score_rows(models), "doc_id long, p array<double>")
    out = out.select("doc_id", *(F.col("p")[k].alias(f"p_{c}") for k, c in enumerate(categories)))
    return out.withColumn("toxic", (F.col(f"p_{categories[-1]}") >= threshold) & F.lit(categories[-1] in told))
