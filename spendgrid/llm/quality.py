"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text has one latent score, the sum of shared weights of its hashed words and of its shares of letters, digits, signs
and repeated words.  Ordered thresholds cut the score into grades: ``P(grade <= k) = sigmoid(threshold_k - score)``.
Expected grade and tail probability follow.  The model is fitted on a bounded sample of rated texts
(:data:`MAX_RATED`, drawn by hash of the id); every text is scored whole.

Rows: a null or empty text has no words and is scored by the thresholds alone; ratings without a text, texts without a
rating, null ids and repeated ratings are left out of the fit (of several ratings of an id the lowest counts); repeated
rows get equal scores; without any rating every text has the top grade and is kept; an empty table gives an empty
result; further columns are kept by :func:`keep_good` and otherwise ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.llm.shared import apart, ship, text_of
from spendgrid.llm.words import Words, chunks

WORD_BUCKETS = 1 << 16
MAX_RATED = 20_000
#: Words that fewer rated texts hold carry no weight: they cannot tell grades apart.
LEAST_TEXTS = 5
ROUNDS = 300
SLICE = 1 << 18  # entries of the fit summed at once
PENALTY = 1e-3
KEEP_FROM = 0.5

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False
#: Classes of bytes whose shares are features: every ASCII sign for itself, then digits, capitals, small and other letters.
_CLASS = np.zeros(256, np.int64)
_CLASS[:128] = np.arange(128)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 0
SHARES = 128
SHARE_SCALE = 10.0  # shares of bytes are small numbers beside the words' ones
EXTRA = 3
WIDTH = WORD_BUCKETS + SHARES + EXTRA


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text of a chunk: ``(text, bucket)`` of its distinct hashed words, and a row of shares."""
    n = len(offsets) - 1
    words = Words(data, offsets, lower=True, space=_NOT_LETTER)
    keys = np.unique(words.doc * WORD_BUCKETS + (words.hash % np.uint64(WORD_BUCKETS)).astype(np.int64))
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(doc_of_byte * SHARES + _CLASS[data], minlength=n * SHARES).reshape(n, SHARES)
    shares = SHARE_SCALE * np.sqrt(shares / np.maximum(1, np.diff(offsets))[:, None])
    same = np.zeros(len(words.hash), bool)
    if len(same):
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    total = np.maximum(1, words.counts)
    distinct = np.unique(np.stack([words.doc, words.hash.view(np.int64)]), axis=1)[0] if len(same) else np.zeros(0, np.int64)
    extra = np.stack([np.bincount(words.doc, same, n) / total, np.bincount(distinct, minlength=n) / total,
                      np.log1p(words.counts) / 10], axis=1) * SHARE_SCALE
    return keys // WORD_BUCKETS, keys % WORD_BUCKETS, np.concatenate([shares, extra], axis=1), words.counts


@dataclass
class Ordinal:
    """Weights of all features and ascending thresholds, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, bucket, shares, _ = features(data, offsets)
        return (np.bincount(text, self.weights[bucket], len(offsets) - 1) + shares @ self.weights[WORD_BUCKETS:])

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for every threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def _summed(keys: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Sums of ``values[at]`` by ascending ``keys``, some keys at a time: temporary arrays of all entries would be several times the features."""
    out = np.zeros(width)
    first = 0
    while first < len(keys):
        last = first + SLICE
        last = len(keys) if last >= len(keys) else max(int(np.searchsorted(keys, keys[last])), int(np.searchsorted(keys, keys[first], "right")))
        base = int(keys[first])
        part = np.bincount(keys[first:last] - base, values[at[first:last]])
        out[base:base + len(part)] = part
        first = last
    return out


def fit(text: np.ndarray, bucket: np.ndarray, shares: np.ndarray, grades: np.ndarray, n_grades: int) -> Ordinal:
    """Adam on the likelihood of a cumulative link with ridge penalty; thresholds stay ordered as steps of positive size."""
    n = len(grades)
    often = np.bincount(bucket, minlength=WORD_BUCKETS) >= min(LEAST_TEXTS, max(1, n // 50))
    text, bucket = text[often[bucket]], bucket[often[bucket]]
    order = np.argsort(bucket, kind="stable").astype(np.int32)
    own_bucket, own_text = bucket[order], text[order]
    del order
    weights = np.zeros(WIDTH)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(1, n), 0.02, 0.98)
    start = np.log(share / (1 - share))
    cuts = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    params = np.concatenate([weights, cuts])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, ROUNDS + 1):
        weights, cuts = params[:WIDTH], params[WIDTH:]
        thresholds = np.concatenate([cuts[:1], cuts[0] + np.cumsum(np.exp(cuts[1:]))])
        score = _summed(text, bucket, weights, n) + shares @ weights[WORD_BUCKETS:]
        below = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - score[:, None], -50, 50)))
        edges = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        row = np.arange(n)
        upper, lower = edges[row, grades + 1], edges[row, grades]
        chance = np.maximum(upper - lower, 1e-9)
        up, down = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        slope = (up - down) / n
        grad_weights = np.concatenate([_summed(own_bucket, own_text, slope, WORD_BUCKETS), slope @ shares])
        grad_thresholds = np.zeros(n_grades - 1)
        np.add.at(grad_thresholds, np.minimum(grades, n_grades - 2), np.where(grades <= n_grades - 2, -up, 0) / n)
        np.add.at(grad_thresholds, np.maximum(grades - 1, 0), np.where(grades >= 1, down, 0) / n)
        grad_cuts = np.concatenate([[grad_thresholds.sum()], np.exp(cuts[1:]) * np.cumsum(grad_thresholds[::-1])[::-1][1:]])
        grad = np.concatenate([grad_weights + PENALTY * weights, grad_cuts])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        params = params - 0.05 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    weights, cuts = params[:WIDTH], params[WIDTH:]
    weights[:WORD_BUCKETS][~often] = 0
    return Ordinal(weights, np.concatenate([cuts[:1], cuts[0] + np.cumsum(np.exp(cuts[1:]))]))


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: 0 toxic, 1 of low quality, 2 good; the lowest of several ratings."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).dropna()
            .groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade")))


def _collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grades = batch.column("grade").to_numpy(zero_copy_only=False)
        for first, data, offsets in chunks(batch.column("text")):
            text, bucket, shares, _ = features(data, offsets)
            ends = np.searchsorted(text, np.arange(len(offsets)))
            rows = [pickle.dumps((bucket[a:b].astype(np.int32), s.astype(np.float32)))
                    for a, b, s in zip(ends, ends[1:], shares)]
            yield pa.RecordBatch.from_pydict({"grade": pa.array(grades[first:first + len(rows)], pa.int32()),
                                              "features": pa.array(rows, pa.binary())})


def train(docs: DataFrame, ratings: DataFrame, max_rated: int = MAX_RATED, n_grades: int = 3) -> Ordinal:
    """Fit on at most ``max_rated`` rated texts: only their hashed features reach the driver."""
    ship(docs.sparkSession)
    sample = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
             .join(F.broadcast(sample), "doc_id").select("grade", "text"))
    rows = texts.mapInArrow(_collect_features, "grade int, features binary").limit(2 * max_rated).collect()
    if not rows:
        return Ordinal(np.zeros(WIDTH), np.full(n_grades - 1, -50.0))
    grades, buckets, shares = np.array([r["grade"] for r in rows]), [], np.empty((len(rows), SHARES + EXTRA))
    rows.reverse()
    for i in range(len(rows)):  # what is unpacked goes
        own, shares[i] = pickle.loads(rows.pop()["features"])
        buckets.append(own)
    text = np.repeat(np.arange(len(buckets), dtype=np.int32), [len(b) for b in buckets])
    bucket = np.concatenate(buckets)
    del buckets, own
    return fit(text, bucket, shares, grades, n_grades)


def _scorer(model: Ordinal):
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            tails = [model.tails(model.scores(data, offsets)) for _, data, offsets in chunks(pa.array(batch, pa.large_string()))]
            tails = np.concatenate(tails) if tails else np.zeros((0, len(model.thresholds)))
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "top_chance": tails[:, -1] if len(tails) else []})
    return F.pandas_udf(score, "expected_grade double, top_chance double")


def rated(docs: DataFrame, model: Ordinal, keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with ``_rating``: expected grade, tail probability of the top grade, and whether the text is kept."""
    scored = docs.withColumn("_rating", _scorer(model)(text_of()))
    return scored.withColumn("_rating", F.struct("_rating.expected_grade", "_rating.top_chance",
                                                 (F.col("_rating.top_chance") >= keep_from).alias("kept")))


@apart
def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    return rated(docs, train(docs, graded(labels))).where("_rating.kept").drop("_rating")
