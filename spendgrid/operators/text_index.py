"""Exact candidates for the insert/delete ratio of texts: an index of letter pairs, rarest first.

Two texts of lengths a and b whose ratio reaches a threshold share a subsequence of L >= threshold * (a + b) / 2 letters.
Then they have L letters in common, counted with repetition, and 3L - a - b - 1 pairs of adjacent letters: a letter left
out of one text breaks two of its pairs at most, one put in breaks one.  If two texts have t of their tokens in common,
the rarest ``tokens - t + 1`` of each share one.  Texts so short that no pair need remain are found by single letters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendgrid.functions import vectors as V
from spendgrid.operators.cells import KEY
from spendgrid.session import cut_lineage, ship_package

WORD = 62  # letters that one machine word holds


def partner_lengths(a: int, threshold: float) -> range:
    """Lengths that a partner of a text of length ``a`` can have."""
    if threshold <= 0:
        raise ValueError("a ratio of 0 is reached by every pair")
    low = max(1, math.ceil(threshold * a / (2 - threshold) - 1e-9))
    return range(low, max(low, math.floor(a * (2 - threshold) / threshold + 1e-9)) + 1)


def shared_letters(a: int, b: int, threshold: float) -> int:
    """Least common subsequence of two texts in reach."""
    return max(1, math.ceil(threshold * (a + b) / 2 - 1e-9))


def least_tokens(a: int, threshold: float) -> tuple[int, int]:
    """Least common letters, and least common pairs of letters, of a text of length ``a`` and any partner."""
    lengths = partner_lengths(a, threshold)
    return (min(shared_letters(a, b, threshold) for b in lengths),
            min(3 * shared_letters(a, b, threshold) - a - b - 1 for b in lengths))


def _numbered(tokens: list[str], kind: str) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for token in tokens:
        seen[token] = seen.get(token, 0) + 1
        out.append(f"{kind}{seen[token]}:{token}")
    return out


def _tokens(threshold: float):
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("prefix", T.IntegerType()), T.StructField("kind", T.StringType())])))
    def tokens(names: pd.Series) -> pd.Series:
        sizes: dict[int, tuple[int, int]] = {}
        out = []
        for name in names:
            n = len(name)
            letters, pairs = sizes.setdefault(n, least_tokens(n, threshold)) if n else (0, 0)
            rows = [{"token": t, "prefix": n - letters + 1, "kind": "L" if pairs >= 1 else "S"} for t in _numbered(list(name), "1")]
            if pairs >= 1:
                rows += [{"token": t, "prefix": n - 1 - pairs + 1, "kind": "P"} for t in _numbered([name[i:i + 2] for i in range(n - 1)], "2")]
            out.append(rows)
        return pd.Series(out)
    return tokens


def keyed(left: DataFrame, right: DataFrame, threshold: float, scope: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a key; names of one scope whose ratio reaches ``threshold`` meet under one key at least.

    Rows need ``pos``, ``name`` and the scope column.  ``L`` and ``S`` are the letters of long and short names, ``P`` pairs
    of letters of long ones: long names meet by pairs, a short one meets any other by letters.
    """
    ship_package(left.sparkSession)
    tokens = _tokens(threshold)

    def listed(side: DataFrame) -> DataFrame:
        return cut_lineage(side.select("pos", F.explode(tokens(F.col("name"))).alias("t")).select("pos", "t.token", "t.prefix", "t.kind"))

    rights = listed(right)
    lefts = rights if left is right else listed(left)
    often = rights.groupBy("token").agg(F.count(F.lit(1)).alias("often"))  # tokens of the left that the right lacks are rarest

    def rarest(side: DataFrame) -> DataFrame:
        ranked = side.join(often, "token", "left").withColumn("often", F.coalesce("often", F.lit(0)))
        ranked = ranked.groupBy("pos", "prefix", "kind").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("all"))
        return ranked.select("pos", "kind", F.explode(F.slice("all", 1, F.greatest("prefix", F.lit(1)))).alias("t")).select("pos", "kind", "t.token")

    def with_key(side: DataFrame, prefixes: DataFrame, way: list[tuple[str, str]]) -> DataFrame:
        ways = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("way")) for kind, name in way])
        rows = prefixes.withColumn("w", F.explode(ways)).where(F.col("w.kind") == F.col("kind"))
        key = F.concat_ws("|", F.col("w.way"), F.col(scope).cast("string"), "token").alias(KEY)
        return side.join(rows, "pos").select(*side.columns, key)

    return (with_key(left, rarest(lefts), [("P", "pairs"), ("S", "short"), ("L", "long")]),
            with_key(right, rarest(rights), [("P", "pairs"), ("S", "short"), ("L", "short"), ("S", "long")]))


# --- the ratio itself, for all pairs of two lists --------------------------------------------------------------------

def _coded(texts: list[str], codes: dict[str, int]) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts), default=0)), -1, np.int64)
    for i, text in enumerate(texts):
        out[i, :len(text)] = [codes[ch] for ch in text]
    return out


def common_lengths(left: list[str], right: list[str], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Longest common subsequences of the given pairs, one pass over the letters for all pairs at once."""
    sizes = np.array([len(t) for t in left], np.int64)
    out = np.zeros(len(rows), np.int64)
    wide = sizes[rows] > WORD
    for k in np.flatnonzero(wide):
        out[k] = V.lcs_length(left[rows[k]], right[cols[k]])
    rows, cols, at = rows[~wide], cols[~wide], np.flatnonzero(~wide)
    if not len(rows):
        return out
    codes = {ch: i for i, ch in enumerate(sorted(set("".join(left)) | set("".join(right))))}
    masks = np.zeros((len(left), len(codes) + 1), np.uint64)
    for i, text in enumerate(left):
        for k, ch in enumerate(text[:WORD]):
            masks[i, codes[ch]] |= np.uint64(1 << k)
    letters = _coded(right, codes)
    full = (np.uint64(1) << sizes[rows].astype(np.uint64)) - np.uint64(1)
    state = full.copy()
    for k in range(letters.shape[1]):
        hit = state & masks[rows, letters[cols, k]]  # the last column, -1, has no letter
        state = ((state + hit) | (state - hit)) & full
    out[at] = sizes[rows] - np.bitwise_count(state).astype(np.int64)
    return out


def ratios(left: list[str], right: list[str], threshold: float) -> np.ndarray:
    """Ratios of all pairs; those whose lengths or letters cannot reach the threshold stay 0."""
    scores = np.zeros((len(left), len(right)))
    if not left or not right:
        return scores
    codes = {ch: i for i, ch in enumerate(sorted(set("".join(left)) | set("".join(right))))}
    bags = []
    for texts in (left, right):
        coded = _coded(texts, codes)
        bag = np.zeros((len(texts), len(codes) + 1), np.int32)
        np.add.at(bag, (np.repeat(np.arange(len(texts)), coded.shape[1]), coded.ravel()), 1)
        bags.append(bag[:, :-1])
    a, b = (np.array([len(t) for t in texts]) for texts in (left, right))
    for i in range(len(left)):
        total = a[i] + b
        near = np.flatnonzero(2.0 * np.minimum(a[i], b) >= threshold * total - 1e-9)
        near = near[2.0 * np.minimum(bags[0][i], bags[1][near]).sum(axis=1) >= threshold * total[near] - 1e-9]
        scores[i, near] = -1.0
    rows, cols = np.nonzero(scores)
    total = a[rows] + b[cols]
    scores[rows, cols] = np.where(total > 0, 2.0 * common_lengths(left, right, rows, cols) / np.maximum(total, 1), 1.0)
    return scores
