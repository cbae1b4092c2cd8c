"""Vector expressions over array columns."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendgrid import fixed_values as fv
from spendgrid.functions.amounts import int8_scale


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda total, x: total + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def char_counts(text: Column | str) -> Column:
    """Counts of the code points of the whole lower-cased text in 256 slots; null for a null text.

    A code point beyond the slots counts in the slot of its remainder, so every text has a vector.
    """
    def present(codes: Column) -> Column:
        return F.map_from_entries(F.transform(
            F.array_distinct(codes), lambda p: F.struct(p, F.size(F.filter(codes, lambda c: c == p)))))

    def slots(counts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(fv.CHAR_SLOTS - 1)),
                           lambda i: F.coalesce(F.element_at(counts, i), F.lit(0)))

    letters = F.filter(F.split(F.lower(_col(text)), ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.pmod(F.ascii(c), F.lit(fv.CHAR_SLOTS)))
    counts = F.transform(F.array(codes), present)  # one-element arrays: each step is evaluated once
    return F.when(_col(text).isNotNull(), F.transform(counts, slots)[0])


def char_vector(text: Column | str) -> Column:
    """Character counts divided by their total; all zero for an empty text."""
    def totalled(counts: Column) -> Column:  # bound by itself: inside the next step it would be summed for every slot
        return F.struct(counts.alias("counts"), F.aggregate(counts, F.lit(0), lambda a, x: a + x).alias("total"))

    def scaled(p: Column) -> Column:
        return F.transform(p["counts"], lambda x: F.coalesce(F.try_divide(x, p["total"]), F.lit(0.0)))

    return F.transform(F.transform(F.array(char_counts(text)), totalled), scaled)[0]


def mean_pool(df: DataFrame, by: str, vector: str = "vector") -> DataFrame:
    """Element-wise mean of the vectors of each group, combined on the map side."""
    pooled = Summarizer.mean(array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return df.groupBy(by).agg(vector_to_array(pooled).alias(vector))


def largest_magnitude(vector: Column | str) -> Column:
    return F.array_max(F.transform(_col(vector), lambda x: F.abs(x.cast("double"))))


def sparse(vector: Column | str) -> Column:
    """A vector as its ``size`` and the places ``at`` and ``value`` of what is not zero, which is little of a text's vector."""
    def packed(v: Column) -> Column:
        places = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1)).otherwise(F.array().cast("array<int>"))
        held = F.filter(places, lambda i: ~F.get(v, i).cast("double").eqNullSafe(F.lit(0.0)))
        return F.transform(F.array(held), lambda at: F.struct(
            F.size(v).alias("size"), at.alias("at"), F.transform(at, lambda i: F.get(v, i).cast("double")).alias("value")))[0]

    return F.when(_col(vector).isNotNull(), F.transform(F.array(_col(vector)), packed)[0])  # bound to a name: evaluated once


def dense(packed: Column | str) -> Column:
    """The whole vector again."""
    def slots(p: Column) -> Column:
        held = F.map_from_arrays(p["at"], p["value"])
        return F.transform(F.array(held), lambda m: F.transform(
            F.sequence(F.lit(0), p["size"] - 1), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0))))[0]

    p = _col(packed)
    return F.when(p["size"] > 0, slots(p)).when(p["size"] == 0, F.array().cast("array<double>"))


def is_sparse(df: DataFrame, column: str = "vector") -> bool:
    return isinstance(df.schema[column].dataType, T.StructType)


def as_sparse(df: DataFrame, column: str = "vector") -> DataFrame:
    return df if is_sparse(df, column) else df.withColumn(column, sparse(column))


def as_dense(df: DataFrame, column: str = "vector") -> DataFrame:
    return df.withColumn(column, dense(column)) if is_sparse(df, column) else df


def length(df: DataFrame, column: str = "vector") -> Column:
    """Entries of a vector in either form."""
    return F.col(f"{column}.size") if is_sparse(df, column) else F.size(column)


def codes(vector: Column | str, scale: Column | str) -> Column:
    """Codes of eight bits, truncated toward zero."""
    return F.transform(vector, lambda x: (x.cast("double") / _col(scale)).cast("int").cast("tinyint"))


def sparse_codes(vector: Column | str, scale: Column | str) -> Column:
    """:func:`codes` of a sparse vector, in the same form."""
    v = _col(vector)
    return F.when(v.isNotNull(), F.struct(v["size"].alias("size"), v["at"].alias("at"), codes(v["value"], scale).alias("value")))


def quantise(df: DataFrame, by: str = "user_id", vector: str = "vector") -> DataFrame:
    """Symmetric int8 codes with one scale per model, truncated toward zero.

    The scale is a per-model maximum (partial aggregation) joined back on the model key.
    """
    scales = df.groupBy(by).agg(F.max(largest_magnitude(vector)).alias("_largest"))
    scales = scales.select(by, int8_scale(F.col("_largest")).alias("scale"))
    return df.join(scales, by).withColumn("codes", codes(vector, "scale")).drop(vector)


def dequantise(codes: Column | str = "codes", scale: Column | str = "scale") -> Column:
    s = _col(scale)
    return F.transform(_col(codes), lambda x: x.cast("double") * s)


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence of two strings, one machine-word style pass per character."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def text_ratio(a: str, b: str) -> float:
    """Twice the common subsequence over the summed lengths; 1 for two empty strings."""
    total = len(a) + len(b)
    return 1.0 if total == 0 else 2.0 * lcs_length(a, b) / total


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Insert/delete similarity of two text columns (no built-in has this edit cost)."""
    return pd.Series([None if x is None or y is None else text_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity_or_ratio(a: Column | str, b: Column | str, left: Column | str, right: Column | str) -> Column:
    """Cosine of two vectors, or the text ratio of a pair that lacks a vector or has vectors of unequal length."""
    usable = _col(a).isNotNull() & _col(b).isNotNull() & (F.size(_col(a)) == F.size(_col(b)))
    text = F.when(~F.coalesce(usable, F.lit(False)), _col(left))  # the ratio is computed where it counts
    return F.when(usable, cosine(a, b)).otherwise(similarity_ratio(text, _col(right)))
