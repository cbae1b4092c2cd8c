"""Evaluation of cleaning, grouping and classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrid import fixed_values as fv
from spendgrid.functions import text as X
from spendgrid.operators.encoding import Encoder, char_encoder, encode_distinct
from spendgrid.operators.grouping import density_grid, with_positions
from spendgrid.session import cut_lineage


def group_sizes(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))


def _band(condition: Column) -> Column:
    return F.count_if(condition)


def size_bands(sizes: DataFrame, *by: str) -> DataFrame:
    """Group counts by size: cumulative bands (10+, 5+, 3+, 1), exclusive bands, and the extremes."""
    size = F.col("size")
    return sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_groups"),
        _band(size >= 10).alias("large_groups"), _band(size >= 5).alias("medium_groups"),
        _band(size >= 3).alias("small_groups"), _band(size == 1).alias("singletons"),
        _band((size >= 5) & (size < 10)).alias("medium_only"), _band((size >= 2) & (size < 5)).alias("small_only"),
        (F.try_divide(_band(size == 1), F.count(F.lit(1))) * 100).alias("singleton_percent"),
        F.max("size").alias("largest_group"))


def effectiveness(bands: DataFrame) -> DataFrame:
    """Large groups, half the medium groups and a tenth of the reduction percentage."""
    reduction = F.coalesce(F.try_divide(F.col("original_unique") - F.col("final_unique"), F.col("original_unique")) * 100, F.lit(0.0))
    return bands.withColumn("reduction_percent", reduction).withColumn(
        "effectiveness_score", F.col("large_groups") + F.col("medium_groups") * 0.5 + F.col("reduction_percent") * 0.1)


def evaluate_grouping_distances(cleaned: DataFrame, distances: list[float], encoder: Encoder = char_encoder) -> DataFrame:
    """One row per density distance with its groups, reduction and score; the names are compared once for all of them."""
    names = cleaned.groupBy(F.col("cleaned").alias("name")).agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n")).where(F.length("name") > 0)
    names = cut_lineage(names)
    placed = with_positions(encode_distinct(names.drop("n"), "name", encoder))
    groups = density_grid(placed, distances)
    sizes = groups.join(names, "name").groupBy("distance", "representative").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("texts"))
    size = F.col("size")
    bands = sizes.groupBy("distance").agg(
        F.sum("texts").alias("original_unique"), F.count(F.lit(1)).alias("final_unique"), _band(size >= 10).alias("large_groups"),
        _band(size >= 5).alias("medium_groups"), _band(size == 1).alias("singletons"))
    return effectiveness(bands)


CLEANING_LEVELS = ("minimal", "moderate", "aggressive")


def evaluate_cleaning_levels(df: DataFrame, column: str = "description") -> DataFrame:
    """One row per cleaning level with its groups, reduction and score.

    Texts are counted once; each level cleans the distinct texts and sums their counts.
    """
    texts = df.groupBy(F.col(column).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    texts = texts.withColumns({
        "minimal": X.minimal_clean("text"), "moderate": X.moderate_clean("text"),
        "aggressive": X.clean_description("text")})
    levels = F.array(*[F.struct(F.lit(name).alias("level"), F.col(name).alias("cleaned")) for name in CLEANING_LEVELS])
    sizes = (texts.select("n", F.explode(levels).alias("c")).select("c.level", "c.cleaned", "n")
             .groupBy("level", "cleaned").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("texts")))
    size = F.col("size")
    bands = sizes.groupBy("level").agg(
        F.sum("texts").alias("original_unique"), F.count(F.lit(1)).alias("final_unique"),
        _band(size >= 10).alias("large_groups"), _band(size >= 5).alias("medium_groups"),
        _band(size == 1).alias("singletons"))
    return effectiveness(bands)


def best_configuration(results: DataFrame, name: str = "level") -> DataFrame:
    """The configuration with the best score, the most large groups and the highest reduction."""
    return results.agg(
        F.max_by(name, "effectiveness_score").alias("best_by_score"),
        F.max_by(name, "large_groups").alias("best_by_large_groups"),
        F.max_by(name, "reduction_percent").alias("highest_reduction"))


def align_results(left: DataFrame, right: DataFrame) -> DataFrame:
    """Results of two classifiers by transaction id, never by position."""
    a = left.select("tx_id", F.col("predicted_category").alias("left_category"), F.col("similarity_score").alias("left_score"))
    b = right.select("tx_id", F.col("predicted_category").alias("right_category"), F.col("similarity_score").alias("right_score"))
    return a.join(b, "tx_id").withColumns({
        "exact_match": F.col("left_category").eqNullSafe(F.col("right_category")),
        "score_difference": F.abs(F.coalesce("left_score", F.lit(0.0)) - F.coalesce("right_score", F.lit(0.0))),
    })


def agreement(aligned: DataFrame) -> DataFrame:
    """Exact matches, their percentage and its band."""
    counts = aligned.agg(F.count(F.lit(1)).alias("compared"), F.count_if("exact_match").alias("exact_matches"))
    percent = F.coalesce(F.try_divide("exact_matches", "compared") * 100, F.lit(0.0))
    band = (F.when(percent >= fv.AGREEMENT_HIGH, F.lit("high"))
            .when(percent >= fv.AGREEMENT_MODERATE, F.lit("moderate")).otherwise(F.lit("low")))
    return counts.select("compared", "exact_matches", percent.alias("match_percent"), band.alias("band"))


def category_distribution(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Categories by number of results, most frequent first."""
    counts = results.groupBy("predicted_category").agg(F.count(F.lit(1)).alias("transactions"))
    ordered = counts.orderBy(F.desc("transactions"), "predicted_category")
    return ordered if limit is None else ordered.limit(limit)
