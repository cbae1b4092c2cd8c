"""Nearest trained rows of each row to score, and the confidence decision on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendgrid import fixed_values as fv
from spendgrid.functions import vectors as V
from spendgrid.operators import blocks as B
from spendgrid.session import cut_lineage, ship_package

# Scores are rounded here so that equal vectors tie exactly, whatever the order of the products.
SCORE_DIGITS = 12


def nearest(score: DataFrame, model: DataFrame, k: int = fv.NEIGHBOURS_KEPT, key: str = "user_id",
            row_id: str = "tx_id", block_rows: int = B.DEFAULT_BLOCK) -> DataFrame:
    """The k most similar model rows of the same user per row to score, ties by item id.

    ``score`` holds key, row id and ``vector``; ``model`` holds key, ``item_id``, ``category`` and
    ``vector``; rows without a vector have no neighbours.  Users of at most ``block_rows`` rows on either side
    are compared one after the other, as they pass sorted through a task; the others in pairs of blocks.  Each
    comparison emits k rows per scored row; those few are ranked again.
    """
    ship_package(score.sparkSession)
    usable = F.col("vector").isNotNull() & F.col(key).isNotNull()
    score = score.where(usable).select(key, row_id, "vector")
    model = model.where(usable).select(key, F.col("item_id").cast("long").alias("item_id"), "category", "vector")

    def large(side: DataFrame) -> DataFrame:
        return side.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows).select(key)

    heavy = cut_lineage(large(score).unionByName(large(model)).distinct())
    schema = f"{key} {dict(score.dtypes)[key]}, {row_id} {dict(score.dtypes)[row_id]}, item_id long, category string, score double"
    if heavy.isEmpty():
        found = _by_user(score, model, k, key, row_id, schema)
    else:
        found = _by_user(*(side.join(heavy, key, "left_anti") for side in (score, model)), k, key, row_id, schema).unionByName(
            _by_blocks(*(side.join(heavy, key, "left_semi") for side in (score, model)), k, key, row_id, schema, block_rows))
    order = W.partitionBy(key, row_id).orderBy(F.desc("score"), "item_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def _by_user(score: DataFrame, model: DataFrame, k: int, key: str, row_id: str, schema: str) -> DataFrame:
    """Neighbours where both sides of a user fit a task: rows are exchanged once, in their sparse form."""
    trained = V.as_sparse(model).withColumn("_wanted", F.lit(False))
    rows = trained.unionByName(V.as_sparse(score).withColumn("_wanted", F.lit(True)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.whole_keys(batches, key):
            vectors, ids = B.unit_rows(B.dense_rows(table["vector"])), table["item_id"].fill_null(0).to_numpy()
            wanted = table["_wanted"].to_numpy()
            bounds = B.key_bounds(table[key])
            rows, items, found = [], [], []
            for first, end in zip(bounds[:-1], bounds[1:]):
                middle = first + int(np.count_nonzero(~wanted[first:end]))  # a user's model comes before what is scored
                if first == middle:
                    continue
                for start in range(middle, end, B.TILE):
                    scores = np.round(vectors[start:min(end, start + B.TILE)] @ vectors[first:middle].T, SCORE_DIGITS)
                    r, c = B.best_per_row(scores, ids[first:middle], k)
                    rows.append(start + r)
                    items.append(first + c)
                    found.append(scores[r, c])
            if rows:
                who, what = table.select([key, row_id]).take(np.concatenate(rows)), table.select(["item_id", "category"]).take(np.concatenate(items))
                yield from pa.table([*who.columns, *what.columns, pa.array(np.concatenate(found))],
                                    names=[key, row_id, "item_id", "category", "score"]).combine_chunks().to_batches()

    return rows.select(key, row_id, "item_id", "category", "vector", "_wanted").repartition(key).sortWithinPartitions(key, "_wanted").mapInArrow(run, schema)


def _by_blocks(score: DataFrame, model: DataFrame, k: int, key: str, row_id: str, schema: str, block_rows: int) -> DataFrame:
    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame()
        trained, ids = B.unit_rows(B.matrix(b["vector"])), b["item_id"].to_numpy()
        categories, rows = b["category"].to_numpy(), a[row_id].to_numpy()
        wanted = B.unit_rows(B.matrix(a["vector"]))
        out = []
        for start in range(0, len(rows), B.TILE):
            scores = np.round(wanted[start:start + B.TILE] @ trained.T, SCORE_DIGITS)
            r, c = B.best_per_row(scores, ids, k)
            out.append(pd.DataFrame({row_id: rows[start + r], "item_id": ids[c],
                                     "category": categories[c], "score": scores[r, c]}))
        found = pd.concat(out)
        found.insert(0, key, a[key].iloc[0])
        return found

    return B.compare_blocks(V.as_dense(score), V.as_dense(model), key, row_id, "item_id", match, schema, block_rows, tile=None)


def dimension_mismatch(score: DataFrame, model: DataFrame, key: str = "user_id", row_id: str = "tx_id") -> DataFrame:
    """Rows to score whose vector length differs from a row of their user's model, with the two lengths.

    A model with rows of several lengths fits no row; its longest counts as the model's length.
    """
    given = model.where(F.col("vector").isNotNull()).select(key, V.length(model).alias("_size"))
    rows = score.where(F.col("vector").isNotNull()).select(key, row_id, V.length(score).alias("dimension"))
    sizes = given.groupBy(key).agg(F.max("_size").alias("model_dimension"), F.min("_size").alias("_least"))
    differs = (F.col("dimension") != F.col("model_dimension")) | (F.col("dimension") != F.col("_least"))
    lengths = given.agg(F.min("_size"), F.max("_size")).first(), rows.agg(F.min("dimension"), F.max("dimension")).first()
    if len({n for pair in lengths for n in pair}) == 1:  # one length everywhere: nothing to join
        differs = F.lit(False)
    return rows.join(sizes, key).where(differs).drop("_least")


def pivot_neighbours(found: DataFrame, key: str = "user_id", row_id: str = "tx_id") -> DataFrame:
    """One row per scored row: best and second neighbour, and the neighbour lists for inspection."""
    def at(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    ordered = F.array_sort(F.collect_list(F.struct("rank", "category", "score")))
    return found.groupBy(key, row_id).agg(
        at(1, "category").alias("best_category"), at(1, "score").alias("best_score"),
        at(2, "category").alias("second_category"), at(2, "score").alias("second_score"),
        ordered.alias("_n")).select(
        key, row_id, "best_category", "best_score",
        F.coalesce("second_category", F.lit("Unknown")).alias("second_category"),
        F.coalesce("second_score", F.lit(0.0)).alias("second_score"),
        F.transform("_n", lambda n: n["category"]).alias("neighbor_categories"),
        F.transform("_n", lambda n: n["score"]).alias("neighbor_scores"))


def confidence(pivoted: DataFrame) -> DataFrame:
    """Low-confidence flag, reason and debug fields; the best category always stands.

    The gap counts only when the two best rows disagree on the category.
    """
    gap = F.col("best_score") - F.col("second_score")
    low_score = F.col("best_score") < fv.MIN_SCORE
    conflict = ~low_score & (F.col("best_category") != F.col("second_category")) & (gap < fv.MIN_GAP)
    reason = F.when(low_score, F.lit(fv.REASON_LOW_SCORE)).when(conflict, F.lit(fv.REASON_CONFLICT))
    code = (F.when(low_score, F.lit("LOW_ABS_CONF"))
            .when(conflict, F.lit("LOW_REL_CONF_AND_CONFLICTING_NEIGHBORS")))
    threshold = F.when(low_score, F.lit(fv.MIN_SCORE)).when(conflict, F.lit(fv.MIN_GAP))
    return pivoted.withColumns({
        "is_low_confidence": low_score | conflict,
        "reason": reason,
        "debug_info": F.struct(
            code.alias("reason_code"), F.col("best_score"), F.col("second_score").alias("second_best_score"),
            gap.alias("difference"), threshold.alias("threshold"), "neighbor_categories", "neighbor_scores"),
    })
