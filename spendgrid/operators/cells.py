"""Exact pruning of cosine comparisons by pivot cells.

Every vector of the right side lives in the cell of its nearest pivot.  By the triangle inequality of angles a vector can
only be within an angle of something in a cell if it is no further from the pivot than that angle and the cell's radius
together.  A left vector visits just those cells, so every pair in reach meets in exactly one cell, the right one's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.operators import blocks as B
from spendgrid.session import cut_lineage, ship_package

CELL_ROWS = 2048  # vectors of a cell, on average
MOST_PIVOTS = 4096  # what every task holds
MARGIN = 1e-5  # radians; more than rounding of scores and angles can make
KEY = "cell_key"


def _angles(vectors: pd.Series, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(B.unit_rows(B.matrix(vectors)) @ pivots.T, -1.0, 1.0))


def keyed(left: DataFrame, right: DataFrame, threshold: float, scope: str, half: bool = False,
          cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with a key; vectors of one scope whose cosine reaches ``threshold`` meet under one key.

    ``half`` is for a table compared with itself: a pair meets once, not from both ends.  Rows need ``pos``, ``vector`` and
    the scope column.  Vectors without length reach nothing above 0 and get no key; at 0 and below nothing can be pruned.
    """
    spark = left.sparkSession
    ship_package(spark)
    if threshold <= 0:
        return left.withColumn(KEY, F.col(scope).cast("string")), right.withColumn(KEY, F.col(scope).cast("string"))
    reach = math.acos(min(threshold, 1.0)) + MARGIN
    n = right.count()
    sample = right.orderBy(F.xxhash64("pos")).select("vector").limit(min(MOST_PIVOTS, max(1, -(-n // cell_rows)))).collect()
    pivots = B.unit_rows(np.array([list(r["vector"]) for r in sample], np.float64)) if sample else np.zeros((0, 1))
    pivots = pivots[(pivots * pivots).sum(axis=1) > 0.5]
    if not len(pivots):
        return left.withColumn(KEY, F.col(scope).cast("string")), right.withColumn(KEY, F.col(scope).cast("string"))

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[[any(v) for v in frame["vector"]]] if len(frame) else frame
            if len(frame):
                angles = _angles(frame["vector"], pivots)
                cell = angles.argmin(axis=1)
                yield frame.assign(_cell=cell, _angle=angles[np.arange(len(frame)), cell])

    homes = cut_lineage(right.mapInPandas(home, f"{_schema(right)}, _cell long, _angle double"))
    radii = np.full(len(pivots), -1.0)
    for r in homes.groupBy("_cell").agg(F.max("_angle").alias("r")).collect():  # one row a pivot
        radii[r["_cell"]] = r["r"]

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[[any(v) for v in frame["vector"]]] if len(frame) else frame
            if len(frame):
                angles = _angles(frame["vector"], pivots)
                near = (radii >= 0)[None, :] & (angles <= reach + radii[None, :])
                if half:
                    near &= np.arange(len(pivots))[None, :] >= angles.argmin(axis=1)[:, None]
                yield frame.assign(_cells=[np.flatnonzero(row).tolist() for row in near])

    visits = left.mapInPandas(visit, f"{_schema(left)}, _cells array<long>").withColumn("_cell", F.explode("_cells")).drop("_cells")
    key = F.concat_ws("|", F.col("_cell").cast("string"), F.col(scope).cast("string")).alias(KEY)
    return visits.select(*left.columns, key), homes.select(*right.columns, key)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def pair_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: pairs that two keyed sides compare, next to all pairs of the two sides."""
    per_key = left.groupBy(KEY).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(KEY).agg(F.count(F.lit(1)).alias("r")), KEY)
    compared = per_key.agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("compared"))
    everything = left.agg(F.count_distinct("pos").alias("l")).join(right.agg(F.count_distinct("pos").alias("r")))  # one row each
    return compared.join(everything).select("compared", (F.col("l") * F.col("r")).alias("everything"))
