"""Running sums and dense positions over a total order, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendgrid.session import cut_lineage

ROW_BITS = 33  # of a monotonically increasing id, the number of a row in its partition


def running_sum(df: DataFrame, order: Sequence[str], value: Column, output: str) -> DataFrame:
    """Sum of ``value`` over all rows up to and including this one in the order of ``order``.

    Rows are range-partitioned by the order, summed within each partition, and shifted by the totals
    of the partitions before.  Only those totals, one row per shuffle partition, meet in one task.
    ``order`` should identify a row; the layout is written once so that both passes see the same cut.
    """
    laid = df.withColumn("_value", value).repartitionByRange(*[F.col(c) for c in order])
    laid = cut_lineage(laid.withColumn("_part", F.spark_partition_id()))
    totals = laid.groupBy("_part").agg(F.sum("_value").alias("_total"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (laid.join(F.broadcast(offsets), "_part")  # one row per shuffle partition
            .withColumn(output, F.sum("_value").over(within) + F.col("_before"))
            .drop("_part", "_value", "_before"))


def place(df: DataFrame, order: Sequence[str], output: str) -> DataFrame:
    """0, 1, 2 ... over all rows in the order of ``order``, which should identify a row.

    Rows are range-partitioned, sorted and numbered within each partition as they are written; the numbers are
    shifted by the rows of the partitions before, so the rows are exchanged once.
    """
    laid = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    laid = cut_lineage(laid.withColumn("_number", F.monotonically_increasing_id()))
    part = F.shiftright("_number", ROW_BITS)
    totals = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_total"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return (laid.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row per shuffle partition
            .withColumn(output, F.col("_before") + F.col("_number").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
            .drop("_part", "_number", "_before"))


def dense_position(df: DataFrame, by: Sequence[str], order: Sequence[str], output: str) -> DataFrame:
    """0, 1, 2 ... within each group in the given order, for groups of any size.

    Positions in the overall order are shifted by the first position of the group, so a group with a
    third of all rows is still numbered by many tasks.
    """
    numbered = place(df, [*by, *order], "_position")
    first = numbered.groupBy(*by).agg(F.min("_position").alias("_first"))
    return (numbered.join(first, list(by))
            .withColumn(output, F.col("_position") - F.col("_first")).drop("_position", "_first"))
