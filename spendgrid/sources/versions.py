"""Tables that only grow by whole batches, with a history that is folded now and then.

A batch is a folder of the log.  A fold reduces the last base and every batch since to the newest row of each key, writes
that as the next base, and then a list of the batches that are in it.  That list is what makes a base valid: a reader takes
the newest base with a list and the batches that its list does not name, so an append, a read and a fold may overlap, and a
fold that is lost halfway changes nothing.  What a valid base has replaced is removed by the next fold.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Collection
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLD_AFTER = 32  # batches of the log that a read has to take in at most, besides the base


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names behind ``prefix`` of the folders in ``path``; one for each batch or base, never one for each row."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    return [s.getPath().getName()[len(prefix):] for s in system.listStatus(folder) if s.getPath().getName().startswith(prefix)]


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _valid(spark: SparkSession, path: str) -> tuple[int, set[str]]:
    """Number of the newest valid base, 0 for none, and the batches it holds."""
    numbers = [int(n) for n in _folders(spark, f"{path}/folded", "fold=") if n.isdigit() and _folders(spark, f"{path}/folded/fold={n}", "_SUCCESS")]
    if not numbers:
        return 0, set()
    newest = max(numbers)
    return newest, {r["batch"] for r in spark.read.schema("batch string").parquet(f"{path}/folded/fold={newest}").collect()}  # one row a batch


def append(rows: DataFrame, path: str, batch: str | None = None) -> str:
    """Add a batch; writing the same ``batch`` again replaces it, so a retried write adds nothing."""
    batch = batch or uuid.uuid4().hex
    if not re.fullmatch(r"[\w-]+", batch):
        raise ValueError(f"a batch is named by letters, digits and dashes, not {batch!r}")
    rows.write.mode("overwrite").parquet(f"{path}/log/batch-{batch}")
    return batch


def read(spark: SparkSession, path: str) -> DataFrame:
    """The base and all batches since, several rows a key."""
    number, folded = _valid(spark, path)
    parts = [f"{path}/log/batch-{b}" for b in _folders(spark, f"{path}/log", "batch-") if b not in folded]
    base = [f"{path}/base/fold={number}"] if number else []
    if not parts and not base:
        raise FileNotFoundError(f"nothing was ever appended to {path}")
    return spark.read.parquet(*base, *sorted(parts))


def waiting(spark: SparkSession, path: str) -> list[str]:
    """Batches that are in no base yet."""
    _, folded = _valid(spark, path)
    return sorted(b for b in _folders(spark, f"{path}/log", "batch-") if b not in folded)


def fold(spark: SparkSession, path: str, newest: Callable[[DataFrame], DataFrame], besides: Collection[str] = ()) -> None:
    """Write the next base from the last one and all waiting batches but ``besides``, and remove what the last one replaced."""
    number, folded = _valid(spark, path)
    present = set(_folders(spark, f"{path}/log", "batch-"))
    for batch in present & folded:
        _remove(spark, f"{path}/log/batch-{batch}")
    for old in _folders(spark, f"{path}/base", "fold="):
        if old.isdigit() and int(old) != number:
            _remove(spark, f"{path}/base/fold={old}")
            _remove(spark, f"{path}/folded/fold={old}")
    batches = sorted(present - folded - set(besides))
    if not batches:
        return
    base = [f"{path}/base/fold={number}"] if number else []
    rows = spark.read.parquet(*base, *(f"{path}/log/batch-{b}" for b in batches))
    newest(rows).write.mode("overwrite").parquet(f"{path}/base/fold={number + 1}")
    # batches removed above stay named, in case their writer tries them again
    names = spark.createDataFrame([(b,) for b in sorted({*batches, *(folded & present)})], "batch string")
    names.coalesce(1).write.mode("overwrite").parquet(f"{path}/folded/fold={number + 1}")


def fold_if_long(spark: SparkSession, path: str, newest: Callable[[DataFrame], DataFrame], most: int = FOLD_AFTER,
                 besides: Collection[str] = ()) -> None:
    if len(waiting(spark, path)) > most:
        fold(spark, path, newest, besides)


def newest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of every key that is last by ``order``; of equal ones the largest of the other columns.

    The order is settled on the key and one order column after the other, so rows with long texts are only joined.
    """
    for column in order:
        last = rows.groupBy(*keys).agg(F.max(column).alias("_last"))
        on = reduce(and_, [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys], F.col(f"r.{column}").eqNullSafe(F.col("l._last")))
        rows = rows.alias("r").join(last.alias("l"), on, "left_semi")
    others = [c for c in rows.columns if c not in (*keys, *order)]
    if not others:
        return rows.distinct()
    tied = rows.groupBy(*keys, *order).agg(F.max(F.struct(*others)).alias("_rest"))
    return tied.select(*keys, *order, *[F.col(f"_rest.{c}").alias(c) for c in others]).select(*rows.columns)
