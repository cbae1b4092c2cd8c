"""Writers: model store, versioned results, job events, result sheets and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendgrid.functions.amounts import direction_label
from spendgrid.operators.jobs import latest_by_key, latest_state
from spendgrid.session import cut_lineage
from spendgrid.sources import versions

MODEL_BUCKETS = 256


def _bucket(buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _stored_buckets(models: DataFrame) -> int | None:
    """The number of buckets a store was made with; it stands in the store's first folder level."""
    row = models.select("user_buckets").first()
    return None if row is None else row[0]


def write_models(models: DataFrame, path: str, buckets: int = MODEL_BUCKETS) -> None:
    """Replace the whole model of every user in ``models``; other users' models stay.

    The store is partitioned by a bucket of the user, so millions of users do not mean millions of
    folders, and only the buckets of the replaced users are rewritten.  ``buckets`` counts when the store
    is made; later writes and reads take the number kept with the data.  Large buckets are split by size.
    """
    spark = models.sparkSession
    stored = spark.read.parquet(path) if _exists(spark, path) else None
    buckets = (stored is not None and _stored_buckets(stored)) or buckets
    keyed = models.withColumns({"user_buckets": F.lit(buckets), "user_bucket": _bucket(buckets)})
    merged = new = cut_lineage(keyed)
    if stored is not None:
        touched = new.select("user_bucket").distinct()
        kept = (stored.join(F.broadcast(touched), "user_bucket", "left_semi")  # at most one row per bucket
                .join(new.select("user_id").distinct(), "user_id", "left_anti"))
        merged = cut_lineage(new.unionByName(kept))
    (merged.hint("rebalance", "user_bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("user_buckets", "user_bucket").parquet(path))


def read_models(spark: SparkSession, path: str, user_ids: Sequence[int] | None = None) -> DataFrame:
    """Stored models; for given users only their buckets are scanned."""
    models = spark.read.parquet(path)
    buckets = _stored_buckets(models) if user_ids is not None else None
    if buckets is not None:
        wanted = spark.range(1).select(F.explode(F.array(*[F.lit(u).cast("long") for u in user_ids])).alias("user_id"))
        numbers = [r[0] for r in wanted.select(_bucket(buckets)).distinct().collect()]
        models = models.where(F.col("user_bucket").isin(numbers) & F.col("user_id").isin(list(user_ids)))
    return models.drop("user_buckets", "user_bucket")


def append_results(results: DataFrame, path: str, key: str, version: Column, fold_after: int = versions.FOLD_AFTER) -> None:
    """Append one JSON document per key with a version; :func:`read_results` shows the newest.

    A long history is folded to the newest document of each key first, so reads stay bounded.
    """
    spark = results.sparkSession
    versions.fold_if_long(spark, path, lambda rows: latest_by_key(rows, key, "version"), fold_after)
    fields = [c for c in results.columns if c != key]
    versions.append(results.select(key, version.alias("version"), F.to_json(F.struct(*fields)).alias("results")), path)


def read_results(spark: SparkSession, path: str, key: str) -> DataFrame:
    return latest_by_key(versions.read(spark, path), key, "version")


def append_job_events(events: DataFrame, path: str, fold_after: int = versions.FOLD_AFTER) -> None:
    """Status events are only ever added; the current state is the newest event of a job."""
    versions.fold_if_long(events.sparkSession, path, lambda rows: versions.newest_rows(rows, ["job_id"], ["updated_at", "event_seq"]), fold_after)
    versions.append(events, path)


def read_job_state(spark: SparkSession, path: str) -> DataFrame:
    return latest_state(versions.read(spark, path))


def sheet_columns(results: DataFrame) -> DataFrame:
    """Category, confidence and IN/OUT flag as written back to a sheet, from whichever columns exist."""
    present = set(results.columns)

    def first(names: Sequence[str], empty: Column) -> Column:
        used = [F.nullif(F.col(n), F.lit("")) if dict(results.dtypes)[n] == "string" else F.col(n) for n in names if n in present]
        return F.coalesce(*used, empty)

    flag = direction_label("money_in") if "money_in" in present else F.lit("")
    return results.select(
        *[c for c in ("tx_id", "seq") if c in present],
        first([n for n in ("predicted_category", "category", "Category") if n in present], F.lit("")).alias("category_out"),
        first([n for n in ("similarity_score", "confidence", "score") if n in present], F.lit(None).cast("double")).alias("confidence_out"),
        flag.alias("direction_out"))


def write_sheet(results: DataFrame, path: str, order: str = "seq") -> None:
    """The sheet columns as CSV parts in row order (range-partitioned, each part sorted)."""
    sheet_columns(results).repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """A report as CSV; array columns become JSON text."""
    columns = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """A nested report, one JSON object per line."""
    df.write.mode("overwrite").json(path)
