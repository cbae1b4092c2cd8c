"""Helpers of the document operators: written intermediate tables, bounded sides, package shipping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendgrid.session import ship_package

#: Rows of a side that may be broadcast; beyond it the join is left to the planner.
BROADCAST_ROWS = 500_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table of a folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session without that setting whose tasks all run in this process gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spendgrid-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings of one write.  Shuffle files go when it ends instead of at the driver's next collection."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
PACKED_ROWS = 4


def stored(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Write ``df`` as a table of the shared folder and go on from there, so that lost executors cost no recomputation.

    ``packed`` says that rows hold megabytes each: then Python functions get few of them at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    settings = {_CLEANUP: "true"} | ({_BATCH: str(PACKED_ROWS)} if packed else {})
    with _settings(spark, settings):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Remove a table of :func:`stored` that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted rows are within the bound, else the plain side of a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_node(name: str = "text") -> Column:
    """64 bits made from the SHA-256 of a text; equal texts agree, and unequal ones by chance alone."""
    return F.xxhash64(F.sha2(F.col(name), 256))


def nodes_of(batch: pa.RecordBatch) -> np.ndarray:
    """The ``node`` column of a batch as unsigned numbers."""
    return batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def once_each(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` of ``docs`` with one of those that repeat id and text; only ids that occur twice are compared by text."""
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_twice"))
    if twice.limit(1).count() == 0:
        return rows
    same = F.col("doc_id").eqNullSafe(F.col("_twice"))
    return (rows.join(twice, same, "left_anti")
            .unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])))


def apart(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Run a step that returns rows of ``docs`` so that no column of ``docs`` clashes with its helpers, which begin with ``_``."""
    @wraps(step)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        taken, back = {c.lower() for c in docs.columns}, {}
        for name in docs.columns:
            if name.startswith("_"):
                own = f"x{name}"
                while own.lower() in taken:
                    own = f"x{own}"
                taken.add(own.lower())
                back[own] = name
        renamed = docs.withColumnsRenamed({name: own for own, name in back.items()})
        return step(renamed, *args, **options).withColumnsRenamed(back)
    return run


def ship(spark: SparkSession) -> None:
    """Python functions find this package on the executors."""
    ship_package(spark)


def text_bytes(df: DataFrame, name: str = "text") -> int:
    """Bytes of all texts; sizes the number of groups of an exchange."""
    return df.agg(F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()[0]
