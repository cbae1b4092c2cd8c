"""Session helpers: a local session for tests and benches, and lineage cuts that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Scans up to this size are dealt out to all cores; only the layout depends on it, never a result.
SPREAD_BYTES = 256 << 20


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  app: str = "spendgrid") -> SparkSession:
    """A single-machine session with the settings the jobs expect (UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may fall back to a
    folder of its own; anywhere else a machine-local folder would not survive a lost executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spendgrid-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROW_SOURCES = "spark.sql.sources.useV1SourceList"
_written = threading.local()


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _columnar(kind: T.DataType) -> bool:
    """Whether Parquet can hold a type."""
    if isinstance(kind, T.StructType):
        names = [f.name.lower() for f in kind.fields]
        return bool(names) and len(set(names)) == len(names) and all(_columnar(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _columnar(kind.elementType)
    if isinstance(kind, T.MapType):
        return _columnar(kind.keyType) and _columnar(kind.valueType)
    return not isinstance(kind, (T.NullType, T.CalendarIntervalType))


def cut_rows(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` as whole rows, for rows that Parquet cannot hold and narrow tables that are read in full."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written rows.

    Rows are written as compressed columns, of which later steps read those they need, and the shuffle files of the
    write go when it ends.  Rows that cannot be written so are checkpointed.
    """
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark)
    if not _columnar(df.schema):
        return cut_rows(df)
    path = f"{folder.rstrip('/')}/rows-{uuid.uuid4().hex}"
    with _setting(spark, _SHUFFLES_GO, "true"):
        df.write.option("compression", "zstd").parquet(path)
    others = [x for x in spark.conf.get(_ROW_SOURCES).split(",") if x.strip().lower() != "parquet"]
    with _setting(spark, _ROW_SOURCES, ",".join(others)):
        table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    if getattr(_written, "tables", None) is not None:
        _written.tables.append(table)
    return table


def discard(table: DataFrame) -> None:
    """Remove the rows of :func:`cut_lineage` that nothing reads any more."""
    if hasattr(table, "written_at"):
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def keeping() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove what is written inside, save the written tables that are handed to the function given.

    Nothing that outlives the block may read a table that is not kept.
    """
    outer, kept = getattr(_written, "tables", None), []
    _written.tables = inside = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _written.tables = outer
        stay = {getattr(t, "written_at", None) for t in kept}
        for table in inside:
            if table.written_at not in stay:
                discard(table)
            elif outer is not None:
                outer.append(table)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """The rows that ``build`` returns, written; what it wrote on the way is removed."""
    with keeping() as keep:
        return keep(cut_lineage(build()))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small scan out to all cores.

    A small file in one row group would otherwise keep every later step in one task.  Scans of more than
    ``SPREAD_BYTES`` by the planner's statistics are left as they are, so no large input is shuffled for this.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once, for functions that run there, whatever the master.

    Call it before any Python function is handed to Spark: workers do not share the driver's module path.
    """
    context = spark.sparkContext
    if getattr(context, "_spendgrid_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(SparkFiles.getRootDirectory()) / "spendgrid_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._spendgrid_shipped = True
