"""Session settings, the shared folder, and the guarded broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A catalog side is broadcast only when its known rows, at the width of its schema, have at most so many bytes.
MAX_BROADCAST_BYTES = 32 << 20

ROWS_PER_PART = 1_000_000  # of a range or hash partitioning: about 100 MB in a task's sort, so that it does not spill

_LOCAL_DIRS: dict[str, str] = {}


def builder(app_name: str = "waveloom") -> SparkSession.Builder:
    """Session builder with the settings the library expects."""
    return (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
    )


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime settings the results depend on (time zone) on an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach, from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _LOCAL_DIRS:
        path = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(path)
        _LOCAL_DIRS[sc.applicationId] = path
    return _LOCAL_DIRS[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a derived table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/waveloom/{name}-{uuid.uuid4().hex}"


def row_width(df: DataFrame) -> int:
    """Bytes of a row by the optimizer's default sizes, text and nested values taken as 64 bytes at least."""
    plain = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}
    return 16 + sum(plain.get(kind, 64) for _, kind in df.dtypes)


def bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast hint for a side of known size; beyond the limit (or unknown) the join stays
    a shuffle join, where adaptive execution splits skewed keys."""
    if rows is not None and rows * row_width(df) <= MAX_BROADCAST_BYTES:
        return F.broadcast(df)
    return df


def _part_count(df: DataFrame, rows: int) -> int | None:
    """Partitions for so many rows; None leaves a single partition's worth to the session.

    An explicit number: adaptive execution coalesces by compressed bytes, which lets a task's sort outgrow its memory as rows grow.
    """
    need = -(-rows // ROWS_PER_PART)
    return max(need, df.sparkSession.sparkContext.defaultParallelism) if need > 1 else None


def range_parts(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Range-partition and sort by columns, with at most about ROWS_PER_PART rows per partition.

    Small data keeps the session's shuffle partitions, which adaptive execution may coalesce.
    """
    need = _part_count(df, rows)
    parts = df.repartitionByRange(*by) if need is None else df.repartitionByRange(need, *by)
    return parts.sortWithinPartitions(*by)


def hash_parts(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Hash-partition by columns for windows, joins or groups over them, with about ROWS_PER_PART rows per partition.

    Small data is left to the session's shuffle partitions; a fixed number of them would make a task's sort grow with the data.
    """
    need = _part_count(df, rows)
    return df if need is None else df.repartition(need, *by)


def task_count(spark: SparkSession, items: int, per_task: int) -> int:
    """Tasks for work whose rows are small but costly (files to open, pieces to decode).

    An explicit number, because adaptive execution would coalesce such rows into a few tasks.
    """
    return max(1, min(items, max(spark.sparkContext.defaultParallelism, -(-items // per_task))))


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage where a result is used more than once, so its input is not computed again
    and the loss of an executor does not repeat it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
