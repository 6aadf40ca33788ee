"""Distributed sample numbering: ``row_number() - 1`` per channel without a per-channel task.

A window partitioned by channel would put a whole channel (maybe a third of all rows) into one
task. Here the rows are range-partitioned on the full order key, so a hot channel spans many
tasks; each row's number is its position in its partition plus the number of earlier rows of
the channel. The partition offsets are a small table (partitions + channels rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bounded, new_path, range_parts, settle

_POS_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def with_sample_index(spark: SparkSession, df: DataFrame, channel: str, order: list[str]) -> DataFrame:
    """Add ``sample_idx`` (BIGINT, 0-based per channel in `order`) to df.

    The range-partitioned rows are written to the shared folder first: the offsets and the rows
    must come from the same partitioning, also after the loss of an executor.
    `order` must be unique within a channel.
    """
    staged = new_path(spark, "staged")
    (
        range_parts(df, df.count(), channel, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .write.parquet(staged)
    )
    rows = spark.read.parquet(staged).withColumn("_part", F.shiftright("_at", _POS_BITS))
    runs = settle(rows.groupBy(channel, "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_cnt")), "runs")
    before = Window.partitionBy(channel).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        channel, "_part",
        (F.coalesce(F.sum("_cnt").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (
        rows.join(bounded(offsets, runs.count()), [channel, "_part"])
        .withColumn("sample_idx", F.col("_at") + F.col("_shift"))
        .drop("_at", "_part", "_shift")
    )
