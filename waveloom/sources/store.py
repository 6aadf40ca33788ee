"""The channel store: clustered samples, the catalog and the rollup as Parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import finite
from ..session import new_path, range_parts
from .indexing import with_sample_index


class ChannelStore:
    """Paths of the three tables of one data set, read back lazily."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    @cached_property
    def samples(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/samples")

    @cached_property
    def channels(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/channels")

    @cached_property
    def n_channels(self) -> int:
        return self.channels.count()

    def buckets(self, base: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/buckets_{base}")


def measure_channels(samples: DataFrame) -> DataFrame:
    """Catalog measures of each channel: length, first value and pivot (first finite value)."""
    ok = finite("v")
    return samples.groupBy("channel_id").agg(
        (F.max("sample_idx") + 1).alias("length"),
        F.min_by("v", "sample_idx").alias("first_v"),
        F.min_by(F.when(ok, F.col("v")), F.when(ok, F.col("sample_idx"))).alias("pivot"),
    )


def create_store(spark: SparkSession, rows: DataFrame, order: list[str], name: str) -> ChannelStore:
    """Number the rows of a plain table and store them clustered by (channel_id, sample_idx).

    rows: channel_id, the order columns, v (double) and any other value columns.
    """
    path = new_path(spark, name)
    with_sample_index(spark, rows, "channel_id", order).write.parquet(f"{path}/samples")
    store = ChannelStore(spark, path)
    measure_channels(store.samples).write.parquet(f"{path}/channels")
    return store


def store_samples(spark: SparkSession, samples: DataFrame, name: str) -> ChannelStore:
    """Store samples that already carry sample_idx, clustered by a range partitioning."""
    path = new_path(spark, name)
    range_parts(samples, samples.count(), "channel_id", "sample_idx").write.parquet(f"{path}/samples")
    store = ChannelStore(spark, path)
    measure_channels(store.samples).write.parquet(f"{path}/channels")
    return store
