"""Channel views of the relational tables, stored once per session and folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded, settle
from .store import ChannelStore, create_store

_CATALOGS: dict[str, DataFrame] = {}
_STORES: dict[tuple[str, str, str], ChannelStore] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ column (session zone UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def _memo(spark: SparkSession, sf_dir: str, name: str, make) -> ChannelStore:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORES:
        _STORES[key] = make()
    return _STORES[key]


def event_store(spark: SparkSession, sf_dir: str) -> ChannelStore:
    """Events as channels: one per event_type, ordered by (ts, event_id).

    v = value, t_us = ts in epoch µs (the X channel).
    """
    def make():
        rows = table(spark, sf_dir, "events").select(
            F.col("event_type").alias("channel_id"), epoch_us("ts").alias("t_us"), "event_id",
            F.col("value").alias("v"), "user_id")
        return create_store(spark, rows, ["t_us", "event_id"], "events")
    return _memo(spark, sf_dir, "events", make)


def lineitem_store(spark: SparkSession, sf_dir: str) -> ChannelStore:
    """Line items as channels: returnflag + linestatus, in order-key order.

    v = l_extendedprice, k = l_partkey (int64 channel), q = l_quantity.
    """
    def make():
        rows = table(spark, sf_dir, "lineitem").select(
            F.concat("l_returnflag", "l_linestatus").alias("channel_id"), "l_orderkey", "l_linenumber",
            "l_suppkey", F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("v"),
            F.col("l_quantity").alias("q"))
        return create_store(spark, rows, ["l_orderkey", "l_linenumber", "k", "l_suppkey", "v"], "lineitem")
    return _memo(spark, sf_dir, "lineitem", make)


def event_channels(store: ChannelStore) -> DataFrame:
    """Stored catalog of the event channels with waveform properties.

    The start time is the first event; x = start - reference + 2.5 s + 0.5 s per sample.
    """
    starts = store.samples.filter("sample_idx = 0").select(
        "channel_id", (F.col("t_us") * 1000).alias("wf_start_ns"))
    if store.path not in _CATALOGS:
        rows = store.channels.join(bounded(starts, store.n_channels), "channel_id")
        _CATALOGS[store.path] = settle(rows.withColumn("file_id", F.lit("events")).withColumn("wf_increment", F.lit(0.5))
                                       .withColumn("wf_start_offset", F.lit(2.5)), "catalog")
    return _CATALOGS[store.path]
