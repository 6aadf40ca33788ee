"""Shared views of the given tables: the channel samples in Spark and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import with_reference
from ..operators.axis import linear_axis
from ..operators.rollup import build_rollup
from ..session import settle
from ..sources.store import ChannelStore
from ..sources.tables import event_channels, event_store, lineitem_store

__all__ = ["event_store", "lineitem_store", "axes_of", "gappy", "spiky", "ranges_of", "rnd", "rnd_sql", "lineitem_rollup", "event_rollup"]

_ROLLUPS: dict = {}


# Results are compared as rounded values. A third of a unit is added first, so that an exact decimal
# tie (means of two-decimal prices are full of them) is not decided by the last bit of a sum.
_DIGITS = 5
_SHIFT = 3.3e-06


def rnd(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(_SHIFT), _DIGITS)


def rnd_sql(x: str) -> str:
    return f"round(({x}) + {_SHIFT!r}::DOUBLE, {_DIGITS})"


def gappy(samples: DataFrame, v: str = "v") -> DataFrame:
    """The samples with missing values (NaN) at every 97th position."""
    return samples.withColumn(v, F.when(F.col("sample_idx") % 97 == 5, F.lit(float("nan"))).otherwise(F.col(v)))


def spiky(samples: DataFrame, v: str = "v") -> DataFrame:
    """The samples with +/-Inf at some positions."""
    return samples.withColumn(v, F.when(F.col("sample_idx") % 89 == 3, F.lit(float("inf")))
                              .when(F.col("sample_idx") % 101 == 4, F.lit(float("-inf"))).otherwise(F.col(v)))


def ranges_of(channels: DataFrame) -> DataFrame:
    """[i0, i1): without the first tenth and the last seventh of each channel."""
    return channels.select("channel_id", F.floor(F.col("length") / 10).alias("i0"),
                           (F.col("length") - F.floor(F.col("length") / 7)).alias("i1"))


_AXES: dict = {}


def axes_of(store: ChannelStore) -> DataFrame:
    """Waveform axes of the event channels, stored with the catalog: channel_id, length, x0, dx, s, e."""
    if store.path not in _AXES:
        cat = with_reference(event_channels(store), 1)
        _AXES[store.path] = settle(linear_axis(cat).select(
            "channel_id", "length", "x0", "dx", F.lit(0).cast("bigint").alias("s"), F.col("length").alias("e")), "axes")
    return _AXES[store.path]


def _rollup(spark: SparkSession, store: ChannelStore, base: int) -> DataFrame:
    key = (store.path, base)
    if key not in _ROLLUPS:
        _ROLLUPS[key] = build_rollup(spark, gappy(store.samples), store.channels, f"{store.path}/buckets_{base}",
                                     base, store.n_channels)
    return _ROLLUPS[key]


def lineitem_rollup(spark: SparkSession, sf_dir: str, base: int = 16) -> DataFrame:
    return _rollup(spark, lineitem_store(spark, sf_dir), base)


def event_rollup(spark: SparkSession, sf_dir: str, base: int = 16) -> DataFrame:
    return _rollup(spark, event_store(spark, sf_dir), base)


# The same views in SQL.
S = """S AS (SELECT event_type AS channel_id,
      row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS sample_idx,
      value AS v, epoch_us(ts) AS t_us, user_id FROM events)"""
C = """C AS (SELECT channel_id, count(*) AS length, min(t_us) * 1000 AS wf_start_ns FROM S GROUP BY channel_id)"""
A = """A AS (SELECT channel_id, length,
      2.5::DOUBLE + (wf_start_ns - (SELECT min(wf_start_ns) FROM C)) / 1e9 AS x0,
      0.5::DOUBLE AS dx, 0::BIGINT AS s, length AS e FROM C)"""
SG = """SG AS (SELECT channel_id, sample_idx,
      CASE WHEN sample_idx % 97 = 5 THEN 'nan'::DOUBLE ELSE v END AS v, t_us FROM S)"""
L = """L AS (SELECT l_returnflag || l_linestatus AS channel_id,
      row_number() OVER (PARTITION BY l_returnflag || l_linestatus
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS sample_idx,
      l_extendedprice AS v, l_partkey AS k, l_quantity AS q, l_linenumber, l_orderkey, l_suppkey FROM lineitem)"""
LC = """LC AS (SELECT channel_id, count(*) AS length FROM L GROUP BY channel_id)"""
LG = """LG AS (SELECT channel_id, sample_idx,
      CASE WHEN sample_idx % 97 = 5 THEN 'nan'::DOUBLE ELSE v END AS v FROM L)"""


def rng(src: str) -> str:
    return f"R AS (SELECT channel_id, length // 10 AS i0, length - length // 7 AS i1 FROM {src})"


def moments(src: str, keys: str, extra: str = "") -> str:
    """Two CTEs M0 (means) and M (n, total, mn, mx, mean, std, m2) of the present values per key."""
    on = " AND ".join(f"d.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"d.{k.strip()}" for k in keys.split(","))
    return f"""M0 AS (SELECT {keys}, avg(v) AS mu FROM {src} WHERE NOT isnan(v) GROUP BY {keys}),
    M AS (SELECT {cols}, count(*) FILTER (WHERE NOT isnan(v)) AS n, count(*) AS total,
      min(v) FILTER (WHERE NOT isnan(v)) AS mn, max(v) FILTER (WHERE NOT isnan(v)) AS mx,
      any_value(m.mu) AS mean, coalesce(sum((v - m.mu) * (v - m.mu)) FILTER (WHERE NOT isnan(v)), 0) AS m2 {extra}
      FROM {src} d LEFT JOIN M0 m ON {on} GROUP BY {cols})"""
