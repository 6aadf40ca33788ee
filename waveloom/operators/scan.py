"""Running aggregates over long ordered groups, without one task per group.

The group is cut into blocks of the integer order column. A window runs inside each block; the
block totals (a table smaller by the block size) carry the state across blocks. A hot group thus
spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, hash_parts, range_parts, settle
from .envelope import bucket_of

BLOCK = 1 << 16


def running(df: DataFrame, keys: list[str], order: str, value: Column, how: str, out: str,
            inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Add the running sum or max of `value` in `order` (unique integers within a key).

    df is read three times (its count, totals and rows): settle it first unless it is a plain scan.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    rows = df.withColumn("_blk", bucket_of(order, block)).withColumn("_val", value)
    totals = rows.groupBy(*keys, "_blk").agg(agg("_val").alias("_tot"))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_blk", agg("_tot").over(earlier).alias("_carry"))
    local = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    joined = hash_parts(rows, df.count(), *keys, "_blk").withColumn("_local", agg("_val").over(local)).join(carry, [*keys, "_blk"])
    zero = F.lit(0)
    both = (F.coalesce("_local", zero) + F.coalesce("_carry", zero)) if how == "sum" else F.greatest("_local", "_carry")
    return joined.withColumn(out, both).drop("_blk", "_val", "_local", "_carry")


def running_rows(df: DataFrame, keys: list[str], order: list[str], value: Column, how: str, out: str, inclusive: bool = True) -> DataFrame:
    """Running sum or max like `running`, for an order of any type and any gaps (nanosecond starts).

    Two passes over rows: they are range-partitioned by (keys, order) and written with their place, each key has a total in each of its
    partitions, and the totals of earlier partitions are carried in. Windows cover a partition's rows of a key, or a key's partitions.
    Rows that are equal in keys and order lie in one partition.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    placed = range_parts(df.withColumn("_val", value), df.count(), *keys, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = settle(placed, "running").withColumn("_part", F.shiftright("_at", 33))
    totals = settle(rows.groupBy(*keys, "_part").agg(agg("_val").alias("_tot")), "running-totals")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_part", agg("_tot").over(earlier).alias("_carry"))
    local = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = rows.withColumn("_local", agg("_val").over(local)).join(bounded(carry, totals.count()), [*keys, "_part"])
    both = (F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0))) if how == "sum" else F.greatest("_local", "_carry")
    return joined.withColumn(out, both).drop("_at", "_part", "_val", "_local", "_carry")


def first_rows(df: DataFrame, group: str, order: str, k: int, spread: int | None = None) -> DataFrame:
    """First k rows per group in two rounds: per slice of a hot group, then over the slices.

    The number of slices follows the row count (about a million rows each).
    """
    spread = spread or max(64, -(-df.count() // 1_000_000))
    slices = Window.partitionBy(group, F.pmod(F.xxhash64(order), F.lit(spread))).orderBy(order)
    near = df.withColumn("_rn", F.row_number().over(slices)).filter(F.col("_rn") <= k)
    return near.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(
        F.col("_rn") <= k).drop("_rn")
