"""Positions in a sorted X channel by descent through its rollup.

The rollup of an X channel is a search tree: on the top level the first bucket whose maximum reaches the wanted x is found, then the
same among its FACTOR buckets one level below, down to one bucket of samples. A lookup reads TOP_BUCKETS rows at the top, FACTOR rows on
each level and `base` samples, however long the channel is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded, settle
from .rollup import BASE, FACTOR, level_count, n_levels

MAX_SPANS = 256  # lookups whose places become literal filters of a scan; beyond, the scan is bounded as a whole and joined


def pruned(rows: DataFrame, state: DataFrame, at: str, more: str | None = None) -> DataFrame:
    """The rows whose (channel_id, at) lies in some [lo, hi) of state, as far as pushed filters can tell."""
    if more:
        rows = rows.filter(more)
    few = state.select("channel_id", "lo", "hi").distinct().limit(MAX_SPANS + 1).collect()
    if len(few) <= MAX_SPANS:
        cond = F.lit(False)
        for c, lo, hi in few:
            cond = cond | ((F.col("channel_id") == c) & (F.col(at) >= lo) & (F.col(at) < hi))
        return rows.filter(cond)
    lo, hi = state.agg(F.min("lo"), F.max("hi")).first()
    return rows.filter((F.col(at) >= lo) & (F.col(at) < hi))


def _reaches(x: str) -> Column:
    return F.when(F.col("strict"), F.col(x) > F.col("q")).otherwise(F.col(x) >= F.col("q"))


def sorted_positions(points: DataFrame, buckets: DataFrame, channels: DataFrame, queries: DataFrame, base: int = BASE,
                     n_channels: int | None = None, n_queries: int | None = None) -> DataFrame:
    """channel_id, key, q, pos: the first index with x >= q (strict: x > q), the length if there is none.

    points: channel_id, sample_idx, x, non-decreasing and finite (`is_monotonic`). buckets: the rollup of x. channels: channel_id, length.
    queries: channel_id, key (tells queries of a channel apart), q, strict. n_queries: their number, if it is known.
    Queries of unknown or empty channels give no row.
    """
    sizes = channels.select("channel_id", "length").filter("length > 0")
    state = queries.select("channel_id", "key", F.col("q").cast("double").alias("q"), "strict").join(bounded(sizes, n_channels), "channel_id")
    state = settle(state.withColumn("top", F.expr(f"{level_count('length', base)} - 1")), "lookup")
    most = n_levels(state.agg(F.max("length")).first()[0] or 0, base) - 1
    low: DataFrame | None = None
    ends = []
    for level in range(most, -1, -1):
        size = base * FACTOR ** level
        starts = state.filter(F.col("top") == level).select(
            "channel_id", "key", "q", "strict", "length", F.lit(0).cast("bigint").alias("lo"), F.expr(f"bigint(ceil(length / {size}D))").alias("hi"))
        here = starts if low is None else low.unionByName(starts)
        here = settle(here, "lookup") if low is not None else here
        rows = pruned(buckets.select("channel_id", "level", "bucket", "mx"), here, "bucket", f"level = {level}")
        near = rows.join(bounded(here, n_queries), "channel_id").filter("bucket >= lo AND bucket < hi")
        found = near.filter(_reaches("mx")).groupBy("channel_id", "key").agg(F.min("bucket").alias("at"))
        all_ = settle(here.join(bounded(found, n_queries), ["channel_id", "key"], "left"), "lookup")
        ends.append(all_.filter("at IS NULL").select("channel_id", "key", "q", F.col("length").alias("pos")))
        width = base if level == 0 else FACTOR  # samples, or buckets of the level below
        limit = F.col("length") if level == 0 else F.expr(f"bigint(ceil(length / {size // FACTOR}D))")
        low = all_.filter("at IS NOT NULL").select("channel_id", "key", "q", "strict", "length", (F.col("at") * width).alias("lo"),
                                                   F.least((F.col("at") + 1) * width, limit).alias("hi"))
    rows = pruned(points.select("channel_id", "sample_idx", "x"), low, "sample_idx")
    near = rows.join(bounded(low, n_queries), "channel_id").filter("sample_idx >= lo AND sample_idx < hi").filter(_reaches("x"))
    out = near.groupBy("channel_id", "key", "q").agg(F.min("sample_idx").alias("pos"))
    for end in ends:
        out = out.unionByName(end)
    return out


def _asked(channels: DataFrame, marks: list[tuple[int, float, bool]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(float(q)).alias("q"), F.lit(strict).alias("strict")) for k, q, strict in marks])
    return channels.select("channel_id", F.inline(rows))


def sorted_range_rollup(points: DataFrame, buckets: DataFrame, channels: DataFrame, xa: float, xb: float, base: int = BASE,
                        n_channels: int | None = None) -> DataFrame:
    """`sorted_range` from the rollup: [i0, i1) with xa <= x <= xb, and [v0, v1) with one sample more each side."""
    n = None if n_channels is None else 2 * n_channels
    at = sorted_positions(points, buckets, channels, _asked(channels, [(0, xa, False), (1, xb, True)]), base, n_channels, n)
    both = at.groupBy("channel_id").agg(F.max(F.when(F.col("key") == 0, F.col("pos"))).alias("i0"), F.max(F.when(F.col("key") == 1, F.col("pos"))).alias("_i1"))
    both = both.join(bounded(channels.select("channel_id", "length"), n_channels), "channel_id")
    zero = F.lit(0).cast("bigint")
    return both.select("channel_id", "i0", F.greatest("i0", "_i1").alias("i1"), F.greatest(zero, F.col("i0") - 1).alias("v0"),
                       F.least("length", F.col("_i1") + 1).alias("v1"))


def nearest_sorted_rollup(points: DataFrame, buckets: DataFrame, channels: DataFrame, cursors: list[float], base: int = BASE,
                          n_channels: int | None = None) -> DataFrame:
    """`nearest_sorted` from the rollup: channel_id, cursor_no, cx, s, e, sample_idx, x, x_first, x_last.

    The neighbours of a cursor are the samples before and at its position; a tie takes the lower side.
    """
    n = None if n_channels is None else len(cursors) * n_channels
    at = sorted_positions(points, buckets, channels, _asked(channels, [(i + 1, q, False) for i, q in enumerate(cursors)]), base, n_channels, n)
    at = at.join(bounded(channels.select("channel_id", "length"), n_channels), "channel_id")
    at = settle(at.selectExpr("channel_id", "key AS cursor_no", "q AS cx", "pos", "length", "greatest(0L, pos - 1) AS lo", "least(length, pos + 1) AS hi"), "lookup")
    near = pruned(points.select("channel_id", "sample_idx", "x"), at, "sample_idx").join(bounded(at, n), "channel_id").filter("sample_idx >= lo AND sample_idx < hi")
    sides = near.groupBy("channel_id", "cursor_no", "cx", "pos", "length").agg(
        F.max(F.when(F.col("sample_idx") < F.col("pos"), F.col("x"))).alias("low"), F.max(F.when(F.col("sample_idx") == F.col("pos"), F.col("x"))).alias("high"))
    lower = F.expr("low IS NOT NULL AND (high IS NULL OR abs(low - cx) <= abs(high - cx))")
    tops = channels.select("channel_id", F.expr(f"{level_count('length', base)} - 1").alias("level"))
    ends = buckets.select("channel_id", "level", "mn", "mx").join(bounded(tops, n_channels), ["channel_id", "level"]).groupBy("channel_id").agg(
        F.min("mn").alias("x_first"), F.max("mx").alias("x_last"))
    return sides.join(bounded(ends, n_channels), "channel_id").select(
        "channel_id", "cursor_no", "cx", F.lit(0).cast("bigint").alias("s"), F.col("length").alias("e"),
        F.when(lower, F.col("pos") - 1).otherwise(F.col("pos")).alias("sample_idx"), F.when(lower, F.col("low")).otherwise(F.col("high")).alias("x"), "x_first", "x_last")
