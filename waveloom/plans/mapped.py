"""Plot views, statistics and cursors of channels whose x is linear or another channel, and of values of any kind.

maps: one row per channel: channel_id, length, map, x0, dx, x_channel_id. map is `linear` (x = x0 + i * dx), `sorted` (the X channel never
decreases, `is_monotonic`) or `unsorted`. Channels whose X channel has another length have no x and are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import floor_pow2
from ..operators.axis import (inner_range, interpolate_x, linear_covers, nearest_linear, nearest_unsorted, view_range, x_of, xy_align, xy_filter)
from ..operators.envelope import clip, envelope, envelope_points
from ..operators.lookup import nearest_sorted_rollup, pruned, sorted_range_rollup
from ..operators.rollup import BASE, covered_prefix, range_states, rollup_envelope
from ..operators.stats import STATE, all_channels, raw_states, with_pivot, with_statistics
from ..session import bounded, settle
from .plot import MIN_PIXELS

WIDE = "decimal(38,0)"


@dataclass
class XChannels:
    """The X channels: points (channel_id, sample_idx, x), the rollup of x, catalog (channel_id, length), its base and their number."""

    points: DataFrame
    buckets: DataFrame
    channels: DataFrame
    base: int = BASE
    n: int | None = None

    def used(self, maps: DataFrame) -> DataFrame:
        ids = maps.select(F.col("x_channel_id").alias("channel_id")).distinct()
        return self.channels.select("channel_id", "length").join(bounded(ids, self.n), "channel_id", "left_semi")


def _axes(maps: DataFrame) -> DataFrame:
    return maps.filter("map = 'linear'").select("channel_id", "x0", "dx", F.lit(0).cast("bigint").alias("s"), F.col("length").alias("e"))


def _with_x(maps: DataFrame, kind: str, x: XChannels | None) -> DataFrame:
    """Maps of a kind whose X channel has the channel's length."""
    own = maps.filter(F.col("map") == kind).select("channel_id", "length", "x_channel_id")
    sizes = x.channels.select(F.col("channel_id").alias("x_channel_id"), F.col("length").alias("_x"))
    return own.join(bounded(sizes, x.n), "x_channel_id").filter("length = _x").drop("_x")


def index_ranges(maps: DataFrame, x: XChannels | None, xa: float, xb: float, view: bool, n_channels: int | None = None) -> DataFrame:
    """channel_id, i0, i1: the samples with xa <= x <= xb of linear and sorted channels (view: one more on each side)."""
    found = view_range(_axes(maps), xa, xb) if view else inner_range(_axes(maps), xa, xb)
    out = found.select("channel_id", "i0", "i1")
    if x is None:
        return out
    own = _with_x(maps, "sorted", x)
    ranges = sorted_range_rollup(x.points, x.buckets, x.used(own), xa, xb, x.base, x.n)
    lo, hi = ("v0", "v1") if view else ("i0", "i1")
    ranges = ranges.select(F.col("channel_id").alias("x_channel_id"), F.col(lo).alias("i0"), F.col(hi).alias("i1"))
    return out.unionByName(own.join(bounded(ranges, x.n), "x_channel_id").select("channel_id", "i0", "i1"))


def plot_mapped(samples: DataFrame, buckets: DataFrame | None, channels: DataFrame, maps: DataFrame, x: XChannels | None, xa: float, xb: float,
                pixels: int, base: int = BASE, n_channels: int | None = None) -> DataFrame:
    """Points to draw: channel_id, bucket, ord, x, y, complete; at most two and a break for a pixel and channel.

    The rollup may still be being built: each channel uses it as far as whole buckets of its size are covered and raw samples beyond, so
    the points are those of a whole rollup; `complete` tells whether the rollup reached the end of the view.
    """
    px = max(MIN_PIXELS, int(pixels))
    count = F.col("i1") - F.col("i0")
    plan = index_ranges(maps, x, xa, xb, True, n_channels).withColumn("b", floor_pow2(count / F.lit(float(px)))).filter("i1 > i0")
    if buckets is None:
        plan = plan.withColumn("covered", F.col("i0"))
    else:
        reach = covered_prefix(buckets, channels, base, n_channels).select("channel_id", "covered")
        plan = plan.join(bounded(reach, n_channels), "channel_id")
    mode = F.when(count <= 2 * px, "raw").when(F.col("b") >= base, "rollup").otherwise("envelope")
    plan = plan.withColumn("mode", mode).withColumn("cut", F.expr("CASE WHEN mode <> 'rollup' THEN i0 WHEN covered >= i1 THEN i1 ELSE greatest(i0, (covered div b) * b) END"))
    plan = settle(plan.withColumn("complete", F.expr("mode <> 'rollup' OR covered >= i1")), "plot-plan")

    raw = clip(samples.select("channel_id", "sample_idx", "v"), plan.filter("mode = 'raw'").select("channel_id", "i0", "i1"), n_channels)
    parts = [raw.select("channel_id", F.col("sample_idx").alias("bucket"), F.lit(0).alias("ord"), F.col("sample_idx").cast("double").alias("x_index"), F.col("v").alias("y"))]
    rest = plan.filter("mode <> 'raw' AND cut < i1").select("channel_id", F.col("cut").alias("i0"), "i1", "b")
    parts.append(envelope_points(envelope(samples, rest, n_channels)))
    if buckets is not None:
        head = plan.filter("mode = 'rollup' AND cut > i0").select("channel_id", "i0", F.col("cut").alias("i1"), "b")
        parts.append(envelope_points(rollup_envelope(samples, buckets, channels, head, base, n_channels)))
    points = reduce(DataFrame.unionByName, [p.select("channel_id", "bucket", "ord", "x_index", "y") for p in parts])
    points = points.join(bounded(plan.select("channel_id", "complete"), n_channels), "channel_id")
    columns = ["channel_id", "bucket", "ord", "x", "y", "complete"]
    out = points.join(bounded(_axes(maps), n_channels), "channel_id").withColumn("x", x_of("x_index")).select(columns)
    if x is None:
        return out
    own = _with_x(maps, "sorted", x)
    asked = points.join(bounded(own, n_channels), "channel_id").select(
        F.col("channel_id").alias("y_channel"), "bucket", "ord", "y", "complete", F.col("x_channel_id").alias("channel_id"), F.col("x_index").alias("at"), F.col("length").alias("n"))
    lo, hi = plan.join(bounded(own, n_channels), "channel_id", "left_semi").agg(F.min("i0"), F.max("i1")).first()
    if lo is None:
        return out
    near = x.points.select("channel_id", "sample_idx", "x").filter((F.col("sample_idx") >= lo) & (F.col("sample_idx") <= hi))
    most = None if n_channels is None else n_channels * 3 * (2 * px + 2)  # no channel has more points
    placed = interpolate_x(settle(asked, "plot-points"), near, most)
    return out.unionByName(placed.select(F.col("y_channel").alias("channel_id"), "bucket", "ord", "x", "y", "complete"))


def _unsorted_points(samples: DataFrame, maps: DataFrame, x: XChannels, n_channels: int | None) -> DataFrame:
    """channel_id, sample_idx, x, y of channels over an X channel of any order."""
    own = _with_x(maps, "unsorted", x).select("channel_id", F.col("length").alias("y_length"), "x_channel_id", F.col("length").alias("x_length"))
    tag = F.lit("x:")
    both = samples.select(F.concat(F.lit("y:"), "channel_id").alias("channel_id"), "sample_idx", "v").unionByName(
        x.points.select(F.concat(tag, "channel_id").alias("channel_id"), "sample_idx", F.col("x").alias("v")))
    pairs = own.withColumn("channel_id", F.concat(F.lit("y:"), "channel_id")).withColumn("x_channel_id", F.concat(tag, "x_channel_id"))
    return xy_align(both, pairs, n_channels).withColumn("channel_id", F.expr("substr(channel_id, 3)"))


def stats_mapped(samples: DataFrame, buckets: DataFrame | None, channels: DataFrame, maps: DataFrame, x: XChannels | None, xa: float, xb: float,
                 base: int = BASE, n_channels: int | None = None) -> DataFrame:
    """Statistics of the samples with xa <= x <= xb of every mapped channel; channels: channel_id, length, pivot."""
    ranges = index_ranges(maps, x, xa, xb, False, n_channels)
    if buckets is not None:
        states = range_states(samples, buckets, channels, ranges, base, n_channels)
    else:
        states = raw_states(with_pivot(clip(samples.select("channel_id", "sample_idx", "v"), ranges, n_channels), channels, n_channels), ["channel_id"])
    states = states.select("channel_id", *STATE)
    mapped = maps.filter("map = 'linear'").select("channel_id")
    if x is not None:
        mapped = mapped.unionByName(_with_x(maps, "sorted", x).select("channel_id")).unionByName(_with_x(maps, "unsorted", x).select("channel_id"))
        inside = xy_filter(_unsorted_points(samples, maps, x, n_channels), xa, xb).withColumn("v", F.col("y"))
        states = states.unionByName(raw_states(with_pivot(inside, channels, n_channels), ["channel_id"]).select("channel_id", *STATE))
    return with_statistics(all_channels(states, mapped, n_channels))


def _sorted_covers(near: DataFrame, x: XChannels) -> DataFrame:
    """Keep the cursors inside a sorted X channel plus half of its first and last spacing."""
    near = settle(near, "cursors")
    ends = near.select("channel_id", "e").distinct()
    spans = ends.select("channel_id", F.inline(F.array(
        F.struct(F.lit(1).cast("bigint").alias("lo"), F.lit(2).cast("bigint").alias("hi")), F.struct((F.col("e") - 2).alias("lo"), (F.col("e") - 1).alias("hi")))))
    edge = pruned(x.points.select("channel_id", "sample_idx", "x"), spans, "sample_idx").join(bounded(ends, x.n), "channel_id")
    edge = edge.groupBy("channel_id").agg(F.max(F.when(F.col("sample_idx") == 1, F.col("x"))).alias("second"),
                                          F.max(F.when(F.col("sample_idx") == F.col("e") - 2, F.col("x"))).alias("before"))
    near = near.join(bounded(edge, x.n), "channel_id", "left")
    low, high = F.coalesce(0.5 * (F.col("second") - F.col("x_first")), F.lit(0.0)), F.coalesce(0.5 * (F.col("x_last") - F.col("before")), F.lit(0.0))
    return near.filter((F.col("x_first") - low <= F.col("cx")) & (F.col("cx") <= F.col("x_last") + high))


def cursors_mapped(samples: DataFrame, maps: DataFrame, x: XChannels | None, cursors: list[float], value: str = "v",
                   n_channels: int | None = None) -> DataFrame:
    """channel_id, cursor_no, sample_idx, x, value of the sample nearest to each cursor; outside a channel's extent there is no row.

    Positions come from the formula or by descent; then only the wanted samples are read.
    """
    own = linear_covers(nearest_linear(_axes(maps), cursors)).filter("covered")
    near = own.select("channel_id", "cursor_no", "sample_idx", x_of("sample_idx").alias("x"))
    if x is not None:
        in_order = _with_x(maps, "sorted", x)
        at = _sorted_covers(nearest_sorted_rollup(x.points, x.buckets, x.used(in_order), cursors, x.base, x.n), x)
        at = at.select(F.col("channel_id").alias("x_channel_id"), "cursor_no", "sample_idx", "x")
        near = near.unionByName(in_order.join(bounded(at, None if x.n is None else x.n * len(cursors)), "x_channel_id").select(near.columns))
        free = _with_x(maps, "unsorted", x)
        used = x.points.join(bounded(x.used(free).select("channel_id"), x.n), "channel_id", "left_semi")
        at = nearest_unsorted(used, cursors, x.n)
        at = settle(at.select("channel_id", "cursor_no", "sample_idx", F.col("sample_idx").alias("lo"), (F.col("sample_idx") + 1).alias("hi")), "cursors")
        n = None if x.n is None else x.n * len(cursors)
        at = pruned(x.points.select("channel_id", "sample_idx", "x"), at, "sample_idx").join(bounded(at.drop("lo", "hi"), n), ["channel_id", "sample_idx"])
        at = at.select(F.col("channel_id").alias("x_channel_id"), "cursor_no", "sample_idx", "x")
        near = near.unionByName(free.join(bounded(at, n), "x_channel_id").select(near.columns))
    near = settle(near, "cursors")
    wanted = near.select("channel_id", F.col("sample_idx").alias("lo"), (F.col("sample_idx") + 1).alias("hi"))
    rows = pruned(samples.select("channel_id", "sample_idx", F.col(value).alias("value")), wanted, "sample_idx")
    n = None if n_channels is None else n_channels * len(cursors)
    return rows.join(bounded(near, n), ["channel_id", "sample_idx"]).select("channel_id", "cursor_no", "sample_idx", "x", "value")


def typed_value(kind: str, v: Column, zero: Column) -> Column:
    """A value as a double for statistics: integers and times relative to the channel's zero, booleans 0 and 1, complex numbers as magnitude."""
    if kind in ("int", "uint64"):
        return (v.cast(WIDE) - zero.cast(WIDE)).cast("double")
    if kind == "time":
        return (v - zero.cast("bigint")) / F.lit(1e9)
    if kind == "bool":
        return v.cast("int").cast("double")
    if kind == "complex":
        return F.hypot(v["re"], v["im"])
    return v.cast("double")


def typed_zero(samples: DataFrame, kind: str) -> DataFrame:
    """channel_id, zero: the first integer or the first valid time of each channel."""
    if kind not in ("int", "uint64", "time"):
        return samples.select("channel_id").distinct().withColumn("zero", F.lit(0).cast("decimal(20,0)"))
    return samples.groupBy("channel_id").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("sample_idx"))).cast("decimal(20,0)").alias("zero"))


def stats_typed(samples: DataFrame, kind: str, ranges: DataFrame | None = None, n_channels: int | None = None) -> DataFrame:
    """Statistics of a channel of any kind: channel_id, kind, n, n_nan, mn, mx, p2p, mean, std, rms, mn_exact, mx_exact.

    samples: channel_id, sample_idx, v in the kind's own type (`family_schema`); ranges: channel_id, i0, i1. 64-bit integers keep their exact
    extremes (mn_exact, mx_exact, else NULL); their mean and RMS have the zero added back. Times are seconds since the first valid one.
    """
    zero = bounded(typed_zero(samples, kind), n_channels)
    inside = samples if ranges is None else clip(samples, ranges, n_channels).drop("i0", "i1")
    rows = inside.join(zero, "channel_id")
    exact = F.col("v").cast("decimal(20,0)") if kind in ("int", "uint64") else F.lit(None).cast("decimal(20,0)")
    rows = rows.select("channel_id", "sample_idx", "zero", exact.alias("exact"), typed_value(kind, F.col("v"), F.col("zero")).alias("v"))
    first = rows.groupBy("channel_id").agg(F.first("zero").alias("zero"), F.min("exact").alias("mn_exact"), F.max("exact").alias("mx_exact"))
    states = with_statistics(raw_states(rows.withColumn("pivot", F.lit(0.0)), ["channel_id"]))
    out = states.join(bounded(first, n_channels), "channel_id")
    shift = F.col("zero").cast("double") if kind in ("int", "uint64") else F.lit(0.0)
    mean = F.col("mean") + shift
    whole = F.col("mn_exact").isNotNull()
    return out.select("channel_id", F.lit(kind).alias("kind"), "n", "n_nan", F.when(whole, F.col("mn_exact").cast("double")).otherwise(F.col("mn")).alias("mn"),
                      F.when(whole, F.col("mx_exact").cast("double")).otherwise(F.col("mx")).alias("mx"), "p2p", mean.alias("mean"), "std",
                      F.when(F.col("rms") == float("inf"), F.col("rms")).when(F.col("n") > 0, F.sqrt(mean * mean + F.col("m2") / F.col("n"))).alias("rms"), "mn_exact", "mx_exact")
