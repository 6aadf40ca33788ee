"""Plot views: which samples, buckets or rollup level draw a channel in a window of pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import floor_pow2
from ..operators.axis import is_monotonic, view_range, x_of, xy_align
from ..operators.envelope import clip, envelope, envelope_points, xy_decimate
from ..operators.rollup import BASE, rollup_envelope
from ..session import bounded

MIN_PIXELS = 16


def fetch_window(xa: float, xb: float, pixels: float, margin: float = 0.25) -> tuple[float, float, int]:
    """View plus a margin on each side, and its width in pixels (at least 64 before the margin)."""
    w = xb - xa
    return xa - margin * w, xb + margin * w, int(max(64.0, pixels) * (1 + 2 * margin))


def plot_plan(axes: DataFrame, xa: float, xb: float, pixels: int, base: int = BASE) -> DataFrame:
    """Per channel: i0, i1, bucket size b and mode (none, raw, envelope, rollup).

    axes: channel_id, x0, dx, s, e.
    """
    px = max(MIN_PIXELS, int(pixels))
    n = F.col("i1") - F.col("i0")
    plan = view_range(axes, xa, xb).withColumn("b", floor_pow2(n / F.lit(float(px))))
    mode = F.when(n <= 0, "none").when(n <= 2 * px, "raw").when(F.col("b") >= base, "rollup").otherwise("envelope")
    return plan.withColumn("mode", mode)


def plot_view(samples: DataFrame, buckets: DataFrame | None, channels: DataFrame, axes: DataFrame, xa: float, xb: float,
              pixels: int, base: int = BASE, n_channels: int | None = None) -> DataFrame:
    """Points to draw: channel_id, bucket, ord, x, y; NaN y breaks the line after a dropout.

    At most two points (and a break) per pixel and channel leave the cluster; every spike is kept.
    Without a rollup all decimated channels read raw samples.
    """
    plan = plot_plan(axes, xa, xb, pixels, base)
    if buckets is None:
        plan = plan.withColumn("mode", F.when(F.col("mode") == "rollup", "envelope").otherwise(F.col("mode")))
    plan = plan.select("channel_id", "x0", "dx", "i0", "i1", "b", "mode")
    modes = {row[0] for row in plan.select("mode").distinct().collect()}  # four values at most
    parts = []
    if "raw" in modes:
        rows = clip(samples.select("channel_id", "sample_idx", "v"), plan.filter("mode = 'raw'"), n_channels)
        parts.append(rows.select("channel_id", F.col("sample_idx").alias("bucket"), F.lit(0).alias("ord"),
                                 F.col("sample_idx").cast("double").alias("x_index"), F.col("v").alias("y")))
    if "envelope" in modes:
        parts.append(envelope_points(envelope(samples, plan.filter("mode = 'envelope'"), n_channels)))
    if "rollup" in modes:
        env = rollup_envelope(samples, buckets, channels, plan.filter("mode = 'rollup'"), base, n_channels)
        parts.append(envelope_points(env))
    if not parts:
        return plan.filter("false").select("channel_id", F.col("i0").alias("bucket"), F.lit(0).alias("ord"),
                                           F.col("x0").alias("x"), F.col("x0").alias("y"))
    points = reduce(DataFrame.unionByName, parts)
    return points.join(bounded(plan.select("channel_id", "x0", "dx"), n_channels), "channel_id").select(
        "channel_id", "bucket", "ord", x_of("x_index").alias("x"), "y")


def xy_plot(samples: DataFrame, pairs: DataFrame, n_curves: int, max_points: int) -> DataFrame:
    """X-Y curves over the full range: aligned by position, then decimated to ``max_points`` per curve (chosen by the caller)."""
    points = xy_align(samples, pairs, n_curves)
    spans = pairs.filter("y_length = x_length").select("channel_id", F.lit(0).cast("bigint").alias("s"), F.col("y_length").alias("e"))
    return xy_decimate(points, spans, max_points, n_curves)


def sorted_curves(points: DataFrame) -> DataFrame:
    """Channels whose X channel allows view decimation (monotonic x)."""
    return is_monotonic(points).filter("monotonic").select("channel_id")
