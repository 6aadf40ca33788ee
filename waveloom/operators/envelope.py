"""Min/max envelopes: no drawn bucket hides a spike or a dropout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import present
from ..session import bounded


def clip(samples: DataFrame, ranges: DataFrame, n_channels: int | None = None) -> DataFrame:
    """Samples inside each channel's [i0, i1); ranges carries channel_id, i0, i1 and more columns.

    The overall bounds (one row) become literal filters, so the scan prunes row groups.
    """
    lo, hi = ranges.agg(F.min("i0"), F.max("i1")).first()
    if lo is not None:
        samples = samples.filter((F.col("sample_idx") >= lo) & (F.col("sample_idx") < hi))
    return samples.join(bounded(ranges, n_channels), "channel_id").filter(
        (F.col("sample_idx") >= F.col("i0")) & (F.col("sample_idx") < F.col("i1")))


def bucket_of(idx: str | Column, size: str | Column | int) -> Column:
    idx = F.col(idx) if isinstance(idx, str) else idx
    size = F.col(size) if isinstance(size, str) else size
    size = F.lit(size).cast("bigint") if isinstance(size, int) else size
    return F.call_function("div", idx, size)


def envelope(samples: DataFrame, ranges: DataFrame, n_channels: int | None = None) -> DataFrame:
    """Exact min/max per bucket of [i0, i1), buckets aligned to multiples of b.

    ranges: channel_id, i0, i1, b. The first and last bucket are clipped to the range.
    """
    inside = clip(samples.select("channel_id", "sample_idx", "v"),
                  ranges.select("channel_id", "i0", "i1", "b"), n_channels)
    x = present("v")
    out = inside.groupBy("channel_id", bucket_of("sample_idx", "b").alias("bucket"), "i0", "i1", "b").agg(
        F.count(x).alias("n"), F.count(F.lit(1)).alias("total"), F.min(x).alias("mn"), F.max(x).alias("mx"))
    return finish_envelope(out)


def finish_envelope(buckets: DataFrame) -> DataFrame:
    """Clipped bounds, center and missing flag of counted buckets (bucket, i0, i1, b, n, total, mn, mx)."""
    return buckets.selectExpr("*", "greatest(i0, bucket * b) AS lo", "least(i1, (bucket + 1) * b) AS hi").selectExpr(
        "channel_id", "bucket", "lo", "hi", "(lo + hi) / 2D AS center", "n", "total", "mn", "mx", "n < total AS missing")


def envelope_points(env: DataFrame, *keep: str) -> DataFrame:
    """(center, min), (center, max) per bucket and a NaN break point after a bucket with missing samples."""
    nan = F.lit(float("nan"))

    def point(ordinal: int, y: Column) -> Column:
        return F.struct(F.lit(ordinal).alias("ord"), F.col("center").alias("x_index"), y.alias("y"))

    pair = [point(0, F.coalesce("mn", nan)), point(1, F.coalesce("mx", nan))]
    points = F.when(F.col("missing"), F.array(*pair, point(2, nan))).otherwise(F.array(*pair))
    return env.select("channel_id", "bucket", *keep, F.inline(points))


def xy_decimate(points: DataFrame, spans: DataFrame, max_points: int, n_channels: int | None = None) -> DataFrame:
    """Decimate an X-Y curve: per bucket keep the samples with the smallest and largest y, in index order.

    points: channel_id, sample_idx, x, y. spans: channel_id, s, e. NaN never wins; ties take the
    first index; samples after the last full bucket stay. Channels within max_points stay whole.
    """
    n = F.col("e") - F.col("s")
    step = F.when(n <= max_points, F.lit(0)).otherwise(F.ceil(n / F.lit(max_points // 2)))
    plan = spans.withColumn("step", step.cast("bigint"))
    plan = plan.withColumn("full", F.when(F.col("step") > 0, bucket_of(n, F.greatest("step", F.lit(1))) * F.col("step"))
                           .otherwise(F.lit(0)))
    rows = points.join(bounded(plan, n_channels), "channel_id").filter(
        (F.col("sample_idx") >= F.col("s")) & (F.col("sample_idx") < F.col("e")))
    at = F.col("sample_idx") - F.col("s")
    raw = rows.filter(at >= F.col("full")).select("channel_id", "sample_idx", "x", "y")
    low = F.when(F.isnan("y") | F.col("y").isNull(), F.lit(float("inf"))).otherwise(F.col("y"))
    high = F.when(F.isnan("y") | F.col("y").isNull(), F.lit(float("-inf"))).otherwise(F.col("y"))
    sample = F.struct("sample_idx", "x", "y")
    picked = (
        rows.filter(at < F.col("full"))
        .groupBy("channel_id", bucket_of(at, F.greatest("step", F.lit(1))).alias("bucket"))
        .agg(F.min_by(sample, F.struct(low.alias("k"), "sample_idx")).alias("a"),
             F.min_by(sample, F.struct((-high).alias("k"), "sample_idx")).alias("b"))
        .select("channel_id", F.inline(F.array("a", "b")))
    )
    return picked.unionByName(raw)
