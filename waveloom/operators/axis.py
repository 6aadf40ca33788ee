"""X axes: sample index to x, ranges in x, nearest samples and coverage.

A linear axis is x = x0 + idx * dx. An X channel is another channel whose value at the same
sample_idx is x. Every decision in x uses the same floating-point formula as the plotted x.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import INF, finite
from ..session import bounded, hash_parts
from .envelope import bucket_of

ORDER_BLOCK = 1 << 20  # samples per block of the two-level order check
_FAR = 9.0e18  # clamp before a cast to BIGINT


def safe_step(dx: str | Column) -> Column:
    """The increment if it is finite and positive, else 1 s per sample."""
    dx = F.col(dx) if isinstance(dx, str) else dx
    return F.when(finite(dx) & (dx > 0), dx).otherwise(F.lit(1.0))


def linear_axis(channels: DataFrame) -> DataFrame:
    """Add x0 and dx of the waveform axis: x0 = offset + start - reference (integer ns)."""
    from .catalog import start_seconds
    return start_seconds(channels).withColumn("x0", F.col("start_s")).withColumn("dx", safe_step("wf_increment"))


def x_of(idx: str | Column) -> Column:
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.col("x0") + idx.cast("double") * F.col("dx")


def with_x(samples: DataFrame, axes: DataFrame, n_channels: int | None = None) -> DataFrame:
    """Attach x of a linear axis (axes: channel_id, x0, dx) to the samples."""
    axes = axes.select("channel_id", "x0", "dx")
    return samples.join(bounded(axes, n_channels), "channel_id").withColumn("x", x_of("sample_idx"))


def view_range(axes: DataFrame, xa: float, xb: float) -> DataFrame:
    """Sample range [i0, i1) that covers x in [xa, xb] plus one sample each side.

    axes: channel_id, x0, dx, s, e. A bound that is not finite gives the whole range.
    """
    out = _fractions(axes, xa, xb)
    known = "abs(_fa) < double('Infinity') AND abs(_fb) < double('Infinity')"
    return out.selectExpr(
        *axes.columns,
        f"CASE WHEN e <= s OR NOT ({known}) THEN s ELSE greatest(s, least(e, floor({_near('_fa')}) - 1)) END AS i0",
        f"CASE WHEN e <= s THEN s WHEN NOT ({known}) THEN e ELSE greatest(s, least(e, ceil({_near('_fb')}) + 2)) END AS i1")


def _near(f: str) -> str:
    """A fractional index limited to what a BIGINT can hold."""
    return f"greatest(least({f}, {_FAR}D), -{_FAR}D)"


def _plain(x: float) -> bool:
    return x == x and abs(x) != INF


def _clamped(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(_FAR)), F.lit(-_FAR))


def inner_range(axes: DataFrame, xa: float, xb: float) -> DataFrame:
    """Samples [i0, i1) with xa <= x0 + i * dx <= xb, exact in the formula of the axis.

    Bisection with the x formula itself (x never decreases with i): 64 halvings settle any BIGINT range.
    """
    out = _fractions(axes, xa, xb)
    known = "abs(_fa) < double('Infinity') AND abs(_fb) < double('Infinity')"
    if not (_plain(xa) and _plain(xb)):
        return out.selectExpr(*axes.columns, "s AS i0", "greatest(s, e) AS i1")

    def first_where(x: float, op: str) -> str:
        mid = "(a.lo + shiftright(a.hi - a.lo, 1))"
        return f"""aggregate(sequence(1, 64), named_struct('lo', bigint(s), 'hi', bigint(e)), (a, k) -> CASE WHEN a.lo >= a.hi THEN a
            WHEN x0 + double({mid}) * dx {op} {float(x)!r}D THEN named_struct('lo', a.lo, 'hi', {mid})
            ELSE named_struct('lo', {mid} + 1, 'hi', a.hi) END, a -> a.lo)"""

    out = out.selectExpr(
        *axes.columns, f"CASE WHEN e <= s OR NOT ({known}) THEN s ELSE {first_where(xa, '>=')} END AS i0",
        f"CASE WHEN e <= s THEN s WHEN NOT ({known}) THEN e ELSE {first_where(xb, '>')} END AS _i1")
    return out.selectExpr(*axes.columns, "i0", "greatest(i0, _i1) AS i1")


def _fractions(axes: DataFrame, xa: float, xb: float) -> DataFrame:
    """Add the fractional indexes _fa and _fb of a range (NaN if a bound is not finite)."""
    if _plain(xa) and _plain(xb):
        return axes.selectExpr("*", f"({float(xa)!r}D - x0) / dx AS _fa", f"({float(xb)!r}D - x0) / dx AS _fb")
    return axes.selectExpr("*", "double('NaN') AS _fa", "double('NaN') AS _fb")


def xy_align(samples: DataFrame, pairs: DataFrame, n_pairs: int | None = None) -> DataFrame:
    """Pair y with an X channel by sample position, only where both have the same length.

    pairs: channel_id, x_channel_id, y_length, x_length. One equi-join on (X channel, sample_idx),
    which spreads a hot channel by its samples; the partitions grow with the declared lengths.
    """
    same = pairs.filter("y_length = x_length").select("channel_id", "x_channel_id", "y_length")
    rows = 2 * (same.agg(F.sum("y_length")).first()[0] or 0)
    same = same.drop("y_length")
    y = samples.select("channel_id", "sample_idx", F.col("v").alias("y")).join(bounded(same, n_pairs), "channel_id")
    x = samples.select(F.col("channel_id").alias("x_channel_id"), "sample_idx", F.col("v").alias("x"))
    x = x.join(bounded(same.select("x_channel_id").distinct(), n_pairs), "x_channel_id", "left_semi")
    y, x = (hash_parts(side, rows, "x_channel_id", "sample_idx") for side in (y, x))
    return y.join(x, ["x_channel_id", "sample_idx"]).select("channel_id", "x_channel_id", "sample_idx", "x", "y")


def xy_filter(points: DataFrame, xa: float, xb: float) -> DataFrame:
    """Points of an X-Y curve with xa <= x <= xb, in any order (NaN x is outside)."""
    return points.filter(~F.isnan("x") & F.col("x").between(xa, xb))


def sorted_range(points: DataFrame, xa: float, xb: float) -> DataFrame:
    """Index ranges of a non-decreasing X channel, per channel.

    [i0, i1): samples with xa <= x <= xb. [v0, v1): the same plus one sample each side. Both are
    counts of smaller values, so one partially aggregated pass is enough.
    """
    out = points.groupBy("channel_id").agg(
        F.min("sample_idx").alias("s"), (F.max("sample_idx") + 1).alias("e"),
        F.count_if(F.col("x") < xa).alias("below"), F.count_if(F.col("x") <= xb).alias("upto"))
    i0, i1 = F.col("s") + F.col("below"), F.col("s") + F.col("upto")
    return out.select(
        "channel_id", i0.alias("i0"), F.greatest(i0, i1).alias("i1"),
        F.greatest(F.col("s"), i0 - 1).alias("v0"), F.least(F.col("e"), i1 + 1).alias("v1"))


def is_monotonic(points: DataFrame) -> DataFrame:
    """Per channel: all x finite and non-decreasing.

    Two levels: order inside blocks of ORDER_BLOCK samples, then over the (few) blocks. No window
    covers a whole channel of samples.
    """
    block = points.withColumn("block", bucket_of("sample_idx", ORDER_BLOCK))
    inner = Window.partitionBy("channel_id", "block").orderBy("sample_idx")
    step = block.withColumn("_prev", F.lag("x").over(inner))
    good = finite("x") & (F.col("_prev").isNull() | (F.col("x") >= F.col("_prev")))
    blocks = step.groupBy("channel_id", "block").agg(
        F.bool_and(good).alias("ok"), F.min_by("x", "sample_idx").alias("first"), F.max_by("x", "sample_idx").alias("last"))
    outer = Window.partitionBy("channel_id").orderBy("block")
    joined = blocks.withColumn("_last", F.lag("last").over(outer))
    fine = F.col("ok") & (F.col("_last").isNull() | (F.col("first") >= F.col("_last")))
    return joined.groupBy("channel_id").agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("monotonic"))


def at_cursors(axes: DataFrame, cursors: list[float]) -> DataFrame:
    """One row per channel and cursor: cursor_no (1-based), cx."""
    marks = F.array(*[F.struct(F.lit(i + 1).alias("cursor_no"), F.lit(float(c)).alias("cx"))
                      for i, c in enumerate(cursors)])
    return axes.select("*", F.inline(marks))


def nearest_linear(axes: DataFrame, cursors: list[float]) -> DataFrame:
    """Nearest sample of each cursor: round((x - x0) / dx), half to even, clamped. NULL if empty.

    axes: channel_id, x0, dx, s, e.
    """
    at = F.rint(_clamped((F.col("cx") - F.col("x0")) / F.col("dx"))).cast("bigint")
    idx = F.when(F.col("e") > F.col("s"), F.least(F.col("e") - 1, F.greatest(F.col("s"), at)))
    return at_cursors(axes, cursors).withColumn("sample_idx", idx)


def linear_covers(at: DataFrame) -> DataFrame:
    """Keep the cursors inside a linear channel's extent plus half a sample."""
    half = F.lit(0.5) * F.col("dx")
    return at.withColumn("covered", (F.col("e") > F.col("s"))
                         & (x_of("s") - half <= F.col("cx")) & (F.col("cx") <= x_of(F.col("e") - 1) + half))


def nearest_sorted(points: DataFrame, cursors: list[float]) -> DataFrame:
    """Nearest sample in a non-decreasing X channel: (channel_id, cursor_no, cx, sample_idx, x, covered).

    The neighbours of q are the largest x below q and the smallest x at or above q; their indexes
    are counts of the values below q. A tie takes the lower side. All buffers are primitive.
    """
    aggs = [F.min("sample_idx").alias("s"), (F.max("sample_idx") + 1).alias("e"), F.min("x").alias("x_first"),
            F.max("x").alias("x_last")]
    for i, q in enumerate(cursors):
        aggs += [F.count_if(F.col("x") < q).alias(f"n{i}"),
                 F.max(F.when(F.col("x") < q, F.col("x"))).alias(f"lo{i}"),
                 F.min(F.when(F.col("x") >= q, F.col("x"))).alias(f"hi{i}")]
    wide = points.groupBy("channel_id").agg(*aggs)
    marks = F.array(*[F.struct(F.lit(i + 1).alias("cursor_no"), F.lit(float(q)).alias("cx"), F.col(f"n{i}").alias("below"),
                               F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, q in enumerate(cursors)])
    rows = wide.select("channel_id", "s", "e", "x_first", "x_last", F.inline(marks))
    take_low = F.col("lo").isNotNull() & (
        F.col("hi").isNull() | (F.abs(F.col("lo") - F.col("cx")) <= F.abs(F.col("hi") - F.col("cx"))))
    at = F.col("s") + F.col("below")
    return rows.select("channel_id", "cursor_no", "cx", "s", "e", F.when(take_low, at - 1).otherwise(at).alias("sample_idx"),
                       F.when(take_low, F.col("lo")).otherwise(F.col("hi")).alias("x"), "x_first", "x_last")


def sorted_covers(points: DataFrame, near: DataFrame, n_channels: int | None = None) -> DataFrame:
    """Add `covered`: the cursor is inside the X channel plus half of its first / last spacing."""
    ends = near.select("channel_id", "s", "e").distinct()
    edge = points.join(bounded(ends, n_channels), "channel_id").filter(
        (F.col("sample_idx") == F.col("s") + 1) | (F.col("sample_idx") == F.col("e") - 2))
    inner = edge.groupBy("channel_id").agg(
        F.max(F.when(F.col("sample_idx") == F.col("s") + 1, F.col("x"))).alias("x_second"),
        F.max(F.when(F.col("sample_idx") == F.col("e") - 2, F.col("x"))).alias("x_before"))
    half0 = F.coalesce(F.lit(0.5) * (F.col("x_second") - F.col("x_first")), F.lit(0.0))
    half1 = F.coalesce(F.lit(0.5) * (F.col("x_last") - F.col("x_before")), F.lit(0.0))
    joined = near.join(bounded(inner, n_channels), "channel_id", "left")
    return joined.withColumn("covered", (F.col("x_first") - half0 <= F.col("cx")) & (F.col("cx") <= F.col("x_last") + half1)) \
        .drop("x_second", "x_before")


def nearest_unsorted(points: DataFrame, cursors: list[float], n_channels: int | None = None) -> DataFrame:
    """Nearest sample in an X channel of any order: smallest |x - q|, lowest index, NaN ignored."""
    def gap(q: float) -> Column:
        return F.when(~F.isnan("x"), F.abs(F.col("x") - F.lit(float(q))))

    best = points.groupBy("channel_id").agg(
        F.bool_or(finite("x")).alias("_any"), *[F.min(gap(q)).alias(f"d{i}") for i, q in enumerate(cursors)])
    rows = points.join(bounded(best.filter("_any"), n_channels), "channel_id")
    hits = rows.groupBy("channel_id").agg(
        *[F.min(F.when(gap(q) == F.col(f"d{i}"), F.col("sample_idx"))).alias(f"i{i}") for i, q in enumerate(cursors)])
    marks = F.array(*[F.struct(F.lit(i + 1).alias("cursor_no"), F.lit(float(q)).alias("cx"),
                               F.col(f"i{i}").alias("sample_idx")) for i, q in enumerate(cursors)])
    return hits.select("channel_id", F.inline(marks))


def linear_extent(axes: DataFrame) -> DataFrame:
    """Overall (x_min, x_max) of linear channels: catalog only, no sample is read."""
    some = axes.filter(F.col("e") > F.col("s")).select(x_of("s").alias("a"), x_of(F.col("e") - 1).alias("b"))
    fine = some.filter(finite("a") & finite("b"))
    return fine.agg(F.min(F.least("a", "b")).alias("x_min"), F.max(F.greatest("a", "b")).alias("x_max"))


def points_extent(points: DataFrame) -> DataFrame:
    """Overall (x_min, x_max) of the finite values of X channels."""
    x = F.when(finite("x"), F.col("x"))
    return points.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"))


def interpolate_x(requests: DataFrame, points: DataFrame, n_requests: int | None = None) -> DataFrame:
    """x at a fractional index: linear between neighbours, clamped at the ends.

    A known, small number of requests (the bucket centers of a plot) is broadcast to the points.

    requests: channel_id, at (fractional index), n (length of the X channel). A whole index takes
    the stored value itself, even next to NaN or Inf.
    """
    whole = F.least(F.greatest(F.floor("at"), F.lit(0)), F.col("n") - 1)
    want = requests.withColumn("_i", whole).withColumn("_j", F.least(F.col("_i") + 1, F.col("n") - 1))
    want = want.withColumn("_f", F.greatest(F.least(F.col("at") - F.col("_i"), F.lit(1.0)), F.lit(0.0)))
    left = points.select("channel_id", F.col("sample_idx").alias("_i"), F.col("x").alias("_xi"))
    right = points.select("channel_id", F.col("sample_idx").alias("_j"), F.col("x").alias("_xj"))
    if n_requests is not None:
        left = left.join(bounded(want.select("channel_id", "_i").distinct(), n_requests), ["channel_id", "_i"], "left_semi")
        right = right.join(bounded(want.select("channel_id", "_j").distinct(), n_requests), ["channel_id", "_j"], "left_semi")
    both = want.join(left, ["channel_id", "_i"], "left").join(right, ["channel_id", "_j"], "left")
    x = F.when(F.col("_f") > 0, F.col("_xi") + F.col("_f") * (F.col("_xj") - F.col("_xi"))).otherwise(F.col("_xi"))
    return both.withColumn("x", x).drop("_i", "_j", "_f", "_xi", "_xj")


def auto_y(samples: DataFrame, axes: DataFrame, xa: float, xb: float, n_channels: int | None = None) -> DataFrame:
    """(y_min, y_max) over all channels inside the x view; one row, NULLs if it is not finite.

    A view with fewer than two samples of a channel uses the neighbours of the view.
    """
    from .envelope import clip
    r = inner_range(axes, xa, xb)
    thin = F.col("i1") - F.col("i0") < 2
    r = r.select("channel_id", F.when(thin, F.greatest(F.col("s"), F.col("i0") - 1)).otherwise(F.col("i0")).alias("i0"),
                 F.when(thin, F.least(F.col("e"), F.col("i1") + 1)).otherwise(F.col("i1")).alias("i1"))
    y = F.when(~F.isnan("v"), F.col("v"))
    one = clip(samples.select("channel_id", "sample_idx", "v"), r, n_channels).agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    fine = finite("lo") & finite("hi")
    return one.select(F.when(fine, F.col("lo")).alias("y_min"), F.when(fine, F.col("hi")).alias("y_max"))


def clamp_inf(samples: DataFrame, n_channels: int | None = None) -> DataFrame:
    """Replace +/-Inf by the finite edge of the channel plus 8 % and flag it (1, -1, 0)."""
    y = F.when(finite("v"), F.col("v"))
    edge = samples.groupBy("channel_id").agg(
        F.coalesce(F.min(y), F.lit(0.0)).alias("_lo"), F.coalesce(F.max(y), F.lit(1.0)).alias("_hi"))
    pad = F.lit(0.08) * (F.col("_hi") - F.col("_lo"))
    pad = F.when(pad != 0, pad).otherwise(F.lit(0.08) * F.greatest(F.abs("_hi"), F.lit(1.0)))
    mark = F.when(F.col("v") == INF, 1).when(F.col("v") == -INF, -1).otherwise(0)
    rows = samples.join(bounded(edge, n_channels), "channel_id")
    return rows.withColumn("inf_mark", mark).withColumn(
        "y", F.when(F.col("v") == INF, F.col("_hi") + pad).when(F.col("v") == -INF, F.col("_lo") - pad).otherwise(F.col("v"))
    ).drop("_lo", "_hi")
