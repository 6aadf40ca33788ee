"""Statistics table, cursor readouts and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_float
from ..operators.axis import inner_range, linear_covers, nearest_linear, x_of, xy_filter
from ..operators.rollup import BASE, range_states
from ..operators.stats import all_channels, raw_states, with_pivot, with_statistics
from ..session import bounded

# Header of the exported statistics table.
STATS_COLUMNS = ["#", "Channel", "Unit", "N", "NaN", "Min", "Max", "Peak-peak", "Mean", "Std dev", "RMS",
                 "C1", "C2", "C2 − C1"]


def stats_range(view: tuple[float, float], cursors: list[float]) -> tuple[float, float]:
    """Between two cursors if both are set, else the view."""
    return (min(cursors), max(cursors)) if len(cursors) == 2 else view


def cursor_values(samples: DataFrame, axes: DataFrame, cursors: list[float], value: str = "v",
                  n_channels: int | None = None) -> DataFrame:
    """(channel_id, cursor_no, sample_idx, x, value) of the sample nearest to each cursor.

    A cursor outside a channel's extent plus half a sample has no row. Only the wanted samples are
    looked up: the key range becomes a scan filter.
    """
    near = linear_covers(nearest_linear(axes, cursors)).filter("covered").select(
        "channel_id", "cursor_no", "sample_idx", x_of("sample_idx").alias("x"))
    lo, hi = near.agg(F.min("sample_idx"), F.max("sample_idx")).first()
    rows = samples.select("channel_id", "sample_idx", F.col(value).alias("value"))
    if lo is not None:
        rows = rows.filter(F.col("sample_idx").between(lo, hi))
    want = None if n_channels is None else n_channels * len(cursors)
    return rows.join(bounded(near, want), ["channel_id", "sample_idx"]).select(
        "channel_id", "cursor_no", "sample_idx", "x", "value")


def cursor_pairs(values: DataFrame) -> DataFrame:
    """One row per channel: c1, c2 and their x."""
    def of(k: int, col: str) -> Column:
        return F.max(F.when(F.col("cursor_no") == k, F.col(col)))

    return values.groupBy("channel_id").agg(
        of(1, "value").alias("c1"), of(2, "value").alias("c2"), of(1, "x").alias("x1"), of(2, "x").alias("x2"))


def cursor_delta(pairs: DataFrame) -> DataFrame:
    """C2 - C1 in the native type: exact for integers; 64-bit differences widen to DECIMAL."""
    kind = dict(pairs.dtypes)["c1"]
    if kind in ("bigint", "decimal(20,0)"):
        wide = "decimal(21,0)"
        diff = F.col("c2").cast(wide) - F.col("c1").cast(wide)
    else:
        diff = F.col("c2") - F.col("c1")
    dx = F.col("x2") - F.col("x1")
    return pairs.withColumn("delta", diff).withColumn("dx", dx).withColumn("inv_dx", F.try_divide(F.lit(1.0), dx))


def time_delta_s(c1_ns: str, c2_ns: str) -> Column:
    """C2 - C1 of timestamps in seconds, from integer nanoseconds."""
    return (F.col(c2_ns) - F.col(c1_ns)) / F.lit(1e9)


def stats_table(samples: DataFrame, buckets: DataFrame | None, channels: DataFrame, axes: DataFrame,
                view: tuple[float, float], cursors: list[float], base: int = BASE, n_channels: int | None = None) -> DataFrame:
    """Statistics of each channel in the view or between the cursors, with the cursor values.

    channels: channel_id, length, pivot, label, unit, kind. Channels that are not plottable have no axis row and are skipped.
    """
    xa, xb = stats_range(view, cursors)
    ranges = inner_range(axes, xa, xb).select("channel_id", "i0", "i1")
    if buckets is not None:
        states = range_states(samples, buckets, channels, ranges, base, n_channels)
    else:
        from ..operators.envelope import clip
        inside = clip(samples.select("channel_id", "sample_idx", "v"), ranges, n_channels)
        states = raw_states(with_pivot(inside, channels, n_channels), ["channel_id"])
    mapped = channels.join(bounded(axes.select("channel_id"), n_channels), "channel_id", "left_semi")
    out = with_statistics(all_channels(states, mapped, n_channels))
    pairs = cursor_delta(cursor_pairs(cursor_values(samples, axes, cursors, n_channels=n_channels))) if cursors else None
    out = mapped.select("channel_id", "label", "unit").join(out, "channel_id")
    if pairs is not None:
        out = out.join(bounded(pairs.select("channel_id", "c1", "c2", F.col("delta").alias("c2_c1")), n_channels), "channel_id", "left")
    return out.drop("pv", "dl", "m2", "total")


def xy_stats(points: DataFrame, channels: DataFrame, xa: float, xb: float, n_channels: int | None = None) -> DataFrame:
    """Statistics of the samples of an X-Y curve with x in [xa, xb], in any order."""
    inside = xy_filter(points, xa, xb).withColumn("v", F.col("y"))
    states = raw_states(with_pivot(inside, channels, n_channels), ["channel_id"])
    return with_statistics(all_channels(states, channels, n_channels))


def cursor_row(axes: DataFrame, x: float, start: int) -> DataFrame:
    """Table row of a cursor: nearest sample of the first mapped channel that has samples, minus the start index.

    axes: channel_no (file order), channel_id, x0, dx, s, e.
    """
    first = axes.filter(F.col("e") > F.col("s")).orderBy("channel_no").limit(1)
    return nearest_linear(first, [x]).select("channel_id", "sample_idx", (F.col("sample_idx") - start).alias("row"))


def stats_text(table: DataFrame, number: str = "channel_no") -> DataFrame:
    """The statistics table as exact text columns under the exported header.

    number: column with the position of the channel in the selection.
    """
    cells = [F.format_string("%02d", number), F.col("label"), F.col("unit"), F.col("n").cast("string"), F.col("n_nan").cast("string")]
    cells += [F.coalesce(format_float(c), F.lit("")) for c in ("mn", "mx", "p2p", "mean", "std", "rms", "c1", "c2", "c2_c1")]
    return table.select(*[c.alias(h) for c, h in zip(cells, STATS_COLUMNS)])
