"""X axes, ranges, nearest samples and X-Y curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import floor_pow2 as pow2
from ..operators import axis as ax
from ..operators import envelope as env
from ..operators import lookup
from ..operators.rollup import build_rollup
from ..plans import plot, readout
from ..session import bounded, new_path, settle
from ..sources.store import measure_channels
from .base import A, C, L, LC, S, axes_of, event_store, lineitem_store, moments, rnd, rnd_sql
from .stats import _STATS_SELECT, _stats_cols

QUERIES: dict = {}
XA, XB = 433.375, 1.0e6  # view: starts inside every channel, ends after all of them
CURSORS = [300.1, 905.3]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


def time_points(samples):
    """Event channels with their time (s since 2024-01-01) as X channel."""
    return samples.select("channel_id", "sample_idx", ((F.col("t_us") - 1704067200000000) / F.lit(1e6)).alias("x"),
                          F.col("v").alias("y"))


P = "P AS (SELECT channel_id, sample_idx, (t_us - 1704067200000000) / 1e6 AS x, v AS y FROM S)"
TA, TB = 100000.5, 2400000.25
T_CURSORS = [5.0, 1234567.8, 2600000.0]


@query("x_linear", f"""WITH {S}, {C}, {A} SELECT S.channel_id, sample_idx, x0 + sample_idx * dx AS x
  FROM S JOIN A ON S.channel_id = A.channel_id""")
def x_linear(spark, sf_dir):
    s = event_store(spark, sf_dir)
    return ax.with_x(s.samples, axes_of(s), s.n_channels).select("channel_id", "sample_idx", "x")


@query("view_range", f"""WITH {S}, {C}, {A} SELECT channel_id,
    greatest(s, least(e, floor(({XA} - x0) / dx)::BIGINT - 1)) AS i0,
    greatest(s, least(e, ceil(({XB} - x0) / dx)::BIGINT + 2)) AS i1 FROM A""")
def view_range(spark, sf_dir):
    s = event_store(spark, sf_dir)
    return ax.view_range(axes_of(s), XA, XB).select("channel_id", "i0", "i1")


@query("inner_range", f"""WITH {S}, {C}, {A} SELECT S.channel_id, min(sample_idx) AS i0, max(sample_idx) + 1 AS i1
  FROM S JOIN A ON S.channel_id = A.channel_id WHERE x0 + sample_idx * dx BETWEEN {XA} AND {XB} GROUP BY S.channel_id""")
def inner_range(spark, sf_dir):
    s = event_store(spark, sf_dir)
    return ax.inner_range(axes_of(s), XA, XB).filter("i1 > i0").select("channel_id", "i0", "i1")


def xy_pairs(spark, sf_dir):
    """Long-form samples with one X channel (price) and y channels of the same or another length.

    Price and quantity of a line-item channel have the same length; the prices of the first channel
    are offered as X to the next channels, which fail on length.
    """
    s = lineitem_store(spark, sf_dir)
    both = s.samples.select(F.concat("channel_id", F.lit("/price")).alias("channel_id"), "sample_idx", "v").unionByName(
        s.samples.select(F.concat("channel_id", F.lit("/qty")).alias("channel_id"), "sample_idx", F.col("q").alias("v")))
    own = s.channels.select(F.concat("channel_id", F.lit("/qty")).alias("channel_id"),
                            F.concat("channel_id", F.lit("/price")).alias("x_channel_id"),
                            F.col("length").alias("y_length"), F.col("length").alias("x_length"))
    other = s.channels.filter("channel_id = 'AF'").select(F.col("length").alias("x_length"))
    wrong = s.channels.filter("channel_id <> 'AF'").select(
        F.concat("channel_id", F.lit("/price")).alias("channel_id"), F.lit("AF/price").alias("x_channel_id"),
        F.col("length").alias("y_length"), F.lit(other.first()[0]).alias("x_length"))
    return both, own.unionByName(wrong), 2 * s.n_channels


@query("xy_align", f"""WITH {L}, {LC}, Y AS (SELECT channel_id || '/qty' AS channel_id, channel_id || '/price' AS x_channel_id,
    sample_idx, v AS x, q AS y FROM L UNION ALL
    SELECT b.channel_id || '/price', 'AF/price', b.sample_idx, a.v, b.v FROM L a JOIN L b ON a.sample_idx = b.sample_idx
    JOIN LC ca ON ca.channel_id = a.channel_id JOIN LC cb ON cb.channel_id = b.channel_id
    WHERE a.channel_id = 'AF' AND b.channel_id <> 'AF' AND ca.length = cb.length)
  SELECT channel_id, x_channel_id, sample_idx, x, y FROM Y""")
def xy_align(spark, sf_dir):
    both, pairs, n = xy_pairs(spark, sf_dir)
    return ax.xy_align(both, pairs, n)


_XARR_RANGE = f"""WITH {S}, {P}, N AS (SELECT channel_id, count(*) AS e, count(*) FILTER (WHERE x < {TA}) AS i0,
    count(*) FILTER (WHERE x <= {TB}) AS i1 FROM P GROUP BY channel_id)
  SELECT channel_id, i0, greatest(i0, i1) AS i1, greatest(0, i0 - 1) AS v0, least(e, i1 + 1) AS v1 FROM N"""


@query("xarr_range", _XARR_RANGE)
def xarr_range(spark, sf_dir):
    return ax.sorted_range(time_points(event_store(spark, sf_dir).samples), TA, TB)


TIME_BASE = 16
_TIME_ROLLUPS: dict = {}


def time_rollup(spark, sf_dir):
    """Points, rollup and catalog of the event channels' times, the rollup and catalog stored once."""
    s = event_store(spark, sf_dir)
    points = time_points(s.samples)
    if s.path not in _TIME_ROLLUPS:
        x = points.select("channel_id", "sample_idx", F.col("x").alias("v"))
        channels = settle(measure_channels(x), "time-channels")
        _TIME_ROLLUPS[s.path] = (build_rollup(spark, x, channels, new_path(spark, "time-buckets"), TIME_BASE, s.n_channels), channels)
    return points, *_TIME_ROLLUPS[s.path], s.n_channels


@query("xarr_range_rollup", _XARR_RANGE)
def xarr_range_rollup(spark, sf_dir):
    """The same ranges by descent through the rollup of the X channel."""
    points, buckets, channels, n = time_rollup(spark, sf_dir)
    return lookup.sorted_range_rollup(points, buckets, channels, TA, TB, TIME_BASE, n)


@query("xy_filter", f"WITH {L} SELECT channel_id, sample_idx, v AS x, q AS y FROM L WHERE v BETWEEN 20000.5 AND 70000.0")
def xy_filter(spark, sf_dir):
    return ax.xy_filter(_price_points(lineitem_store(spark, sf_dir)), 20000.5, 70000.0)


def _price_points(s):
    return s.samples.select("channel_id", "sample_idx", F.col("v").alias("x"), F.col("q").alias("y"))


@query("is_monotonic", f"""WITH {S}, X AS (SELECT channel_id || '/t' AS channel_id, sample_idx, t_us::DOUBLE AS x FROM S
    UNION ALL SELECT channel_id || '/v', sample_idx, v FROM S
    UNION ALL SELECT channel_id || '/i', sample_idx, CASE WHEN sample_idx = 1000 THEN 'nan'::DOUBLE ELSE sample_idx END FROM S),
  D AS (SELECT channel_id, isfinite(x) AND coalesce(x >= lag(x) OVER (PARTITION BY channel_id ORDER BY sample_idx), true) AS ok FROM X)
  SELECT channel_id, bool_and(ok) AS monotonic FROM D GROUP BY channel_id""")
def is_monotonic(spark, sf_dir):
    s = event_store(spark, sf_dir).samples

    def ch(suffix, x):
        return s.select(F.concat("channel_id", F.lit(suffix)).alias("channel_id"), "sample_idx", x.alias("x"))

    holes = F.when(F.col("sample_idx") == 1000, F.lit(float("nan"))).otherwise(F.col("sample_idx").cast("double"))
    return ax.is_monotonic(ch("/t", F.col("t_us").cast("double")).unionByName(ch("/v", F.col("v"))).unionByName(ch("/i", holes)))


_CUR = "U AS (SELECT unnest([1, 2]) AS cursor_no, unnest([" + ", ".join(f"{c}::DOUBLE" for c in CURSORS) + "]) AS cx)"


@query("nearest_linear", f"""WITH {S}, {C}, {A}, {_CUR}, D AS (SELECT S.channel_id, cursor_no, cx, sample_idx,
    row_number() OVER (PARTITION BY S.channel_id, cursor_no ORDER BY abs(sample_idx - (cx - x0) / dx), sample_idx % 2) AS rk
    FROM S JOIN A ON S.channel_id = A.channel_id, U)
  SELECT channel_id, cursor_no, cx, sample_idx FROM D WHERE rk = 1""")
def nearest_linear(spark, sf_dir):
    s = event_store(spark, sf_dir)
    return ax.nearest_linear(axes_of(s), CURSORS).select("channel_id", "cursor_no", "cx", "sample_idx")


_TCUR = "U AS (SELECT unnest([1, 2, 3]) AS cursor_no, unnest([" + ", ".join(f"{c}::DOUBLE" for c in T_CURSORS) + "]) AS cx)"


@query("nearest_xarr", f"""WITH {S}, {P}, {_TCUR}, D AS (SELECT channel_id, cursor_no, cx, sample_idx, x,
    row_number() OVER (PARTITION BY channel_id, cursor_no ORDER BY abs(x - cx), x >= cx, CASE WHEN x < cx THEN -sample_idx ELSE sample_idx END) AS rk
    FROM P, U)
  SELECT 'sorted' AS kind, channel_id, cursor_no, cx, sample_idx, x FROM D WHERE rk = 1
  UNION ALL SELECT 'any', channel_id, cursor_no, cx, sample_idx, x FROM (SELECT channel_id, cursor_no, cx, sample_idx, v AS x,
    row_number() OVER (PARTITION BY channel_id, cursor_no ORDER BY abs(v - cx), sample_idx) AS rk
    FROM S, (SELECT unnest([1, 2, 3]) AS cursor_no, unnest([50.005, 12.5, 1e9]) AS cx) V) WHERE rk = 1""")
def nearest_xarr(spark, sf_dir):
    s = event_store(spark, sf_dir)
    near = ax.nearest_sorted(time_points(s.samples), T_CURSORS).select(
        F.lit("sorted").alias("kind"), "channel_id", "cursor_no", "cx", "sample_idx", "x")
    free = s.samples.select("channel_id", "sample_idx", F.col("v").alias("x"))
    other = ax.nearest_unsorted(free, [50.005, 12.5, 1e9], s.n_channels)
    other = free.join(bounded(other, 3 * s.n_channels), ["channel_id", "sample_idx"])
    return near.unionByName(other.select(F.lit("any").alias("kind"), "channel_id", "cursor_no", "cx", "sample_idx", "x"))


@query("nearest_xarr_rollup", f"""WITH {S}, {P}, {_TCUR}, D AS (SELECT channel_id, cursor_no, cx, sample_idx, x,
    row_number() OVER (PARTITION BY channel_id, cursor_no ORDER BY abs(x - cx), x >= cx, CASE WHEN x < cx THEN -sample_idx ELSE sample_idx END) AS rk
    FROM P, U) SELECT channel_id, cursor_no, cx, sample_idx, x FROM D WHERE rk = 1""")
def nearest_xarr_rollup(spark, sf_dir):
    """Nearest samples by descent through the rollup of the X channel."""
    points, buckets, channels, n = time_rollup(spark, sf_dir)
    near = lookup.nearest_sorted_rollup(points, buckets, channels, T_CURSORS, TIME_BASE, n)
    return near.select("channel_id", "cursor_no", "cx", "sample_idx", "x")


@query("covers", f"""WITH {S}, {C}, {A}, {P}, {_TCUR}, V AS (SELECT unnest([1, 2, 3]) AS cursor_no, unnest([2.3::DOUBLE, 700.0, 1e7]) AS cx),
  O AS (SELECT channel_id, count(*) AS n, min(x) AS lo, max(x) AS hi, max(x) FILTER (WHERE sample_idx = 1) AS x1 FROM P GROUP BY channel_id),
  O2 AS (SELECT O.*, P.x AS x2 FROM O JOIN P ON P.channel_id = O.channel_id AND P.sample_idx = O.n - 2)
  SELECT 'linear' AS kind, channel_id, cursor_no, cx, x0 - 0.5 * dx <= cx AND cx <= x0 + (e - 1) * dx + 0.5 * dx AS covered FROM A, V
  UNION ALL SELECT 'sorted', channel_id, cursor_no, cx, lo - 0.5 * (x1 - lo) <= cx AND cx <= hi + 0.5 * (hi - x2) FROM O2, U""")
def covers(spark, sf_dir):
    s = event_store(spark, sf_dir)
    lin = ax.linear_covers(ax.at_cursors(axes_of(s), [2.3, 700.0, 1e7])).select(
        F.lit("linear").alias("kind"), "channel_id", "cursor_no", "cx", "covered")
    pts = time_points(s.samples)
    arr = ax.sorted_covers(pts, ax.nearest_sorted(pts, T_CURSORS), s.n_channels).select(
        F.lit("sorted").alias("kind"), "channel_id", "cursor_no", "cx", "covered")
    return lin.unionByName(arr)


@query("x_extent", f"""WITH {S}, {C}, {A}, {P} SELECT 'linear' AS kind, min(x0) AS x_min, max(x0 + (e - 1) * dx) AS x_max FROM A
  UNION ALL SELECT 'array', min(x), max(x) FROM P""")
def x_extent(spark, sf_dir):
    s = event_store(spark, sf_dir)
    return ax.linear_extent(axes_of(s)).select(F.lit("linear").alias("kind"), "x_min", "x_max").unionByName(
        ax.points_extent(time_points(s.samples)).select(F.lit("array").alias("kind"), "x_min", "x_max"))


@query("x_interp", f"""WITH {S}, {P}, N AS (SELECT channel_id, count(*) AS n FROM P GROUP BY channel_id),
  Q AS (SELECT P.channel_id, n, sample_idx, sample_idx + (sample_idx % 4) * 0.25::DOUBLE AS p FROM P JOIN N ON P.channel_id = N.channel_id)
  SELECT Q.channel_id, p AS "at", {rnd_sql('''CASE WHEN least(p - a.sample_idx, 1) > 0 THEN a.x + least(p - a.sample_idx, 1) * (b.x - a.x) ELSE a.x END''')} AS x
  FROM Q JOIN P a ON a.channel_id = Q.channel_id AND a.sample_idx = least(floor(p)::BIGINT, n - 1)
    JOIN P b ON b.channel_id = Q.channel_id AND b.sample_idx = least(floor(p)::BIGINT + 1, n - 1)""")
def x_interp(spark, sf_dir):
    s = event_store(spark, sf_dir)
    pts = time_points(s.samples)
    at = F.col("sample_idx") + (F.col("sample_idx") % 4) * F.lit(0.25)
    want = pts.join(bounded(s.channels.select("channel_id", F.col("length").alias("n")), s.n_channels), "channel_id")
    return ax.interpolate_x(want.select("channel_id", "n", at.alias("at")), pts).select("channel_id", "at", rnd("x").alias("x"))


@query("floor_pow2", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(power(2, floor(log2(greatest(1, floor(l_extendedprice)))) ) AS BIGINT) AS p
  FROM lineitem""")
def floor_pow2(spark, sf_dir):
    from ..sources.tables import table
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pow2("l_extendedprice").alias("p"))


def _decimate_sql(max_points: int) -> str:
    half = max_points // 2
    return f"""N AS (SELECT channel_id, count(*) AS n FROM T GROUP BY channel_id),
  G AS (SELECT channel_id, n, CASE WHEN n <= {max_points} THEN 0 ELSE (n + {half} - 1) // {half} END AS b FROM N),
  H AS (SELECT T.channel_id, sample_idx, x, y, CASE WHEN b > 0 THEN n // b * b ELSE 0 END AS full_to, sample_idx // greatest(b, 1) AS bucket
    FROM T JOIN G ON T.channel_id = G.channel_id),
  K AS (SELECT *, row_number() OVER (PARTITION BY channel_id, bucket ORDER BY y, sample_idx) AS lo,
    row_number() OVER (PARTITION BY channel_id, bucket ORDER BY y DESC, sample_idx) AS hi FROM H WHERE sample_idx < full_to)
  SELECT channel_id, sample_idx, x, y FROM K WHERE lo = 1 UNION ALL SELECT channel_id, sample_idx, x, y FROM K WHERE hi = 1
  UNION ALL SELECT channel_id, sample_idx, x, y FROM H WHERE sample_idx >= full_to"""


@query("xy_decimate", f"WITH {S}, T AS (SELECT channel_id, sample_idx, user_id::DOUBLE AS x, v AS y FROM S), {_decimate_sql(400)}")
def xy_decimate(spark, sf_dir):
    s = event_store(spark, sf_dir)
    pts = s.samples.select("channel_id", "sample_idx", F.col("user_id").cast("double").alias("x"), F.col("v").alias("y"))
    spans = s.channels.select("channel_id", F.lit(0).cast("bigint").alias("s"), F.col("length").alias("e"))
    return env.xy_decimate(pts, spans, 400, s.n_channels)


@query("xy_plot", f"""WITH {L}, T AS (SELECT channel_id || '/qty' AS channel_id, sample_idx, v AS x, q AS y FROM L), {_decimate_sql(2000)}""")
def xy_plot(spark, sf_dir):
    both, pairs, n = xy_pairs(spark, sf_dir)
    return plot.xy_plot(both, pairs.filter("channel_id LIKE '%/qty'"), n, 2000)


@query("xy_stats", f"""WITH {L}, W AS (SELECT channel_id, q AS v FROM L WHERE v BETWEEN 20000.5 AND 70000.0), {moments('W', 'channel_id')}
  SELECT channel_id, {_STATS_SELECT} FROM M""")
def xy_stats(spark, sf_dir):
    s = lineitem_store(spark, sf_dir)
    return _stats_cols(readout.xy_stats(_price_points(s), s.channels.withColumn("pivot", F.lit(25.0)), 20000.5, 70000.0, s.n_channels), "channel_id")


@query("auto_y", f"""WITH {S}, {C}, {A} SELECT min(v) AS y_min, max(v) AS y_max FROM S JOIN A ON S.channel_id = A.channel_id
  WHERE x0 + sample_idx * dx BETWEEN {XA} AND {XB}""")
def auto_y(spark, sf_dir):
    s = event_store(spark, sf_dir)
    return ax.auto_y(s.samples, axes_of(s), XA, XB, s.n_channels)
