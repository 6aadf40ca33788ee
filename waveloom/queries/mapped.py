"""Plots, statistics and cursors over X channels of any order and over values of any kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import present
from ..operators.rollup import FACTOR
from ..plans import mapped
from ..session import settle
from .axis import TIME_BASE, time_points, time_rollup
from .base import A, C, L, S, SG, axes_of, event_rollup, event_store, gappy, lineitem_store, moments, rnd, rnd_sql
from .stats import _STD

QUERIES: dict = {}
BASE, PIXELS = 16, 40
XA, XB = 433.375, 1.0e6
MAP_CURSORS = [950.0, 460.25]
LINEAR, UNSORTED = "click", "signup"  # the other event types are over their time, which is sorted


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


def event_maps(spark, sf_dir):
    """Maps of the event channels and their X channels: times `t:<type>`, sorted, and user numbers `u:<type>`, in any order."""
    s = event_store(spark, sf_dir)
    _, buckets, channels, n = time_rollup(spark, sf_dir)
    kind = F.when(F.col("channel_id") == LINEAR, "linear").when(F.col("channel_id") == UNSORTED, "unsorted").otherwise("sorted")
    maps = axes_of(s).select("channel_id", "length", kind.alias("map"), "x0", "dx")
    maps = maps.withColumn("x_channel_id", F.when(kind != "linear", F.concat(F.when(kind == "sorted", "t:").otherwise("u:"), "channel_id")))

    def named(df, tag):
        return df.withColumn("channel_id", F.concat(F.lit(tag), "channel_id"))
    users = s.samples.select("channel_id", "sample_idx", F.col("user_id").cast("double").alias("x"))
    points = named(time_points(s.samples).select("channel_id", "sample_idx", "x"), "t:").unionByName(named(users, "u:"))
    sizes = channels.select("channel_id", "length")
    return maps, mapped.XChannels(points, named(buckets, "t:"), named(sizes, "t:").unionByName(named(sizes, "u:")), TIME_BASE, 2 * n)


_MP = f"""MP AS (SELECT SG.channel_id, SG.sample_idx, SG.v, S.v AS stored, x0, dx, length, CASE WHEN SG.channel_id = '{LINEAR}' THEN x0 + SG.sample_idx * dx
    WHEN SG.channel_id = '{UNSORTED}' THEN S.user_id::DOUBLE ELSE (SG.t_us - 1704067200000000) / 1e6 END AS x
  FROM SG JOIN A ON A.channel_id = SG.channel_id JOIN S ON S.channel_id = SG.channel_id AND S.sample_idx = SG.sample_idx)"""

_PLOT = f"""WITH {S}, {SG}, {C}, {A}, {_MP}, V AS (SELECT channel_id, any_value(length) AS length,
    CASE WHEN channel_id = '{LINEAR}' THEN greatest(0, least(any_value(length), floor(({XA} - any_value(x0)) / any_value(dx))::BIGINT - 1)) ELSE greatest(0, count(*) FILTER (WHERE x < {XA}) - 1) END AS i0,
    CASE WHEN channel_id = '{LINEAR}' THEN greatest(0, least(any_value(length), ceil(({XB} - any_value(x0)) / any_value(dx))::BIGINT + 2))
      ELSE least(count(*), count(*) FILTER (WHERE x <= {XB}) + 1) END AS i1 FROM MP WHERE channel_id <> '{UNSORTED}' GROUP BY channel_id),
  B AS (SELECT *, i1 - i0 AS n, CAST(power(2, floor(log2(greatest(1, (i1 - i0) / {PIXELS})))) AS BIGINT) AS b FROM V WHERE i1 > i0),
  D AS (SELECT MP.channel_id, sample_idx, v, i0, i1, n AS cnt, b FROM MP JOIN B ON MP.channel_id = B.channel_id WHERE sample_idx >= i0 AND sample_idx < i1),
  E AS (SELECT channel_id, sample_idx // b AS bucket,
    (greatest(any_value(i0), sample_idx // b * any_value(b)) + least(any_value(i1), (sample_idx // b + 1) * any_value(b))) / 2 AS center,
    min(v) FILTER (WHERE NOT isnan(v)) AS mn, max(v) FILTER (WHERE NOT isnan(v)) AS mx, bool_or(isnan(v)) AS missing
    FROM D WHERE cnt > {2 * PIXELS} GROUP BY channel_id, sample_idx // b),
  Q AS (SELECT channel_id, bucket, ord, center, CASE ord WHEN 0 THEN mn WHEN 1 THEN mx END AS y FROM E, (SELECT unnest([0, 1, 2]) AS ord) o WHERE ord < 2 OR missing
    UNION ALL SELECT channel_id, sample_idx, 0, sample_idx::DOUBLE, CASE WHEN NOT isnan(v) THEN v END FROM D WHERE cnt <= {2 * PIXELS}),
  R AS (SELECT Q.*, B.n, B.b, B.i1, B.length, p.x0, p.dx, p.x AS xl, nx.x AS xr FROM Q JOIN B ON B.channel_id = Q.channel_id
    JOIN MP p ON p.channel_id = Q.channel_id AND p.sample_idx = least(floor(center)::BIGINT, B.length - 1)
    JOIN MP nx ON nx.channel_id = Q.channel_id AND nx.sample_idx = least(floor(center)::BIGINT + 1, B.length - 1))
  SELECT channel_id, bucket, ord, {rnd_sql(f"CASE WHEN channel_id = '{LINEAR}' THEN x0 + center * dx ELSE xl + (center - floor(center)) * (xr - xl) END")} AS x, y, {{complete}} AS complete FROM R"""


def _points(df: DataFrame) -> DataFrame:
    return df.select("channel_id", "bucket", "ord", rnd("x").alias("x"), present("y").alias("y"), "complete")


@query("plot_view_xarr", _PLOT.format(complete="true"))
def plot_view_xarr(spark, sf_dir):
    """Plot points of channels over a formula and over sorted X channels in one answer."""
    s = event_store(spark, sf_dir)
    maps, x = event_maps(spark, sf_dir)
    return _points(mapped.plot_mapped(gappy(s.samples), event_rollup(spark, sf_dir, BASE), s.channels, maps, x, XA, XB, PIXELS, BASE, s.n_channels))


@query("plot_view_partial", _PLOT.format(complete=f"NOT (channel_id = 'view' AND n > {2 * PIXELS} AND b >= {BASE} AND (length // 2) // {BASE} * {BASE} < i1)"))
def plot_view_partial(spark, sf_dir):
    """The same points while the rollup of one channel covers only the first half."""
    s = event_store(spark, sf_dir)
    maps, x = event_maps(spark, sf_dir)
    half = s.channels.select("channel_id", F.expr("length div 2").alias("half"))
    there = event_rollup(spark, sf_dir, BASE).join(F.broadcast(half), "channel_id")
    there = there.filter(f"channel_id <> 'view' OR (bucket + 1) * {BASE} * power({FACTOR}, level) <= half").drop("half")
    return _points(mapped.plot_mapped(gappy(s.samples), there, s.channels, maps, x, XA, XB, PIXELS, BASE, s.n_channels))


@query("stats_table_xarr", f"""WITH {S}, {SG}, {C}, {A}, {_MP}, W AS (SELECT channel_id, v FROM MP WHERE x BETWEEN {XA} AND {XB}), {moments('W', 'channel_id')}
  SELECT A.channel_id, coalesce(n, 0) AS n, coalesce(total - n, 0) AS n_nan, mn, mx, {rnd_sql('mx - mn')} AS p2p, {rnd_sql('mean')} AS mean, {_STD} AS std,
    {rnd_sql('sqrt(mean * mean + m2 / n)')} AS rms FROM A LEFT JOIN M ON M.channel_id = A.channel_id""")
def stats_table_xarr(spark, sf_dir):
    """Statistics in an x range over a formula, sorted and unsorted X channels."""
    s = event_store(spark, sf_dir)
    maps, x = event_maps(spark, sf_dir)
    out = mapped.stats_mapped(gappy(s.samples), event_rollup(spark, sf_dir, BASE), s.channels, maps, x, XA, XB, BASE, s.n_channels)
    return out.select("channel_id", "n", F.coalesce("n_nan", F.lit(0)).alias("n_nan"), "mn", "mx", rnd("p2p").alias("p2p"), rnd("mean").alias("mean"), rnd("std").alias("std"), rnd("rms").alias("rms"))


_CUR = "U AS (SELECT unnest([1, 2]) AS cursor_no, unnest([" + ", ".join(f"{c}::DOUBLE" for c in MAP_CURSORS) + "]) AS cx)"


@query("cursor_values_xarr", f"""WITH {S}, {SG}, {C}, {A}, {_MP}, {_CUR},
  O AS (SELECT channel_id, min(x) AS lo, max(x) AS hi, max(x) FILTER (WHERE sample_idx = 1) AS x1, max(x) FILTER (WHERE sample_idx = length - 2) AS x2,
    any_value(x0) AS x0, any_value(dx) AS dx, any_value(length) AS length FROM MP GROUP BY channel_id),
  K AS (SELECT MP.channel_id, cursor_no, sample_idx, x, stored, row_number() OVER (PARTITION BY MP.channel_id, cursor_no ORDER BY
      CASE WHEN MP.channel_id = '{LINEAR}' THEN abs(sample_idx - (cx - MP.x0) / MP.dx) ELSE abs(x - cx) END,
      CASE WHEN MP.channel_id = '{LINEAR}' THEN sample_idx % 2 WHEN MP.channel_id = '{UNSORTED}' THEN sample_idx ELSE (x >= cx)::BIGINT END,
      CASE WHEN x < cx THEN -sample_idx ELSE sample_idx END) AS rk FROM MP JOIN O ON O.channel_id = MP.channel_id, U
    WHERE CASE WHEN MP.channel_id = '{LINEAR}' THEN O.x0 - 0.5 * O.dx <= cx AND cx <= O.x0 + (O.length - 1) * O.dx + 0.5 * O.dx
      WHEN MP.channel_id = '{UNSORTED}' THEN true ELSE lo - 0.5 * (x1 - lo) <= cx AND cx <= hi + 0.5 * (hi - x2) END)
  SELECT channel_id, cursor_no, sample_idx, x, stored AS value FROM K WHERE rk = 1""")
def cursor_values_xarr(spark, sf_dir):
    """Cursor readings of channels over a formula, sorted and unsorted X channels."""
    s = event_store(spark, sf_dir)
    maps, x = event_maps(spark, sf_dir)
    return mapped.cursors_mapped(s.samples, maps, x, MAP_CURSORS, n_channels=s.n_channels)


FAR = 1 << 40


def _typed_sql(kind: str, value: str, exact: str = "NULL", shift: str = "0") -> str:
    return f"""SELECT L.channel_id, '{kind}' AS kind, count({value}) AS n, count(*) - count({value}) AS n_nan, min({value}) + {shift} AS mn, max({value}) + {shift} AS mx,
      {rnd_sql(f'max({value}) - min({value})')} AS p2p, round({shift} + avg({value}), 2) AS mean, {rnd_sql(f'stddev_samp({value})')} AS std,
      min({exact})::DECIMAL(20,0) AS mn_exact, max({exact})::DECIMAL(20,0) AS mx_exact FROM L JOIN Z ON Z.channel_id = L.channel_id GROUP BY L.channel_id, k0, t0"""


@query("stats_table_typed", f"""WITH {L}, Z AS (SELECT channel_id, min(k) FILTER (WHERE sample_idx = 0) AS k0, min(k) FILTER (WHERE sample_idx = 1) AS t0 FROM L GROUP BY channel_id)
  {_typed_sql('int', '(k - k0)::DOUBLE', f'k + {FAR}', f'(k0 + {FAR})::DOUBLE')} UNION ALL {_typed_sql('bool', '(k % 2 = 0)::INT::DOUBLE')}
  UNION ALL {_typed_sql('complex', 'sqrt(v * v + q * q)')} UNION ALL {_typed_sql('time', 'CASE WHEN sample_idx % 7 > 0 THEN (k - t0) * 250 / 1e9 END')}""")
def stats_table_typed(spark, sf_dir):
    """Statistics of integer, boolean, complex and time channels."""
    s = lineitem_store(spark, sf_dir)
    values = {"int": F.col("k") + F.lit(FAR), "bool": F.col("k") % 2 == 0, "complex": F.struct(F.col("v").alias("re"), F.col("q").alias("im")),
              "time": F.when(F.col("sample_idx") % 7 > 0, F.col("k") * 250)}
    parts = [mapped.stats_typed(settle(s.samples.select("channel_id", "sample_idx", v.alias("v")), kind), kind, n_channels=s.n_channels) for kind, v in values.items()]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("channel_id", "kind", "n", "n_nan", "mn", "mx", rnd("p2p").alias("p2p"), F.round("mean", 2).alias("mean"), rnd("std").alias("std"), "mn_exact", "mx_exact")
