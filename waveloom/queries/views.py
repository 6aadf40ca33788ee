"""Composite answers: plot views, the statistics table, cursors, pages and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import present
from ..operators import rows as rw
from ..operators.catalog import unit_text
from ..plans import export, plot, readout
from .axis import XA, XB
from .base import A, C, L, LC, S, SG, axes_of, event_rollup, event_store, gappy, lineitem_store, moments, rnd, rnd_sql
from .stats import _STD

QUERIES: dict = {}
BASE = 16
PIXELS = 40


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


# Plot: raw below 2 * pixels samples, else one min/max pair per bucket of floor_pow2(n / pixels).
_PLOT = f"""WITH {S}, {SG}, {C}, {A}, V AS (SELECT channel_id, x0, dx,
    greatest(s, least(e, floor(({XA} - x0) / dx)::BIGINT - 1)) AS i0,
    greatest(s, least(e, ceil(({XB} - x0) / dx)::BIGINT + 2)) AS i1 FROM A),
  B AS (SELECT *, i1 - i0 AS n, CAST(power(2, floor(log2(greatest(1, (i1 - i0) / {PIXELS})))) AS BIGINT) AS b FROM V),
  D AS (SELECT SG.channel_id, sample_idx, v, x0, dx, i0, i1, n AS cnt, b FROM SG JOIN B ON SG.channel_id = B.channel_id
    WHERE sample_idx >= i0 AND sample_idx < i1),
  E AS (SELECT channel_id, sample_idx // b AS bucket, any_value(x0) AS x0, any_value(dx) AS dx,
    (greatest(any_value(i0), sample_idx // b * any_value(b)) + least(any_value(i1), (sample_idx // b + 1) * any_value(b))) / 2 AS center,
    min(v) FILTER (WHERE NOT isnan(v)) AS mn, max(v) FILTER (WHERE NOT isnan(v)) AS mx, bool_or(isnan(v)) AS missing
    FROM D WHERE cnt > {2 * PIXELS} GROUP BY channel_id, sample_idx // b)
  SELECT channel_id, bucket, ord, x0 + center * dx AS x, CASE ord WHEN 0 THEN mn WHEN 1 THEN mx END AS y
    FROM E, (SELECT unnest([0, 1, 2]) AS ord) o WHERE ord < 2 OR missing
  UNION ALL SELECT channel_id, sample_idx, 0, x0 + sample_idx * dx, CASE WHEN NOT isnan(v) THEN v END FROM D WHERE cnt <= {2 * PIXELS}"""


@query("plot_view", _PLOT)
def plot_view(spark, sf_dir):
    s = event_store(spark, sf_dir)
    pts = plot.plot_view(gappy(s.samples), event_rollup(spark, sf_dir, BASE), s.channels, axes_of(s), XA, XB, PIXELS, BASE, s.n_channels)
    return pts.withColumn("y", present("y"))


STAT_CURSORS = [950.0, 460.25]

_CURSOR_ROWS = f"""CU AS (SELECT unnest([1, 2]) AS cursor_no, unnest([{STAT_CURSORS[0]}::DOUBLE, {STAT_CURSORS[1]}::DOUBLE]) AS cx),
  CP AS (SELECT S.channel_id, cursor_no, sample_idx, x0 + sample_idx * dx AS x, v, k, row_number() OVER (PARTITION BY S.channel_id, cursor_no
      ORDER BY abs(sample_idx - (cx - x0) / dx), sample_idx % 2) AS rk
    FROM (SELECT *, user_id AS k FROM S) S JOIN A ON S.channel_id = A.channel_id, CU
    WHERE x0 + s * dx - 0.5 * dx <= cx AND cx <= x0 + (e - 1) * dx + 0.5 * dx),
  CV AS (SELECT * FROM CP WHERE rk = 1)"""


@query("stats_table", f"""WITH {S}, {SG}, {C}, {A}, {_CURSOR_ROWS},
  W AS (SELECT SG.channel_id, v FROM SG JOIN A ON SG.channel_id = A.channel_id
    WHERE x0 + sample_idx * dx BETWEEN {min(STAT_CURSORS)} AND {max(STAT_CURSORS)}), {moments('W', 'channel_id')},
  PV AS (SELECT channel_id, max(v) FILTER (WHERE cursor_no = 1) AS c1, max(v) FILTER (WHERE cursor_no = 2) AS c2 FROM CV GROUP BY channel_id)
  SELECT A.channel_id, 'events/' || A.channel_id AS label, CASE A.channel_id WHEN 'click' THEN '|z| [ms]' WHEN 'view' THEN 's since first sample' ELSE 'ms' END AS unit, coalesce(n, 0) AS n, coalesce(total - n, 0) AS n_nan, mn, mx,
    {rnd_sql('mx - mn')} AS p2p, {rnd_sql('mean')} AS mean, {_STD} AS std, {rnd_sql('sqrt(mean * mean + m2 / n)')} AS rms,
    c1, c2, {rnd_sql('c2 - c1')} AS c2_c1
  FROM A LEFT JOIN M ON A.channel_id = M.channel_id LEFT JOIN PV ON A.channel_id = PV.channel_id""")
def stats_table(spark, sf_dir):
    s = event_store(spark, sf_dir)
    kind = F.when(F.col("channel_id") == "click", "complex").when(F.col("channel_id") == "view", "time").otherwise("float")
    cat = s.channels.withColumn("label", F.concat(F.lit("events/"), "channel_id")).withColumn("kind", kind).withColumn("unit", F.lit("ms"))
    cat = cat.withColumn("unit", unit_text())
    # The cursor shows the stored value, the statistics skip the missing ones.
    out = readout.stats_table(gappy(s.samples), event_rollup(spark, sf_dir, BASE), cat, axes_of(s), (XA, XB), STAT_CURSORS, BASE, s.n_channels)
    raw = readout.cursor_delta(readout.cursor_pairs(readout.cursor_values(s.samples, axes_of(s), STAT_CURSORS, n_channels=s.n_channels)))
    out = out.drop("c1", "c2", "c2_c1").join(raw.select("channel_id", "c1", "c2", F.col("delta").alias("c2_c1")), "channel_id", "left")
    return out.select("channel_id", "label", "unit", "n", "n_nan", "mn", "mx", rnd("p2p").alias("p2p"), rnd("mean").alias("mean"),
                      rnd("std").alias("std"), rnd("rms").alias("rms"), "c1", "c2", rnd("c2_c1").alias("c2_c1"))


@query("cursor_values", f"WITH {S}, {C}, {A}, {_CURSOR_ROWS} SELECT channel_id, cursor_no, sample_idx, x, v AS value FROM CV")
def cursor_values(spark, sf_dir):
    s = event_store(spark, sf_dir)
    return readout.cursor_values(s.samples, axes_of(s), STAT_CURSORS, n_channels=s.n_channels)


@query("cursor_delta", f"""WITH {S}, {C}, {A}, {_CURSOR_ROWS}, PR AS (SELECT channel_id, max(k) FILTER (WHERE cursor_no = 1) AS c1,
    max(k) FILTER (WHERE cursor_no = 2) AS c2, max(x) FILTER (WHERE cursor_no = 1) AS x1, max(x) FILTER (WHERE cursor_no = 2) AS x2
    FROM CV GROUP BY channel_id)
  SELECT channel_id, c1, c2, c2 - c1 AS delta, x2 - x1 AS dx, CASE WHEN x2 <> x1 THEN 1.0::DOUBLE / (x2 - x1) END AS inv_dx FROM PR""")
def cursor_delta(spark, sf_dir):
    s = event_store(spark, sf_dir)
    pairs = readout.cursor_pairs(readout.cursor_values(s.samples, axes_of(s), STAT_CURSORS, "user_id", s.n_channels))
    return readout.cursor_delta(pairs).select("channel_id", "c1", "c2", F.col("delta").cast("bigint").alias("delta"), "dx", "inv_dx")


@query("cursor_row", f"""WITH {S}, {C}, {A}, FR AS (SELECT * FROM A ORDER BY channel_id LIMIT 1), D AS (SELECT S.channel_id, sample_idx,
    row_number() OVER (ORDER BY abs(sample_idx - (700.3 - x0) / dx), sample_idx % 2) AS rk FROM S JOIN FR ON S.channel_id = FR.channel_id)
  SELECT channel_id, sample_idx, sample_idx - 100 AS "row" FROM D WHERE rk = 1""")
def cursor_row(spark, sf_dir):
    s = event_store(spark, sf_dir)
    return readout.cursor_row(axes_of(s).withColumn("channel_no", F.col("channel_id")), 700.3, 100)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("values_page", f"""WITH {S} SELECT sample_idx, {', '.join(f"max(v) FILTER (WHERE channel_id = '{c}') AS {c}" for c in EVENT_TYPES)}
  FROM S WHERE sample_idx >= 1900 AND sample_idx < 2100 GROUP BY sample_idx""")
def values_page(spark, sf_dir):
    return rw.values_page(event_store(spark, sf_dir).samples, EVENT_TYPES, 1900, 2100)


@query("page_info", f"""WITH {L}, {LC}, T AS (SELECT max(length - 500) AS total_rows FROM LC) SELECT total_rows, least(4000, total_rows) AS rows,
  total_rows > 4000 AS clamped, CASE WHEN total_rows > 4000 THEN 4500 END AS next_start FROM T""")
def page_info(spark, sf_dir):
    return rw.page_info(lineitem_store(spark, sf_dir).channels, 500, None, 4000).withColumn("next_start", F.col("next_start").cast("int"))


BOXES = [(3, 40, 0, 2), (30, 60, 1, 4), (500, 520, 4, 4)]


@query("box_select", f"""WITH {S}, T AS (SELECT channel_id, sample_idx, v, list_position({EVENT_TYPES}, channel_id) - 1 AS c FROM S),
  K AS (SELECT sample_idx, channel_id, CASE WHEN {' OR '.join(f'(sample_idx BETWEEN {t} AND {b} AND c BETWEEN {lf} AND {rt})' for t, b, lf, rt in BOXES)}
    THEN v END AS v FROM T WHERE sample_idx BETWEEN 3 AND 60 OR sample_idx BETWEEN 500 AND 520)
  SELECT sample_idx AS row_no, {', '.join(f"max(v::VARCHAR) FILTER (WHERE channel_id = '{c}') AS {c}" for c in EVENT_TYPES)} FROM K GROUP BY sample_idx""")
def box_select(spark, sf_dir):
    return rw.box_select(event_store(spark, sf_dir).samples, EVENT_TYPES, BOXES)


_ISO = """strftime(make_timestamp(CAST(floor(x) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(round((x - floor(x)) * 1e9) AS BIGINT) AS VARCHAR), 9, '0') || 'Z'"""


@query("export_wide", f"""WITH {S}, {C}, {A}, D AS (SELECT S.channel_id, sample_idx, x0 + sample_idx * dx AS x, v FROM S JOIN A
    ON S.channel_id = A.channel_id), R AS (SELECT channel_id, min(sample_idx) AS i0 FROM D WHERE x BETWEEN {XA} AND {XB} GROUP BY channel_id),
  W AS (SELECT D.channel_id, sample_idx - i0 AS row_no, sample_idx::VARCHAR AS i, x::VARCHAR AS x,
      {_ISO.replace('floor(x)', 'floor(1.25::DOUBLE + x)').replace('(x - ', '(1.25::DOUBLE + x - ')} AS t, v::VARCHAR AS v
    FROM D JOIN R ON D.channel_id = R.channel_id WHERE x BETWEEN {XA} AND {XB})
  SELECT row_no, {', '.join(f"coalesce(max({f}) FILTER (WHERE channel_id = '{c}'), '') AS {c}_{f}" for c in EVENT_TYPES for f in 'ixtv' if not (f == 't' and c == 'view'))},
    '' AS view_t FROM W GROUP BY row_no""")
def export_wide(spark, sf_dir):
    """All channels side by side with UTC times (one channel has no absolute time)."""
    s = event_store(spark, sf_dir)
    rows = export.export_rows(s.samples, axes_of(s), XA, XB, s.n_channels)
    return export.export_wide(rows, EVENT_TYPES, time_ref=(1, 0.25), timed=[c for c in EVENT_TYPES if c != "view"])


@query("sample_window", f"WITH {S} SELECT channel_id, sample_idx, v FROM S WHERE channel_id = 'click' AND sample_idx >= 100 AND sample_idx < 1900")
def sample_window(spark, sf_dir):
    return rw.sample_window(event_store(spark, sf_dir).samples, ["click"], 100, 1900).select("channel_id", "sample_idx", "v")


@query("multi_channel_window", f"""WITH {S} SELECT channel_id, sample_idx, v FROM S
  WHERE channel_id IN ('click', 'view', 'error') AND sample_idx < 2000""")
def multi_channel_window(spark, sf_dir):
    return rw.sample_window(event_store(spark, sf_dir).samples, ["click", "view", "error", "absent"], -5, 2000).select(
        "channel_id", "sample_idx", "v")
