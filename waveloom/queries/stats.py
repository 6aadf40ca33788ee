"""Statistics, envelopes and the rollup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import present
from ..operators import envelope as env
from ..operators import rollup as roll
from ..operators import stats as st
from ..session import bounded, new_path
from ..streaming.levels import LevelTable, level_coverage, read_levels, start_levels
from ..streaming.rollup import read_rollup, start_rollup
from .base import (C, L, LC, LG, S, SG, event_store, gappy, lineitem_rollup, lineitem_store, moments, rnd, rnd_sql, ranges_of, rng,
                   spiky)

QUERIES: dict = {}
BASE = 16


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


def _stats_cols(df, *keys):
    return df.select(*keys, "n", "total", "mn", "mx", rnd("p2p").alias("p2p"), rnd("mean").alias("mean"),
                     rnd("std").alias("std"), rnd("rms").alias("rms"), "n_nan")


_STD = rnd_sql("CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) END")
_MEAN = rnd_sql("mean")
_STATS_SELECT = f"""n, total, mn, mx, {rnd_sql('mx - mn')} AS p2p, {_MEAN} AS mean, {_STD} AS std,
  {rnd_sql('sqrt(mean * mean + m2 / n)')} AS rms, total - n AS n_nan"""


@query("range_stats", f"WITH {S}, {SG}, {moments('SG', 'channel_id')} SELECT channel_id, {_STATS_SELECT} FROM M")
def range_stats(spark, sf_dir):
    s = event_store(spark, sf_dir)
    return _stats_cols(st.range_stats(gappy(s.samples), s.channels, n_channels=s.n_channels), "channel_id")


@query("rms", f"""WITH {S}, I AS (SELECT channel_id, sample_idx, CASE WHEN channel_id = 'click' AND sample_idx % 89 = 3
  THEN 'inf'::DOUBLE ELSE v END AS v FROM S)
  SELECT channel_id, CASE WHEN bool_or(isinf(v)) THEN 'Inf' ELSE printf('%.6f', sqrt(avg(v * v) FILTER (WHERE NOT isinf(v)))) END AS rms
  FROM I GROUP BY channel_id""")
def rms(spark, sf_dir):
    s = event_store(spark, sf_dir)
    hot = F.when((F.col("channel_id") == "click") & (F.col("sample_idx") % 89 == 3), F.lit(float("inf"))).otherwise(F.col("v"))
    out = st.range_stats(s.samples.withColumn("v", hot), s.channels, n_channels=s.n_channels)
    return out.select("channel_id", F.when(F.col("rms") == float("inf"), "Inf").otherwise(
        F.format_string("%.6f", "rms")).alias("rms"))


@query("nan_count", f"""WITH {L}, {LG} SELECT channel_id, count(*) - count(*) FILTER (WHERE NOT isnan(v)) AS n_nan
  FROM LG GROUP BY channel_id""")
def nan_count(spark, sf_dir):
    s = lineitem_store(spark, sf_dir)
    return gappy(s.samples).groupBy("channel_id").agg((F.count(F.lit(1)) - F.count(present("v"))).alias("n_nan"))


@query("merge_stats", f"WITH {L}, {LG}, {moments('LG', 'channel_id')} SELECT channel_id, {_STATS_SELECT} FROM M")
def merge_stats(spark, sf_dir):
    """Whole-channel statistics from all level-0 states of the rollup."""
    s = lineitem_store(spark, sf_dir)
    states = lineitem_rollup(spark, sf_dir, BASE).filter("level = 0")
    span = -(-s.channels.agg(F.max("length")).first()[0] // BASE)
    merged = st.merge_states(states, ["channel_id"], "bucket", span)
    return _stats_cols(st.with_statistics(merged), "channel_id")


_ENV_SQL = """SELECT channel_id, bucket, greatest(i0, bucket * b) AS lo, least(i1, (bucket + 1) * b) AS hi,
    (greatest(i0, bucket * b) + least(i1, (bucket + 1) * b)) / 2 AS center, n, total, mn, mx, n < total AS missing FROM (
    SELECT d.channel_id, sample_idx // {b} AS bucket, any_value(i0) AS i0, any_value(i1) AS i1, {b} AS b,
      count(*) FILTER (WHERE NOT isnan(v)) AS n, count(*) AS total,
      min(v) FILTER (WHERE NOT isnan(v)) AS mn, max(v) FILTER (WHERE NOT isnan(v)) AS mx
    FROM {src} d JOIN R ON d.channel_id = R.channel_id WHERE sample_idx >= i0 AND sample_idx < i1
    GROUP BY d.channel_id, sample_idx // {b}) t"""


def _events_envelope(spark, sf_dir, b=64):
    s = event_store(spark, sf_dir)
    r = ranges_of(s.channels).withColumn("b", F.lit(b).cast("bigint"))
    return env.envelope(gappy(s.samples), r, s.n_channels)


@query("envelope", f"WITH {S}, {SG}, {C}, {rng('C')} {_ENV_SQL.format(b=64, src='SG')}")
def envelope(spark, sf_dir):
    return _events_envelope(spark, sf_dir)


@query("envelope_points", f"""WITH {S}, {SG}, {C}, {rng('C')}, E AS ({_ENV_SQL.format(b=64, src='SG')})
  SELECT channel_id, bucket, ord, center AS x_index, CASE ord WHEN 0 THEN mn WHEN 1 THEN mx END AS y
  FROM E, (SELECT unnest([0, 1, 2]) AS ord) o WHERE ord < 2 OR missing""")
def envelope_points(spark, sf_dir):
    pts = env.envelope_points(_events_envelope(spark, sf_dir))
    return pts.withColumn("y", present("y"))


_L0 = f"""WITH {L}, {LG}, B AS (SELECT channel_id, sample_idx // {BASE} AS bucket, sample_idx, v FROM LG),
  {moments('B', 'channel_id, bucket', ', arg_min(v, sample_idx) FILTER (WHERE isfinite(v)) AS pv')}"""


@query("rollup_l0", f"""{_L0} SELECT channel_id, bucket, n, total, mn, mx, coalesce(pv, 0) AS pv, {_MEAN} AS mean,
  {_STD} AS std FROM M""")
def rollup_l0(spark, sf_dir):
    s = lineitem_store(spark, sf_dir)
    out = st.with_statistics(roll.level0(gappy(s.samples), s.channels, BASE, s.n_channels))
    return out.select("channel_id", "bucket", "n", "total", "mn", "mx", "pv", rnd("mean").alias("mean"), rnd("std").alias("std"))


_LEVELS = f"""WITH {L}, {LG}, {LC}, N AS (SELECT channel_id, k AS level, CAST({BASE} * power(8, k) AS BIGINT) AS size
    FROM LC, (SELECT unnest(range(0, 12)) AS k) t
    WHERE k = 0 OR ceil(length / ({BASE} * power(8, k - 1))) > 64),
  B AS (SELECT N.channel_id, level, sample_idx // size AS bucket, sample_idx, v FROM LG JOIN N ON LG.channel_id = N.channel_id),
  {moments('B', 'channel_id, level, bucket', ', arg_min(v, sample_idx) FILTER (WHERE isfinite(v)) AS pv')}"""


@query("rollup_levels", f"""{_LEVELS} SELECT channel_id, CAST(level AS BIGINT) AS level, bucket, n, total, mn, mx,
  coalesce(pv, 0) AS pv, {_MEAN} AS mean, {_STD} AS std FROM M""")
def rollup_levels(spark, sf_dir):
    out = st.with_statistics(lineitem_rollup(spark, sf_dir, BASE))
    return out.select("channel_id", F.col("level").cast("bigint").alias("level"), "bucket", "n", "total", "mn", "mx", "pv",
                      rnd("mean").alias("mean"), rnd("std").alias("std"))


_IN_RANGE = f"""WITH {L}, {LG}, {LC}, {rng('LC')}, W AS (SELECT LG.channel_id, sample_idx, v FROM LG JOIN R
  ON LG.channel_id = R.channel_id WHERE sample_idx >= i0 AND sample_idx < i1)"""


@query("rollup_range_stats", f"{_IN_RANGE}, {moments('W', 'channel_id')} SELECT channel_id, {_STATS_SELECT} FROM M")
def rollup_range_stats(spark, sf_dir):
    s = lineitem_store(spark, sf_dir)
    states = roll.range_states(gappy(s.samples), lineitem_rollup(spark, sf_dir, BASE), s.channels, ranges_of(s.channels),
                               BASE, s.n_channels)
    return _stats_cols(st.with_statistics(states), "channel_id")


@query("partial_range_stats", f"{_IN_RANGE}, {moments('W', 'channel_id')} SELECT channel_id, {_STATS_SELECT}, false AS from_rollup FROM M")
def partial_range_stats(spark, sf_dir):
    """The same answer while only the first level of the first two fifths of each channel is stored."""
    s = lineitem_store(spark, sf_dir)
    sizes = s.channels.select("channel_id", "length")
    done = lineitem_rollup(spark, sf_dir, BASE).filter("level = 0").join(bounded(sizes, s.n_channels), "channel_id").filter(
        f"(bucket + 1) * {BASE} <= length * 0.4").drop("length")
    states = roll.complete_range_states(gappy(s.samples), done, s.channels, ranges_of(s.channels), BASE, s.n_channels, levels=1)
    flags = states.select("channel_id", "from_rollup")
    return _stats_cols(st.with_statistics(states.drop("from_rollup")), "channel_id").join(flags, "channel_id")


@query("rollup_envelope", f"WITH {L}, {LG}, {LC}, {rng('LC')} {_ENV_SQL.format(b=512, src='LG')}")
def rollup_envelope(spark, sf_dir):
    s = lineitem_store(spark, sf_dir)
    r = ranges_of(s.channels).withColumn("b", F.lit(512).cast("bigint"))
    return roll.rollup_envelope(gappy(s.samples), lineitem_rollup(spark, sf_dir, BASE), s.channels, r, BASE, s.n_channels)


@query("bucket_mean", f"{_LEVELS} SELECT channel_id, CAST(level AS BIGINT) AS level, bucket, {_MEAN} AS mean FROM M")
def bucket_mean(spark, sf_dir):
    return roll.bucket_mean(lineitem_rollup(spark, sf_dir, BASE)).select(
        "channel_id", F.col("level").cast("bigint").alias("level"), "bucket", rnd("mean").alias("mean"))


@query("int_stats", f"""WITH {L}, K AS (SELECT channel_id, k + 9007199254740992 AS k FROM L), Z AS (
    SELECT channel_id, k + 9007199254740992 AS kz FROM L WHERE sample_idx = 0), D AS (
    SELECT K.channel_id, k, kz, (k - kz)::DOUBLE AS v FROM K JOIN Z ON K.channel_id = Z.channel_id), U AS (
    SELECT channel_id, avg(v) AS mu FROM D GROUP BY channel_id)
  SELECT D.channel_id, count(*) AS n, min(k) AS mn, max(k) AS mx, round(kz::DOUBLE + any_value(mu), 0) AS mean,
    {rnd_sql('sqrt(sum((v - mu) * (v - mu)) / (count(*) - 1))')} AS std FROM D JOIN U ON D.channel_id = U.channel_id
  GROUP BY D.channel_id, kz""")
def int_stats(spark, sf_dir):
    """Integers above 2^53: exact min and max, spread from the differences to the first sample."""
    s = lineitem_store(spark, sf_dir)
    big = s.samples.withColumn("k", F.col("k") + F.lit(1 << 53))
    zero = big.filter("sample_idx = 0").select("channel_id", F.col("k").alias("k0"))
    out = st.integer_stats(big, zero, "k", s.n_channels)
    return out.select("channel_id", "n", "mn", "mx", F.round("mean", 0).alias("mean"), rnd("std").alias("std"))


@query("rollup_base", f"""WITH {L}, {LC}, T AS (SELECT sum(length) AS total FROM LC)
  SELECT min(p.base) AS base FROM T, (SELECT CAST(256 * power(2, k) AS BIGINT) AS base FROM (SELECT unnest(range(0, 40)) AS k) t) p
  WHERE p.base >= total / 20""")
def rollup_base(spark, sf_dir):
    s = lineitem_store(spark, sf_dir)
    base = roll.rollup_base(s.channels, 20)
    return s.channels.agg(F.lit(base).cast("bigint").alias("base"))


@query("stream_rollup", f"""{_L0} SELECT channel_id, bucket, n, total, mn, mx, coalesce(pv, 0) AS pv, {_MEAN} AS mean,
  {_STD} AS std FROM M""")
def stream_rollup(spark, sf_dir):
    """The rollup of the line items read as a stream of files, several micro-batches."""
    s = lineitem_store(spark, sf_dir)
    stream = gappy(spark.readStream.schema(s.samples.schema).option("maxFilesPerTrigger", 3).parquet(f"{s.path}/samples"))
    out, ckpt = new_path(spark, "stream"), new_path(spark, "stream_ckpt")
    start_rollup(stream, s.channels, out, ckpt, BASE).awaitTermination()
    states = st.with_statistics(read_rollup(spark, out))
    return states.select("channel_id", "bucket", "n", "total", "mn", "mx", "pv", rnd("mean").alias("mean"), rnd("std").alias("std"))


@query("stream_levels", f"""{_LEVELS} SELECT channel_id, CAST(level AS BIGINT) AS level, bucket, n, total, mn, mx,
  coalesce(pv, 0) AS pv, {_MEAN} AS mean, {_STD} AS std FROM M""")
def stream_levels(spark, sf_dir):
    """All levels of the rollup kept up to date while the line items arrive in micro-batches."""
    s = lineitem_store(spark, sf_dir)
    stream = gappy(spark.readStream.schema(s.samples.schema).option("maxFilesPerTrigger", 3).parquet(f"{s.path}/samples"))
    table = LevelTable(spark, new_path(spark, "levels"), BASE)
    start_levels(stream, s.channels, table, new_path(spark, "levels_ckpt")).awaitTermination()
    out = st.with_statistics(read_levels(table))
    return out.select("channel_id", F.col("level").cast("bigint").alias("level"), "bucket", "n", "total", "mn", "mx", "pv",
                      rnd("mean").alias("mean"), rnd("std").alias("std"))


@query("stream_duplicates", f"""WITH {L}, {LC}, D AS (SELECT * FROM L WHERE channel_id <> 'NO' OR sample_idx // {BASE} <> 3 OR sample_idx % {BASE} <> 1),
    M AS (SELECT channel_id, count(*) AS n, sum(v) AS total_v FROM D GROUP BY channel_id)
  SELECT M.channel_id, n, {rnd_sql("total_v / n")} AS mean, length, CASE WHEN M.channel_id = 'NO' THEN 3 * {BASE} ELSE length END AS covered, M.channel_id <> 'NO' AS complete
  FROM M JOIN LC ON LC.channel_id = M.channel_id""")
def stream_duplicates(spark, sf_dir):
    """Every third sample arrives twice, every seventh once more later, and a sample that is missing is not made up by a repeat."""
    s = lineitem_store(spark, sf_dir)
    there = s.samples.select("channel_id", "sample_idx", "v").filter(f"channel_id <> 'NO' OR sample_idx div {BASE} <> 3 OR sample_idx % {BASE} <> 1")
    folder = new_path(spark, "repeated")
    there.unionByName(there.filter("sample_idx % 3 = 0")).write.parquet(folder)
    there.filter("sample_idx % 7 = 0").withColumn("v", F.col("v") + 1).write.mode("append").parquet(folder)
    there.filter("sample_idx = 5").withColumn("sample_idx", F.lit(1 << 40)).write.mode("append").parquet(folder)
    declared = s.channels.select("channel_id", "length", "pivot")
    table, checkpoint = LevelTable(spark, new_path(spark, "levels"), BASE), new_path(spark, "levels_ckpt")
    stream = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", 8).option("latestFirst", "false").parquet(folder)
    start_levels(stream, declared, table, checkpoint).awaitTermination()
    states = st.with_statistics(st.merge_states(table.rows(0), ["channel_id"], "bucket", 1 << 40))
    return states.join(level_coverage(table, declared), "channel_id").select("channel_id", "n", rnd("mean").alias("mean"), "length", "covered", "complete")


_PART = "(channel_id <> 'NO' OR sample_idx // 16 <> (length // 16) // 2) AND (channel_id <> 'RF' OR sample_idx < length - 5)"


@query("covered_prefix", f"""WITH {L}, {LC}, D AS (SELECT L.channel_id, length, sample_idx // 16 AS b, count(*) AS c FROM L JOIN LC
    ON L.channel_id = LC.channel_id WHERE {_PART.replace('channel_id', 'L.channel_id')} GROUP BY L.channel_id, length, sample_idx // 16),
  F AS (SELECT channel_id, length, b, row_number() OVER (PARTITION BY channel_id ORDER BY b) - 1 AS rn FROM D
    WHERE c >= least(16, length - b * 16))
  SELECT channel_id, length, least(length, (SELECT count(*) FROM F WHERE F.channel_id = LC.channel_id AND b = rn) * 16) AS covered,
    least(length, (SELECT count(*) FROM F WHERE F.channel_id = LC.channel_id AND b = rn) * 16) = length AS complete FROM LC""")
def covered_prefix(spark, sf_dir):
    """One channel lost a bucket in its middle, one still misses its last samples."""
    s = lineitem_store(spark, sf_dir)
    here = s.samples.join(bounded(s.channels.select("channel_id", "length"), s.n_channels), "channel_id").filter(_PART.replace("//", "DIV"))
    return roll.covered_prefix(roll.level0(here.drop("length"), s.channels, BASE, s.n_channels), s.channels, BASE, s.n_channels)


@query("overrun", f"""WITH {L}, {LC} SELECT L.channel_id, sample_idx, v FROM L JOIN LC ON L.channel_id = LC.channel_id
  WHERE sample_idx >= length - length // 5""")
def overrun(spark, sf_dir):
    """Samples beyond a declared length of four fifths."""
    s = lineitem_store(spark, sf_dir)
    declared = s.channels.select("channel_id", (F.col("length") - F.floor(F.col("length") / 5)).alias("length"))
    return roll.overrun(s.samples, declared, s.n_channels).select("channel_id", "sample_idx", "v")


@query("to_double", """SELECT p_partkey, p_size::DOUBLE AS from_int, p_retailprice AS from_float,
  (p_size > 25)::INT::DOUBLE AS from_bool FROM part""")
def to_double(spark, sf_dir):
    from ..functions.values import to_double as f64
    from ..sources.tables import table
    return table(spark, sf_dir, "part").select(
        "p_partkey", f64("p_size").alias("from_int"), f64("p_retailprice").alias("from_float"),
        f64(F.col("p_size") > 25).alias("from_bool"))


@query("int_relative", f"""WITH {L}, Z AS (SELECT channel_id, k AS k0 FROM L WHERE sample_idx = 0)
  SELECT L.channel_id, sample_idx, (k - k0)::DOUBLE AS rel,
    ((k::HUGEINT + 18446744073709000000) - (k0::HUGEINT + 18446744073709000000))::DOUBLE AS rel_unsigned
  FROM L JOIN Z ON L.channel_id = Z.channel_id""")
def int_relative(spark, sf_dir):
    from ..functions.values import int_relative as rel, unsigned_relative
    s = lineitem_store(spark, sf_dir)
    zero = s.samples.filter("sample_idx = 0").select("channel_id", F.col("k").alias("k0"))
    u = F.lit("18446744073709000000").cast("decimal(20,0)")
    return s.samples.join(bounded(zero, s.n_channels), "channel_id").select(
        "channel_id", "sample_idx", rel("k", "k0").alias("rel"),
        unsigned_relative(F.col("k").cast("decimal(20,0)") + u, F.col("k0").cast("decimal(20,0)") + u).alias("rel_unsigned"))


@query("time_relative", f"""WITH {S}, T AS (SELECT channel_id, sample_idx, CASE WHEN sample_idx % 7 <> 0 THEN t_us * 1000 + sample_idx % 1000 END AS ns FROM S),
    Z AS (SELECT channel_id, arg_min(ns, sample_idx) FILTER (WHERE ns IS NOT NULL) AS z FROM T GROUP BY channel_id)
  SELECT T.channel_id, sample_idx, (ns - coalesce(z, 0)) / 1e9 AS s FROM T JOIN Z ON T.channel_id = Z.channel_id""")
def time_relative(spark, sf_dir):
    """Nanosecond timestamps (every 7th missing) as seconds since the first valid one."""
    from ..functions.values import time_relative as rel, time_zero
    s = event_store(spark, sf_dir)
    ns = F.when(F.col("sample_idx") % 7 != 0, F.col("t_us") * 1000 + F.col("sample_idx") % 1000)
    t = s.samples.select("channel_id", "sample_idx", ns.alias("ns"))
    return t.join(bounded(time_zero(t, "ns"), s.n_channels), "channel_id").select("channel_id", "sample_idx", rel("ns", "z").alias("s"))


@query("magnitude", f"WITH {L} SELECT channel_id, sample_idx, {rnd_sql('sqrt(v * v + q * q)')} AS mag FROM L")
def magnitude(spark, sf_dir):
    from ..functions.values import magnitude as mag
    s = lineitem_store(spark, sf_dir)
    return s.samples.select("channel_id", "sample_idx", rnd(mag("v", "q")).alias("mag"))


@query("clamp_inf", f"""WITH {S}, I AS (SELECT channel_id, sample_idx, CASE WHEN sample_idx % 89 = 3 THEN 'inf'::DOUBLE
    WHEN sample_idx % 101 = 4 THEN '-inf'::DOUBLE ELSE v END AS v FROM S),
  E AS (SELECT channel_id, min(v) FILTER (WHERE isfinite(v)) AS lo, max(v) FILTER (WHERE isfinite(v)) AS hi FROM I GROUP BY channel_id)
  SELECT I.channel_id, sample_idx, {rnd_sql("CASE WHEN v = 'inf'::DOUBLE THEN hi + 0.08 * (hi - lo) WHEN v = '-inf'::DOUBLE THEN lo - 0.08 * (hi - lo) ELSE v END")} AS y,
    CASE WHEN v = 'inf'::DOUBLE THEN 1 WHEN v = '-inf'::DOUBLE THEN -1 ELSE 0 END AS inf_mark
  FROM I JOIN E ON I.channel_id = E.channel_id""")
def clamp_inf(spark, sf_dir):
    from ..operators.axis import clamp_inf as clamp
    s = event_store(spark, sf_dir)
    return clamp(spiky(s.samples), s.n_channels).select("channel_id", "sample_idx", rnd("y").alias("y"), "inf_mark")
