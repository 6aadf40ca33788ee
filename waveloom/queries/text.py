"""Value conversion and text functions over whole tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import text as tx
from ..functions import values as val
from ..sources.tables import epoch_us, table
from .base import rnd, rnd_sql

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = ", ".join(_KEYS)


@query("epoch1904_ns", """WITH T AS (SELECT event_id, CASE WHEN event_id % 50 = 7 THEN 1099511627776 WHEN event_id % 50 = 8 THEN -10000000000 ELSE epoch_us(ts) // 1000000 + 2082844800 END AS sec,
    (event_id::HUGEINT * 18446744073709551::HUGEINT * 977) % 18446744073709551616::HUGEINT AS frac FROM events)
  SELECT event_id, CASE WHEN sec BETWEEN -7140527236 AND 11306216835 THEN ((sec - 2082844800) * 1000000000 + (frac * 1000000000 + 9223372036854775808::HUGEINT) // 18446744073709551616::HUGEINT)::BIGINT END AS ns FROM T""")
def epoch1904_ns(spark, sf_dir):
    m = F.col("event_id") % 50
    sec = F.when(m == 7, F.lit(1 << 40)).when(m == 8, F.lit(-10**10)).otherwise(
        F.call_function("div", epoch_us("ts"), F.lit(1_000_000)) + val.EPOCH_1904_S)
    frac = (F.col("event_id").cast("decimal(12,0)") * F.lit(str(18446744073709551 * 977)).cast("decimal(20,0)")) % F.lit("18446744073709551616").cast("decimal(20,0)")
    return table(spark, sf_dir, "events").select("event_id", val.epoch1904_ns(sec, frac).alias("ns"))


@query("text_decode", r"""WITH T AS (SELECT doc_id, regexp_replace(text, '[^\x{00}-\x{7F}\x{A0}-\x{FF}]', '?', 'g') AS t FROM documents)
  SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '€' || t ELSE t END AS text, doc_id % 3 = 0 OR (doc_id % 3 = 1 AND NOT regexp_matches(t, '[^\x{00}-\x{7F}]')) AS is_utf8 FROM T""")
def text_decode(spark, sf_dir):
    """Documents as UTF-8 bytes, as Latin-1 bytes and as Windows-1252 bytes."""
    t = F.regexp_replace("text", r"[^\x00-\x7F\xA0-\xFF]", "?")
    latin = F.encode(t, "iso-8859-1")
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode(t, "utf-8")).when(F.col("doc_id") % 3 == 1, latin).otherwise(F.concat(F.unhex(F.lit("80")), latin))
    return table(spark, sf_dir, "documents").select("doc_id", val.decode_text(raw).alias("d")).select("doc_id", "d.text", "d.is_utf8")


@F.pandas_udf(BinaryType())
def _to_extended(v: pd.Series) -> pd.Series:
    """Doubles as 80-bit extended floats in 16 bytes: the input of the decoder."""
    m, e = np.frexp(np.abs(v.to_numpy()))
    rows = np.zeros((len(v), 16), dtype=np.uint8)
    rows[:, 0:8] = np.ldexp(m, 64).astype(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
    head = np.where(v.to_numpy() == 0, 0, e + 16382) + np.where(v.to_numpy() < 0, 0x8000, 0)
    rows[:, 8:10] = head.astype("<u2").view(np.uint8).reshape(-1, 2)
    return pd.Series([r.tobytes() for r in rows])


@query("ext80", f"SELECT {_K}, l_extendedprice / 7 - 5000 AS v FROM lineitem")
def ext80(spark, sf_dir):
    raw = _to_extended(F.col("l_extendedprice") / 7 - 5000)
    return table(spark, sf_dir, "lineitem").select(*_KEYS, raw.alias("raw")).select(*_KEYS, val.extended_to_double("raw").alias("v"))


@query("iso_ns", """WITH T AS (SELECT event_id, CASE WHEN event_id % 100 = 3 THEN 'nan'::DOUBLE WHEN event_id % 100 = 4 THEN 1e13 ELSE 0.25::DOUBLE + (value * 1000.1::DOUBLE - 20000) END AS f FROM events),
  U AS (SELECT event_id, f, CASE WHEN isfinite(f) AND abs(f) < 9e9 THEN floor(f)::BIGINT END AS w FROM T),
  V AS (SELECT event_id, w, round_even((f - w) * 1e9, 0)::BIGINT AS ns FROM U)
  SELECT event_id, CASE WHEN w IS NULL OR abs(w + 1400000321) >= 9000000000 THEN '' ELSE strftime(make_timestamp((1400000321 + w + ns // 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad((ns % 1000000000)::VARCHAR, 9, '0') || 'Z' END AS t FROM V""")
def iso_ns(spark, sf_dir):
    m = F.col("event_id") % 100
    x = F.when(m == 3, F.lit(float("nan"))).when(m == 4, F.lit(1e13)).otherwise(F.col("value") * 1000.1 - 20000)
    return table(spark, sf_dir, "events").select("event_id", tx.iso_ns(F.lit(1400000321), F.lit(0.25), x).alias("t"))


@query("fmt_duration", f"""WITH T AS (SELECT {_K}, l_extendedprice / 7 - 3000 AS s FROM lineitem), U AS (SELECT *, round_even(abs(s) * 1000, 0)::BIGINT AS k FROM T)
  SELECT {_K}, CASE WHEN s < 0 THEN '-' ELSE '' END || CASE WHEN k >= 3600000 THEN printf('%02d:', k // 3600000) ELSE '' END || printf('%02d:%02d', k // 60000 % 60, k // 1000 % 60) || printf('.%03d', k % 1000) AS t FROM U""")
def fmt_duration(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_KEYS, tx.format_duration(F.col("l_extendedprice") / 7 - 3000, 3).alias("t"))


@query("fmt_float", f"SELECT {_K}, (l_extendedprice / 7)::VARCHAR AS a, l_extendedprice::VARCHAR AS b FROM lineitem")
def fmt_float(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_KEYS, tx.format_float(F.col("l_extendedprice") / 7).alias("a"), tx.format_float("l_extendedprice").alias("b"))


@query("fmt_local_time", """SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S.%f') || CASE WHEN event_id % 1000 <> 0 THEN lpad((event_id % 1000)::VARCHAR, 3, '0') ELSE '' END || '+05:30' AS t FROM events""")
def fmt_local_time(spark, sf_dir):
    ns = epoch_us("ts") * 1000 + F.col("event_id") % 1000
    return table(spark, sf_dir, "events").select("event_id", tx.format_local_time(ns, "+05:30").alias("t"))


@query("fmt_value", f"""SELECT {_K}, CASE WHEN l_quantity > 25 THEN 'true' ELSE 'false' END AS b, l_partkey::VARCHAR AS i, l_extendedprice::VARCHAR AS f,
  l_extendedprice::VARCHAR || CASE WHEN l_discount - 0.05 >= 0 THEN '+' ELSE '-' END || abs(l_discount - 0.05::DOUBLE)::VARCHAR || 'j' AS c,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') || '+00:00' AS t, '"' || l_returnflag || ',' || l_linestatus || '"' AS s FROM lineitem""")
def fmt_value(spark, sf_dir):
    """Display text of each kind, and a quoted CSV cell."""
    return table(spark, sf_dir, "lineitem").select(
        *_KEYS, tx.format_bool(F.col("l_quantity") > 25).alias("b"), F.col("l_partkey").cast("string").alias("i"), tx.format_float("l_extendedprice").alias("f"),
        tx.format_complex("l_extendedprice", F.col("l_discount") - 0.05).alias("c"), tx.format_local_time(epoch_us("l_shipdate") * 1000).alias("t"),
        tx.csv_cell(F.concat("l_returnflag", F.lit(","), "l_linestatus")).alias("s"))


@query("fmt_compact", f"SELECT {_K}, printf('%.6g', l_extendedprice * l_quantity) AS a, printf('%.7g', l_discount / 7000) AS b FROM lineitem")
def fmt_compact(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        *_KEYS, tx.format_compact(F.col("l_extendedprice") * F.col("l_quantity")).alias("a"), tx.format_compact(F.col("l_discount") / 7000, 7).alias("b"))


@query("time_split", f"""WITH T AS (SELECT event_id, 0.75::DOUBLE + (value - 60) AS f FROM events)
  SELECT event_id, 1704067200 + floor(f)::BIGINT AS sec, f - floor(f) AS frac, strftime(make_timestamp((1704067200 + floor(f)::BIGINT) * 1000000 + round_even((f - floor(f)) * 1000, 0)::BIGINT * 1000), '%H:%M:%S.%g') AS label FROM T""")
def time_split(spark, sf_dir):
    sec, frac = tx.time_split(F.lit(1704067200), F.lit(0.75), F.col("value") - 60)
    label = tx.time_label(F.lit(1704067200), F.lit(0.75), F.col("value") - 60, 3)
    return table(spark, sf_dir, "events").select("event_id", sec.alias("sec"), frac.alias("frac"), label.alias("label"))


@query("human_bytes", f"""WITH T AS (SELECT {_K}, (l_orderkey * l_partkey * l_suppkey)::DOUBLE * l_linenumber * l_linenumber AS n FROM lineitem)
  SELECT {_K}, CASE WHEN n < 1000 THEN printf('%.0f B', n) WHEN n / 1000 < 1000 THEN printf('%.1f kB', n / 1000) WHEN n / 1000 / 1000 < 1000 THEN printf('%.1f MB', n / 1000 / 1000)
    WHEN n / 1000 / 1000 / 1000 < 1000 THEN printf('%.1f GB', n / 1000 / 1000 / 1000) ELSE printf('%.1f TB', n / 1000 / 1000 / 1000 / 1000) END AS t FROM T""")
def human_bytes(spark, sf_dir):
    n = (F.col("l_orderkey") * F.col("l_partkey") * F.col("l_suppkey")).cast("double") * F.col("l_linenumber") * F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(*_KEYS, tx.human_bytes(n).alias("t"))


@query("calendar_bucket", f"""WITH T AS (SELECT event_type AS channel_id, value AS v, epoch_us(ts) // 1000000 - 10800 AS local FROM events)
  SELECT channel_id, 'h' AS step, make_timestamp((local - local % 10800) * 1000000) AS bucket, count(*) AS n, {rnd_sql('max(v)')} AS mx FROM T GROUP BY channel_id, bucket
  UNION ALL SELECT channel_id, 'd', make_timestamp((local // 86400 - (local // 86400 + 719163) % 2) * 86400 * 1000000) AS bucket, count(*), {rnd_sql('max(v)')} FROM T GROUP BY channel_id, bucket""")
def calendar_bucket(spark, sf_dir):
    """Maximum per local 3-hour and 2-day bucket at UTC-3; the steps come from the wanted widths."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel_id"), F.col("value").alias("v"), "ts")

    def by(name, want):
        bucket = tx.calendar_bucket("ts", tx.calendar_step(want), "-03:00").alias("bucket")
        return ev.groupBy("channel_id", bucket).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("mx")).select(
            "channel_id", F.lit(name).alias("step"), "bucket", "n", rnd("mx").alias("mx"))

    return by("h", 9000.0).unionByName(by("d", 100000.0))
