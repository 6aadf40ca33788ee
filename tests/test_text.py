"""Texts and conversions."""

import datetime as dt
import math
import struct
from fractions import Fraction
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.functions import text as tx
from waveloom.functions import values as val

INF, NAN = float("inf"), float("nan")


def one(spark, col):
    return spark.range(1).select(col.alias("c")).first()[0]


def each(spark, values, ddl, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}").select("i", fn(F.col("v")).alias("c"))
    return [r["c"] for r in rows.orderBy("i").collect()]


def _clock(units: int, decimals: int) -> str:
    """Text of a whole number of 10^-decimals seconds."""
    sign, units = "-" if units < 0 else "", abs(units)
    seconds, part = divmod(units, 10 ** decimals)
    minutes, s = divmod(seconds, 60)
    h, m = divmod(minutes, 60)
    text = (f"{h:02d}:" if h else "") + f"{m:02d}:{s:02d}"
    return sign + text + (f".{part:0{decimals}d}" if decimals else "")


@pytest.mark.parametrize("decimals", [0, 1, 2, 3, 6])
def test_duration_of_whole_units(spark, decimals):
    rng = np.random.default_rng(decimals)
    units = [int(u) for u in np.concatenate([rng.integers(-10**7, 10**7, 40), [0, 1, 10**decimals * 60 - 1, 10**decimals * 3600, 10**decimals * 86_400 * 5]])]
    got = each(spark, [u / 10**decimals for u in units], "double", lambda c: tx.format_duration(c, decimals))
    assert got == [_clock(u, decimals) for u in units]


def test_duration_carries_and_not_a_number(spark):
    for whole in (7, 60, 3600):  # just below a whole second: rounds up and carries
        assert one(spark, tx.format_duration(F.lit(whole - 1e-7), 4)) == _clock(whole * 10**4, 4)
    assert each(spark, [NAN, INF, -INF], "double", lambda c: tx.format_duration(c, 2)) == ["NaN", "Inf", "-Inf"]


def _iso(ns: int) -> str:
    seconds, part = divmod(ns, 10**9)
    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S") + f".{part:09d}Z"


def test_iso_times_exact_to_the_nanosecond(spark):
    rng = np.random.default_rng(4)
    base = int(rng.integers(10**9, 2 * 10**9))
    # Multiples of 2^-9 s are exact in binary and a whole number of nanoseconds.
    xs = [int(k) / 512 for k in rng.integers(-10**6, 10**6, 30)]
    got = each(spark, xs, "double", lambda c: tx.iso_ns(F.lit(base), F.lit(0.125), c))
    assert got == [_iso(base * 10**9 + 125_000_000 + int(x * 512) * 1_953_125) for x in xs]
    assert each(spark, [NAN, INF, 1e14], "double", lambda c: tx.iso_ns(F.lit(base), F.lit(0.0), c)) == ["", "", ""]


def test_float_text_is_the_shortest(spark):
    bits = np.random.default_rng(8).integers(0, 2**63, 200, dtype=np.uint64).view(np.float64)
    vs = [float(v) for v in bits] + [float(10.0**k) for k in range(-12, 23, 3)] + [-0.0, NAN, INF, -INF]
    want = ["NaN" if math.isnan(v) else "Inf" if v == INF else "-Inf" if v == -INF else repr(v) for v in vs]
    assert each(spark, vs, "double", tx.format_float) == want
    small = [float(np.float32(v)) for v in (0.3, 7.0, 2.5e-5, 6.25e20)]
    got = each(spark, small, "float", tx.format_float32)
    assert [np.float32(g) for g in got] == [np.float32(v) for v in small] and all(len(g) <= len(repr(v)) for g, v in zip(got, small))
    assert each(spark, [None], "double", tx.format_float) == [None]


def test_compact_and_sizes(spark):
    vs = [float(v) for v in np.random.default_rng(3).standard_normal(40) * 10.0 ** np.arange(-20, 20)]
    assert each(spark, vs, "double", tx.format_compact) == [f"{v:.6g}" for v in vs]
    assert each(spark, vs, "double", lambda c: tx.format_compact(c, 9)) == [f"{v:.9g}" for v in vs]
    assert each(spark, [NAN, -INF], "double", tx.format_compact) == ["NaN", "-Inf"]
    sizes = [0, 999, 1000, 1150, 1250, 1_000_000, 999_949_999, 5 * 10**15]
    names = ["0 B", "999 B", "1.0 kB", "1.1 kB", "1.2 kB", "1.0 MB", "999.9 MB", "5000.0 TB"]  # ties as the doubles 1.15 and 1.25 have them
    assert each(spark, sizes, "bigint", tx.human_bytes) == names
    plan = spark.range(5).select(tx.human_bytes("id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("zone", ["America/Halifax", "Asia/Kolkata"])
def test_local_time_follows_the_zone(spark, zone):
    rng = np.random.default_rng(2)
    instants = [int(v) for v in rng.integers(0, 2 * 10**18, 25)] + [-1]

    def want(ns):
        seconds, part = divmod(ns, 10**9)
        t = dt.datetime.fromtimestamp(seconds, ZoneInfo(zone))
        offset = t.strftime("%z")
        return t.strftime("%Y-%m-%d %H:%M:%S") + (f".{part:09d}" if part % 1000 else f".{part // 1000:06d}") + f"{offset[:3]}:{offset[3:]}"
    assert each(spark, instants, "bigint", lambda c: tx.format_local_time(c, zone)) == [want(n) for n in instants]
    assert each(spark, [None], "bigint", lambda c: tx.format_local_time(c, zone)) == ["NaT"]


@pytest.mark.parametrize("zone, text", [("UTC", "+00:00"), ("+05:30", "+05:30"), ("-03:15", "-03:15")])
def test_fixed_offsets_are_literals(spark, zone, text):
    instants = [0, -1, 1_700_000_000_123_456_789, 1_700_000_000_123_456_000]
    shift = (-1 if text[0] == "-" else 1) * (int(text[1:3]) * 3600 + int(text[4:]) * 60)

    def want(ns):
        t = dt.datetime.fromtimestamp(ns // 10**9 + shift, dt.UTC)
        part = ns % 10**9
        return t.strftime("%Y-%m-%d %H:%M:%S") + (f".{part:09d}" if part % 1000 else f".{part // 1000:06d}") + text
    assert each(spark, instants, "bigint", lambda c: tx.format_local_time(c, zone)) == [want(n) for n in instants]
    assert "from_utc_timestamp" not in spark.range(1).select(tx.format_local_time("id", zone))._jdf.queryExecution().optimizedPlan().toString()


def test_short_decimals_need_no_python(spark):
    vs = [0.1, -0.25, 1e-4, 9.9e-5, 123456.75, -20.0, 999999998.999999, 1e9, 0.1 + 0.2, -0.0, 0.0, 0.05 - 0.03, 1e16, 5e-324, 123456789.123456]
    assert each(spark, vs, "double", tx.format_float) == [repr(v) for v in vs]
    short = spark.createDataFrame([(v,) for v in vs], "v double").select(tx._short_decimal(F.col("v")).alias("d")).collect()
    assert [r["d"] is not None for r in short] == [1e-4 <= abs(v) < 999999999 and round(v, 6) == v for v in vs]


def test_calendar_buckets_follow_the_wall_clock(spark):
    zone = ZoneInfo("America/Halifax")
    start = int(dt.datetime(2025, 3, 8, tzinfo=zone).timestamp())  # the clock is put forward a day later
    instants = [start + k * 5400 for k in range(40)]
    local = [dt.datetime.fromtimestamp(t, zone) for t in instants]
    got = each(spark, instants, "bigint", lambda c: tx.calendar_bucket(F.timestamp_seconds(c), 86_400, "America/Halifax").cast("string"))
    assert got == [t.strftime("%Y-%m-%d 00:00:00") for t in local]
    got = each(spark, instants, "bigint", lambda c: tx.calendar_bucket(F.timestamp_seconds(c), 21_600, "America/Halifax").cast("string"))
    assert got == [f"{t:%Y-%m-%d} {t.hour // 6 * 6:02d}:00:00" for t in local]
    steps = [tx.calendar_step(w) for w in np.geomspace(0.5, 3e6, 60)]
    assert steps == sorted(steps) and all(s >= w for s, w in zip(steps, np.geomspace(0.5, 3e6, 60)) if w <= 86_400)


def test_complex_bool_and_cells(spark):
    pairs = [((8.25, -0.5), "8.25-0.5j"), ((-3.0, 4.0), "-3.0+4.0j"), ((NAN, 2.0), "NaN+2.0j"), ((INF, -INF), "Inf-Infj")]
    for (re, im), want in pairs:
        assert one(spark, tx.format_complex(F.lit(re), F.lit(im))) == want
    assert each(spark, [True, False], "boolean", tx.format_bool) == ["true", "false"]
    assert each(spark, ["plain", "semi;x", "one,two", 'say "hi"', "up\ndown"], "string", tx.csv_cell) == ["plain", "semi;x", '"one,two"', '"say ""hi"""', '"up\ndown"']


def test_time_label_carries(spark):
    assert one(spark, tx.time_label(F.lit(3599), F.lit(0.75), F.lit(0.2499), 2)) == "01:00:00.00"
    assert one(spark, tx.time_label(F.lit(3599), F.lit(0.75), F.lit(0.2499), 0)) == "01:00:00"
    ns = 1_234_567_890_123_456_789
    assert one(spark, tx.iso_reference(F.lit(ns).cast("bigint"))) == _iso(ns)


def test_floor_pow2(spark):
    vs = [0.0, 1.0, 1.99, 2.0, 3.0, 1023.9, 1024.0, 2.0**53 + 2, -4.0]
    want = [1 if not v >= 2 else 1 << (int(v).bit_length() - 1) for v in vs]
    assert each(spark, vs, "double", val.floor_pow2) == want


def test_epoch_1904(spark):
    off, half = val.EPOCH_1904_S, 1 << 63
    secs = [0, off, -9_223_372_036 + off, 9_223_372_035 + off, -9_223_372_037 + off, 2**40, -10**10]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(secs)], "i int, s bigint")
    for frac in (half, 0, (1 << 64) - 1, 18446744073):
        got = [r[0] for r in rows.orderBy("i").select(val.epoch1904_ns("s", F.lit(str(frac)).cast("decimal(20,0)"))).collect()]
        ns = (frac * 10**9 + (1 << 63)) >> 64
        want = [(s - off) * 10**9 + ns for s in secs[:4]] + [None] * 3
        assert got[:3] == want[:3] and got[4:] == want[4:], frac


def test_byte_text(spark):
    raws = [b"ascii", "Ärger ½".encode(), b"\xe9t\xe9", b"\x96 \x99", b"\x8d\xe9", b""]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raws)], "i int, v binary").select("i", val.decode_text("v").alias("d"))
    got = [(r["d"]["text"], r["d"]["is_utf8"]) for r in rows.orderBy("i").collect()]
    assert got == [("ascii", True), ("Ärger ½", True), ("été", False), ("– ™", False), ("\x8dé", False), ("", True)]


def _ext(mant, exp, sign=0, pad=b"\0" * 6):
    return struct.pack("<QH", mant, exp | sign << 15) + pad


def test_extended_floats(spark):
    rng, rows, want = np.random.default_rng(6), [], []
    for exp in [*rng.integers(15_400, 17_400, 200).tolist(), 1, 0x7FFE]:
        mant, sign = int(rng.integers(0, 1 << 63)) | 1 << 63, int(rng.integers(0, 2))
        try:
            v = float(Fraction(mant) * Fraction(2) ** (exp - 16383 - 63))
        except OverflowError:
            v = INF
        rows.append(_ext(mant, exp, sign))
        want.append(-v if sign else v)
    top = 1 << 63
    rows += [_ext(0, 0), _ext(top, 0x7FFF), _ext(top, 0x7FFF, 1), _ext(top | 9, 0x7FFF), _ext(7 << 60 & ~top, 16_000), _ext(top, 16_000, pad=b"\0" * 5 + b"\1")]
    want += [0.0, INF, -INF, NAN, NAN, NAN]
    got = each(spark, [bytearray(b) for b in rows], "binary", val.extended_to_double)
    assert np.array_equal(np.array(got), np.array(want), equal_nan=True)


def test_relative_values(spark):
    u = F.lit("18446744073709551615").cast("decimal(20,0)")
    assert one(spark, val.unsigned_relative(u, F.lit("18446744073709551610").cast("decimal(20,0)"))) == 5.0
    assert one(spark, val.int_relative(F.lit(2**62 + 3), F.lit(2**62))) == 3.0
    assert one(spark, val.magnitude(F.lit(3.0), F.lit(-4.0))) == 5.0
