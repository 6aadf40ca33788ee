"""Value conversion: everything becomes a DOUBLE with the NaN / Inf rules of the engine.

NaN (and NULL) is "missing" and excluded; +/-Inf is a value. Spark orders NaN above every number
and lets it poison max/avg/stddev, so every aggregate goes through `present`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

INF = float("inf")
NS_PER_S = 1_000_000_000

# Seconds from 1904-01-01 to 1970-01-01, and the whole seconds since 1904
# whose nanoseconds fit a signed 64-bit epoch.
EPOCH_1904_S = 2_082_844_800
NS_MIN_S = -9_223_372_036 + EPOCH_1904_S
NS_MAX_S = 9_223_372_035 + EPOCH_1904_S


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(v: str | Column) -> Column:
    """True for finite values; false for NaN (which Spark orders above Inf), Inf and NULL."""
    return F.coalesce(F.abs(_col(v)) < F.lit(INF), F.lit(False))


def present(v: str | Column) -> Column:
    """The value, or NULL where it is NaN."""
    v = _col(v)
    return F.when(~F.isnan(v), v)


def to_double(v: str | Column) -> Column:
    """Plot value of a float, integer or boolean column."""
    return _col(v).cast("double")


def int_relative(v: str | Column, zero: str | Column) -> Column:
    """64-bit integers relative to the first sample: exact differences before the cast."""
    return (_col(v) - _col(zero)).cast("double")


def unsigned_relative(v: str | Column, zero: str | Column) -> Column:
    """Unsigned 64-bit values, held as DECIMAL(20,0), relative to the first sample."""
    return (_col(v).cast("decimal(20,0)") - _col(zero).cast("decimal(20,0)")).cast("double")


def time_relative(ns: str | Column, zero_ns: str | Column) -> Column:
    """Seconds since the first valid timestamp."""
    return (_col(ns) - _col(zero_ns)) / F.lit(1e9)


def time_zero(samples: DataFrame, ns: str) -> DataFrame:
    """channel_id, z: the first valid time of each channel over all its samples, 0 without one (partially aggregated)."""
    return samples.groupBy("channel_id").agg(F.coalesce(F.min_by(ns, F.when(F.col(ns).isNotNull(), F.col("sample_idx"))), F.lit(0)).alias("z"))


def magnitude(re: str | Column, im: str | Column) -> Column:
    return F.hypot(_col(re), _col(im))


def epoch1904_ns(seconds: str | Column, fractions: str | Column) -> Column:
    """(seconds since 1904, 2^-64 s fractions) to epoch nanoseconds, rounded to the nearest.

    `fractions` is DECIMAL(20,0). NULL outside the range of a 64-bit nanosecond epoch.
    """
    sec, frac = _col(seconds), _col(fractions).cast("decimal(20,0)")
    scaled = (frac * F.lit(NS_PER_S).cast("decimal(10,0)")
              + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(38,0)")
    ns = F.call_function("div", scaled, F.lit("18446744073709551616").cast("decimal(20,0)")).cast("bigint")
    inside = sec.between(NS_MIN_S, NS_MAX_S)
    safe = F.when(inside, sec).otherwise(F.lit(EPOCH_1904_S))
    return F.when(inside, (safe - EPOCH_1904_S) * NS_PER_S + ns)


def floor_pow2(v: str | Column) -> Column:
    """Largest power of two <= v (1 below 2), from the bit length: exact where log2 is not."""
    v = _col(v)
    whole = F.greatest(F.coalesce(F.floor(v).cast("bigint"), F.lit(1)), F.lit(1))
    one = F.lit(1).cast("bigint")
    return F.call_function("shiftleft", one, F.length(F.bin(whole)) - 1)


# Windows-1252 characters of the bytes 0x80 to 0x9F; the bytes 0x81, 0x8D, 0x8F,
# 0x90 and 0x9D are not assigned.
CP1252_UNDEFINED = "\x81\x8d\x8f\x90\x9d"
CP1252_FROM = ("\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
               "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f")
CP1252_TO = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def decode_text(raw: str | Column) -> Column:
    """BINARY to text: UTF-8, else Windows-1252, else Latin-1. Struct of (text, is_utf8)."""
    raw = _col(raw)
    valid = F.is_valid_utf8(raw.cast("string"))
    latin = F.decode(raw, "iso-8859-1")
    odd = F.translate(latin, CP1252_UNDEFINED, "") != latin
    fallback = F.when(odd, latin).otherwise(F.translate(latin, CP1252_FROM, CP1252_TO))
    return F.struct(F.when(valid, raw.cast("string")).otherwise(fallback).alias("text"),
                    valid.alias("is_utf8"))


# Classes of 80-bit values.
_ZERO, _NORMAL, _INFINITE, _INVALID = range(4)


def decode_extended(raw: np.ndarray) -> np.ndarray:
    """80-bit extended floats in rows of 16 little-endian bytes to float64.

    The value is (-1)^sign * significand * 2^(exponent - bias), the significand a fixed-point number with 63 binary places. It is
    taken as two exact halves of 32 bits. NaN for not-a-numbers, for numbers without their integer bit and for rows whose last
    six bytes are not zero.
    """
    words = np.ascontiguousarray(raw).view("<u4").reshape(-1, 4)
    low, high = words[:, 0], words[:, 1]
    sign_exponent = (words[:, 2] & 0xFFFF).astype(np.int64)
    padding = (words[:, 2] >> 16) | words[:, 3]
    power = sign_exponent % 0x8000
    leading, rest = high >> 31 == 1, (high << 1 != 0) | (low != 0)
    kind = np.select([padding != 0, power == 0x7FFF, power == 0, leading],
                     [_INVALID, np.where(leading & ~rest, _INFINITE, _INVALID), _ZERO, _NORMAL], _INVALID)
    with np.errstate(over="ignore", under="ignore"):
        # Rounded once to 53 bits while in range, then scaled; numbers near zero have the power of the smallest normal.
        significand = high.astype(np.float64) * 2.0 ** 32 + low.astype(np.float64)
        size = np.ldexp(significand, np.maximum(power, 1) - 16383 - 63)
    value = np.select([kind == _INFINITE, kind == _INVALID], [np.inf, np.nan], size)
    return np.copysign(value, np.where(sign_exponent >= 0x8000, -1.0, 1.0))


@F.pandas_udf(DoubleType())
def _extended_udf(raw: pd.Series) -> pd.Series:
    if raw.empty:
        return pd.Series([], dtype="float64")
    block = np.frombuffer(b"".join(bytes(b) for b in raw), dtype=np.uint8).reshape(-1, 16)
    return pd.Series(decode_extended(block))


def extended_to_double(raw: str | Column) -> Column:
    """Decoder for a BINARY(16) column of 80-bit extended floats; bad values are NaN (Arrow hands them back as NULL)."""
    raw = _col(raw)
    value = _extended_udf(F.coalesce(raw, F.unhex(F.lit("00" * 16))))
    return F.when(raw.isNotNull(), F.coalesce(value, F.lit(float("nan"))))
