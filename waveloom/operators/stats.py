"""Exact range statistics as mergeable states.

A state is (n, total, mn, mx, pv, dl, m2): count of present values, count of samples, minimum,
maximum, pivot (first finite value), mean - pivot, and the sum of squared deviations. Values are
taken relative to a reference of the channel before they are summed, so a small noise on a large
offset keeps full precision. NaN is ignored, +/-Inf takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded

STATE = ["n", "total", "mn", "mx", "pv", "dl", "m2"]
FAN_IN = 64  # states merged per group and round


def state_columns(v: str = "v", ref: str = "pivot", order: str = "sample_idx") -> list[Column]:
    """Aggregates that build one state; `ref` is any finite value near the data.

    All buffers are primitive, so Spark aggregates map-side in generated code.
    """
    x = f"CASE WHEN NOT isnan({v}) THEN {v} END"
    d = f"({x}) - coalesce({ref}, 0D)"
    return [F.expr(e) for e in (
        f"count({x}) AS n", "count(1) AS total", f"min({x}) AS mn", f"max({x}) AS mx",
        f"min_by({v}, {order}) FILTER (WHERE abs({v}) < double('Infinity')) AS pv",
        f"avg({d}) AS _avg", f"var_pop({d}) AS _var", f"first({ref}, true) AS _ref")]


def close_state(df: DataFrame, keys: list[str]) -> DataFrame:
    """Turn the aggregates of `state_columns` into the stored state."""
    return df.selectExpr(
        *keys, "n", "total", "mn", "mx", "coalesce(pv, 0D) AS pv",
        "_avg - (coalesce(pv, 0D) - coalesce(_ref, 0D)) AS dl", "coalesce(_var * n, 0D) AS m2")


def with_pivot(samples: DataFrame, channels: DataFrame, n_channels: int | None) -> DataFrame:
    """Attach the channel's pivot (from the catalog) to its samples."""
    return samples.join(bounded(channels.select("channel_id", "pivot"), n_channels), "channel_id")


def raw_states(samples: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """States of the samples per key; samples carry `pivot`. One pass, partial aggregation."""
    return close_state(samples.groupBy(*keys).agg(*state_columns(v)), keys)


def merge_once(states: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Merge the states of each key relative to the pivot of the first non-empty one.

    Only for groups of bounded size (see `merge_states`): the states of a group become one array.
    """
    part = f"named_struct('o', {order}, 'n', double(n), 'pv', pv, 'dl', dl, 'm2', m2)"
    out = states.groupBy(*keys).agg(*[F.expr(e) for e in (
        "sum(n) AS n", "sum(total) AS total", "min(mn) AS mn", "max(mx) AS mx",
        f"array_sort(collect_list({part}) FILTER (WHERE n > 0)) AS _s")])
    mean = "(s.pv - _s[0].pv) + s.dl"  # of a state, relative to the first pivot
    out = out.selectExpr("*", f"aggregate(_s, 0D, (a, s) -> a + s.n * ({mean})) / nullif(double(n), 0D) AS _em")
    spread = f"aggregate(_s, 0D, (a, s) -> a + s.m2 + s.n * power(({mean}) - _em, 2))"
    return out.selectExpr(*keys, "n", "total", "mn", "mx", "coalesce(try_element_at(_s, 1).pv, 0D) AS pv", "_em AS dl",
                          f"CASE WHEN n > 0 THEN {spread} ELSE 0D END AS m2")


def merge_states(states: DataFrame, keys: list[str], order: str, span: int) -> DataFrame:
    """Merge any number of states per key in a tree of groups of FAN_IN states.

    order: position of a state in its key (0 <= order < span), e.g. the bucket number. A hot key
    is spread over span / FAN_IN groups in the first round, so no task sees all its states.
    """
    while span > FAN_IN:
        states = merge_once(
            states.withColumn(order, F.floor(F.col(order) / FAN_IN)), [*keys, order], order)
        span = -(-span // FAN_IN)
    return merge_once(states, keys, order)


def with_statistics(states: DataFrame) -> DataFrame:
    """Mean, sample standard deviation, RMS, peak-to-peak and NaN count of each state.

    Undefined results (no samples; n < 2 for std) are NULL.
    """
    has_inf = "abs(mn) = double('Infinity') OR abs(mx) = double('Infinity')"
    return states.selectExpr("*", "CASE WHEN n > 0 THEN pv + dl END AS mean").selectExpr(
        "*", "CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) END AS std",
        f"CASE WHEN n > 0 THEN CASE WHEN {has_inf} THEN double('Infinity') ELSE sqrt(mean * mean + m2 / n) END END AS rms",
        "mx - mn AS p2p", "total - n AS n_nan")


def range_stats(samples: DataFrame, channels: DataFrame, i0: int | None = None, i1: int | None = None,
                n_channels: int | None = None) -> DataFrame:
    """Statistics of samples [i0, i1) of each channel, from the raw samples."""
    if i0 is not None:
        samples = samples.filter(F.col("sample_idx") >= i0)
    if i1 is not None:
        samples = samples.filter(F.col("sample_idx") < i1)
    states = raw_states(with_pivot(samples, channels, n_channels), ["channel_id"])
    return with_statistics(all_channels(states, channels, n_channels))


def all_channels(states: DataFrame, channels: DataFrame, n_channels: int | None = None) -> DataFrame:
    """Add the empty state for channels without samples in the range."""
    return channels.select("channel_id").join(bounded(states, n_channels), "channel_id", "left").fillna(
        {"n": 0, "total": 0, "m2": 0.0, "pv": 0.0})


def integer_stats(samples: DataFrame, zero: DataFrame, k: str = "k", n_channels: int | None = None) -> DataFrame:
    """Statistics of a 64-bit integer channel: exact integer min/max, mean with the offset added back.

    zero: channel_id, k0 (the first sample of each channel).
    """
    rel = (F.col(k) - F.col("k0")).cast("double")
    out = samples.join(bounded(zero, n_channels), "channel_id").groupBy("channel_id").agg(
        F.first("k0").alias("k0"), F.count(k).alias("n"), F.min(k).alias("mn"), F.max(k).alias("mx"),
        F.avg(rel).alias("_rel"), F.var_pop(rel).alias("_var"))
    mean = F.col("k0").cast("double") + F.col("_rel")
    return out.select(
        "channel_id", "n", "mn", "mx", mean.alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(F.col("_var") * F.col("n") / (F.col("n") - 1))).alias("std"),
        F.sqrt(mean * mean + F.col("_var")).alias("rms"))
