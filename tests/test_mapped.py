"""Channels over X channels of any order, partial rollups and typed values, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from signals import brute, catalog, frame, signal

from waveloom.operators.rollup import build_rollup
from waveloom.plans import mapped
from waveloom.session import new_path, settle

N, BASE = 3000, 4


@pytest.fixture(scope="module")
def plant(spark):
    """y channels over a formula, a sorted X channel with flat parts, an unsorted one, and one of another length."""
    rng = np.random.default_rng(21)
    ys = {c: signal("gaps", N, k) for k, c in enumerate(["line", "curve", "loop", "odd"])}
    xs = {"up": np.sort(rng.integers(0, 900, N) / 3.0), "round": np.sin(np.arange(N) / 40.0) * 100, "short": np.arange(N - 1.0)}
    xs["round"][50] = np.nan
    samples, points = settle(frame(spark, ys), "ys"), settle(frame(spark, xs), "xs")
    channels, x_cat = settle(catalog(spark, ys), "ycat"), settle(catalog(spark, xs), "xcat")
    buckets = build_rollup(spark, samples, channels, new_path(spark, "ybuckets"), BASE, 4)
    x_buckets = build_rollup(spark, points, x_cat, new_path(spark, "xbuckets"), BASE, 3)
    maps = spark.createDataFrame([("line", N, "linear", -5.0, 0.1, None), ("curve", N, "sorted", None, None, "up"), ("loop", N, "unsorted", None, None, "round"),
                                  ("odd", N, "sorted", None, None, "short")], "channel_id string, length bigint, map string, x0 double, dx double, x_channel_id string")
    x = mapped.XChannels(points.withColumnRenamed("v", "x"), x_buckets, x_cat.select("channel_id", "length"), BASE, 3)
    return ys, {"line": -5.0 + np.arange(N) * 0.1, "curve": xs["up"], "loop": xs["round"]}, samples, channels, buckets, maps, x


def test_statistics_of_an_x_range(spark, plant):
    ys, xs, samples, channels, buckets, maps, x = plant
    for xa, xb in [(10.0, 120.5), (99.9, 100.0), (1e6, 2e6)]:
        for rollup in (buckets, None):
            got = {r["channel_id"]: r for r in mapped.stats_mapped(samples, rollup, channels, maps, x, xa, xb, BASE, 4).collect()}
            assert sorted(got) == ["curve", "line", "loop"]  # the X channel of `odd` has another length
            for c, at in xs.items():
                want = brute(ys[c][(at >= xa) & (at <= xb)])
                assert got[c]["n"] == want["n"], (c, xa)
                if want["n"]:
                    assert (got[c]["mn"], got[c]["mx"]) == (want["mn"], want["mx"]) and abs(got[c]["mean"] - want["mean"]) < 1e-9


@pytest.mark.parametrize("share", [1.0, 0.5, 0.0])
def test_plot_with_a_rollup_that_is_being_built(spark, plant, share):
    ys, xs, samples, channels, buckets, maps, x = plant
    part = buckets.filter(F.expr(f"(bucket + 1) * {BASE} * power(8, level) <= {int(N * share)} OR {share} = 1.0"))
    got = mapped.plot_mapped(samples, part, channels, maps, x, 20.0, 250.0, 16, BASE, 4).collect()
    assert {(r["channel_id"], r["complete"]) for r in got} == {(c, share == 1.0) for c in ("line", "curve")}
    for c in ("line", "curve"):
        at = xs[c]
        i0, i1 = max(0, int(np.searchsorted(at, 20.0, "left")) - 1), min(N, int(np.searchsorted(at, 250.0, "right")) + 1)
        rows = sorted((r for r in got if r["channel_id"] == c), key=lambda r: (r["bucket"], r["ord"]))
        b = 1 << int(np.log2((i1 - i0) / 16))
        if c == "curve":
            assert [r["bucket"] for r in rows if r["ord"] == 0] == list(range(i0 // b, (i1 - 1) // b + 1))
        for r in rows:
            if r["ord"] < 2 and c == "curve":
                lo, hi = max(i0, r["bucket"] * b), min(i1, (r["bucket"] + 1) * b)
                v = ys[c][lo:hi]
                v = v[~np.isnan(v)]
                assert (np.isnan(r["y"]) and not len(v)) or r["y"] == (v.min() if r["ord"] == 0 else v.max())
                assert abs(r["x"] - np.interp((lo + hi) / 2, np.arange(N), at)) < 1e-9


def test_few_samples_are_drawn_as_they_are(spark, plant):
    ys, xs, samples, channels, buckets, maps, x = plant
    got = mapped.plot_mapped(samples, buckets, channels, maps, x, 100.0, 100.4, 16, BASE, 4).collect()
    for c in ("line", "curve"):
        at = xs[c]
        i0, i1 = max(0, int(np.searchsorted(at, 100.0 - 1e-12 if c == "line" else 100.0)) - 1), min(N, int(np.searchsorted(at, 100.4, "right")) + 1)
        rows = {r["bucket"]: r for r in got if r["channel_id"] == c}
        assert set(range(i0 + 1, i1 - 1)) <= set(rows) and all(r["x"] == at[i] and (r["y"] == ys[c][i] or np.isnan(ys[c][i])) for i, r in rows.items())


def test_cursors(spark, plant):
    ys, xs, samples, channels, buckets, maps, x = plant
    cursors = [100.0, 33.4, -5.04, 1e7]
    got = {(r["channel_id"], r["cursor_no"]): (r["sample_idx"], r["x"]) for r in mapped.cursors_mapped(samples, maps, x, cursors, n_channels=4).collect()}
    for k, q in enumerate(cursors, 1):
        d = np.abs(xs["loop"] - q)
        i = int(np.nanargmin(d))
        assert got["loop", k] == (i, xs["loop"][i])  # an X-Y curve always has a nearest sample
        at = xs["curve"]
        k0 = int(np.searchsorted(at, q))
        if q == 1e7 or q < at[0]:
            assert ("curve", k) not in got
        else:
            i = k0 - 1 if k0 == N or (k0 and abs(at[k0 - 1] - q) <= abs(at[k0] - q)) else k0
            assert got["curve", k] == (i, at[i])
    assert got["line", 1][0] == 1050 and got["line", 3][0] == 0 and ("line", 4) not in got


def test_typed_statistics_are_exact(spark):
    big = 2**62 + 1
    ints = spark.createDataFrame([("a", i, big + i) for i in range(5)], "channel_id string, sample_idx bigint, v bigint")
    r = mapped.stats_typed(ints, "int").first()
    assert (int(r["mn_exact"]), int(r["mx_exact"]), r["p2p"], r["n"]) == (big, big + 4, 4.0, 5) and abs(r["std"] - np.std(np.arange(5), ddof=1)) < 1e-12
    unsigned = ints.selectExpr("channel_id", "sample_idx", "cast(v as decimal(20,0)) * 2 as v").selectExpr("channel_id", "sample_idx", "cast(v as decimal(20,0)) as v")
    assert int(mapped.stats_typed(unsigned, "uint64").first()["mx_exact"]) == 2 * (big + 4)
    times = spark.createDataFrame([("a", 0, None), ("a", 1, big), ("a", 2, big + 1), ("a", 3, big + 3)], "channel_id string, sample_idx bigint, v bigint")
    r = mapped.stats_typed(times, "time").first()
    assert (r["mn"], r["n"], r["n_nan"]) == (0.0, 3, 1) and abs(r["mx"] - 3e-9) < 1e-20
    flags = spark.createDataFrame([("a", i, i % 4 == 0) for i in range(8)], "channel_id string, sample_idx bigint, v boolean")
    assert mapped.stats_typed(flags, "bool").first()["mean"] == 0.25
    ranges = spark.createDataFrame([("a", 1, 3)], "channel_id string, i0 bigint, i1 bigint")
    r = mapped.stats_typed(ints, "int", ranges).first()
    assert (r["n"], int(r["mn_exact"])) == (2, big + 1)
    pairs = spark.createDataFrame([("a", 0, (3.0, 4.0)), ("a", 1, (0.0, float("nan")))], "channel_id string, sample_idx bigint, v struct<re: double, im: double>")
    r = mapped.stats_typed(pairs, "complex").first()
    assert (r["mx"], r["n"], r["n_nan"], r["mn_exact"]) == (5.0, 1, 1, None)
