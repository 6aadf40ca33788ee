"""X maps, ranges, cursors: brute force on small channels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signals import frame
from waveloom.operators import axis as ax
from waveloom.plans import plot

AXES = [("a", 2.5, 0.1, 0, 1000), ("b", -3.0, 0.001, 5, 700), ("c", 0.0, 1.0, 0, 0), ("d", 1e9, 1e-8, 0, 5000), ("e", 1.7e9, 1e-3, 0, 4000), ("f", 0.1, 0.1, 0, 64)]
SCHEMA = "channel_id string, x0 double, dx double, s bigint, e bigint"
VIEWS = [(2.5, 2.6), (0.0, 50.0), (-1e300, 1e300), (float("-inf"), 5.0), (10.05, 10.05), (3.0, 2.0), (1e9, 1e9 + 1e-6), (1e9 + 1e-7, 1e9 + 3e-7),
         (1.7e9 + 0.5, 1.7e9 + 1.25), (0.30000000000000004, 0.7), (0.3, 0.7000000000000001)]


@pytest.mark.parametrize("xa,xb", VIEWS)
def test_ranges_of_linear_axes(spark, xa, xb):
    axes = spark.createDataFrame(AXES, SCHEMA)
    inner = {r["channel_id"]: (r["i0"], r["i1"]) for r in ax.inner_range(axes, xa, xb).collect()}
    view = {r["channel_id"]: (r["i0"], r["i1"]) for r in ax.view_range(axes, xa, xb).collect()}
    for c, x0, dx, s, e in AXES:
        x = x0 + np.arange(s, e) * dx
        fa, fb = (xa - x0) / dx, (xb - x0) / dx
        if e <= s:
            want_in = want_view = (s, s)
        elif not (math.isfinite(fa) and math.isfinite(fb)):
            want_in = want_view = (s, e)
        else:
            i0 = s + int(np.searchsorted(x, xa, "left"))
            i1 = s + int(np.searchsorted(x, xb, "right"))
            want_in = (i0, max(i0, i1))
            want_view = (max(s, min(e, math.floor(fa) - 1)), max(s, min(e, math.ceil(fb) + 2)))
        assert inner[c] == want_in, (c, "inner")
        assert view[c] == want_view, (c, "view")


def test_inner_range_far_from_the_first_guess(spark):
    # The step is far below the resolution of x: millions of samples share one x.
    axes = spark.createDataFrame([("a", 1e9, 1e-15, 0, 1 << 40)], SCHEMA)
    x = lambda i: 1e9 + float(i) * 1e-15
    xa = float(np.nextafter(1e9, 2e9))
    r = ax.inner_range(axes, xa, xa).first()
    assert x(r["i0"] - 1) < xa <= x(r["i0"]) and x(r["i1"] - 1) <= xa < x(r["i1"]) and r["i1"] - r["i0"] > 10**6


def test_bad_increment_is_one_second(spark):
    rows = spark.createDataFrame([(0.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,), (0.5,)], "dx double")
    assert [r[0] for r in rows.select(ax.safe_step("dx")).collect()] == [1.0] * 5 + [0.5]


def test_nearest_linear_rounds_half_to_even_and_clamps(spark):
    axes = spark.createDataFrame([("a", 0.0, 1.0, 0, 10), ("z", 0.0, 1.0, 0, 0)], SCHEMA)
    rows = ax.nearest_linear(axes, [0.5, 1.5, 2.5, -7.0, 99.0]).filter("channel_id = 'a'").orderBy("cursor_no").collect()
    assert [r["sample_idx"] for r in rows] == [0, 2, 2, 0, 9]
    assert ax.nearest_linear(axes, [1.0]).filter("channel_id = 'z'").first()["sample_idx"] is None
    cov = ax.linear_covers(ax.at_cursors(axes, [-0.5, -0.51, 9.5, 9.51])).filter("channel_id = 'a'").orderBy("cursor_no").collect()
    assert [r["covered"] for r in cov] == [True, False, True, False]


def _points(spark, x):
    return frame(spark, {"a": np.asarray(x, float)}).withColumnRenamed("v", "x")


def _nearest_sorted(x, q):
    """A sample at the least distance: left of q before right of it, and of equal x the one next to q (at q itself the first)."""
    near = np.flatnonzero(np.abs(x - q) == np.abs(x - q).min())
    left = near[x[near] < q]
    return int(left[-1] if left.size else near[0])


def test_nearest_sorted_duplicates_and_ties(spark):
    x = np.array([0, 1, 1, 1, 2, 4, 4, 6, 7.5, 7.5])
    qs = [-5.0, 0.0, 0.5, 1.0, 1.4, 1.5, 3.0, 4.0, 5.0, 5.1, 6.75, 7.5, 100.0]
    rows = ax.nearest_sorted(_points(spark, x), qs).orderBy("cursor_no").collect()
    assert [r["sample_idx"] for r in rows] == [_nearest_sorted(x, q) for q in qs]
    assert [r["x"] for r in rows] == [x[_nearest_sorted(x, q)] for q in qs]


def test_nearest_unsorted_ignores_nan(spark):
    rng = np.random.default_rng(5)
    x = rng.permutation(500).astype(float)
    x[::17] = np.nan
    qs = [10.4, 33.0, 499.7, -3.0]
    rows = ax.nearest_unsorted(_points(spark, x), qs).orderBy("cursor_no").collect()
    assert [r["sample_idx"] for r in rows] == [int(np.nanargmin(np.abs(x - q))) for q in qs]
    assert ax.nearest_unsorted(_points(spark, [np.nan, np.nan]), [1.0]).count() == 0


def test_sorted_range_and_coverage(spark):
    x = np.array([0, 1, 1, 2, 4, 4, 6.0])
    pts = _points(spark, x)
    for xa, xb in [(1, 4), (1.5, 1.6), (-3, -1), (9, 12), (4, 1)]:
        r = ax.sorted_range(pts, xa, xb).first()
        i0, i1 = int(np.searchsorted(x, xa, "left")), int(np.searchsorted(x, xb, "right"))
        assert (r["i0"], r["i1"]) == (i0, max(i0, i1))
        assert (r["v0"], r["v1"]) == (max(0, i0 - 1), min(7, i1 + 1))
    qs = [-0.5, -0.6, 7.0, 7.1, 3.0]
    cov = ax.sorted_covers(pts, ax.nearest_sorted(pts, qs)).orderBy("cursor_no").collect()
    assert [r["covered"] for r in cov] == [True, False, True, False, True]


@pytest.mark.parametrize("x,want", [(np.full(9, 4.5), True), (np.arange(50) // 3, True), (np.append(np.arange(50), 48), False), ([-np.inf, 0, 1], False),
    ([5, 6, np.nan, np.nan], False), ([-1e300, -1e-300, 0, 1e-300], True)])
def test_monotonic(spark, x, want):
    assert ax.is_monotonic(_points(spark, x)).first()["monotonic"] is want


def test_monotonic_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ax, "ORDER_BLOCK", 8)
    x = np.arange(100.0)
    assert ax.is_monotonic(_points(spark, x)).first()["monotonic"]
    x[48:] -= 2.5  # a step back exactly at a block edge
    assert not ax.is_monotonic(_points(spark, x)).first()["monotonic"]


def test_interpolation_next_to_nan(spark):
    x = np.array([0.0, 2.0, np.nan, 5.0, np.inf, 8.0])
    want = {0.0: 0.0, 0.25: 0.5, 1.0: 2.0, 3.0: 5.0, 4.0: np.inf, 3.5: np.inf, 5.0: 8.0, 9.0: 8.0, -1.0: 0.0}
    req = spark.createDataFrame([("a", at, 6) for at in want] + [("a", 1.5, 6)], "channel_id string, at double, n bigint")
    got = {r["at"]: r["x"] for r in ax.interpolate_x(req, _points(spark, x)).collect()}
    assert np.isnan(got.pop(1.5))
    assert got == want


def test_auto_y_uses_neighbours_and_skips_nan(spark):
    v = np.array([0.0, 5.0, np.nan, -7.0, 1.0])
    axes = spark.createDataFrame([("a", 0.0, 1.0, 0, 5)], SCHEMA)
    s = frame(spark, {"a": v})
    assert tuple(ax.auto_y(s, axes, 0.2, 0.8).first()) == (0.0, 5.0)
    assert tuple(ax.auto_y(s, axes, 1.0, 4.0).first()) == (-7.0, 5.0)
    inf = frame(spark, {"a": np.array([np.inf, np.inf])})
    assert tuple(ax.auto_y(inf, spark.createDataFrame([("a", 0.0, 1.0, 0, 2)], SCHEMA), 0.0, 5.0).first()) == (None, None)


def test_inf_marks(spark):
    rows = {r["sample_idx"]: (r["y"], r["inf_mark"]) for r in ax.clamp_inf(frame(spark, {"a": np.array([1.0, np.inf, 3.0, -np.inf])})).collect()}
    assert rows[1] == (3.0 + 0.08 * 2, 1) and rows[3] == (1.0 - 0.08 * 2, -1) and rows[0] == (1.0, 0)
    flat = {r["sample_idx"]: r["y"] for r in ax.clamp_inf(frame(spark, {"a": np.array([5.0, np.inf])})).collect()}
    assert flat[1] == 5.0 + 0.08 * 5.0


def test_raw_view_and_fetch_window(spark):
    v = np.sin(np.arange(1000) / 20)
    s = frame(spark, {"a": v})
    axes = spark.createDataFrame([("a", 0.0, 1.0, 0, 1000)], SCHEMA)
    cat = spark.createDataFrame([("a", 1000, 0.0)], "channel_id string, length bigint, pivot double")
    pts = plot.plot_view(s, None, cat, axes, 100.0, 120.0, 16).orderBy("x").collect()
    assert [r["x"] for r in pts] == list(range(99, 122)) and [r["y"] for r in pts] == list(v[99:122])
    assert plot.plot_view(s, None, cat, axes, 5000.0, 6000.0, 16).count() in (0, 1)
    assert plot.fetch_window(0.0, 100.0, 1000) == (-25.0, 125.0, 1500)


def test_curves_of_other_length_are_left_out(spark):
    s = frame(spark, {"x": np.arange(10.0), "y": np.arange(10.0), "z": np.arange(9.0)})
    pairs = spark.createDataFrame([("y", "x", 10, 10), ("z", "x", 9, 10)], "channel_id string, x_channel_id string, y_length bigint, x_length bigint")
    got = plot.xy_plot(s, pairs, 2, 5000)
    assert got.select("channel_id").distinct().collect()[0][0] == "y" and got.count() == 10
    assert ax.xy_filter(got.withColumn("x", F.col("x")), 2.0, 4.0).count() == 3


def test_one_view_mixes_raw_envelope_and_rollup(spark):
    from signals import brute_envelope, catalog, signal
    from waveloom.functions.values import present
    from waveloom.operators.rollup import build_rollup
    from waveloom.session import new_path
    chans = {"raw": signal("ramp", 30), "mid": signal("gaps", 150), "long": signal("gaps", 9000)}
    samples, cat = frame(spark, chans).persist(), catalog(spark, chans)
    buckets = build_rollup(spark, samples, cat, new_path(spark, "view"), 16, 3)
    axes = spark.createDataFrame([(c, 0.0, 0.5, 0, len(v)) for c, v in chans.items()], SCHEMA)
    px, xa, xb = 16, 1.25, 4321.0
    modes = {r["channel_id"]: (r["mode"], r["b"]) for r in plot.plot_plan(axes, xa, xb, px, 16).collect()}
    assert modes == {"raw": ("raw", 1), "mid": ("envelope", 8), "long": ("rollup", 512)}
    pts = plot.plot_view(samples, buckets, cat, axes, xa, xb, px, 16, 3).withColumn("y", present("y")).collect()
    for c, v in chans.items():
        got = sorted((r["x"], r["ord"], r["y"]) for r in pts if r["channel_id"] == c)
        i0, i1 = 1, min(len(v), int(np.ceil(xb / 0.5)) + 2)
        if modes[c][0] == "raw":
            want = [(i * 0.5, 0, v[i]) for i in range(i0, i1)]
        else:
            want = []
            for _k, _lo, _hi, center, mn, mx, miss in brute_envelope(v, i0, i1, modes[c][1]):
                want += [(center * 0.5, 0, mn), (center * 0.5, 1, mx)] + ([(center * 0.5, 2, None)] if miss else [])
        assert [tuple(w) for w in got] == sorted(want, key=lambda t: t[:2]), c
