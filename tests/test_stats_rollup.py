"""Statistics, envelopes and the rollup against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signals import KINDS, assert_stats, brute_envelope, catalog, frame, signal
from waveloom.operators import rollup as roll
from waveloom.operators import stats as st
from waveloom.operators.envelope import envelope, envelope_points, xy_decimate
from waveloom.session import new_path
from waveloom.streaming.rollup import batch_states

LENGTHS = (1, 15, 16, 17, 35, 1200, 16 * 64 * 9 + 5)


@pytest.fixture(scope="module")
def channels():
    return {f"{kind}/{n}": signal(kind, n, seed=n) for kind in KINDS for n in LENGTHS}


@pytest.fixture(scope="module")
def data(spark, channels):
    return frame(spark, channels).persist(), catalog(spark, channels).persist()


@pytest.fixture(scope="module")
def rollup(spark, data):
    return roll.build_rollup(spark, *data, new_path(spark, "rollup"), 16, 50)


def test_range_stats_match_brute_force(data, channels):
    rows = st.range_stats(*data, n_channels=50).collect()
    assert len(rows) == len(channels)
    for r in rows:
        assert_stats(r, channels[r["channel_id"]])


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_result_does_not_depend_on_partitions(spark, channels, data, parts):
    got = {r["channel_id"]: r for r in st.range_stats(frame(spark, channels, parts), data[1]).collect()}
    want = {r["channel_id"]: r for r in st.range_stats(*data).collect()}
    for c in channels:
        assert tuple(got[c])[:5] == tuple(want[c])[:5]


def test_levels_and_states(spark, rollup, channels):
    rows = st.with_statistics(rollup).collect()
    seen = {}
    for r in rows:
        size = 16 * 8 ** r["level"]
        v = channels[r["channel_id"]][r["bucket"] * size:(r["bucket"] + 1) * size]
        assert_stats(r, v)
        fin = v[np.isfinite(v)]
        assert r["pv"] == (fin[0] if fin.size else 0.0)
        seen.setdefault(r["channel_id"], set()).add(r["level"])
    for c, v in channels.items():
        assert seen[c] == set(range(roll.n_levels(len(v), 16))), c


WINDOWS = [(0, 10**9), (0, 1), (5, 6), (16, 32), (15, 33), (127, 1025), (128, 1024), (1, 9220), (8191, 8193), (640, 7000), (9000, 9100), (50, 40)]


@pytest.mark.parametrize("i0,i1", WINDOWS)
def test_rollup_answer_equals_brute_force(spark, data, rollup, channels, i0, i1):
    samples, cat = data
    ranges = cat.select("channel_id", F.lit(i0).cast("bigint").alias("i0"), F.lit(i1).cast("bigint").alias("i1"))
    states = roll.range_states(samples, rollup, cat, ranges, 16, 50)
    rows = st.with_statistics(st.all_channels(states, cat, 50)).collect()
    assert len(rows) == len(channels)
    for r in rows:
        assert_stats(r, channels[r["channel_id"]][i0:i1])


def test_merge_tree_equals_whole(spark, data, rollup, channels):
    merged = st.with_statistics(st.merge_states(rollup.filter("level = 0"), ["channel_id"], "bucket", 2000)).collect()
    for r in merged:
        assert_stats(r, channels[r["channel_id"]])


@pytest.mark.parametrize("i0,i1,b", [(0, 9221, 16), (3, 9000, 64), (100, 101, 16), (17, 31, 16), (5, 9219, 1024), (0, 9221, 8192), (700, 9221, 128)])
def test_envelopes(spark, data, rollup, channels, i0, i1, b):
    samples, cat = data
    clip = cat.selectExpr("channel_id", f"least({i0}L, length) AS i0", f"least({i1}L, length) AS i1", f"{b}L AS b").filter("i1 > i0")
    for env in (envelope(samples, clip, 50), roll.rollup_envelope(samples, rollup, cat, clip, 16, 50)):
        got: dict = {}
        for r in env.collect():
            got.setdefault(r["channel_id"], []).append((r["bucket"], r["lo"], r["hi"], r["center"], r["mn"], r["mx"], r["missing"]))
        for c, v in channels.items():
            lo, hi = min(i0, len(v)), min(i1, len(v))
            want = brute_envelope(v, lo, hi, b) if hi > lo else []
            assert sorted(got.get(c, [])) == want, (c, b)


def test_break_points_follow_missing_buckets(spark):
    v = np.arange(64.0)
    v[20] = np.nan
    chans = {"a": v}
    ranges = spark.createDataFrame([("a", 0, 64, 16)], "channel_id string, i0 bigint, i1 bigint, b bigint")
    rows = envelope_points(envelope(frame(spark, chans), ranges)).orderBy("bucket", "ord").collect()
    assert [(r["bucket"], r["ord"]) for r in rows] == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1)]
    assert np.isnan(rows[4]["y"]) and rows[4]["x_index"] == rows[3]["x_index"] == 24.0


def test_covered_prefix_and_overrun(spark):
    v = np.arange(100.0)
    cat = spark.createDataFrame([("a", 100, 0.0), ("b", 100, 0.0), ("c", 90, 0.0), ("d", 100, 0.0), ("e", 0, None)],
                                "channel_id string, length bigint, pivot double")
    samples = frame(spark, {"a": v, "b": v, "c": v, "d": v[:70]}).filter("NOT (channel_id = 'b' AND sample_idx BETWEEN 40 AND 41)")
    got = {r["channel_id"]: (r["covered"], r["complete"]) for r in roll.covered_prefix(
        roll.level0(samples.filter("channel_id <> 'c' OR sample_idx < 90"), cat, 16), cat, 16).collect()}
    assert got == {"a": (100, True), "b": (32, False), "c": (90, True), "d": (64, False), "e": (0, True)}
    over = roll.overrun(samples, cat).collect()
    assert sorted((r["channel_id"], r["sample_idx"]) for r in over) == [("c", i) for i in range(90, 100)]


def test_base_doubles_until_the_budget_fits(spark):
    cat = spark.createDataFrame([("a", 10_000_000)], "channel_id string, length bigint")
    assert roll.rollup_base(cat, 10**6) == 256
    assert roll.rollup_base(cat, 10_000) == 1024
    with pytest.raises(ValueError):
        roll.build_rollup(spark, cat, cat, "/tmp/never", 3)


@pytest.mark.parametrize("cut", [1, 7, 100, 997])
def test_batches_do_not_change_the_rollup(spark, cut):
    v = signal("gaps", 1000)
    samples = frame(spark, {"a": v})
    parts = None
    for lo in range(0, 1000, max(cut, 125)):
        got = batch_states(samples.filter(f"sample_idx >= {lo} AND sample_idx < {lo + max(cut, 125)}"), 16)
        parts = got if parts is None else parts.unionByName(got)
    rows = st.with_statistics(st.merge_once(parts, ["channel_id", "bucket"], "start")).collect()
    assert len(rows) == 63
    for r in rows:
        assert_stats(r, v[r["bucket"] * 16:(r["bucket"] + 1) * 16])


def test_integers_stay_exact(spark):
    big = 2**62 + 1
    rows = [("a", i, big + i) for i in range(5)]
    samples = spark.createDataFrame(rows, "channel_id string, sample_idx bigint, k bigint")
    zero = spark.createDataFrame([("a", big)], "channel_id string, k0 bigint")
    r = st.integer_stats(samples, zero).first()
    assert (r["mn"], r["mx"]) == (big, big + 4)
    assert abs(r["std"] - np.std(np.arange(5), ddof=1)) < 1e-12


def test_xy_decimation_keeps_extremes(spark):
    rng = np.random.default_rng(3)
    y = rng.standard_normal(1003)
    y[17] = np.nan
    y[400:420] = np.nan
    y[500] = y[505] = 99.0
    pts = frame(spark, {"a": y}).selectExpr("channel_id", "sample_idx", "double(sample_idx * 2) AS x", "v AS y")
    spans = spark.createDataFrame([("a", 0, 1003)], "channel_id string, s bigint, e bigint")
    got = sorted(r["sample_idx"] for r in xy_decimate(pts, spans, 100).collect())
    b = -(-1003 // 50)
    want = []
    for k in range(1003 // b):
        seg = y[k * b:(k + 1) * b]
        lo = int(np.where(np.isnan(seg), np.inf, seg).argmin())
        hi = int(np.where(np.isnan(seg), -np.inf, seg).argmax())
        want += [k * b + lo, k * b + hi]
    want += range(1003 // b * b, 1003)
    assert got == sorted(want)
    assert xy_decimate(pts, spans, 2000).count() == 1003


@pytest.mark.parametrize("base", [2, 16, 1 << 20])
def test_level_count_is_one_closed_form(spark, base):
    lengths = [0, 1, base * 64, base * 64 + 1, 10**6, 10**12, (1 << 62) + 5, (1 << 63) - 1]
    rows = spark.createDataFrame([(n,) for n in lengths], "length bigint")
    got = [r[0] for r in rows.select(F.expr(roll.level_count("length", base))).collect()]

    def want(n):
        count, buckets = 1, -(-n // base)
        while buckets > 64:
            count, buckets = count + 1, -(-buckets // 8)
        return count
    assert got == [roll.n_levels(n, base) for n in lengths] == [want(n) for n in lengths]
