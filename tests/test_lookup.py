"""Lookups in sorted X channels by descent through the rollup."""

import numpy as np
import pytest
from signals import catalog, frame

from waveloom.operators import axis as ax
from waveloom.operators import lookup
from waveloom.operators.rollup import FACTOR, TOP_BUCKETS, build_rollup
from waveloom.session import new_path, settle

LENGTHS = {"one": 1, "few": 7, "edge": 128, "over": 129, "tall": 9000}


def sorted_channels():
    rng = np.random.default_rng(4)
    out = {c: np.sort(rng.integers(0, max(3, n // 3), n) / 4.0) for c, n in LENGTHS.items()}
    out["flat"] = np.full(700, 5.0)
    out["stairs"] = np.repeat(np.arange(40.0), 50)
    return out


@pytest.fixture(scope="module")
def stored(spark):
    chans = sorted_channels()
    samples = settle(frame(spark, chans), "sorted")
    cat = settle(catalog(spark, {**chans, "none": np.zeros(0)}), "catalog")
    buckets = build_rollup(spark, samples, cat, new_path(spark, "buckets"), 2, len(chans) + 1)
    return chans, samples.withColumnRenamed("v", "x"), buckets, cat


@pytest.mark.parametrize("known", [True, False])
def test_positions_equal_binary_search(spark, stored, known):
    chans, points, buckets, cat = stored
    rng = np.random.default_rng(5)
    asked = []
    for c, x in chans.items():
        for k, q in enumerate([-1.0, x[0], x[-1], x[-1] + 1, *(rng.choice(x, 3)), *(rng.uniform(x[0], x[-1] + 1e-9, 3))]):
            asked += [(c, 2 * k, float(q), False), (c, 2 * k + 1, float(q), True)]
    asked += [("none", 1, 0.0, False), ("unknown", 1, 0.0, False)]
    queries = spark.createDataFrame(asked, "channel_id string, key int, q double, strict boolean")
    got = {(r["channel_id"], r["key"]): r["pos"] for r in lookup.sorted_positions(
        points, buckets, cat, queries, 2, len(chans) + 1 if known else None, len(asked) if known else None).collect()}
    assert got == {(c, k): int(np.searchsorted(chans[c], q, "right" if strict else "left")) for c, k, q, strict in asked if c in chans}


def test_equals_the_scan(spark, stored, monkeypatch):
    chans, points, buckets, cat = stored
    for xa, xb in [(0.25, 3.0), (5.0, 5.0), (-9.0, -1.0), (3.1, 1e9), (4.0, 2.0)]:
        got = lookup.sorted_range_rollup(points, buckets, cat, xa, xb, 2)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ax.sorted_range(points, xa, xb).collect())), (xa, xb)
    qs = [-1.0, 0.25, 2.125, 5.0, 19.5, 1e9]
    columns = ["channel_id", "cursor_no", "cx", "s", "e", "sample_idx", "x", "x_first", "x_last"]
    want = sorted(map(tuple, ax.nearest_sorted(points, qs).select(columns).collect()))
    assert sorted(map(tuple, lookup.nearest_sorted_rollup(points, buckets, cat, qs, 2).select(columns).collect())) == want
    monkeypatch.setattr(lookup, "MAX_SPANS", 1)  # more lookups than literal filters
    assert sorted(map(tuple, lookup.nearest_sorted_rollup(points, buckets, cat, qs, 2).select(columns).collect())) == want


def test_a_lookup_reads_one_parent_a_level(spark, stored, monkeypatch):
    chans, points, buckets, cat = stored
    seen = []
    plain = lookup.pruned

    def counted(rows, state, at, more=None):
        out = plain(rows, state, at, more)
        seen.append((out.count(), out._jdf.queryExecution().executedPlan().toString()))
        return out
    monkeypatch.setattr(lookup, "pruned", counted)
    queries = spark.createDataFrame([("tall", 1, 700.3, False)], "channel_id string, key int, q double, strict boolean")
    got = lookup.sorted_positions(points, buckets, cat, queries, 2, 8, 1).first()
    assert got["pos"] == np.searchsorted(chans["tall"], 700.3)
    assert seen[0][0] <= TOP_BUCKETS and all(n <= FACTOR for n, _ in seen[1:]) and seen[-1][0] <= 2 and len(seen) == 5
    assert all("EqualTo(channel_id,tall)" in p and "GreaterThanOrEqual(" in p for _, p in seen)
