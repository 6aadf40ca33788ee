"""The rollup kept up to date by micro-batches: positions, repeats, versions, levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from signals import catalog, frame, signal

from waveloom.operators import rollup as roll
from waveloom.session import new_path, settle
from waveloom.streaming import levels as lv

COLS = ["channel_id", "level", "bucket", "n", "total", "mn", "mx", "pv"]


def ordered(df, cols):
    return sorted(map(repr, (tuple(r) for r in df.select(cols).collect())))


def test_repeats_are_not_coverage(spark):
    rows = [("a", i, float(i)) for i in (0, 0, 2, 3)] + [("b", i, float(i)) for i in (0, 1, 2, 3, 3)]
    samples = spark.createDataFrame(rows, "channel_id string, sample_idx bigint, v double")
    cat = spark.createDataFrame([("a", 4, 0.0), ("b", 4, 0.0)], "channel_id string, length bigint, pivot double")
    for base in (4, 2, 256):
        got = {r["channel_id"]: (r["covered"], r["complete"]) for r in roll.covered_prefix(roll.level0(samples, cat, base, positions=True), cat, base).collect()}
        assert got == {"a": (0, False), "b": (4, True)}, base


@pytest.mark.parametrize("base, slice_buckets", [(4, 8), (128, 16)])
def test_any_order_and_repeats_give_the_batch_rollup(spark, base, slice_buckets):
    """Shuffled batches with repeats (inside a batch, across batches, after completion), out-of-range samples and a replay."""
    rng = np.random.default_rng(base)
    chans = {"a": signal("gaps", 3000), "b": signal("pedestal", 700), "c": signal("rails", 130)}
    cat = settle(catalog(spark, chans), "catalog")
    want = roll.build_rollup(spark, frame(spark, chans), cat, new_path(spark, "want"), base)
    rows = [(c, i, float(v[i])) for c, v in chans.items() for i in range(len(v))]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    parts = [rows[k::4] for k in range(4)]
    batches = [parts[0], parts[1] + parts[1][:200] + [("b", 700, 9.0), ("a", -1, 9.0)], parts[2] + [(c, i, v + 1) for c, i, v in parts[0][::3]], parts[3],
               [(c, i, v + 5) for c, i, v in rows[:500]] + [("zz", 0, 1.0)]]
    table = lv.LevelTable(spark, new_path(spark, "levels"), base, slice_buckets).create()
    declared = cat.select("channel_id", "length")
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "channel_id string, sample_idx bigint, v double").repartition(3)
        lv.apply_batch(table, df, k, declared)
        lv.apply_batch(table, df, k, declared)  # a replay
    assert table.version() == 4
    assert ordered(lv.read_levels(table), COLS) == ordered(want, COLS)
    close = lv.read_levels(table).alias("g").join(want.alias("w"), ["channel_id", "level", "bucket"])
    worst = close.filter("g.n > 0 AND abs(g.pv) < 1e300").agg(F.max(F.expr("IF(abs(g.dl) < 1e300, abs(g.pv + g.dl - w.pv - w.dl), 0D)"))).first()[0]
    assert worst < 1e-9
    assert {(r["channel_id"], r["complete"]) for r in lv.level_coverage(table, declared).collect()} == {("a", True), ("b", True), ("c", True)}
    over = spark.read.parquet(f"{table.path}/overrun")
    assert sorted((r["channel_id"], r["sample_idx"]) for r in over.collect()) == [("a", -1), ("b", 700), ("zz", 0)]
    assert ordered(lv.read_levels(table, 3), COLS) == ordered(lv.read_levels(table), COLS)  # repeats made no difference
    first = lv.read_levels(table, 0)
    assert first.filter("level = 0").agg(F.sum("total")).first()[0] == len(parts[0])


def test_a_batch_that_died_leaves_the_version_before(spark, monkeypatch):
    cat = spark.createDataFrame([("a", 100)], "channel_id string, length bigint")
    table = lv.LevelTable(spark, new_path(spark, "levels"), 4, 8).create()
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("'a' AS channel_id", "id AS sample_idx", "double(id) AS v")
    lv.apply_batch(table, rows(0, 40), 0, cat)
    before = ordered(lv.read_levels(table), COLS)
    with monkeypatch.context() as m:
        m.setattr(lv.LevelTable, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            lv.apply_batch(table, rows(40, 100), 1, cat)
    assert table.version() == 0 and ordered(lv.read_levels(table), COLS) == before
    lv.apply_batch(table, rows(40, 100), 1, cat)
    assert lv.level_coverage(table, cat).first()["complete"]
    lv.apply_batch(table, rows(200, 210), 2, cat)  # nothing that belongs to the channel
    lv.apply_batch(table, rows(90, 100), 3, cat)
    assert lv.read_levels(table).filter("level = 0").agg(F.sum("total")).first()[0] == 100
    assert table.vacuum(1) == 1 and table.vacuum(1) == 0  # the second slice, which the second batch wrote again
    assert lv.read_levels(table).filter("level = 0").agg(F.sum("n")).first()[0] == 100
    lv.apply_batch(table, rows(0, 100), 4, cat)
    assert table.version() == 4 and lv.level_coverage(table, cat).first()["covered"] == 100


def test_reading_does_not_grow_with_the_batches(spark):
    cat = spark.createDataFrame([("a", 640)], "channel_id string, length bigint")
    files = []
    for n in (2, 8):
        table = lv.LevelTable(spark, new_path(spark, "levels"), 4, 8).create()
        for k in range(n):
            lv.apply_batch(table, spark.range(k * 640 // n, (k + 1) * 640 // n).selectExpr("'a' AS channel_id", "id AS sample_idx", "double(id) AS v"), k, cat)
        files.append(len(lv.read_levels(table).inputFiles()))
        assert lv.read_levels(table).filter("level = 0").count() == 160
    assert files[1] == files[0]
    touched = table.slices().filter("v = 7").count()
    assert touched <= 4 + 2  # the slices of one eighth of level 0, and of the level above


def test_slices_hold_whole_families(spark):
    with pytest.raises(ValueError):
        lv.LevelTable(spark, "/tmp/never", 4, 12)


def test_default_slices_span_positions_whatever_the_base(spark):
    """Buckets of 16 samples must not make a file of every 8,192 samples."""
    sizes = {base: lv.LevelTable(spark, "/tmp/never", base).slice_buckets for base in (3, 16, 256, 1 << 22)}
    assert all(n % lv.FACTOR == 0 for n in sizes.values()) and sizes[16] * 16 == sizes[256] * 256 == 1 << 20 and sizes[1 << 22] == lv.FACTOR
