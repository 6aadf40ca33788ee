"""Plans that must hold at scale, streams and written files."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from signals import catalog, frame, signal
from waveloom.operators import layout as lay
from waveloom.operators import rollup as roll
from waveloom.operators import rows as rw
from waveloom.operators import stats as st
from waveloom.operators.scan import running, running_rows
from waveloom.plans import export, readout
from waveloom.queries.base import axes_of, event_store, lineitem_rollup, lineitem_store, ranges_of
from waveloom.session import MAX_BROADCAST_BYTES, bounded, row_width, new_path, shared_dir
from waveloom.sources.indexing import with_sample_index
from waveloom.streaming.rollup import read_rollup, start_rollup, stream_coverage


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def full_plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + plan(df)


def test_window_scan_pushes_both_predicates(spark, sf_dir):
    p = plan(rw.sample_window(event_store(spark, sf_dir).samples, ["click"], 10, 20).select("channel_id", "sample_idx", "v"))
    assert "EqualTo(channel_id,click)" in p or "In(channel_id" in p
    assert "GreaterThanOrEqual(sample_idx,10)" in p and "LessThan(sample_idx,20)" in p
    assert "ReadSchema: struct<channel_id:string,v:double,sample_idx:bigint>" in p or "user_id" not in p.split("ReadSchema")[1]


def test_statistics_shuffle_only_states(spark, sf_dir):
    s = event_store(spark, sf_dir)
    p = plan(st.raw_states(st.with_pivot(s.samples, s.channels, s.n_channels), ["channel_id"]))
    assert "partial_count" in p and "partial_min_by" in p and "BroadcastHashJoin" in p
    assert p.index("partial_count") > p.index("Exchange hashpartitioning")  # below the exchange
    assert "Window" not in p and "SortAggregate" not in p


def test_rollup_answer_reads_pruned_buckets(spark, sf_dir):
    s = lineitem_store(spark, sf_dir)
    got = plan(roll.range_states(s.samples, lineitem_rollup(spark, sf_dir), s.channels, ranges_of(s.channels), 16, s.n_channels))
    assert "EqualTo(level,0)" in got and "GreaterThanOrEqual(bucket," in got
    assert "GreaterThanOrEqual(sample_idx," in got


def test_no_window_without_partition(spark, sf_dir):
    """Sample numbering and running sums never put a whole channel into one window."""
    s = lineitem_store(spark, sf_dir)
    p = plan(running(s.samples, ["channel_id"], "sample_idx", F.col("k"), "sum", "acc"))
    for line in p.splitlines():
        if "Window [" in line and "_tot" not in line and "_carry" not in line:
            assert "_blk" in line


def test_hot_channel_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _hot_channel(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _hot_channel(spark):
    rows = spark.range(0, 50_000).selectExpr("IF(id % 10 < 9, 'hot', 'cold') AS channel_id", "hash(id) AS k", "id")
    out = with_sample_index(spark, rows, "channel_id", ["k", "id"])
    staged = spark.read.parquet(*[f for f in out.inputFiles() if "/staged-" in f])
    files = staged.filter("channel_id = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 6 and max(r["count"] for r in files) < 15_000
    want = rows.selectExpr("id", "row_number() OVER (PARTITION BY channel_id ORDER BY k, id) - 1 AS sample_idx")
    assert out.select("id", F.col("sample_idx").cast("int")).exceptAll(want).count() == 0
    assert out.count() == 50_000


def test_broadcast_needs_a_known_bound(spark):
    small = spark.range(10)
    assert "broadcast" not in full_plan(bounded(small, None)).lower()
    assert "broadcast" not in full_plan(bounded(small, MAX_BROADCAST_BYTES // row_width(small) + 1)).lower()
    assert "broadcast" in small.join(bounded(spark.range(10**8), 10), "id")._jdf.queryExecution().optimizedPlan().toString().lower()


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir", shared_dir(spark))
    assert new_path(spark, "a") != new_path(spark, "a")


def test_running_matches_a_plain_window(spark):
    rows = spark.range(0, 3000).selectExpr("id % 3 AS g", "id DIV 3 AS o", "hash(id) % 100 AS v")
    for how, fn in (("sum", "sum"), ("max", "max")):
        for inclusive, frame_ in ((True, "CURRENT ROW"), (False, "1 PRECEDING")):
            got = running(rows, ["g"], "o", F.col("v"), how, "r", inclusive, block=64)
            want = rows.selectExpr("g", "o", "v", f"{fn}(v) OVER (PARTITION BY g ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND {frame_}) AS r")
            want = want.fillna(0, ["r"]) if how == "sum" else want
            assert got.select("g", "o", "v", "r").exceptAll(want).count() == 0


def test_running_rows_of_sparse_starts(spark, monkeypatch):
    """Nanosecond starts, one key with most rows, ties: no window over more than a partition's rows."""
    rows = spark.range(0, 4000).selectExpr("IF(id % 10 < 8, 'hot', 'cold') AS g", "(hash(id) % 1000) * 1000000007L AS o", "hash(id, 1) % 50 AS v", "id")
    for how, fn in (("sum", "sum"), ("max", "max")):
        got = running_rows(rows, ["g"], ["o", "id"], F.col("v"), how, "r")
        want = rows.selectExpr("*", f"{fn}(v) OVER (PARTITION BY g ORDER BY o, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r")
        assert got.select("g", "o", "v", "id", "r").exceptAll(want).count() == 0 and got.count() == 4000
        for line in plan(got).splitlines():
            if "Window [" in line and "_tot" not in line:
                assert "_part" in line
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_rows(rows, ["g"], ["o", "id"], F.col("v"), "sum", "r")
        files = spark.read.parquet(*[f for f in got.inputFiles() if "/running-" in f and "totals" not in f]).filter("g = 'hot'").groupBy(F.input_file_name()).count().collect()
        assert len(files) >= 5 and max(r["count"] for r in files) < 1500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wide = spark.createDataFrame([("k", i * 10**15, i * 10**15 + (10**15 if i % 3 else 5)) for i in range(300)], "k string, r0 bigint, r1 bigint")
    assert rw.interval_merge(wide, "k").count() == 100 + 1


def _greedy_runs(pos, layout):
    """Sequential definition of the runs: first index, length and stride."""
    out, i = [], 0
    while i < len(pos):
        j, stride = i + 1, None
        while j < len(pos) and layout[j] == layout[i] and (stride is None or pos[j] - pos[j - 1] == stride):
            stride = pos[j] - pos[j - 1]
            j += 1
        out.append((i, j - i, stride))
        i = j
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_the_sequential_definition(spark, monkeypatch, seed):
    monkeypatch.setattr(lay, "BLOCK", 16)
    rng = np.random.default_rng(seed)
    pos = np.cumsum(rng.integers(1, 4, 300))
    layout = rng.integers(0, 2, 300) * (rng.random(300) < 0.2)
    df = spark.createDataFrame([("f", i, int(p), int(q), 2) for i, (p, q) in enumerate(zip(pos, layout))], "file_id string, seg_no bigint, pos bigint, layout int, cnt bigint")
    got = sorted((r["seg_no"], r["n_segs"], r["stride"], r["start"]) for r in lay.run_compress(df).collect())
    assert got == [(i, n, s, 2 * i) for i, n, s in _greedy_runs(pos.tolist(), layout.tolist())]


def test_intervals_merge_across_blocks(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2000, 300)
    df = spark.createDataFrame([("k", int(x), int(x + y)) for x, y in zip(a, rng.integers(1, 9, 300))], "k string, r0 bigint, r1 bigint")
    got = sorted((r["r0"], r["r1"]) for r in rw.interval_merge(df, "k").collect())
    want = []
    for r in sorted((r["r0"], r["r1"]) for r in df.collect()):
        if want and r[0] <= want[-1][1]:
            want[-1][1] = max(want[-1][1], r[1])
        else:
            want.append(list(r))
    assert got == [tuple(w) for w in want]
    assert rw.merged_rows([(0, 3, 0, 0), (4, 5, 1, 1), (9, 9, 0, 0)]) == [(0, 6), (9, 10)]


def test_boxes_of_any_size_and_both_wide_forms(spark, monkeypatch):
    rows = spark.range(0, 30_000).selectExpr("concat('c', id % 3) AS channel_id", "id div 3 AS sample_idx", "IF(id % 7 = 0, NULL, double(id)) AS v")
    big = rw.box_select(rows, ["c0", "c1", "c2"], [(0, 5_000_000, 0, 2)])
    assert big.count() == 10_000
    monkeypatch.setattr(rw, "WIDE_BY_CONDITION", 0)
    assert rw.box_select(rows, ["c0", "c1", "c2"], [(0, 5_000_000, 0, 2)]).select(big.columns).exceptAll(big).count() == 0


@pytest.mark.parametrize("files", [1, 5])
def test_stream_equals_batch(spark, tmp_path, files):
    v = signal("gaps", 2000)
    samples = frame(spark, {"a": v, "b": v[:1500]})
    samples.repartition(files).write.parquet(str(tmp_path / "in"))
    declared = spark.createDataFrame([("a", 2000, 0.0), ("b", 1400, 0.0)], "channel_id string, length bigint, pivot double")
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_rollup(stream, declared, str(tmp_path / "out"), str(tmp_path / "ckpt"), 16).awaitTermination()
    got = read_rollup(spark, str(tmp_path / "out"))
    want = roll.level0(samples.filter("channel_id = 'a' OR sample_idx < 1400"), declared, 16)
    cols = ["channel_id", "bucket", "n", "total", "mn", "mx", "pv"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0 and got.count() == want.count()
    assert spark.read.parquet(str(tmp_path / "out_overrun")).count() == 100
    cov = {r["channel_id"]: r["complete"] for r in stream_coverage(got, declared, 16).collect()}
    assert cov == {"a": True, "b": True}


def test_export_reads_back(spark, tmp_path):
    v = signal("ramp", 40)
    chans = {"a": v, "b": v[:25]}
    axes = spark.createDataFrame([("a", 0.0, 0.1, 0, 40), ("b", 0.0, 0.1, 0, 25)], "channel_id string, x0 double, dx double, s bigint, e bigint")
    rows = export.export_rows(frame(spark, chans), axes, 0.3, 99.0)
    wide = export.export_wide(rows, ["a", "b"])
    export.write_csv(wide, str(tmp_path / "csv"), ["a idx", "a x, s", "a", "b idx", "b x", 'b "v"'])
    joined = sorted(glob.glob(str(tmp_path / "csv_header" / "part-*"))) + sorted(glob.glob(str(tmp_path / "csv" / "part-*")))
    lines = "".join(open(f).read() for f in joined).splitlines()
    assert lines[0] == 'a idx,"a x, s",a,b idx,b x,"b ""v"""'
    cells = [line.split(",") for line in lines[1:]]
    first = 3 if 3 * 0.1 >= 0.3 else 4
    assert len(cells) == 40 - first
    for k, c in enumerate(cells):
        i = first + k
        assert c[:3] == [str(i), repr(i * 0.1), repr(float(v[i]))]
        assert c[3:] == ([str(i), repr(i * 0.1), repr(float(v[i]))] if i < 25 else ["", "", ""])


def test_xy_export_numbers_kept_samples(spark):
    x = np.array([5.0, 1.0, 3.0, np.nan, 2.0, 9.0])
    pts = frame(spark, {"a": x}).selectExpr("channel_id", "sample_idx", "v AS x", "double(sample_idx) AS y")
    got = [(r["row_no"], r["sample_idx"]) for r in export.export_rows_xy(pts, 1.0, 3.0).orderBy("row_no").collect()]
    assert got == [(0, 1), (1, 2), (2, 4)]


def test_statistics_text(spark, sf_dir, tmp_path):
    s = event_store(spark, sf_dir)
    cat = s.channels.withColumn("label", F.col("channel_id")).withColumn("unit", F.lit("V"))
    table = readout.stats_table(s.samples, None, cat, axes_of(s), (-1e9, 1e9), [], n_channels=s.n_channels)
    number = spark.createDataFrame([(r[0], i) for i, r in enumerate(sorted(cat.select("channel_id").collect()))], "channel_id string, channel_no int")
    table = table.selectExpr("*", "double(null) AS c1", "double(null) AS c2", "double(null) AS c2_c1").join(number, "channel_id")
    text = readout.stats_text(table)
    assert text.columns == readout.STATS_COLUMNS
    export.write_tsv(text, str(tmp_path / "tsv"))
    assert spark.read.text(str(tmp_path / "tsv_header")).first()[0].split("\t") == readout.STATS_COLUMNS
    back = spark.read.option("sep", "\t").csv(str(tmp_path / "tsv")).toDF(*readout.STATS_COLUMNS)
    assert back.count() == s.n_channels and {r["#"] for r in back.collect()} == {f"{i:02d}" for i in range(s.n_channels)}
    assert sorted(float(r["Max"]) for r in back.collect()) == sorted(r["mx"] for r in table.collect())


def test_coverage_of_parts(spark):
    cases = {"ok": [(0, 3), (3, 2)], "hole": [(0, 3), (4, 1)], "overlap": [(0, 3), (2, 3)], "short": [(0, 4)], "late": [(1, 4)], "empty": [(0, 0), (0, 5)], "twice": [(0, 5), (0, 5)]}
    parts = spark.createDataFrame([(c, a, n) for c, ps in cases.items() for a, n in ps], "channel_id string, start bigint, cnt bigint")
    chans = spark.createDataFrame([(c, 5) for c in cases] + [("none", 0), ("lost", 5)], "channel_id string, length bigint")
    got = {r["channel_id"]: r["covers"] for r in lay.coverage_check(parts, chans).collect()}
    assert got == {c: c in ("ok", "none") for c in [*cases, "none", "lost"]}


def test_brute_catalog_helper(spark):
    assert catalog(spark, {"a": np.array([np.nan, 2.0])}).first()["pivot"] == 2.0


def test_partition_counts_grow_with_the_data(spark):
    from waveloom.session import ROWS_PER_PART, range_parts, task_count
    assert task_count(spark, 1, 64) == 1 and task_count(spark, 5, 64) == 5
    assert task_count(spark, 10**6, 64) == -(-10**6 // 64)
    df = spark.range(10)
    assert "rangepartitioning(id#" in plan(range_parts(df, 10, "id")) and ", 8)" in plan(range_parts(df, 10, "id"))
    assert ", 100)" in plan(range_parts(df, 100 * ROWS_PER_PART, "id"))


def test_first_rows_of_a_hot_group(spark):
    from waveloom.operators.scan import first_rows
    df = spark.range(0, 5000).selectExpr("IF(id % 10 = 0, 'b', 'a') AS g", "hash(id) AS o", "id")
    got = first_rows(df, "g", "o", 7).select("g", "o", "id")
    want = df.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY o) AS rn").filter("rn <= 7").select("g", "o", "id")
    assert got.count() == 14 and got.exceptAll(want).count() == 0


def test_windows_get_more_partitions_with_more_rows(spark):
    from waveloom.session import ROWS_PER_PART, hash_parts
    df = spark.range(10).selectExpr("id", "id % 3 AS k")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(hash_parts(df, 10, "k")) and "hashpartitioning(k" in plan(hash_parts(df, 99 * ROWS_PER_PART + 1, "k"))
    assert ", 100)" in plan(hash_parts(df, 99 * ROWS_PER_PART + 1, "k"))


def test_partitions_are_bounded_below_the_session_number(spark):
    """F2, F3, F8, F9: three partitions' worth of rows may not be left to adaptive execution, which coalesces by compressed bytes."""
    from waveloom.session import ROWS_PER_PART, hash_parts, range_parts
    assert ROWS_PER_PART <= 1_000_000
    df = spark.range(10).selectExpr("id", "id % 3 AS k")
    for made in (range_parts(df, 3 * ROWS_PER_PART, "id"), hash_parts(df, 3 * ROWS_PER_PART, "k")):
        p = full_plan(made)
        assert "REPARTITION_BY_NUM" in p and ", 8)" in p
    assert "REPARTITION_BY_NUM" not in full_plan(range_parts(df, 10, "id"))


def test_aligned_curves_meet_in_bounded_partitions(spark):
    from waveloom.operators.axis import xy_align
    from waveloom.session import ROWS_PER_PART
    samples = spark.createDataFrame([("x", i, float(i)) for i in range(5)] + [("y", i, float(-i)) for i in range(5)], "channel_id string, sample_idx bigint, v double")
    pairs = spark.createDataFrame([("y", "x", 10 * ROWS_PER_PART, 10 * ROWS_PER_PART)], "channel_id string, x_channel_id string, y_length bigint, x_length bigint")
    out = xy_align(samples, pairs, 1)
    p = full_plan(out)
    assert p.count(", 20), REPARTITION_BY_NUM") == 2
    assert sorted(map(tuple, out.collect())) == [("y", "x", i, float(i), float(-i)) for i in range(5)]
