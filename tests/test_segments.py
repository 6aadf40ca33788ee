"""The segmented file source: layouts, damage, catalog rules and index files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.functions.values import EPOCH_1904_S
from waveloom.operators import catalog as cat
from waveloom.operators.layout import file_snapshot, mixed_layout, source_drift
from waveloom.sources import segments as sg
from waveloom.sources.encode import encode_segment

A, B, C = "/'g'/'a'", "/'g'/'b'", "/'g'/'c'"
NUMERIC = {"i1": "int", "i2": "int", "i4": "int", "i8": "int", "u1": "int", "u2": "int", "u4": "int", "u8": "uint64", "f4": "float", "f8": "float", "b1": "bool",
           "c8": "complex", "c16": "complex"}


def values(code, n, seed=1):
    rng = np.random.default_rng(seed)
    dt = np.dtype(code)
    if dt.kind in "iu":
        v = rng.integers(np.iinfo(dt).min, np.iinfo(dt).max, n, dtype=dt, endpoint=True)
        v[0] = np.iinfo(dt).max
        return v
    if dt.kind == "b":
        return rng.integers(0, 2, n).astype(bool)
    if dt.kind == "c":
        return (rng.standard_normal(n) + 1j * rng.standard_normal(n)).astype(dt)
    v = (rng.standard_normal(n) * 1000).astype(dt)
    v[:3] = [np.nan, np.inf, -0.0]
    return v


def write(folder, name, segments, cut=0, tail=b"", index=False):
    data = b"".join(b"".join(s) for s in segments)
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes((data[:-cut] if cut else data) + tail)
    if index:
        (folder / (name + "_index")).write_bytes(b"".join(b"TDSh" + s[0][4:] + s[1] for s in segments))
    return data


def channel(spark, folder, path, kind, **window):
    scan = sg.scan_segments(spark, str(folder))
    return [r["v"] for r in sg.read_samples(sg.value_runs(scan), kind, [path], **window).orderBy("sample_idx").collect()]


def same(got, want):
    if len(want) and isinstance(want[0], (complex, np.complexfloating)):
        got = [complex(g["re"], g["im"]) for g in got]
    assert len(got) == len(want)
    assert np.array_equal(np.array([g if g is not None else np.nan for g in got], dtype=np.asarray(want).dtype), np.asarray(want),
                          equal_nan=np.asarray(want).dtype.kind in "fc")


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("interleaved", [False, True])
def test_all_numeric_types(spark, tmp_path, big, interleaved):
    chans = {f"/'g'/'{c}'": values(c, 60) for c in NUMERIC}
    write(tmp_path / "d", "f.tdms", [encode_segment(chans, chunks=3, big=big, interleaved=interleaved)])
    runs = sg.value_runs(sg.scan_segments(spark, str(tmp_path / "d"))).persist()
    for kind in set(NUMERIC.values()):
        rows = sg.read_samples(runs, kind).orderBy("path", "sample_idx").collect()
        for code in (c for c, k in NUMERIC.items() if k == kind):
            same([r["v"] for r in rows if r["path"] == f"/'g'/'{code}'"], chans[f"/'g'/'{code}'"])


def test_channel_is_one_series_over_all_layouts(spark, tmp_path):
    parts = [values("f8", n, n) for n in (40, 120, 30, 80, 50)]
    other = [values("i2", n, n) for n in (40, 120, 30, 80, 50)]
    pair = lambda k: {A: parts[k], B: other[k]}
    segs = [encode_segment(pair(0), props={"/": {}, "/'g'": {}}), encode_segment(pair(1), chunks=3), encode_segment(pair(2), interleaved=True, big=True),
            encode_segment(pair(3), chunks=2, big=True), encode_segment(pair(4), interleaved=True)]
    write(tmp_path / "d", "f.tdms", segs)
    same(channel(spark, tmp_path / "d", A, "float"), np.concatenate(parts))
    same(channel(spark, tmp_path / "d", B, "int"), np.concatenate(other).astype(np.int64))
    for start, stop in [(0, 1), (39, 41), (35, 215), (300, 999), (-5, 10), (500, 600)]:
        same(channel(spark, tmp_path / "d", A, "float", start=start, stop=stop), np.concatenate(parts)[max(0, start):max(0, stop)])


def test_raw_only_same_index_and_late_channels(spark, tmp_path):
    a = [values("f8", 20, k) for k in range(5)]
    b = [values("i4", 20, k) for k in range(5)]
    segs = [encode_segment({A: a[0]}), encode_segment({A: a[1]}, meta=False), encode_segment({B: b[0]}, new_list=False),
            # list is now a and b: the raw-only style segment below holds both
            encode_segment({A: a[3], B: b[1]}, same=True), encode_segment({A: None}, new_list=False)]
    # Third segment adds b to the list, so a's values are stored too: encode both for it.
    both = encode_segment({A: a[2], B: b[0]}, meta=False)
    head = encode_segment({B: b[0]}, new_list=False)
    lead = head[0][:4] + head[0][4:8] + struct.pack("<iQQ", 4713, len(head[1]) + len(both[2]), len(head[1]))
    segs[2] = (lead, head[1], both[2])
    # Last: a has no data any more, b keeps its index.
    last = encode_segment({A: None}, new_list=False)
    body = encode_segment({B: b[2]}, meta=False)[2]
    toc = struct.unpack("<i", last[0][4:8])[0] | 8
    segs[4] = (last[0][:4] + struct.pack("<i", toc) + struct.pack("<iQQ", 4713, len(last[1]) + len(body), len(last[1])), last[1], body)
    write(tmp_path / "d", "f.tdms", segs)
    same(channel(spark, tmp_path / "d", A, "float"), np.concatenate(a[:4]))
    same(channel(spark, tmp_path / "d", B, "int"), np.concatenate([b[0], b[1], b[2]]).astype(np.int64))


def _complete(kept: int, sizes: list[int], n: int, chunks: int, interleaved: bool) -> list[int]:
    """Values of each channel that lie wholly inside the first ``kept`` bytes of the data."""
    if interleaved:
        return [min(kept // sum(sizes), n * chunks)] * len(sizes)
    out = [0] * len(sizes)
    for _ in range(chunks):
        for k, size in enumerate(sizes):
            out[k] += min(n, max(0, kept) // size)
            kept -= n * size
    return out


@pytest.mark.parametrize("interleaved", [False, True])
def test_every_cut_of_the_last_segment(spark, tmp_path, interleaved):
    codes, n, chunks = {A: "u2", B: "f4", C: "i8"}, 6, 3
    first = {p: values(c, 5, 1) for p, c in codes.items()}
    last = {p: values(c, n * chunks, 2) for p, c in codes.items()}
    segs = [encode_segment(first), encode_segment(last, chunks=chunks, interleaved=interleaved)]
    size = len(segs[1][2])
    cuts = range(1, size, 17)
    for cut in cuts:
        write(tmp_path / "d", f"{cut:05d}.tdms", segs, cut=cut)
    scan = sg.scan_segments(spark, str(tmp_path / "d")).persist()
    runs = sg.value_runs(scan).persist()
    rows = [r for kind in ("int", "float") for r in sg.read_samples(runs, kind).orderBy("file", "path", "sample_idx").collect()]
    for cut in cuts:
        counts = _complete(size - cut, [np.dtype(c).itemsize for c in codes.values()], n, chunks, interleaved)
        for (path, code), count in zip(codes.items(), counts):
            got = [r["v"] for r in rows if r["file"].endswith(f"{cut:05d}.tdms") and r["path"] == path]
            want = np.concatenate([first[path], last[path][:count]])
            same(got, want if code == "f4" else want.astype(np.int64))
    assert {r["status"] for r in sg.segments(scan).filter("seg_no = 1").collect()} == {"cut"}


def test_unfinished_segment_runs_to_the_end_of_the_file(spark, tmp_path):
    v = values("f8", 48)
    write(tmp_path / "d", "f.tdms", [encode_segment({A: v[:16]}), encode_segment({A: v[16:]}, chunks=4, unfinished=True)], cut=8 * 5)
    scan = sg.scan_segments(spark, str(tmp_path / "d")).persist()
    same([r["v"] for r in sg.read_samples(sg.value_runs(scan)).orderBy("sample_idx").collect()], v[:-5])
    assert [r["status"] for r in sg.segments(scan).orderBy("seg_no").collect()] == ["ok", "open"]


@pytest.mark.parametrize("folder", ["run 7", "100%25 load", "a#b"])
def test_paths_with_odd_characters(spark, tmp_path, folder):
    v = values("f8", 10)
    write(tmp_path / folder, "my file.tdms", [encode_segment({A: v})])
    same(channel(spark, tmp_path / folder, A, "float"), v)


def _scale(slope, intercept, **more):
    return {"NI_Number_Of_Scales": 1, "NI_Scale[0]_Scale_Type": "Linear", "NI_Scale[0]_Linear_Slope": slope, "NI_Scale[0]_Linear_Y_Intercept": intercept, **more}


def test_scales_of_channel_group_and_file(spark, tmp_path):
    paths = ["/'g'/'own'", "/'g'/'done'", "/'g'/'group'", "/'h'/'file'"]
    raw = {p: np.arange(5, dtype=t) for p, t in zip(paths, ("i2", "f8", "u4", "f4"))}
    props = {"/": _scale(7.0, -1.0), "/'g'": _scale(0.5, 20.0), paths[0]: _scale(2.0, 100.0), paths[1]: _scale(9.0, 9.0, NI_Scaling_Status="scaled")}
    write(tmp_path / "d", "f.tdms", [encode_segment(raw, props=props)])
    scan = sg.scan_segments(spark, str(tmp_path / "d")).persist()
    rows = sg.scaled_samples(sg.read_numbers(sg.value_runs(scan)), sg.channel_scales(scan)).orderBy("sample_idx").collect()
    i = np.arange(5.0)
    for p, want in zip(paths, (2 * i + 100, i, i / 2 + 20, 7 * i - 1)):
        assert [r["v"] for r in rows if r["path"] == p] == list(want), p
    odd = {paths[0]: {"NI_Number_Of_Scales": 1, "NI_Scale[0]_Scale_Type": "Polynomial"}}
    write(tmp_path / "e", "f.tdms", [encode_segment({paths[0]: raw[paths[0]]}, props=odd)])
    scan = sg.scan_segments(spark, str(tmp_path / "e"))
    with pytest.raises(ValueError):
        sg.scaled_samples(sg.read_numbers(sg.value_runs(scan)), sg.channel_scales(scan))
    write(tmp_path / "f", "f.tdms", [encode_segment({paths[0]: raw[paths[0]], paths[2]: raw[paths[2]]}, props={**odd, "/'g'": _scale(0.5, 20.0)})])
    scan = sg.scan_segments(spark, str(tmp_path / "f"))
    rows = sg.scaled_samples(sg.read_numbers(sg.value_runs(scan), paths[2:3]), sg.channel_scales(scan), paths[2:3]).orderBy("sample_idx").collect()
    assert [r["v"] for r in rows] == list(i / 2 + 20)


def test_a_channel_that_changes_its_type(spark, tmp_path):
    one, two = values("i2", 5), values("f8", 3)
    write(tmp_path / "d", "f.tdms", [encode_segment({A: one}), encode_segment({A: two})])
    scan = sg.scan_segments(spark, str(tmp_path / "d")).persist()
    assert sg.channel_catalog(scan).first()["n_types"] == 2
    for kind in ("float", "int"):
        with pytest.raises(ValueError):
            sg.read_samples(sg.value_runs(scan), kind)
    same([r["v"] for r in sg.read_numbers(sg.value_runs(scan)).orderBy("sample_idx").collect()], np.concatenate([one.astype(float), two]))


TAILS = {"blank": b" " * 3001, "digits": b"0123456789" * 77, "one": b"\x7f", "text": b"TDS" + b"end of log" * 9}


@pytest.mark.parametrize("tail", list(TAILS))
def test_bytes_after_the_last_segment(spark, tmp_path, tail):
    v = values("f8", 100)
    data = write(tmp_path / "d", "f.tdms", [encode_segment({A: v[:50]}), encode_segment({A: v[50:]}, meta=False)], tail=TAILS[tail], index=True)
    scan = sg.scan_segments(spark, str(tmp_path / "d")).persist()
    assert sg.segments(scan).count() == 2
    assert sg.ignored_tails(scan).first()["message"] == f"No segment begins at byte {len(data)}: the last {len(TAILS[tail])} bytes of the file were left out."
    same([r["v"] for r in sg.read_samples(sg.value_runs(scan)).orderBy("sample_idx").collect()], v)


def test_strings_times_and_extended(spark, tmp_path):
    words = ["", "a", "Grüße", "日本", "comma,quote\"", "line\nbreak"]
    times = [(EPOCH_1904_S + 5, 1 << 63), (2**40, 0), (0, 0)]
    segs = [encode_segment({A: words, B: values("f8", 6), C: times}), encode_segment({A: words[::-1]}, big=True)]
    write(tmp_path / "d", "f.tdms", segs)
    assert channel(spark, tmp_path / "d", A, "string") == words + words[::-1]
    assert channel(spark, tmp_path / "d", C, "time") == [5_500_000_000, None, -EPOCH_1904_S * 10**9]
    assert channel(spark, tmp_path / "d", A, "string", start=4, stop=8) == (words + words[::-1])[4:8]


def test_large_chunks_are_cut_into_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sg, "PIECE_VALUES", 7)
    a, b = values("f8", 60), values("i4", 60)
    write(tmp_path / "d", "f.tdms", [encode_segment({A: a, B: b}, chunks=4), encode_segment({A: a, B: b}, interleaved=True)])
    same(channel(spark, tmp_path / "d", A, "float"), np.concatenate([a, a]))
    same(channel(spark, tmp_path / "d", B, "int"), np.concatenate([b, b]).astype(np.int64))


def test_equal_segments_become_few_runs(spark, tmp_path):
    a, b = values("f8", 400), values("i2", 400)
    segs = [encode_segment({A: a[k:k + 10], B: b[k:k + 10]}, meta=k == 0, interleaved=k >= 300) for k in range(0, 400, 10)]
    write(tmp_path / "d", "f.tdms", segs)
    runs = sg.value_runs(sg.scan_segments(spark, str(tmp_path / "d"))).persist()
    merged = sg.merge_runs(runs).persist()
    assert runs.count() == 80 and merged.count() <= 6
    for path, kind, want in ((A, "float", a), (B, "int", b.astype(np.int64))):
        for start, stop in ((0, None), (5, 17), (95, 311), (399, 500)):
            got = [r["v"] for r in sg.read_samples(merged, kind, [path], start, stop).orderBy("sample_idx").collect()]
            same(got, want[start:stop])


def test_catalog(spark, tmp_path):
    props = {"/": {"title": "t"}, "/'g'": {"rack": "A1"},
             A: {"wf_increment": 0.001, "wf_start_offset": 1.5, "wf_start_time": (EPOCH_1904_S + 100, 0), "unit_string": "", "Unit": "V"},
             B: {"wf_increment": -1.0, "wf_start_offset": 1.5, "wf_start_time": (3600, 1 << 63)}, "/'it''s'/'x'": {"unit": "m"}}
    write(tmp_path / "d", "f.tdms", [encode_segment({A: values("f8", 4), B: values("i2", 4), "/'it''s'/'x'": None}, props=props),
                                     encode_segment({A: values("f8", 4)}, props={A: {"late": 1, "Unit": "mV"}})])
    ch = {r["path"]: r for r in sg.channel_catalog(sg.scan_segments(spark, str(tmp_path / "d"))).collect()}
    a, b, x = ch[A], ch[B], ch["/'it''s'/'x'"]
    assert (a["label"], a["kind"], a["length"], a["unit"], a["wf_increment"], a["wf_start_ns"]) == ("g/a", "float", 8, "mV", 0.001, 100 * 10**9)
    assert (a["props"]["late"], a["wf_start_offset"]) == ("1", 1.5)
    assert (b["wf_increment"], b["bad"], b["wf_start_ns"], b["wf_start_offset"]) == (None, True, None, 1.5 + 3600.5)
    assert (x["grp"], x["name"], x["kind"], x["length"], x["unit"]) == ("it's", "x", "empty", 0, "m")


def test_names_that_are_not_utf8_stay_different(spark, tmp_path):
    one = encode_segment({"/'g'/'??'": values("f8", 3, 1)})
    raws = [(s[0], s[1].replace(b"??", raw), s[2]) for s, raw in ((one, b"I\xb5"), (one, b"I\xb0"))]
    write(tmp_path / "d", "f.tdms", raws)
    names = {r["name"] for r in sg.channel_catalog(sg.scan_segments(spark, str(tmp_path / "d"))).collect()}
    assert names == {"Iµ", "I°"}


def test_index_files(spark, tmp_path):
    segs = [encode_segment({A: values("f8", 10)}), encode_segment({A: values("f8", 10)}, meta=False), encode_segment({A: values("f8", 5)})]
    write(tmp_path / "d", "good.tdms", segs, index=True)
    write(tmp_path / "d", "stale.tdms", segs, index=True)
    (tmp_path / "d" / "stale.tdms_index").write_bytes(b"".join(b"TDSh" + s[0][4:] + s[1] for s in segs[:2]))
    write(tmp_path / "d", "wrong.tdms", segs, index=True)
    raw = bytearray((tmp_path / "d" / "wrong.tdms_index").read_bytes())
    raw[-8] ^= 1
    (tmp_path / "d" / "wrong.tdms_index").write_bytes(bytes(raw))
    got = sg.index_check(sg.scan_segments(spark, str(tmp_path / "d")), sg.scan_segments(spark, str(tmp_path / "d"), "*.tdms_index", index=True))
    assert {r["file"].split("/")[-1]: r["matches"] for r in got.collect()} == {"good.tdms": True, "stale.tdms": False, "wrong.tdms": False}


def test_drift_and_mixed_layout(spark, tmp_path):
    write(tmp_path / "d", "a.tdms", [encode_segment({A: values("f8", 4)})])
    write(tmp_path / "d", "b.tdms", [encode_segment({A: values("f8", 4)}, interleaved=True)])
    before = spark.createDataFrame(file_snapshot(spark, str(tmp_path / "d"), "*.tdms").collect())
    assert source_drift(before, file_snapshot(spark, str(tmp_path / "d"), "*.tdms")).count() == 0
    (tmp_path / "d" / "a.tdms").write_bytes(b"x")
    (tmp_path / "d" / "c.tdms").write_bytes(b"y")
    now = source_drift(before, file_snapshot(spark, str(tmp_path / "d"), "*.tdms")).collect()
    assert {(r["path"].split("/")[-1], r["state"]) for r in now} == {("a.tdms", "changed"), ("c.tdms", "added")}
    seg = sg.segments(sg.scan_segments(spark, str(tmp_path / "d"), "b.tdms")).withColumnRenamed("file", "file_id")
    assert mixed_layout(seg).first()["mixed"]


def test_wrong_clock_and_year_rules(spark):
    rows = [("f", "u", 7_000, 1_500_000_000), ("f", "i", 9_000, 1_500_000_001), ("f", "slow", 40, 86_400), ("f", "none", 5, None),
            ("y", "a", 10, 1_500_000_000), ("y", "b", 1000, 1_500_000_000 + 200 * 86_400)]
    ch = spark.createDataFrame([(f, c, n, None if t is None else t * 10**9) for f, c, n, t in rows], "file_id string, channel_id string, length bigint, wf_start_ns bigint")
    got = {r["channel_id"]: r for r in cat.start_seconds(cat.with_reference(ch).withColumn("wf_start_offset", F.lit(None).cast("double"))).collect()}
    assert got["u"]["t_ref"] == 1_500_000_000 * 10**9 and got["slow"]["far"] and not got["u"]["far"]
    assert got["i"]["start_s"] == 1.0 and got["slow"]["start_s"] < -1e9 and got["none"]["start_s"] == 0.0
    assert got["a"]["t_ref"] == got["b"]["t_ref"] == 1_500_000_000 * 10**9 and not got["b"]["far"]


def test_every_bad_increment_has_a_warning(spark):
    texts = ["-2", "0", "nan", "3d", "1.5f", "0x10", "", " ", "fast"] * 5
    ch = spark.createDataFrame([("f", i, f"g/c{i}", t) for i, t in enumerate([*texts, "2.5", "1e-3", None])], "file_id string, channel_no bigint, label string, dx_text string")
    rows = cat.increment_warnings(cat.check_increment(ch)).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(len(texts))) and all(f"g/c{r['seq']} " in r["message"] for r in rows)
    many = spark.range(0, 900).selectExpr("'f' AS file_id", "concat('m', id % 300) AS message", "id AS seq")
    assert cat.warn_dedupe(many).filter("n = 3").count() == 300


def test_time_fields_are_written_like_pairs():
    from waveloom.sources.encode import encode_values
    pairs = [(2_082_844_800, 0), (-5, 1 << 63), (7, (3 << 62) + 1)]
    fields = np.array(pairs, [("s", "i8"), ("f", "u8")])
    for order in "<>":
        assert encode_values(fields, order) == encode_values(pairs, order)


def test_scales_of_runs_equal_scales_of_samples(spark, tmp_path):
    """the scale and other columns of a run reach its samples without a join of samples."""
    linear = {"NI_Number_Of_Scales": 1, "NI_Scaling_Status": "unscaled", "NI_Scale[0]_Scale_Type": "Linear", "NI_Scale[0]_Linear_Slope": 2.0,
              "NI_Scale[0]_Linear_Y_Intercept": 1.0, "NI_Scale[0]_Linear_Input_Source": -1}
    a, b = "/'g'/'a'", "/'g'/'b'"
    seg = encode_segment({a: np.arange(7, dtype="f8"), b: np.arange(7, dtype="f8")}, props={a: linear})
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.tdms").write_bytes(b"".join(seg))
    scan = sg.scan_segments(spark, str(tmp_path / "d"))
    runs, scales = sg.value_runs(scan), sg.channel_scales(scan)
    got = sg.read_scaled(runs.withColumn("own", F.lit(5)), scales, "float", ("path", "own"))
    assert not any(s in got._jdf.queryExecution().executedPlan().toString() for s in ("Join",))
    want = sg.scaled_samples(sg.read_samples(runs, "float"), scales).select("path", F.lit(5).alias("own"), "sample_idx", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 14
