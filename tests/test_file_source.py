"""Shared reads of interleaved channels, the data source with pushed filters, and headers in large reads."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_segments import NUMERIC, A, B, C, same, values, write

from waveloom.functions.values import EPOCH_1904_S
from waveloom.sources import families as fam
from waveloom.sources import segments as sg
from waveloom.sources.datasource import source_samples, store_plan
from waveloom.sources.encode import encode_segment
from waveloom.sources.readahead import ReadAhead


class Counted:
    """A file that counts what is read."""

    def __init__(self, file, log):
        self.file, self.log = file, log

    def read_at(self, n, pos):
        out = self.file.read_at(n, pos)
        self.log.append((pos, len(out)))
        return out

    def close(self):
        self.file.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def families_of(spark, folder):
    return fam.layout_families(sg.value_runs(sg.scan_segments(spark, str(folder))))


def read_here(pieces, log, **window):
    """The reader of a task, run in this process over counted files."""
    rows = sorted((p.asDict(recursive=True) for p in pieces.collect()), key=lambda p: (p["file"], p["base"], p["a"]))
    return pa.Table.from_batches(fam.decoded_pieces(iter(rows), fam.family_arrow(), opened=lambda uri: Counted(sg._open(uri), log), **window), fam.family_arrow())


def typed(rows, path, kind):
    return [r[kind] for r in sorted((r for r in rows if r["path"] == path), key=lambda r: r["sample_idx"])]


@pytest.mark.parametrize("n", [1, 2, 100])
def test_bytes_do_not_grow_with_the_channels(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(fam, "PIECE_BYTES", 32 << 10)
    chans = {f"/'g'/'{k:03d}'": values("f8", 2000, k) for k in range(100)}
    data = write(tmp_path / "d", "f.tdms", [encode_segment(chans, interleaved=True)])
    wanted = sorted(chans)[:n] if n > 1 else [sorted(chans)[37]]
    pieces = fam.family_pieces(families_of(spark, tmp_path / "d"), wanted)
    assert pieces.count() == -(-2000 // (32 * 1024 // 800))
    assert pieces.agg(F.max((F.col("b") - F.col("a")) * F.col("stride"))).first()[0] <= 32 << 10
    log = []
    got = read_here(pieces, log).to_pylist()
    assert 2000 * 800 - 50 * 800 <= sum(k for _, k in log) <= len(data) + (64 << 10)
    for path in wanted:
        same(typed(got, path, "float"), chans[path])


@pytest.mark.parametrize("big", [False, True])
def test_one_scan_for_all_kinds(spark, tmp_path, big):
    chans = {f"/'g'/'{c}'": values(c, 60) for c in NUMERIC}
    write(tmp_path / "d", "one.tdms", [encode_segment(chans, big=big, interleaved=True), encode_segment(chans, chunks=3, big=big)])
    rows = [r.asDict(recursive=True) for r in fam.read_families(families_of(spark, tmp_path / "d")).collect()]
    for code, kind in NUMERIC.items():
        v = chans[f"/'g'/'{code}'"]
        got = typed(rows, f"/'g'/'{code}'", kind)
        want = np.concatenate([v, v]).astype({"int": np.int64, "float": np.float64}.get(kind, v.dtype))
        same([g if g is None else complex(g["re"], g["im"]) for g in got] if kind == "complex" else got, want) if kind != "complex" else None
        if kind == "complex":
            assert [complex(g["re"], g["im"]) for g in got] == [complex(x) for x in want]
    assert all(sum(r[k] is not None for k in fam.KINDS) == 1 for r in rows)


def test_windows_late_channels_strings_and_times(spark, tmp_path):
    words = ["", "a", "Grüße", "日本", "comma,quote\"", "line\nbreak"]
    times = [(EPOCH_1904_S + 5, 1 << 63), (2**40, 0), (0, (1 << 64) - 1), (EPOCH_1904_S, 3), (EPOCH_1904_S, (1 << 64) // 3), (EPOCH_1904_S, 1 << 33)]
    a = [values("f8", n, n) for n in (40, 120, 30)]
    b = [values("i2", n, n) for n in (120, 30)]
    segs = [encode_segment({A: a[0]}), encode_segment({A: a[1], B: b[0]}, interleaved=True), encode_segment({A: a[2], B: b[1]}, chunks=3),
            encode_segment({C: words}), encode_segment({C: words[::-1]}, big=True), encode_segment({"/'g'/'t'": times})]
    write(tmp_path / "d", "f.tdms", segs)
    f = families_of(spark, tmp_path / "d").persist()
    for start, stop in [(0, None), (0, 1), (39, 41), (35, 165), (118, 999), (-5, 10), (500, 600)]:
        rows = [r.asDict(recursive=True) for r in fam.read_families(f, [A, B], start, stop).collect()]
        cut = slice(max(0, start), None if stop is None else max(0, stop))
        same(typed(rows, A, "float"), np.concatenate(a)[cut])
        same(typed(rows, B, "int"), np.concatenate(b).astype(np.int64)[cut])
    for start, stop in [(0, None), (4, 8), (7, 9), (11, 12)]:
        rows = [r.asDict() for r in fam.read_families(f, [C], start, stop, ("string",)).collect()]
        assert typed(rows, C, "string") == (words + words[::-1])[start:stop]
    rows = [r.asDict() for r in fam.read_families(f, kinds=("time",)).collect()]
    assert typed(rows, "/'g'/'t'", "time") == [sg.time_ns(*t) for t in times]


def test_only_the_wanted_strings_are_read(spark, tmp_path, monkeypatch):
    words = [f"{k:04d}" * 50 for k in range(4000)]
    write(tmp_path / "d", "f.tdms", [encode_segment({C: words})])
    monkeypatch.setattr(fam, "ReadAhead", lambda f: f)
    log = []
    got = read_here(fam.family_pieces(families_of(spark, tmp_path / "d"), [C], 3000, 3010), log, start=3000, stop=3010)
    assert got["string"].to_pylist() == words[3000:3010] and sum(k for _, k in log) < 3000


def test_source_pushes_filters(spark, tmp_path):
    for k in range(3):
        write(tmp_path / "d", f"{k}.tdms", [encode_segment({A: values("f8", 50, k), B: values("i4", 50, k)}, interleaved=True),
                                            encode_segment({A: values("f8", 50, k + 9), B: values("i4", 50, k + 9)})])
    plan = store_plan(sg.scan_segments(spark, str(tmp_path / "d")))
    assert source_samples(spark, plan).count() == 600
    window = source_samples(spark, plan, (F.col("path") == A) & (F.col("sample_idx") >= 45) & (F.col("sample_idx") < 55) & (F.col("float") > -1e300))
    text = window._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in text and "> -1.0E300" in text and ">= 45)" not in text and f"= {A})" not in text  # the reader took the others
    rows = window.collect()
    whole = [r for r in source_samples(spark, plan).collect() if r["path"] == A and 45 <= r["sample_idx"] < 55 and not r["float"] <= -1e300]
    assert sorted(map(repr, rows)) == sorted(map(repr, whole)) and {r["sample_idx"] for r in rows} <= set(range(45, 55)) and len(rows) > 15
    files = sorted(r[0] for r in source_samples(spark, plan).select("file").distinct().collect())
    for k in (1, 2):
        (tmp_path / "d" / f"{k}.tdms").unlink()
    one = source_samples(spark, plan, (F.col("file") == files[0]) & F.col("path").isin(A, B) & (F.col("sample_idx") > 97))
    assert sorted((r["path"], r["sample_idx"]) for r in one.collect()) == [(p, i) for p in (A, B) for i in (98, 99)]
    with pytest.raises(Exception):
        source_samples(spark, plan).count()


def test_queries_on_one_source_do_not_meet(spark, tmp_path):
    """What one query pushes must not narrow another one."""
    write(tmp_path / "d", "f.tdms", [encode_segment({A: values("f8", 50), B: values("i4", 50)}, interleaved=True)])
    plan = store_plan(sg.scan_segments(spark, str(tmp_path / "d")))
    everything = source_samples(spark, plan)
    few = source_samples(spark, plan, f"path = '{A.replace(chr(39), chr(39) * 2)}' AND sample_idx < 10")
    ints = everything.filter("kind = 'int' AND sample_idx >= 45")
    assert (everything.count(), few.count(), ints.count(), everything.count(), few.count()) == (100, 10, 5, 100, 10)
    assert few.unionByName(ints).count() == 15 and few.filter("sample_idx = 3").count() == 1 and few.count() == 10


def test_runs_outside_the_window_are_not_opened(spark, tmp_path):
    """A file whose samples all lie before the window may be gone."""
    write(tmp_path / "d", "short.tdms", [encode_segment({A: values("f8", 10)})])
    write(tmp_path / "d", "long.tdms", [encode_segment({A: values("f8", 500)})])
    plan = store_plan(sg.scan_segments(spark, str(tmp_path / "d")))
    (tmp_path / "d" / "short.tdms").unlink()
    got = source_samples(spark, plan, "sample_idx >= 10 AND sample_idx <= 12 AND kind = 'float'", ("float",))
    assert sorted(r["sample_idx"] for r in got.collect()) == [10, 11, 12]
    assert source_samples(spark, plan, "sample_idx = 499").count() == 1 and source_samples(spark, plan, "kind = 'int'").count() == 0


def test_headers_of_many_segments_in_few_reads(tmp_path, monkeypatch):
    v = values("f8", 8)
    segs = [encode_segment({A: v}), *[encode_segment({A: v}, meta=False)] * 19_999]
    write(tmp_path / "d", "f.tdms", segs)
    log = []
    plain = sg._open
    monkeypatch.setattr(sg, "_open", lambda uri: Counted(plain(uri), log))
    uri = "file://" + str(tmp_path / "d" / "f.tdms")
    size = (tmp_path / "d" / "f.tdms").stat().st_size
    rows = list(sg._walk(uri, size, False))
    assert len(rows) == 20_000 and len(log) < 50 and sum(n for _, n in log) <= 1.1 * size


def test_headers_of_large_segments_skip_the_data(tmp_path, monkeypatch):
    v = values("f8", 200_000)
    write(tmp_path / "d", "f.tdms", [encode_segment({A: v}), *[encode_segment({A: v}, meta=False)] * 9])
    log = []
    plain = sg._open
    monkeypatch.setattr(sg, "_open", lambda uri: Counted(plain(uri), log))
    size = (tmp_path / "d" / "f.tdms").stat().st_size
    assert len(list(sg._walk("file://" + str(tmp_path / "d" / "f.tdms"), size, False))) == 10
    assert sum(n for _, n in log) < size / 10


def test_read_ahead_gives_the_bytes_of_the_file():
    raw = bytes(np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8))

    class File:
        def read_at(self, n, pos):
            return raw[pos:pos + n]
    rng, f = np.random.default_rng(2), ReadAhead(File(), 16, 256)
    for _ in range(3000):
        pos, n = int(rng.integers(0, 5100)), int(rng.choice([1, 7, 30, 400]))
        assert f.read_at(n, pos) == raw[pos:pos + n]
