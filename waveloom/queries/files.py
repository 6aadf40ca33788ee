"""The file source, run over files that Spark encodes from the whole line-item channels."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import EPOCH_1904_S
from ..operators import catalog as cat
from ..session import new_path, settle
from ..sources import families as fam
from ..sources import segments as sg
from ..sources.datasource import source_samples, store_plan
from ..sources.encode import FILE_SAMPLES, SEGMENT_SAMPLES, write_files
from .base import L, LC, lineitem_store, rnd, rnd_sql

QUERIES: dict = {}
_SCANS: dict = {}
_RUNS: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


def scanned(spark, sf_dir):
    """Segment table of the encoded files, stored once."""
    store = lineitem_store(spark, sf_dir)
    if store.path not in _SCANS:
        folder = new_path(spark, "files")
        write_files(store.samples, folder, ["v", "k"]).write.mode("overwrite").parquet(new_path(spark, "written"))
        path = new_path(spark, "segments")
        sg.scan_segments(spark, folder).write.parquet(path)
        _SCANS[store.path] = (folder, path)
    return spark.read.parquet(_SCANS[store.path][1])


def stored_runs(spark, sf_dir):
    """Merged value runs of the encoded files, stored once (as a reader of many windows would)."""
    scan = scanned(spark, sf_dir)
    key = lineitem_store(spark, sf_dir).path
    if key not in _RUNS:
        _RUNS[key] = settle(sg.merge_runs(sg.value_runs(scan)), "runs")
    return _RUNS[key]


def file_name(col="file"):
    return F.element_at(F.split(F.col(col), "/"), -1)


@query("segments", f"""WITH {L}, {LC}, F AS (SELECT channel_id, length, b, least({FILE_SAMPLES}, length - b * {FILE_SAMPLES}) AS cnt
    FROM LC, (SELECT unnest(range(0, 100000)) AS b) t WHERE b * {FILE_SAMPLES} < length),
  G AS (SELECT channel_id || '-' || lpad(b::VARCHAR, 9, '0') || '.tdms' AS name, b, k, least({SEGMENT_SAMPLES}, cnt - k * {SEGMENT_SAMPLES}) AS m
    FROM F, (SELECT unnest(range(0, {FILE_SAMPLES // SEGMENT_SAMPLES})) AS k) t WHERE k * {SEGMENT_SAMPLES} < cnt)
  SELECT name, k AS seg_no, 14 + CASE WHEN (b + k) % 2 = 1 THEN 32 ELSE 0 END + CASE WHEN k % 5 = 3 THEN 64 ELSE 0 END AS toc, m * 16 AS data_bytes, 'ok' AS status FROM G""")
def segments(spark, sf_dir):
    return sg.segments(scanned(spark, sf_dir)).select(
        file_name().alias("name"), "seg_no", "toc", (F.col("next_pos") - F.col("data_pos")).alias("data_bytes"), "status")


@query("channels", f"""WITH {L}, {LC}, F AS (SELECT channel_id, b, least({FILE_SAMPLES}, length - b * {FILE_SAMPLES}) AS length
    FROM LC, (SELECT unnest(range(0, 100000)) AS b) t WHERE b * {FILE_SAMPLES} < length)
  SELECT channel_id || '-' || lpad(b::VARCHAR, 9, '0') || '.tdms' AS name, channel_id || '/' || c AS label, CASE c WHEN 'v' THEN 'float' ELSE 'int' END AS kind, length,
    'u' || c AS unit, 0.5::DOUBLE AS wf_increment, (b * {FILE_SAMPLES})::DOUBLE AS wf_start_offset FROM F, (SELECT unnest(['v', 'k']) AS c) t""")
def channels(spark, sf_dir):
    return sg.channel_catalog(scanned(spark, sf_dir)).select(
        file_name("file_id").alias("name"), "label", "kind", "length", "unit", "wf_increment", "wf_start_offset")


@query("index_check", f"""WITH {L}, {LC}, F AS (SELECT channel_id, b, least({FILE_SAMPLES}, length - b * {FILE_SAMPLES}) AS cnt
    FROM LC, (SELECT unnest(range(0, 100000)) AS b) t WHERE b * {FILE_SAMPLES} < length)
  SELECT channel_id || '-' || lpad(b::VARCHAR, 9, '0') || '.tdms' AS name, true AS matches, (cnt + {SEGMENT_SAMPLES - 1}) // {SEGMENT_SAMPLES} AS n_rows, 0::BIGINT AS n_diff FROM F""")
def index_check(spark, sf_dir):
    """Every segment header of every file against its sidecar index."""
    scan = scanned(spark, sf_dir)
    folder = _SCANS[lineitem_store(spark, sf_dir).path][0]
    got = sg.index_check(scan, sg.scan_segments(spark, folder, "*.tdms_index", index=True))
    return got.select(file_name().alias("name"), "matches", "n_rows", "n_diff")


def _placed(df, col, *more):
    """Channel name and sample index in the whole channel (the file's first sample is in its name)."""
    name = file_name()
    block = F.regexp_extract(name, r"-(\d+)\.tdms$", 1).cast("bigint")
    return df.select(F.regexp_extract(name, r"^(.*)-\d+\.tdms$", 1).alias("channel_id"),
                     (block * FILE_SAMPLES + F.col("sample_idx")).alias("sample_idx"), F.col("v").alias(col), *more)


@query("file_scan_float", f"WITH {L} SELECT channel_id, sample_idx, v FROM L")
def file_scan_float(spark, sf_dir):
    return _placed(sg.read_samples(stored_runs(spark, sf_dir), "float"), "v")


@query("file_scan_int", f"WITH {L} SELECT channel_id, sample_idx, k FROM L WHERE sample_idx % {FILE_SAMPLES} >= 1000 AND sample_idx % {FILE_SAMPLES} < 9000")
def file_scan_int(spark, sf_dir):
    """Samples [1000, 9000) of each file."""
    return _placed(sg.read_samples(stored_runs(spark, sf_dir), "int", start=1000, stop=9000), "k")


_PLANS: dict = {}


def stored_plan(spark, sf_dir):
    """Layout families of the encoded files, stored once."""
    key = lineitem_store(spark, sf_dir).path
    if key not in _PLANS:
        _PLANS[key] = store_plan(scanned(spark, sf_dir))
    return _PLANS[key]


@query("file_scan_family", f"WITH {L} SELECT channel_id, sample_idx, 'float' AS kind, v, NULL::BIGINT AS k FROM L UNION ALL SELECT channel_id, sample_idx, 'int', NULL, k FROM L")
def file_scan_family(spark, sf_dir):
    """Both channels of every file from one read of its bytes."""
    rows = fam.read_families(spark.read.parquet(stored_plan(spark, sf_dir)), kinds=("float", "int"))
    return _placed(rows.withColumn("v", F.struct("kind", "float", "int")), "x").select(
        "channel_id", "sample_idx", "x.kind", F.col("x.float").alias("v"), F.col("x.int").alias("k"))


@query("file_source", f"""WITH {L} SELECT channel_id, sample_idx, k FROM L
    WHERE channel_id IN ('AF', 'RF') AND sample_idx % {FILE_SAMPLES} >= 1000 AND sample_idx % {FILE_SAMPLES} < 9000""")
def file_source(spark, sf_dir):
    """A window of two channels through the data source: the filters reach the reader."""
    wanted = F.col("path").isin("/'AF'/'k'", "/'RF'/'k'") & (F.col("kind") == "int") & (F.col("sample_idx") >= 1000) & (F.col("sample_idx") < 9000)
    rows = source_samples(spark, stored_plan(spark, sf_dir), wanted, ("float", "int"))
    return _placed(rows.withColumn("v", F.col("int")), "k")


def _linear(slope: float, intercept: float) -> dict:
    return {"NI_Number_Of_Scales": 1, "NI_Scaling_Status": "unscaled", "NI_Scale[0]_Scale_Type": "Linear", "NI_Scale[0]_Linear_Slope": slope,
            "NI_Scale[0]_Linear_Y_Intercept": intercept, "NI_Scale[0]_Linear_Input_Source": -1}


@query("file_scan_scaled", f"""WITH {L} SELECT channel_id, sample_idx, 'v' AS name, {rnd_sql("CASE WHEN channel_id LIKE 'A%' THEN v * 3.0 + 1.0 ELSE v * 1.5 + 10.0 END")} AS y FROM L
  UNION ALL SELECT channel_id, sample_idx, 'k', {rnd_sql('k * 0.25 - 2.0')} FROM L""")
def file_scan_scaled(spark, sf_dir):
    """Scales on the channel (k), the group (v of N and R) and the file (v of A), applied on reading."""
    folder = new_path(spark, "scaled")

    def props(channel, group):
        return {"/": _linear(3.0, 1.0), **({} if channel.startswith("A") else {group: _linear(1.5, 10.0)}), f"{group}/'k'": _linear(0.25, -2.0)}
    settle(write_files(lineitem_store(spark, sf_dir).samples, folder, ["v", "k"], more_props=props), "written")
    scan = settle(sg.scan_segments(spark, folder), "segments")
    runs, scales = settle(sg.value_runs(scan), "runs"), settle(sg.channel_scales(scan), "scales")
    # The place in the whole channel is the same for all samples of a run: found once a run, not once a sample.
    placed = _placed(runs.select("*", F.lit(0).alias("sample_idx"), F.lit(0).alias("v")), "v", *runs.columns).withColumnRenamed("sample_idx", "first").drop("v")
    both = [(name, sg.read_scaled(placed, scales, kind, ("channel_id", "first"))) for name, kind in (("v", "float"), ("k", "int"))]
    return reduce(DataFrame.unionByName, [rows.select("channel_id", (F.col("first") + F.col("sample_idx")).alias("sample_idx"), F.lit(name).alias("name"),
                                                      rnd("v").alias("y")) for name, rows in both])


@query("file_scan_typed", f"""WITH {L} SELECT channel_id, sample_idx, 'bool' AS kind, (k % 2 = 0)::BIGINT AS n, NULL::DOUBLE AS re, NULL::DOUBLE AS im FROM L
  UNION ALL SELECT channel_id, sample_idx, 'uint64', k, NULL, NULL FROM L
  UNION ALL SELECT channel_id, sample_idx, 'time', k * 1000000000 + (k % 4) * 250000000, NULL, NULL FROM L
  UNION ALL SELECT channel_id, sample_idx, 'complex', NULL, v, q FROM L""")
def file_scan_typed(spark, sf_dir):
    """Boolean, unsigned, time and complex channels; the unsigned values lie beyond the signed range."""
    folder = new_path(spark, "typed")

    def encode(rows):
        k = rows["k"].to_numpy()
        return {"bool": k % 2 == 0, "uint64": k.astype("u8") + np.uint64(1 << 63), "complex": rows["v"].to_numpy() + 1j * rows["q"].to_numpy(),
                "time": np.rec.fromarrays([k + EPOCH_1904_S, (k % 4).astype("u8") << np.uint64(62)], [("s", "i8"), ("f", "u8")])}
    settle(write_files(lineitem_store(spark, sf_dir).samples, folder, ["v", "k", "q"], encode), "written")
    runs = settle(sg.value_runs(settle(sg.scan_segments(spark, folder), "segments")), "runs")
    none = F.lit(None).cast("double")

    def rows(kind, n, re=none, im=none):
        return _placed(sg.read_samples(runs, kind), "x").select("channel_id", "sample_idx", F.lit(kind).alias("kind"), n.cast("bigint").alias("n"), re.alias("re"), im.alias("im"))
    x = F.col("x")
    return reduce(DataFrame.unionByName, [
        rows("bool", x), rows("uint64", x - F.lit(str(1 << 63)).cast("decimal(20,0)")), rows("time", x), rows("complex", F.lit(None), F.col("x.re"), F.col("x.im"))])


@query("file_properties", f"""WITH {L}, {LC}, F AS (SELECT channel_id, b FROM LC, (SELECT unnest(range(0, 100000)) AS b) t WHERE b * {FILE_SAMPLES} < length)
  SELECT channel_id || '-' || lpad(b::VARCHAR, 9, '0') || '.tdms' AS file, '/''' || channel_id || '''' AS object, 'block' AS name, b::VARCHAR AS value FROM F
  UNION ALL SELECT channel_id || '-' || lpad(b::VARCHAR, 9, '0') || '.tdms', '/', 'first', (b * {FILE_SAMPLES})::VARCHAR FROM F""")
def file_properties(spark, sf_dir):
    """Properties of the files and groups."""
    objects = sg.object_catalog(scanned(spark, sf_dir)).filter("path NOT LIKE '%/%/%'").withColumn("object_id", F.struct(file_name().alias("file"), F.col("path").alias("object")))
    return cat.property_list(objects).select("object_id.file", "object_id.object", "name", "value")
