"""Segmented measurement files as DataFrames.

1. `scan_segments` reads only headers and metadata, one file per row of the file list: a table
   of segments with the layout of every channel in it.
2. `object_catalog`, `channel_catalog` and `value_runs` are DataFrame operations on that table.
3. `read_samples` cuts the wanted runs into pieces of bounded size, spreads them over the cluster
   (a large file is many pieces) and decodes them into Arrow batches. Channel and sample-range
   predicates drop runs before any data byte is read.
"""

from __future__ import annotations

import hashlib
import struct
from functools import reduce
from urllib.parse import quote
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import EPOCH_1904_S, NS_MAX_S, NS_MIN_S, NS_PER_S, decode_extended, epoch1904_ns
from ..operators import catalog as cat
from ..operators.layout import (TOC_BIG_ENDIAN, TOC_DAQMX, TOC_INTERLEAVED, TOC_META, TOC_NEW_LIST, TOC_RAW, file_snapshot,
                                run_compress)
from ..operators.scan import running, running_rows
from ..session import settle, task_count
from .readahead import ReadAhead

# Fixed values of the file format.
LEAD_IN = 28
DATA_TAG, INDEX_TAG = b"TDSm", b"TDSh"
UNFINISHED = 0xFFFFFFFFFFFFFFFF
NO_DATA, SAME_INDEX = 0xFFFFFFFF, 0
DAQMX_INDEX = (0x1269, 0x126A)
TOC_KNOWN = TOC_META | TOC_NEW_LIST | TOC_RAW | TOC_INTERLEAVED | TOC_BIG_ENDIAN | TOC_DAQMX
NUMPY_OF = {1: "i1", 2: "i2", 3: "i4", 4: "i8", 5: "u1", 6: "u2", 7: "u4", 8: "u8", 9: "f4", 10: "f8",
            0x19: "f4", 0x1A: "f8", 0x21: "u1", 0x08000C: "c8", 0x10000D: "c16"}
EXT_CODES = (0x0B, 0x1B)
STRING_CODE, TIME_CODE = 0x20, 0x44

PIECE_VALUES = 1 << 18  # values decoded by one piece
BATCH_ROWS = 1 << 16
FILES_PER_TASK = 64
PIECES_PER_TASK = 4096
VALUES_PER_TASK = 1 << 24
ONE_READ_BYTES = 8 << 20  # spread chunks within this span are read at once

SEGMENT_SCHEMA = """file string, size bigint, seg_no bigint, pos bigint, toc int, data_pos bigint, next_pos bigint,
  status string, digest bigint,
  objects array<struct<path: string, type_code: bigint, item: bigint, npc: bigint, rel: bigint, stride: bigint,
    chunk: bigint, n_chunks: bigint, tail: bigint, tail_rel: bigint, blob: bigint, daqmx: boolean>>,
  props array<struct<path: string, name: string, type_code: bigint, text: string, ns: bigint>>"""

SAMPLE_TYPES = {"float": "double", "int": "bigint", "uint64": "decimal(20,0)", "bool": "boolean", "time": "bigint",
                "complex": "struct<re: double, im: double>", "string": "string"}


def filesystem_of(uri: str):
    """(file system, path in it) of any file system Arrow knows. Spark gives paths as they are, a URI wants them percent-encoded."""
    scheme, _, rest = ("file", ":", uri) if uri.startswith("/") else uri.partition(":")
    authority, path = "", rest
    if rest.startswith("//"):
        authority, _, path = rest[2:].partition("/")
        path = "/" + path
    return pafs.FileSystem.from_uri(f"{scheme}://{authority}{quote(path)}")


def _open(uri: str):
    """Random-access file."""
    fs, path = filesystem_of(uri)
    return fs.open_input_file(path)


def decode_name(raw: bytes) -> str:
    """UTF-8, else Windows-1252, else Latin-1: different bytes stay different names."""
    for codec in ("utf-8", "cp1252"):
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def time_ns(sec: int, frac: int) -> int | None:
    """Seconds since 1904 and 2^-64 fractions to epoch ns; None outside 64-bit ns."""
    if not NS_MIN_S <= sec <= NS_MAX_S:
        return None
    return (sec - EPOCH_1904_S) * NS_PER_S + (frac * NS_PER_S + (1 << 63)) // (1 << 64)


class _Cursor:
    """Sequential decoder of one metadata block."""

    def __init__(self, data: bytes, order: str):
        self.data, self.order, self.at = data, order, 0

    def take(self, fmt: str):
        s = struct.Struct(self.order + fmt)
        out = s.unpack_from(self.data, self.at)
        self.at += s.size
        return out[0] if len(out) == 1 else out

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise struct.error("metadata ends early")
        self.at += n
        return self.data[self.at - n:self.at]

    def text(self) -> str:
        return decode_name(self.raw(self.take("I")))

    def value(self, code: int) -> tuple[str | None, int | None]:
        """(text, ns) of a property value."""
        if code == STRING_CODE:
            return self.text(), None
        if code == TIME_CODE:
            frac, sec = self.take("Qq") if self.order == "<" else reversed(self.take("qQ"))
            ns = time_ns(sec, frac)
            return (None if ns is None else str(ns)), ns
        if code == 0x21:
            return ("true" if self.raw(1) != b"\0" else "false"), None
        if code in EXT_CODES:
            return repr(float(_extended(self.raw(16), self.order)[0])), None
        if code not in NUMPY_OF:
            raise struct.error(f"unknown property type {code:#x}")
        dt = np.dtype(NUMPY_OF[code]).newbyteorder(self.order)
        v = np.frombuffer(self.raw(dt.itemsize), dt)[0]
        if dt.kind == "f" and dt.itemsize == 4:
            return np.format_float_positional(v, unique=True, trim="0"), None
        return (repr(v.item()) if dt.kind in "fc" else str(int(v))), None


def _extended(raw: bytes, order: str) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 16)
    return decode_extended(rows[:, ::-1] if order == ">" else rows)


def _item_size(code: int) -> int:
    if code in EXT_CODES or code == TIME_CODE:
        return 16
    return np.dtype(NUMPY_OF[code]).itemsize if code in NUMPY_OF else 0


def _read_objects(cur: _Cursor, listed: dict, last: dict) -> list[dict]:
    """Update the object list of a segment from its metadata; returns the properties."""
    props = []
    for _ in range(cur.take("I")):
        path, head = cur.text(), cur.take("I")
        entry = dict(listed.get(path) or last.get(path) or {"path": path, "code": None, "npc": 0, "blob": 0, "daqmx": False})
        if head == NO_DATA:
            entry["has"] = False
        elif head == SAME_INDEX:
            entry["has"] = True
        elif head in DAQMX_INDEX:
            code, _dim, npc, n_scalers = cur.take("IIQI")
            cur.raw(n_scalers * (17 if head == DAQMX_INDEX[1] else 20))
            cur.raw(4 * cur.take("I"))
            entry.update(has=True, daqmx=True, code=code, npc=npc, blob=0)
        else:
            code, _dim, npc = cur.take("IIQ")
            entry.update(has=True, daqmx=False, code=code, npc=npc, blob=cur.take("Q") if code == STRING_CODE else 0)
        listed[path] = last[path] = entry
        for _ in range(cur.take("I")):
            name, code = cur.text(), cur.take("I")
            text, ns = cur.value(code)
            props.append({"path": path, "name": name, "type_code": code, "text": text, "ns": ns})
    return props


def _layout(entries: list[dict], toc: int, nbytes: int) -> list[dict]:
    """Where the values of each object lie: full chunks, and the short chunk at the end.

    A cut contiguous chunk is filled object by object; a cut interleaved chunk by whole rows.
    """
    sized = [(e, _item_size(e["code"]), e["blob"] or e["npc"] * _item_size(e["code"])) for e in entries]
    rows = bool(toc & TOC_INTERLEAVED)
    width = sum(item for _e, item, _b in sized)
    chunk = width * entries[0]["npc"] if rows else sum(b for _e, _i, b in sized)
    full, rest = divmod(nbytes, chunk) if chunk else (0, 0)
    out, rel, left, tail_rel = [], 0, rest, 0
    for e, item, size in sized:
        tail = 0
        if rest and rows:
            tail = rest // width
        elif rest and item:
            tail = min(e["npc"], left // item)
            left = left - size if tail == e["npc"] else 0  # bytes after a cut value belong to no object
        base = {"path": e["path"], "type_code": e["code"], "item": item, "npc": e["npc"], "rel": rel, "blob": e["blob"],
                "daqmx": e["daqmx"]}
        if rows:  # one strided run over all rows
            out.append({**base, "npc": e["npc"] * full + tail, "stride": width, "chunk": 0, "n_chunks": 1, "tail": 0, "tail_rel": 0})
            rel += item
        else:
            out.append({**base, "stride": item, "chunk": chunk, "n_chunks": full, "tail": tail, "tail_rel": full * chunk + tail_rel})
            rel += size
            tail_rel += tail * item
    return out


def _walk(uri: str, size: int, index: bool) -> Iterator[dict]:
    """Segment rows of one file, ending with a `tail` row if bytes after the last segment are ignored."""
    listed: dict = {}
    last: dict = {}
    pos = at = seg_no = 0  # pos: place in the data file; at: place in the file that is read
    with _open(uri) as raw:
        f = ReadAhead(raw)  # the headers of small segments share reads
        while at + LEAD_IN <= size:
            lead = f.read_at(LEAD_IN, at)
            toc = struct.unpack_from("<i", lead, 4)[0]
            if lead[:4] != (INDEX_TAG if index else DATA_TAG) or toc & ~TOC_KNOWN:
                break
            order = ">" if toc & TOC_BIG_ENDIAN else "<"
            _version, nxt, meta = struct.unpack_from(order + "iQQ", lead, 8)
            unfinished = nxt == UNFINISHED
            if not unfinished and meta > nxt:
                break
            data_pos = pos + LEAD_IN + meta
            end = size if unfinished or (not index and pos + LEAD_IN + nxt > size) else pos + LEAD_IN + nxt
            head = f.read_at(min(meta, size - at - LEAD_IN), at + LEAD_IN)
            props: list = []
            try:
                if toc & TOC_META:
                    if toc & TOC_NEW_LIST:
                        listed = {}
                    props = _read_objects(_Cursor(head, order), listed, last)
            except (struct.error, IndexError):
                break
            held = [e for e in listed.values() if e.get("has") and e["code"] is not None]
            objects = _layout(held, toc, max(0, end - data_pos)) if held and toc & TOC_RAW and not index else []
            digest = int.from_bytes(hashlib.blake2b(lead[4:] + head, digest_size=8).digest(), "little", signed=True)
            status = "open" if unfinished else ("cut" if pos + LEAD_IN + nxt > size and not index else "ok")
            yield {"file": uri, "size": size, "seg_no": seg_no, "pos": pos, "toc": toc, "data_pos": data_pos, "next_pos": end,
                   "status": status, "digest": digest, "objects": objects, "props": props}
            seg_no += 1
            pos = end
            at = at + LEAD_IN + meta if index else end
    if at < size:
        yield {"file": uri, "size": size, "seg_no": seg_no, "pos": at, "toc": 0, "data_pos": at, "next_pos": size,
               "status": "tail", "digest": 0, "objects": [], "props": []}


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def _header_reader(index: bool):
    schema = _arrow_schema(SEGMENT_SCHEMA)

    def read(batches):
        for batch in batches:
            for uri, size in zip(batch["path"].to_pylist(), batch["size"].to_pylist()):
                block: list = []
                for row in _walk(uri, size, index):
                    block.append(row)
                    if len(block) >= 1024:
                        yield pa.RecordBatch.from_pylist(block, schema=schema)
                        block = []
                if block:
                    yield pa.RecordBatch.from_pylist(block, schema=schema)
    return read


def scan_segments(spark: SparkSession, path: str, pattern: str = "*.tdms", index: bool = False) -> DataFrame:
    """Segment table of a folder of files: headers and metadata only, files in parallel.

    status: ok, open (unfinished, runs to the end of the file), cut (longer than the file) or tail
    (ignored bytes). `index` walks sidecar index files instead of data files.
    """
    files = file_snapshot(spark, path, pattern).select("path", "size")
    return files.repartition(task_count(spark, files.count(), FILES_PER_TASK)).mapInArrow(_header_reader(index), SEGMENT_SCHEMA)


def segments(scan: DataFrame) -> DataFrame:
    """file, seg_no, pos, toc, data_pos, next_pos, status."""
    return scan.filter("status <> 'tail'").select("file", "seg_no", "pos", "toc", "data_pos", "next_pos", "status")


def ignored_tails(scan: DataFrame) -> DataFrame:
    """One warning per file with bytes after its last segment."""
    return scan.filter("status = 'tail'").select("file", F.format_string(
        "No segment begins at byte %d: the last %d bytes of the file were left out.", F.col("pos"), F.col("size") - F.col("pos")).alias("message"))


def index_check(data: DataFrame, index: DataFrame) -> DataFrame:
    """Per file: does the sidecar index repeat the header of every segment? (all segments are compared)"""
    from ..operators.layout import reconcile
    a = data.filter("status <> 'tail'").select("file", "seg_no", "digest")
    b = index.filter("status <> 'tail'").select(F.regexp_replace("file", "_index$", "").alias("file"), "seg_no", "digest")
    return reconcile(a, b, ["file", "seg_no"], "file")


_PATH = r"^/'((?:[^']|'')*)'(?:/'((?:[^']|'')*)')?$"


def _part(path: Column, k: int) -> Column:
    return F.replace(F.regexp_extract(path, _PATH, k), F.lit("''"), F.lit("'"))


def object_catalog(scan: DataFrame) -> DataFrame:
    """Properties of every object of every file, the last written value of each: file, path, props, times."""
    rows = scan.select("file", "seg_no", F.posexplode("props").alias("_i", "p")).select("file", "seg_no", "_i", "p.*")
    latest = rows.groupBy("file", "path", "name").agg(
        F.max_by(F.struct("type_code", "text", "ns"), F.struct("seg_no", "_i")).alias("v"))
    entry = F.struct(F.col("name"), F.coalesce("v.text", F.lit("NaT")).alias("text"))
    return latest.groupBy("file", "path").agg(
        F.map_from_entries(F.collect_list(entry)).alias("props"),
        F.max(F.when((F.col("name") == "wf_start_time") & (F.col("v.type_code") == TIME_CODE), F.col("v.ns"))).alias("start_prop_ns"))


def _layouts(scan: DataFrame) -> DataFrame:
    return scan.select("file", "seg_no", "toc", "data_pos", F.posexplode("objects").alias("obj_no", "o")).select(
        "file", "seg_no", "toc", "data_pos", "obj_no", "o.*").withColumn(
        "cnt", F.col("npc") * F.col("n_chunks") + F.col("tail"))


def channel_catalog(scan: DataFrame) -> DataFrame:
    """Channels of all files with type, kind, length, unit and waveform properties.

    Objects that only appear in metadata are channels of length 0.
    """
    held = _layouts(scan).groupBy("file", "path").agg(
        F.sum("cnt").alias("length"), F.max_by("type_code", "seg_no").alias("type_code"),
        F.count_distinct("type_code").alias("n_types"), F.bool_or("daqmx").alias("daqmx"))
    named = object_catalog(scan)
    out = held.join(named, ["file", "path"], "full_outer")
    out = out.withColumn("grp", _part(F.col("path"), 1)).withColumn("name", _part(F.col("path"), 2))
    out = out.filter(F.length("name") > 0).fillna({"length": 0, "daqmx": False})
    out = out.withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))
    rel = cat.start_relative_s("start_prop_ns")
    offset = cat.float_prop(F.try_element_at("props", F.lit("wf_start_offset")))
    out = out.withColumn("dx_text", F.try_element_at("props", F.lit("wf_increment")))
    out = cat.check_increment(out)
    return out.select(
        F.col("file").alias("file_id"), "path", "grp", "name", cat.label_of().alias("label"), "type_code",
        F.when(F.col("daqmx"), "raw").otherwise(cat.kind_of("type_code", "length")).alias("kind"), "length", cat.unit_of().alias("unit"), "wf_increment", "bad", "dx_text",
        F.when(rel != 0, F.coalesce(offset, F.lit(0.0)) + rel).otherwise(offset).alias("wf_start_offset"),
        cat.start_ns("start_prop_ns").alias("wf_start_ns"), "daqmx", F.coalesce("n_types", F.lit(0)).alias("n_types"), "props")


def channel_scales(scan: DataFrame) -> DataFrame:
    """file, path, slope, intercept, scale of every channel.

    The scale belongs to the channel, else to its group, else to the file. scale: none, linear, scaled (values are stored scaled)
    or unsupported (another type, several scales, or a scale of another one's result); only linear ones are applied.
    """
    objects = object_catalog(scan).select("file", "path", "props")
    chans = _layouts(scan).select("file", "path").distinct()

    def entry(key: str) -> Column:
        return F.try_element_at("props", F.lit(key))

    count = F.coalesce(entry("NI_Number_Of_Scales").try_cast("int"), F.lit(0))
    source = F.coalesce(entry("NI_Scale[0]_Linear_Input_Source").try_cast("bigint"), F.lit(-1))
    plain = (count == 1) & (entry("NI_Scale[0]_Scale_Type") == "Linear") & source.isin(-1, 0xFFFFFFFF)
    slope, intercept = cat.float_prop(entry("NI_Scale[0]_Linear_Slope")), cat.float_prop(entry("NI_Scale[0]_Linear_Y_Intercept"))
    kind = F.when(F.lower(entry("NI_Scaling_Status")) == "scaled", "scaled").when(count == 0, F.lit(None)).when(
        F.coalesce(plain & slope.isNotNull(), F.lit(False)), "linear").otherwise("unsupported")
    own = objects.select("file", "path", F.struct(kind.alias("scale"), slope.alias("slope"), F.coalesce(intercept, F.lit(0.0)).alias("intercept")).alias("s"))
    own = own.filter("s.scale IS NOT NULL")
    levels = chans.select("file", "path", F.col("path").alias("p0"), F.regexp_extract("path", r"^(/'(?:[^']|'')*')/", 1).alias("p1"), F.lit("/").alias("p2"))
    for k in range(3):
        levels = levels.join(own.select("file", F.col("path").alias(f"p{k}"), F.col("s").alias(f"s{k}")), ["file", f"p{k}"], "left")
    best = F.coalesce("s0", "s1", "s2")
    out = levels.select("file", "path", F.coalesce(best["scale"], F.lit("none")).alias("scale"), best["slope"].alias("slope"), best["intercept"].alias("intercept"))
    return out.select("file", "path", F.when(F.col("scale") == "linear", F.col("slope")).alias("slope"),
                      F.when(F.col("scale") == "linear", F.col("intercept")).alias("intercept"), "scale")


def scaled_samples(samples: DataFrame, scales: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Numeric samples as doubles, with the linear scale of their channel.

    paths: the channels that samples holds (None: all of scales). One of these with an unsupported scale is an error, others do not matter.
    """
    scales = scales if paths is None else scales.filter(F.col("path").isin(paths))
    odd = scales.filter("scale = 'unsupported'").select("path").first()
    if odd is not None:
        raise ValueError(f"the scale of {odd.path} is not linear")
    v = F.col("v").cast("double")
    return samples.join(scales.select("file", "path", "slope", "intercept"), ["file", "path"], "left").select(
        "file", "path", "sample_idx", F.when(F.col("slope").isNull(), v).otherwise(v * F.col("slope") + F.col("intercept")).alias("v"))


def read_scaled(runs: DataFrame, scales: DataFrame, kind: str = "float", keep: tuple[str, ...] = ("file", "path")) -> DataFrame:
    """The columns ``keep`` of runs, sample_idx and v: numeric samples as doubles, with the linear scale of their channel.

    The same as `scaled_samples` of `read_samples`, but scales meet the few runs, not every sample. An unsupported scale is an error.
    """
    odd = runs.filter(F.col("type_code").isin(_codes_of(kind))).join(scales.filter("scale = 'unsupported'"), ["file", "path"], "left_semi").select("path").first()
    if odd is not None:
        raise ValueError(f"the scale of {odd.path} is not linear")
    scaled = settle(runs.join(scales.select("file", "path", "slope", "intercept"), ["file", "path"], "left"), "scaled-runs")
    v = F.col("v").cast("double")
    return read_samples(scaled, kind, keep=(*keep, "slope", "intercept")).select(
        *keep, "sample_idx", F.when(F.col("slope").isNull(), v).otherwise(v * F.col("slope") + F.col("intercept")).alias("v"))


def value_runs(scan: DataFrame) -> DataFrame:
    """Runs of values of each channel with their first sample index.

    file, path, type_code, big, base (byte), item, stride, npc, chunk, n_chunks, cnt, start.
    """
    lay = _layouts(scan).filter(~F.col("daqmx"))
    common = ["file", "path", "seg_no", "type_code", "item", "blob", "stride"]
    big = (F.col("toc").bitwiseAND(F.lit(TOC_BIG_ENDIAN)) != 0).alias("big")
    main = F.struct(F.lit(0).alias("part"), (F.col("data_pos") + F.col("rel")).alias("base"), F.col("npc"), F.col("chunk"), F.col("n_chunks"))
    tail = F.struct(F.lit(1).alias("part"), (F.col("data_pos") + F.col("tail_rel")).alias("base"), F.col("tail").alias("npc"),
                    F.lit(0).cast("bigint").alias("chunk"), F.lit(1).cast("bigint").alias("n_chunks"))
    runs = lay.select(*common, big, F.inline(F.array(main, tail))).withColumn("cnt", F.col("npc") * F.col("n_chunks")).filter("cnt > 0")
    runs = runs.withColumn("_order", F.col("seg_no") * 2 + F.col("part"))
    return running(runs, ["file", "path"], "_order", F.col("cnt"), "sum", "start", inclusive=False).drop("_order", "part")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Join the runs of consecutive single-chunk segments of one layout at a constant distance.

    A file written as thousands of equal segments becomes a few strided runs per channel.
    """
    numbered = running_rows(runs.withColumn("_one", F.lit(1)), ["file", "path"], ["start"], F.col("_one"), "sum", "_no", inclusive=False)
    # A run of several chunks stays alone: its position is part of its layout.
    alone = F.when(F.col("n_chunks") > 1, F.col("base"))
    lay = F.struct("type_code", "big", "item", "blob", F.col("stride").alias("step"), "npc", "chunk", "n_chunks", alone.alias("alone"))
    parts = numbered.select("file", "path", F.col("_no").alias("seg_no"), F.col("base").alias("pos"), lay.alias("layout"), "cnt")
    many = F.col("n_segs") > 1
    return run_compress(parts, ("file", "path")).select(
        "file", "path", "layout.type_code", "layout.item", "layout.blob", F.col("layout.step").alias("stride"), "layout.big",
        F.col("pos").alias("base"), "layout.npc", F.when(many, F.col("stride")).otherwise(F.col("layout.chunk")).alias("chunk"),
        F.when(many, F.col("n_segs")).otherwise(F.col("layout.n_chunks")).alias("n_chunks"), "cnt", "start")


def _decoded(raw: bytes, stride: int, item: int, n: int) -> np.ndarray:
    """n values of `item` bytes at distance `stride` as rows of bytes."""
    block = np.frombuffer(raw, np.uint8)
    if stride == item:
        return block[:n * item].reshape(n, item)
    return np.lib.stride_tricks.as_strided(block, (n, item), (stride, 1))


def _values(rows: np.ndarray, code: int, big: bool, kind: str) -> pa.Array:
    order = ">" if big else "<"
    rows = np.ascontiguousarray(rows)
    if code in EXT_CODES:
        return pa.array(decode_extended(rows[:, ::-1] if big else rows))
    if code == TIME_CODE:
        dt = np.dtype([("f", "<u8"), ("s", "<i8")]) if not big else np.dtype([("s", ">i8"), ("f", ">u8")])
        t = rows.view(dt)[:, 0]
        frac = pa.array(t["f"].astype(np.uint64)).cast(pa.decimal128(20, 0))
        return pa.StructArray.from_arrays([pa.array(t["s"].astype(np.int64)), frac], ["sec", "frac"])
    v = rows.view(np.dtype(NUMPY_OF[code]).newbyteorder(order))[:, 0]
    v = v.astype(v.dtype.newbyteorder("="))
    if kind == "float":
        return pa.array(v.astype(np.float64))
    if kind == "bool":
        return pa.array(v != 0)
    if kind == "complex":
        return pa.StructArray.from_arrays([pa.array(v.real.astype(np.float64)), pa.array(v.imag.astype(np.float64))], ["re", "im"])
    if kind == "uint64":
        return pa.array(v).cast(pa.decimal128(20, 0))
    return pa.array(v.astype(np.int64))


def _strings(f, p: dict, order: str) -> list[str]:
    """Values [a, b) of string chunks: a table of end offsets, then the bytes."""
    out: list[str] = []
    npc, a, b = p["npc"], p["a"], p["b"]
    for c in range(a // npc, -(-b // npc)):
        raw = f.read_at(p["blob"], p["base"] + c * p["chunk"])
        ends = np.frombuffer(raw, np.dtype("u4").newbyteorder(order), npc).astype(np.int64)
        body, begin = raw[4 * npc:], np.concatenate(([0], ends[:-1]))
        for i in range(max(a - c * npc, 0), min(b - c * npc, npc)):
            out.append(decode_name(body[begin[i]:ends[i]]))
    return out


def _piece_rows(f, p: dict) -> np.ndarray:
    """Bytes of the values [a, b) of a run, one row per value; near chunks share one read."""
    npc, item, stride, chunk, a, b = p["npc"], p["item"], p["stride"], p["chunk"], p["a"], p["b"]
    first, last = a // npc, (b - 1) // npc
    if first == last or chunk == 0:
        lo = p["base"] + first * chunk + (a - first * npc) * stride
        return _decoded(f.read_at((b - a - 1) * stride + item, lo), stride, item, b - a)
    lo = p["base"] + first * chunk
    span = (last - first) * chunk + npc * stride
    if span <= ONE_READ_BYTES:
        raw = f.read_at(span, lo)
        raw += b"\0" * ((last - first + 1) * chunk - len(raw))
        grid = np.frombuffer(raw, np.uint8)[:(last - first + 1) * chunk].reshape(-1, chunk)[:, :npc * stride]
        return grid.reshape(-1, stride)[a - first * npc:b - first * npc, :item]
    parts = []
    for c in range(first, last + 1):
        i, j = max(a - c * npc, 0), min(b - c * npc, npc)
        raw = f.read_at((j - i) * stride, p["base"] + c * chunk + i * stride)
        parts.append(np.frombuffer(raw, np.uint8).reshape(-1, item))
    return np.concatenate(parts)


def _piece_reader(kind: str, ddl: str, keep: tuple[str, ...] = ("file", "path")):
    schema = _arrow_schema(ddl)

    def joined(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], schema=schema)

    def read(batches):
        uri = f = None
        held: list = []  # small pieces are sent together
        rows = 0
        for batch in batches:
            for p in batch.to_pylist():
                if p["file"] != uri:
                    if f is not None:
                        f.close()
                    uri, f = p["file"], _open(p["file"])
                n = p["b"] - p["a"]
                if kind == "string":
                    values = pa.array(_strings(f, p, ">" if p["big"] else "<"), pa.string())
                else:
                    values = _values(_piece_rows(f, p), p["type_code"], p["big"], kind)
                idx = pa.array(p["start"] + np.arange(p["a"], p["b"], dtype=np.int64))
                same = [pa.repeat(pa.scalar(p[c], schema.field(c).type), n) for c in keep]
                held.append((*same, idx, values.cast(schema.field("v").type)))
                rows += n
                if rows >= BATCH_ROWS:
                    yield joined(held)
                    held, rows = [], 0
        if held:
            yield joined(held)
        if f is not None:
            f.close()
    return read


def _codes_of(kind: str) -> list[int]:
    if kind == "float":
        return [9, 10, 0x19, 0x1A, *EXT_CODES]
    if kind == "int":
        return [1, 2, 3, 4, 5, 6, 7]
    return {"uint64": [8], "bool": [0x21], "time": [TIME_CODE], "complex": [0x08000C, 0x10000D], "string": [STRING_CODE]}[kind]


def read_samples(runs: DataFrame, kind: str = "float", paths: list[str] | None = None, start: int = 0,
                 stop: int | None = None, partial: bool = False, keep: tuple[str, ...] = ("file", "path")) -> DataFrame:
    """Samples of one kind: file, path, sample_idx, v (type: SAMPLE_TYPES). keep: other columns of runs that each sample repeats instead.

    runs: `value_runs` (store it once for repeated reads). Only runs of the wanted channels that
    overlap [start, stop) become pieces. A channel whose values change their kind is refused, see `read_numbers`.
    """
    asked = runs if paths is None else runs.filter(F.col("path").isin(paths))
    mine = F.col("type_code").isin(_codes_of(kind))
    mixed = None if partial else asked.groupBy("file", "path").agg(F.bool_or(mine).alias("a"), F.bool_or(~mine).alias("b")).filter("a AND b").first()
    if mixed is not None:
        raise ValueError(f"{mixed.path} holds values of several kinds")
    wanted = asked.filter(mine)
    lo = F.greatest(F.lit(max(0, start)).cast("bigint") - F.col("start"), F.lit(0))
    hi = F.col("cnt") if stop is None else F.least(F.lit(stop).cast("bigint") - F.col("start"), F.col("cnt"))
    wanted = wanted.withColumn("_lo", lo).withColumn("_hi", hi).filter("_hi > _lo")
    pieces, values = wanted.selectExpr(f"sum(ceil((_hi - _lo) / {PIECE_VALUES}))", "sum(_hi - _lo)").first()
    spark = runs.sparkSession
    tasks = max(task_count(spark, pieces or 0, PIECES_PER_TASK), -(-(values or 0) // VALUES_PER_TASK))
    pieces = wanted.withColumn("a", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1, F.lit(PIECE_VALUES).cast("bigint"))))
    pieces = pieces.withColumn("b", F.least(F.col("a") + PIECE_VALUES, F.col("_hi"))).select(
        "file", "path", "type_code", "big", "base", "item", "stride", "npc", "chunk", "blob", "start", "a", "b",
        *[c for c in keep if c not in ("file", "path")])
    stored = "struct<sec: bigint, frac: decimal(20,0)>" if kind == "time" else SAMPLE_TYPES[kind]
    ddl = ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in keep) + f", sample_idx bigint, v {stored}"
    # Range partitioning keeps neighbouring bytes in one task and splits a large file over many.
    out = pieces.repartitionByRange(tasks, "file", "base", "a").sortWithinPartitions("file", "base", "a").mapInArrow(
        _piece_reader(kind, ddl, keep), ddl)
    return out.withColumn("v", epoch1904_ns("v.sec", "v.frac")) if kind == "time" else out


def read_numbers(runs: DataFrame, paths: list[str] | None = None, start: int = 0, stop: int | None = None) -> DataFrame:
    """All numeric and boolean samples as doubles, also of channels whose type changes between segments."""
    parts = [read_samples(runs, kind, paths, start, stop, partial=True) for kind in ("float", "int", "uint64", "bool")]
    return reduce(DataFrame.unionByName, [p.withColumn("v", F.col("v").cast("double")) for p in parts])


__all__ = ["read_numbers", "channel_scales", "scaled_samples", "read_scaled", "scan_segments", "segments", "ignored_tails", "index_check", "object_catalog", "channel_catalog", "value_runs",
           "merge_runs", "read_samples"]
