"""Encode DataFrame rows as small segmented files: input for checking the file source.

The engine itself never writes this format for users; the encoder exists so that the reader can
be run over whole tables and in tests.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.envelope import bucket_of
from ..operators.layout import TOC_BIG_ENDIAN, TOC_INTERLEAVED, TOC_META, TOC_NEW_LIST, TOC_RAW

CODE_OF = {"i1": 1, "i2": 2, "i4": 3, "i8": 4, "u1": 5, "u2": 6, "u4": 7, "u8": 8, "f4": 9, "f8": 10, "b1": 0x21,
           "c8": 0x08000C, "c16": 0x10000D}
FILE_SAMPLES = 1 << 14  # samples per encoded file
SEGMENT_SAMPLES = 1 << 11


def _text(s: str | bytes, order: str) -> bytes:
    raw = s if isinstance(s, bytes) else s.encode()
    return struct.pack(order + "I", len(raw)) + raw


def _time(sec: int, frac: int, order: str) -> bytes:
    return struct.pack("<Qq", frac, sec) if order == "<" else struct.pack(">qQ", sec, frac)


def encode_props(props: dict, order: str) -> bytes:
    """str, float, int (int32) or (seconds, fractions) property values."""
    out = struct.pack(order + "I", len(props))
    for name, v in props.items():
        out += _text(name, order)
        if isinstance(v, str):
            out += struct.pack(order + "I", 0x20) + _text(v, order)
        elif isinstance(v, float):
            out += struct.pack(order + "Id", 10, v)
        elif isinstance(v, tuple):
            out += struct.pack(order + "I", 0x44) + _time(*v, order)
        else:
            out += struct.pack(order + "Ii", 3, v)
    return out


def encode_values(values, order: str) -> tuple[int, bytes, int]:
    """(type code, bytes, item size; 0 for strings) of one chunk."""
    if isinstance(values, list) and (not values or isinstance(values[0], str)):
        raw = [v.encode() for v in values]
        ends = np.cumsum([len(r) for r in raw]).astype(order + "u4")
        return 0x20, ends.tobytes() + b"".join(raw), 0
    if isinstance(values, list):  # (seconds, fractions) pairs
        return 0x44, b"".join(_time(s, f, order) for s, f in values), 16
    v = np.asarray(values)
    if v.dtype.names:  # the same pairs as fields s and f
        names = "fs" if order == "<" else "sf"
        t = np.empty(len(v), [(k, f"{order}{'i8' if k == 's' else 'u8'}") for k in names])
        t["s"], t["f"] = v["s"], v["f"]
        return 0x44, t.tobytes(), 16
    return CODE_OF[v.dtype.str[1:]], v.astype(v.dtype.newbyteorder(order)).tobytes(), v.dtype.itemsize


def encode_segment(channels: dict, *, chunks: int = 1, interleaved: bool = False, big: bool = False, new_list: bool = True,
                   meta: bool = True, same: bool = False, props: dict | None = None, unfinished: bool = False,
                   tag: bytes = b"TDSm", extra: bytes = b"") -> tuple[bytes, bytes, bytes]:
    """(lead-in, metadata, data) of one segment. channels: path -> values (None: object without data)."""
    order = ">" if big else "<"
    props = props or {}
    head, parts = b"", []
    paths = list(dict.fromkeys([*props, *channels]))
    if meta:
        head = struct.pack(order + "I", len(paths))
    for path in paths:
        values = channels.get(path)
        if values is None:
            index = struct.pack(order + "I", 0xFFFFFFFF)
        else:
            npc = len(values) // chunks
            pieces = [encode_values(values[c * npc:(c + 1) * npc], order) for c in range(chunks)]
            code, _raw, item = pieces[0]
            parts.append((item, [p[1] for p in pieces]))
            body = struct.pack(order + "IIQ", code, 1, npc)
            if code == 0x20:
                body += struct.pack(order + "Q", len(pieces[0][1]))
            index = struct.pack(order + "I", 0) if same else struct.pack(order + "I", len(body) + 4) + body
        if meta:
            head += _text(path, order) + index + encode_props(props.get(path, {}), order)
    if interleaved and parts:
        data = np.hstack([np.frombuffer(b"".join(raw), np.uint8).reshape(-1, item) for item, raw in parts]).tobytes()
    else:
        data = b"".join(raw[c] for c in range(chunks) for _item, raw in parts)
    data += extra
    toc = (TOC_META if meta else 0) | (TOC_NEW_LIST if meta and new_list else 0) | (TOC_RAW if parts else 0)
    toc |= (TOC_INTERLEAVED if interleaved else 0) | (TOC_BIG_ENDIAN if big else 0)
    nxt = 0xFFFFFFFFFFFFFFFF if unfinished else len(head) + len(data)
    return tag + struct.pack("<i", toc) + struct.pack(order + "iQQ", 4713, nxt, len(head)), head, data


def write_files(samples: DataFrame, folder: str, columns: list[str], encode=None, more_props=None) -> DataFrame:
    """Write one file (and its index) per channel and block of FILE_SAMPLES samples; returns file name, first sample and count.

    The layout alternates: contiguous, interleaved, big-endian, several chunks. A task writes its
    file under a temporary name and renames it, so a repeated task leaves the same file.
    encode(rows) gives the values of each channel (default: the columns), more_props(channel) further properties by path.
    """
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs as pafs

        uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        pdf = pdf.sort_values("sample_idx")
        channel, block, first = pdf["channel_id"].iloc[0], int(pdf["block"].iloc[0]), int(pdf["sample_idx"].iloc[0])
        group = "/'" + channel.replace("'", "''") + "'"
        props = {"/": {"first": first}, group: {"block": block},
                 **{f"{group}/'{c}'": {"wf_increment": 0.5, "wf_start_offset": float(first), "unit_string": "u" + c} for c in columns}}
        for path, own in (more_props(channel, group) if more_props else {}).items():
            props[path] = {**props.get(path, {}), **own}
        out = index = b""
        for k, lo in enumerate(range(0, len(pdf), SEGMENT_SAMPLES)):
            part = pdf.iloc[lo:lo + SEGMENT_SAMPLES]
            chunks = 4 if k % 3 == 2 and len(part) % 4 == 0 else 1
            held = encode(part) if encode else {c: part[c].to_numpy() for c in columns}
            values = {f"{group}/'{c}'": v for c, v in held.items()}
            seg = encode_segment(values, chunks=chunks, interleaved=(block + k) % 2 == 1, big=k % 5 == 3, props=props if k == 0 else None)
            out += b"".join(seg)
            index += b"TDSh" + seg[0][4:] + seg[1]
        name = f"{channel}-{block:09d}.tdms"
        for target, data in ((name, out), (f"{name}_index", index)):
            with fs.open_output_stream(f"{root}/{target}.part") as f:
                f.write(data)
            fs.move(f"{root}/{target}.part", f"{root}/{target}")
        return pd.DataFrame({"name": [name], "first": [first], "cnt": [len(pdf)]})

    rows = samples.select("channel_id", "sample_idx", *columns).withColumn("block", bucket_of("sample_idx", FILE_SAMPLES))
    return rows.groupBy("channel_id", "block").applyInPandas(write, "name string, first bigint, cnt bigint")
