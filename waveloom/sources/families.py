"""Shared reads: the channels that lie interleaved in one block of rows are decoded from one read of its bytes.

`layout_families` groups the value runs of a segment: a family holds all channels of an interleaved block, a contiguous run is a family of
its own. `family_pieces` cuts the wanted rows of a family into pieces of bounded bytes, whatever the number of channels, and
`read_families` decodes every wanted channel, of any kind, from the one read of each piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import EPOCH_1904_S, NS_MAX_S, NS_MIN_S, NS_PER_S
from ..session import task_count
from .readahead import ReadAhead
from .segments import (BATCH_ROWS, PIECE_VALUES, SAMPLE_TYPES, STRING_CODE, TIME_CODE, _codes_of, _open, _piece_rows, _values,
                       decode_name)

PIECE_BYTES = 4 << 20  # of one piece
PIECES_PER_TASK = 32
KINDS = tuple(SAMPLE_TYPES)
KIND_OF = {code: kind for kind in KINDS for code in _codes_of(kind)}

MEMBERS = "array<struct<rel: bigint, path: string, type_code: bigint, item: bigint, start: bigint>>"
PIECE_SCHEMA = f"file string, big boolean, base bigint, stride bigint, npc bigint, chunk bigint, blob bigint, a bigint, b bigint, members {MEMBERS}"


def layout_families(runs: DataFrame) -> DataFrame:
    """Families of the runs of `value_runs`: file, big, base, stride, npc, chunk, n_chunks, blob, rows, members(rel, path, type_code, item, start).

    rel: first byte of a member's value in a row. The members of a family are the channels of one segment, as its metadata lists them.
    """
    alone = F.when(F.col("stride") == F.col("item"), F.col("base")).alias("_alone")
    same = ["file", "seg_no", "big", "stride", "npc", "chunk", "n_chunks", "blob"]
    member = F.struct("base", "path", "type_code", "item", "start")
    out = runs.groupBy(*same, alone).agg(F.min("base").alias("base"), F.array_sort(F.collect_list(member)).alias("m"))
    return out.select("file", "big", "base", "stride", "npc", "chunk", "n_chunks", "blob", (F.col("npc") * F.col("n_chunks")).alias("rows"),
                      F.expr("transform(m, x -> named_struct('rel', x.base - base, 'path', x.path, 'type_code', x.type_code, 'item', x.item, 'start', x.start))").cast(MEMBERS).alias("members"))


def family_pieces(families: DataFrame, paths: list[str] | None = None, start: int = 0, stop: int | None = None,
                  kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Pieces (PIECE_SCHEMA) of the wanted channels and samples: rows [a, b) of a family with the wanted members that have samples there.

    A piece of numbers has at most PIECE_BYTES (or one row), of strings PIECE_VALUES values.
    """
    codes = ", ".join(str(c) for c in sorted(KIND_OF) if KIND_OF[c] in kinds) or "NULL"
    lo = max(0, start)
    first = f"greatest({lo}L - m.start, 0L)"
    last = "rows" if stop is None else f"least({int(stop)}L - m.start, rows)"
    f = families.withColumn("members", F.expr(f"filter(members, m -> m.type_code IN ({codes}) AND {last} > {first})"))
    if paths is not None:
        f = f.withColumn("members", F.filter("members", lambda m: m["path"].isin(paths)))
    f = f.filter("size(members) > 0").selectExpr("*", f"array_min(transform(members, m -> {first})) AS lo", f"array_max(transform(members, m -> {last})) AS hi",
                                                 f"IF(stride > 0, greatest(1L, {PIECE_BYTES}L div stride), {PIECE_VALUES}L) AS step")
    f = f.withColumn("a", F.explode(F.sequence("lo", F.col("hi") - 1, "step"))).withColumn("b", F.least(F.col("a") + F.col("step"), "hi"))
    return f.select("file", "big", "base", "stride", "npc", "chunk", "blob", "a", "b", "members")


def epoch_ns(sec: np.ndarray, frac: np.ndarray) -> pa.Array:
    """Seconds since 1904 and 2^-64 fractions as epoch ns, to nearest; null outside 64-bit ns."""
    low = np.uint64(0xFFFFFFFF)
    billion = np.uint64(NS_PER_S)
    t = (frac >> np.uint64(32)) * billion + ((frac & low) * billion >> np.uint64(32))
    ns = ((t + np.uint64(1 << 31)) >> np.uint64(32)).astype(np.int64)
    fine = (sec >= NS_MIN_S) & (sec <= NS_MAX_S)
    return pa.array((np.where(fine, sec, EPOCH_1904_S) - EPOCH_1904_S) * NS_PER_S + ns, mask=~fine)


def _strings(f, p: dict, order: str) -> list[str]:
    """Values [a, b) of string chunks: of each chunk only their part of the offset table and their bytes are read."""
    out: list[str] = []
    npc = p["npc"]
    for c in range(p["a"] // npc, -(-p["b"] // npc)):
        i, j, at = max(p["a"] - c * npc, 0), min(p["b"] - c * npc, npc), p["base"] + c * p["chunk"]
        ends = np.frombuffer(f.read_at(4 * (j - max(i - 1, 0)), at + 4 * max(i - 1, 0)), np.dtype("u4").newbyteorder(order)).astype(np.int64)
        begins = np.concatenate([[0], ends]) if i == 0 else ends
        body = f.read_at(int(begins[-1] - begins[0]), at + 4 * npc + int(begins[0]))
        out += [decode_name(body[x - begins[0]:y - begins[0]]) for x, y in zip(begins[:-1], begins[1:])]
    return out


def decoded_pieces(pieces: Iterator[dict], schema: pa.Schema, start: int = 0, stop: int | None = None, opened=None) -> Iterator[pa.RecordBatch]:
    """Samples of pieces as batches of file, path, sample_idx, kind and one column for each kind in schema."""
    uri = f = None
    held: list = []
    rows = 0
    columns = schema.names[4:]
    for p in pieces:
        if p["file"] != uri:
            if f is not None:
                f.close()
            uri, f = p["file"], ReadAhead((opened or _open)(p["file"]))
        a, b, members = p["a"], p["b"], p["members"]
        if members[0]["type_code"] == STRING_CODE:
            grid = None
        else:
            width = max(m["rel"] + m["item"] for m in members)
            grid = _piece_rows(f, {**p, "item": width})  # one read: a row per sample, the members beside each other
        for m in members:
            i = max(a, max(0, start) - m["start"])
            j = b if stop is None else min(b, stop - m["start"])
            if j <= i:
                continue
            kind = KIND_OF[m["type_code"]]
            if grid is None:
                values = pa.array(_strings(f, {**p, "a": i, "b": j}, ">" if p["big"] else "<"), pa.string())
            else:
                values = _values(grid[i - a:j - a, m["rel"]:m["rel"] + m["item"]], m["type_code"], p["big"], kind)
                if m["type_code"] == TIME_CODE:
                    values = epoch_ns(values.field(0).to_numpy(), values.field(1).cast(pa.uint64()).to_numpy())
            n = j - i
            typed = [values.cast(schema.field(k).type) if k == kind else pa.nulls(n, schema.field(k).type) for k in columns]
            held.append([pa.repeat(p["file"], n), pa.repeat(m["path"], n), pa.array(m["start"] + np.arange(i, j, dtype=np.int64)), pa.repeat(kind, n), *typed])
            rows += n
            if rows >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], schema=schema)
                held, rows = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], schema=schema)
    if f is not None:
        f.close()


def family_schema(kinds: tuple[str, ...] = KINDS) -> str:
    return "file string, path string, sample_idx bigint, kind string, " + ", ".join(f"`{k}` {SAMPLE_TYPES[k]}" for k in kinds)


def family_arrow(kinds: tuple[str, ...] = KINDS) -> pa.Schema:
    """The same for Arrow; needs no session, so readers on executors can ask for it."""
    of = {"float": pa.float64(), "int": pa.int64(), "uint64": pa.decimal128(20, 0), "bool": pa.bool_(), "time": pa.int64(),
          "complex": pa.struct([("re", pa.float64()), ("im", pa.float64())]), "string": pa.string()}
    return pa.schema([("file", pa.string()), ("path", pa.string()), ("sample_idx", pa.int64()), ("kind", pa.string()), *[(k, of[k]) for k in kinds]])


def read_families(families: DataFrame, paths: list[str] | None = None, start: int = 0, stop: int | None = None,
                  kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Samples [start, stop) of the wanted channels: file, path, sample_idx, kind and a column of its native type for each kind.

    families: `layout_families` (store it for repeated reads). The bytes of an interleaved block are read once, for one channel or for
    all of them; times come as epoch ns.
    """
    schema = family_arrow(kinds)
    pieces = family_pieces(families, paths, start, stop, kinds)
    tasks = task_count(pieces.sparkSession, pieces.count(), PIECES_PER_TASK)

    def read(batches):
        return decoded_pieces((p for batch in batches for p in batch.to_pylist()), schema, start, stop)

    return pieces.repartitionByRange(tasks, "file", "base", "a").sortWithinPartitions("file", "base", "a").mapInArrow(read, family_schema(kinds))
