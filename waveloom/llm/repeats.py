"""Removal of byte strings that an earlier document has: bounded suffix arrays per bucket and interval expansion on their BWT.

A 50-byte string belongs to the bucket of its minimizer (the smallest hash of its 20-byte windows), so all its occurrences meet
there. Runs of neighbouring strings with one minimizer travel as one string. Only runs whose minimizer occurs in two documents
are sent, each distinct run once per group of documents, with the smallest doc_id that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import settle, table
from .textbytes import _TABLE, _powers, blocks, mixed, text_bytes

CHUNK = 1 << 18
MIN_LENGTH = 50
ANCHOR = 20                # bytes whose hash is compared for the minimizer
GROUP_BYTES = 6 << 20     # bytes of the texts of one group, about
BATCH_BYTES = 6 << 20      # bytes of texts whose runs are sorted together
SORT_BYTES = 1 << 18       # bytes of one suffix array, about
KEY = 7                    # bytes that fit one sorting key
BIG = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of the same length or not, byte planes side by side, compressed."""
    parts = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        parts.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little"))
        parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 2
    for _ in range(int.from_bytes(raw[:2], "little")):
        kind, n = np.dtype(raw[at:at + 4].decode().strip()), int.from_bytes(raw[at + 4:at + 12], "little")
        at += 12
        out.append(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy().reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def _cut(column: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """One binary value for the entries before each end and after the end before: no call and no buffer for each value."""
    offsets = (np.concatenate([[0], ends]) * column.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(column))])


def _whole(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The entries of all binary values, one after the other."""
    return text_bytes(column)[0].view(kind)


def _ends(ordered: np.ndarray) -> np.ndarray:
    """The ends of the stretches of equal values."""
    return np.flatnonzero(np.concatenate([ordered[1:] != ordered[:-1], np.ones(min(1, len(ordered)), bool)])) + 1


class Runs:
    """Runs of neighbouring strings of ``length`` bytes with the same minimizer: row, pos (in its text), start, end, value, key."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int):
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
        n = len(data) - length + 1
        size = np.maximum(np.diff(off) - length + 1, 0)
        anchor = min(ANCHOR, length)
        if n <= 0 or not size.any():
            self.row = self.pos = self.start = self.end = np.zeros(0, np.int64)
            self.value = self.key = np.zeros(0, np.uint64)
            return
        low = mixed((sums[anchor:] - sums[:-anchor]) * down[: len(data) - anchor + 1])
        want, have = length - anchor + 1, 1
        while have < want:  # minimum of ``want`` neighbours by doubling
            step = min(have, want - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        place = np.repeat(off[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())  # valid starts
        row = np.repeat(np.arange(len(size)), size)
        value = low[place]
        head = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(value)))
        self.row, self.start, self.value = row[first], place[first], value[first]
        self.pos = self.start - off[self.row]
        self.end = self.start + count + length - 1
        self.key = mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def _sorted_keys(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys of so many bits, and the keys in it. Where key and place fit one word, the words themselves are sorted, which is
    several times faster than sorting places by keys."""
    low = max(1, (len(key) - 1).bit_length())
    if bits + low <= 64:
        both = np.sort((key << np.uint64(low)) | np.arange(len(key), dtype=np.uint64))
        return (both & np.uint64((1 << low) - 1)).astype(np.int64), both >> np.uint64(low)
    order = np.argsort(key)
    return order, key[order]


def suffix_order(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their first ``length`` codes (by doubling), and the rank by the first KEY codes."""
    n, span = len(codes), min(KEY, length)
    there = np.bincount(codes, minlength=1) > 0
    there[0] = True  # what follows the end
    kinds = int(there.sum())
    padded = np.concatenate([(np.cumsum(there) - 1)[codes], np.zeros(span, np.int64)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(span):
        key = key * np.uint64(kinds) + padded[k:k + n]
    short, bits = None, (kinds ** span - 1).bit_length()
    while True:
        order, key = _sorted_keys(key, bits)
        ranks = np.empty(n, np.uint64)
        ranks[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]), dtype=np.uint64)
        short = ranks if short is None else short
        if span >= length:
            return order, short
        step = min(span, length - span)
        later = np.zeros(n, np.uint64)
        later[: n - step] = ranks[step:] if step < n else 0
        key, span, bits = ranks * np.uint64(n + 1) + later, span + step, ((n + 1) ** 2 - 1).bit_length()


def bounded_classes(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and, for each place in it, the class of suffixes that agree in their first ``length`` codes.

    Breadth-first backward extension on the BWT: the intervals of strings of k codes give, extended by each code to the left,
    those of k + 1 codes. An interval whose end has no common-prefix value yet gets the value k there and is expanded further;
    intervals at known ends are dropped. Values come by increasing size, and the expansion stops at ``length``: ends that are
    still open then have a longer common prefix. It begins with the intervals of KEY codes, which the sort has given.
    """
    order, short = suffix_order(codes, length)
    n = len(codes)
    bwt = codes[order - 1]
    by_code = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)          # where the suffix that is longer by one code to the left stands
    step[by_code] = np.arange(n)
    closed = np.zeros(n + 1, bool)
    closed[0] = closed[n] = True
    closed[1:n] |= short[order][1:] != short[order][:-1]
    ends = np.flatnonzero(closed)
    lo, hi = ends[:-1], ends[1:]
    for _ in range(min(KEY, length), length):
        size = hi - lo
        if not len(lo):
            break
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        # The places of one interval with the same code go to neighbouring places, in order.
        code, to, owner = bwt[at], step[at], np.repeat(np.arange(len(lo)), size)
        if (size > 1).any():
            sort = np.lexsort((to, owner))
            code, to, owner = code[sort], to[sort], owner[sort]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(to)) - 1
        lo, hi = to[first], to[last] + 1
        fresh = ~closed[hi]
        lo, hi = lo[fresh], hi[fresh]
        closed[hi] = True
    return order, np.cumsum(closed[:n]) - 1


def least_docs(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For every start in every string (data holds them one after the other), the smallest doc that has the ``length`` bytes there."""
    codes = np.zeros(int(sizes.sum()) + len(sizes), np.uint16)  # byte + 1, and 0 after each string
    begin = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(codes), bool)
    inside[begin + sizes] = False
    codes[inside] = data.astype(np.uint16) + 1
    order, group = bounded_classes(codes, length)
    owner = np.full(len(codes), BIG)
    starts = sizes - length + 1
    place = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    owner[place] = np.repeat(docs, starts)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))
    out = np.empty(len(codes), np.int64)
    out[order] = least[group]
    return out[place]


def _spread(value: np.ndarray, n: int) -> np.ndarray:
    """Buckets of minimizers. They are mixed again: the smallest of many hashes crowd at the low end."""
    return ((mixed(value) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


REFS = "j int, doc binary, check binary, pos binary"


def _shared_runs(docs: DataFrame, n_groups: int, length: int) -> DataFrame:
    """refs(j, doc, check, pos): the runs whose minimizer is in two documents, for the group j of their document. n_groups is for minimizers.

    Minimizers that two documents of one batch have are settled there; one of their runs goes on, so that others meet it.
    """
    def settle_here(ids: np.ndarray, checks: np.ndarray, group: np.ndarray, data: np.ndarray, off: np.ndarray) -> list[tuple[int, bytes]]:
        parts = []
        for i, j in blocks(off, CHUNK):
            r = Runs(data[off[i]:off[j]], off[i:j + 1] - off[i], length)
            parts.append((r.value, r.row + i, r.pos.astype(np.uint32)))
        if not sum(len(p[0]) for p in parts):
            return []
        value, row, pos = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(value, kind="stable")
        value, row, pos = value[order], row[order], pos[order]
        doc = ids[row]
        head = np.concatenate([[True], value[1:] != value[:-1]])
        at = np.flatnonzero(head)
        hot = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        settled = hot[np.cumsum(head) - 1]
        out = []
        goes = np.flatnonzero(~settled | head)
        bucket = _spread(value[goes], n_groups)
        by_bucket = np.argsort(bucket, kind="stable")
        goes, bucket = goes[by_bucket], bucket[by_bucket]
        low, owner, spots, done = (value[goes] & np.uint64(0xFFFFFFFF)).astype(np.uint32), row[goes], pos[goes], settled[goes].astype(np.uint8)
        ends = _ends(bucket)
        for i, j in zip([0, *ends[:-1]], ends):
            rows, spot = np.unique(owner[i:j], return_inverse=True)
            out.append((int(bucket[i]), pack(low[i:j], spot.astype(np.uint32), spots[i:j], done[i:j], ids[rows], checks[rows], group[rows])))
        out += [(n_groups + j, blob) for j, blob in _by_group(group[row[settled]], doc[settled], checks[row[settled]], pos[settled])]
        return out

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ids, all_checks, all_groups = (b.column(k).to_numpy() for k in range(3))
            whole, ends = text_bytes(b.column(3))
            for lo, hi in blocks(ends, BATCH_BYTES):
                out = settle_here(all_ids[lo:hi], all_checks[lo:hi], all_groups[lo:hi], whole[ends[lo]:ends[hi]], ends[lo:hi + 1] - ends[lo])
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], ["g", "blob"])

    def meet(t: pa.Table) -> pa.Table:
        g = t["g"][0].as_py()
        parts = [unpack(x.as_py()) for x in t["blob"]]
        if g >= n_groups:
            doc, check, pos = (np.concatenate(x) for x in zip(*parts))
            return pa.table({"j": pa.array([g - n_groups], pa.int32()), "doc": [doc.tobytes()], "check": [check.tobytes()], "pos": [pos.tobytes()]})
        value = np.concatenate([p[0] for p in parts])
        spot = np.concatenate([p[1] + base for p, base in zip(parts, np.cumsum([0] + [len(p[4]) for p in parts[:-1]]))])
        pos, settled = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
        ids, checks, group = (np.concatenate([p[k] for p in parts]) for k in (4, 5, 6))
        order = np.argsort(value, kind="stable")
        value, spot, pos, settled = value[order], spot[order], pos[order], settled[order] > 0
        at = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        hot = (np.minimum.reduceat(ids[spot], at) != np.maximum.reduceat(ids[spot], at)) | np.logical_or.reduceat(settled, at)
        send = np.repeat(hot, np.diff(np.append(at, len(value)))) & ~settled
        spot, pos = spot[send], pos[send]
        order = np.lexsort((pos, ids[spot], group[spot]))
        spot, pos = spot[order], pos[order]
        ends = _ends(group[spot])
        return pa.table({"j": pa.array(group[spot][ends - 1], pa.int32()), "doc": _cut(ids[spot], ends), "check": _cut(checks[spot], ends), "pos": _cut(pos, ends)})

    return docs.select("doc_id", "check", "j", "text").mapInArrow(find, "g int, blob binary").groupBy("g").applyInArrow(meet, REFS)


def _by_group(group: np.ndarray, doc: np.ndarray, check: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((pos, doc, group))
    group, doc, check, pos = group[order], doc[order], check[order], pos[order]
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
    for lo, hi in zip(at, np.append(at[1:], len(group)) if len(at) else []):
        yield int(group[lo]), pack(doc[lo:hi], check[lo:hi], pos[lo:hi])


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array. isin would deduplicate all of that array again for each few values."""
    at = np.searchsorted(ordered, values)
    return (at < len(ordered)) & (ordered[np.minimum(at, len(ordered) - 1)] == values) if len(ordered) else np.zeros(len(values), bool)


class _Group:
    """Documents of one group with their shared runs: distinct runs in order of their key, and every run's place among them."""

    def __init__(self, docs: pa.Table, refs: list[bytes | tuple], length: int):
        self.ids, self.checks = docs["doc_id"].to_numpy(), docs["check"].to_numpy()
        self.data, self.off = text_bytes(docs["text"])
        parts = [unpack(x) if isinstance(x, bytes) else x for x in refs] or [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)]]
        doc, check, pos = (np.concatenate([p[k] for p in parts]) for k in range(3))
        # Rows that repeat a document (id and check) share its runs; each row looks them up by its own number among the pairs.
        names = mixed(np.concatenate([self.ids, doc]).view(np.uint64)) ^ np.concatenate([self.checks, check]).view(np.uint64)
        _, pair = np.unique(names, return_inverse=True)
        mine, wanted = pair[: len(self.ids)].astype(np.int64), np.sort((pair[len(self.ids):].astype(np.int64) << 32) | pos)
        rows = []
        for i, j in blocks(self.off, CHUNK):
            r = Runs(self.data[self.off[i]:self.off[j]], self.off[i:j + 1] - self.off[i], length)
            own = (mine[r.row + i] << 32) | r.pos
            keep = _among(own, wanted)
            rows.append((r.row[keep] + i, r.start[keep] + self.off[i], r.end[keep] + self.off[i], r.value[keep], r.key[keep]))
        self.row, self.start, self.end, self.value, key = (np.concatenate(x) for x in zip(*rows))
        _, self.first, self.place = np.unique(key, return_index=True, return_inverse=True)
        self.least = np.full(len(self.first), BIG)
        np.minimum.at(self.least, self.place, self.ids[self.row])

    def sent(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, the distinct runs in the order of their buckets, and the end of each bucket's runs among them."""
        bucket = _spread(self.value[self.first], n_buckets)
        order = np.argsort(bucket, kind="stable")
        ends = _ends(bucket[order])
        return bucket[order][ends - 1], order, ends

    def removed(self, answers: np.ndarray, n_buckets: int, length: int) -> np.ndarray:
        """Flags of the removed bytes. answers: the least docs of all runs that were sent, in that order."""
        own = self.end[self.first] - self.start[self.first] - length + 1
        begin = np.cumsum(own) - own
        least = np.full(int(own.sum()), BIG)
        order = self.sent(n_buckets)[1]
        least[_ranges(begin[order], own[order])] = answers
        gone = np.zeros(len(self.data), bool)
        for i, j in blocks(self.off, CHUNK):  # runs are in the order of their rows
            lo, base = slice(*np.searchsorted(self.row, [i, j])), self.off[i]
            starts = self.end[lo] - self.start[lo] - length + 1
            hit = least[_ranges(begin[self.place[lo]], starts)] < np.repeat(self.ids[self.row[lo]], starts)
            at = _ranges(self.start[lo] - base, starts)[hit]
            delta = np.bincount(at, minlength=int(self.off[j] - base) + 1)
            covered = np.cumsum(delta)
            covered[length:] -= np.cumsum(delta)[:-length]
            gone[base:self.off[j]] = covered[:self.off[j] - base] > 0
        return gone


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The entries of each range, some ranges at a time: their places take eight bytes an entry."""
    off = np.concatenate([[0], np.cumsum(end - start)])
    return np.concatenate([data[_ranges(start[i:j], end[i:j] - start[i:j])] for i, j in blocks(off, 4 * CHUNK)] or [data[:0]])


def string_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of the byte strings [start, end)."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def remove_repeats(docs: DataFrame, length: int = MIN_LENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Texts are UTF-8 bytes (null: empty). A byte goes if a ``length``-byte string that covers it also starts in a document with a
    smaller doc_id; strings are judged on the input. Rows that share a doc_id do not remove from each other. Rows with a null
    doc_id neither remove nor lose anything. Repeated rows give equal rows. An empty table gives an empty result.
    """
    n = max(2, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // GROUP_BYTES))
    n_meets, n_sorts = max(2, n // 4), max(2, n // 2)  # buckets of places and of distinct runs, which are small beside a group's texts
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("text"), F.xxhash64(raw).alias("check"))
    base = base.withColumn("j", F.pmod(F.xxhash64("doc_id", "check"), F.lit(n)).cast("int"))
    known = base.where(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    refs = settle(_shared_runs(known, n_meets, length), "repeat-runs")

    def with_refs(docs: pa.Table, refs: pa.Table) -> _Group:
        return _Group(docs, [(_whole(refs["doc"], np.int64), _whole(refs["check"], np.int64), _whole(refs["pos"], np.uint32))], length)

    def strings(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            return pa.table([[]] * 6, pa.schema([("p", pa.int32()), ("j", pa.int32()), *((c, pa.binary()) for c in ("least", "value", "size", "data"))]))
        g = with_refs(left, right)
        p, order, ends = g.sent(n_sorts)
        at = g.first[order]
        size = (g.end - g.start)[at]
        value = (g.value[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pa.table({"p": pa.array(p, pa.int32()), "j": pa.array(np.full(len(p), key[0].as_py()), pa.int32()), "least": _cut(g.least[order], ends),
                         "value": _cut(value, ends), "size": _cut(size.astype(np.uint32), ends),
                         "data": _cut(_gather(g.data, g.start[at], g.end[at]), np.cumsum(size)[ends - 1])})

    def classes(t: pa.Table) -> pa.Table:
        rows = np.cumsum(pc.binary_length(t["least"]).to_numpy()) // 8
        least, value, data = _whole(t["least"], np.int64), _whole(t["value"], np.uint32).astype(np.uint64), _whole(t["data"], np.uint8)
        size = _whole(t["size"], np.uint32).astype(np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        begin = off[:-1]
        # The same run from several groups counts once, with the smallest doc. Keys are made block by block to bound the memory.
        keys = [string_keys(data[off[i]:off[j]], off[i:j] - off[i], off[i + 1:j + 1] - off[i]) for i, j in blocks(off, CHUNK)]
        _, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        docs_of = np.full(len(first), BIG)
        np.minimum.at(docs_of, place, least)
        own = size[first] - length + 1
        at = np.cumsum(own) - own
        answer = np.empty(int(own.sum()), np.int64)
        # All strings of a minimizer that has one distinct run are in copies of that run: nothing is left to compare.
        _, same, n_same = np.unique(value[first], return_inverse=True, return_counts=True)
        alone = n_same[same] == 1
        answer[_ranges(at[alone], own[alone])] = np.repeat(docs_of[alone], own[alone])
        rest = np.flatnonzero(~alone)
        part = value[first[rest]] * np.uint64(max(1, int(size[first[rest]].sum()) // SORT_BYTES)) >> np.uint64(32)
        for k in np.unique(part):
            rows_of = rest[part == k]
            strings = _gather(data, begin[first[rows_of]], begin[first[rows_of]] + size[first[rows_of]])
            answer[_ranges(at[rows_of], own[rows_of])] = least_docs(strings, size[first[rows_of]], docs_of[rows_of], length)
        ends = np.cumsum(own[place])[rows - 1]
        return pa.table({"j": t["j"], "p": t["p"], "blob": _cut(_gather(answer, at[place], at[place] + own[place]), ends)})

    asked = known.groupBy("j").cogroup(refs.groupBy("j"))
    answers = settle(asked.applyInArrow(strings, "p int, j int, least binary, value binary, size binary, data binary").groupBy("p").applyInArrow(classes, "j int, p int, blob binary"), "repeat-answers")

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "check", "n_removed", "n_spans", "kept_sha256"]
        rows: list = []
        if len(left) and len(right):
            found = pc.is_valid(right["p"])
            g = with_refs(left, right.filter(pc.invert(found)))
            if len(g.row):
                answers = right.filter(found).sort_by("p")
                gone = g.removed(_whole(answers["blob"], np.int64), n_sorts, length)
                before = np.concatenate([[0], np.cumsum(gone)])
                for k in range(len(g.ids)):
                    i, j = g.off[k], g.off[k + 1]
                    if before[j] > before[i]:
                        f = gone[i:j]
                        rows.append((g.ids[k], g.checks[k], before[j] - before[i], int(f[0]) + int((f[1:] & ~f[:-1]).sum()),
                                     hashlib.sha256(g.data[i:j][~f].tobytes()).hexdigest()))
        cols = list(zip(*rows)) or [[]] * 5
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))})

    both = refs.unionByName(answers, allowMissingColumns=True)
    schema = "doc_id long, check long, n_removed long, n_spans long, kept_sha256 string"
    changed = known.groupBy("j").cogroup(both.groupBy("j")).applyInArrow(cut, schema).dropDuplicates(["doc_id", "check"])
    rows = base.select("doc_id", "check", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return rows.join(changed, ["doc_id", "check"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
