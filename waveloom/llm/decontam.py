"""Benchmark decontamination with spaced seeds: fixed masks skip some word positions, so hits survive substitutions."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import settle, table, WORD_BREAK
from .textbytes import Words, blocks, mixed, plain_words, text_bytes

CHUNK = 1 << 20
# 1: the word counts; 0: any word. Every overlap of the two rules below is hit by one of them at some place (tests/llm proves it
# for overlaps of any length); for other rules masks must be chosen anew.
MASKS = ("1111011", "11010001011", "110011101", "11101000011")
MIN_WORDS = 9          # an overlap has at least so many equal words (or all words of a shorter item)
MIN_IDENTITY = 0.8     # share of equal words between its ends
MISMATCH = 3           # a different word costs so many equal ones when the ends are sought
PASS_WORDS = 200_000   # words of benchmark items that one pass over the documents carries: the bound of what is shipped

_MUL = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)
PAIRS = "item_id {}, hits long, start_word long, n_words long, n_equal long, identity double"


def _masked(h: np.ndarray, offsets: list[int], span: int, at: np.ndarray | None = None) -> np.ndarray:
    n = max(len(h) - span + 1, 0)
    acc = np.zeros(n, np.uint64)
    for k, o in enumerate(offsets):
        acc += h[o: o + n] * _MUL[k]
    return mixed(acc)


class _Seeds:
    """Masked hashes of a bounded set of items, sorted, with item and position."""

    def __init__(self, items: list[tuple[object, str]], masks, min_words: int, min_identity: float):
        self.ids = [i for i, _ in items]
        self.min_words, self.min_identity = min_words, min_identity
        data, off = text_bytes(pa.array([t for _, t in items], pa.string()))
        self.words = Words(data, off, plain_words())
        sizes = np.diff(self.words.first)
        shapes = {("".join("1" * int(n))) for n in sizes if 0 < n < max(map(len, masks))} | set(masks)
        self.tables = []
        for mask in sorted(shapes):
            ones, span = [k for k, c in enumerate(mask) if c == "1"], len(mask)
            h = _masked(self.words.hash, ones, span)
            doc = self.words.doc[: len(h)]
            ok = doc == self.words.doc[span - 1: span - 1 + len(h)] if len(h) else np.zeros(0, bool)
            if mask not in masks:  # a mask for items that are as short as it
                ok &= sizes[doc] == span
            at = np.flatnonzero(ok)
            order = np.argsort(h[at], kind="stable")
            flags = np.zeros(1 << 20, bool)
            flags[(h[at] >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((ones, span, h[at][order], at[order], flags))

    def overlaps(self, w: Words) -> list[tuple]:
        """(row, item, hits, start, words, equal) of every verified overlap, the best one of each row and item."""
        hits = []
        for ones, span, keys, places, flags in self.tables:
            h = _masked(w.hash, ones, span)
            at = np.flatnonzero(flags[(h >> np.uint64(44)).astype(np.int64)])
            at = at[w.doc[at] == w.doc[at + span - 1]] if len(at) else at
            lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            n = hi - lo
            rows = np.repeat(at, n)
            spot = places[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            hits.append(np.stack([w.doc[rows], self.words.doc[spot], rows - spot]))
        hits = np.concatenate(hits, axis=1) if hits else np.zeros((3, 0), np.int64)
        if not hits.shape[1]:
            return []
        diagonals, count = np.unique(hits, axis=1, return_counts=True)
        best: dict = {}
        for (row, item, shift), n in zip(diagonals.T.tolist(), count.tolist()):
            found = self._verify(w, row, item, shift)
            key = (row, item)
            if found is not None:
                old = best.get(key)
                total = n + (old[0] if old else 0)
                better = found if old is None or (found[2], -found[0]) > (old[1][2], -old[1][0]) else old[1]
                best[key] = (total, better)
        return [(row, item, n, *f) for (row, item), (n, f) in sorted(best.items())]

    def _verify(self, w: Words, row: int, item: int, shift: int) -> tuple[int, int, int] | None:
        """Ends of the best overlap on one diagonal: equal words count 1, different ones -MISMATCH.

        Where the best-scoring segment is no overlap, the one with most equal words of all segments that are one.
        """
        i0, i1 = self.words.first[item], self.words.first[item + 1]
        d0, d1 = max(w.first[row], i0 + shift), min(w.first[row + 1], i1 + shift)
        equal = w.hash[d0:d1] == self.words.hash[d0 - shift:d1 - shift]
        least = min(self.min_words, i1 - i0)
        if equal.sum() < least:
            return None
        sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
        low = np.minimum.accumulate(sums)
        end = int(np.argmax(sums - low))
        start = int(np.argmax(sums[: end + 1] == low[end]))
        n, same = end - start, int(equal[start:end].sum())
        if same < least or same < self.min_identity * n:
            start, end = _most_equal(equal, self.min_identity)
            n, same = end - start, int(equal[start:end].sum())
            if same < least:
                return None
        return int(d0 + start - w.first[row]), n, same


def _most_equal(equal: np.ndarray, min_identity: float) -> tuple[int, int]:
    """Ends of a segment with most equal words among those with a share of ``min_identity`` of them.

    A segment has the share if its prefix sum of (equal - share) does not fall. For each end the first start whose sum is not
    above gives most equal words; the sums are whole numbers, so that a share that is just met is met.
    """
    share = Fraction(str(min_identity))
    sums = np.concatenate([[0], np.cumsum(np.where(equal, share.denominator - share.numerator, -share.numerator))])
    count = np.concatenate([[0], np.cumsum(equal)])
    start = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
    end = int(np.argmax(count - count[start]))
    at = start[end] + np.flatnonzero(equal[start[end]:end])
    return (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)


def _passes(benchmark: DataFrame, text: str, id_col: str) -> Iterator[tuple[list[tuple], bool]]:
    """The items, a bounded number of words at a time, and whether there is more than one pass.

    A pass is fetched when the one before it is done. A single item beyond PASS_WORDS is a pass of its own size.
    """
    n = F.coalesce(F.regexp_count(text, F.lit(WORD_BREAK)), F.lit(0))
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text).alias("text"), n.alias("n")).where("n > 0")
    total = items.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // PASS_WORDS))
    if count > 1:
        items = settle(items, "benchmark")
    dealt = items.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for k in range(count):
        rows = dealt.where(F.col("pass") == k).distinct().orderBy("item_id", "text").collect()
        yield [(r.item_id, r.text) for r in rows], count > 1


def overlaps(docs: DataFrame, benchmark: DataFrame, masks=MASKS, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY,
             doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Every pair of a document and a benchmark item that overlap, with the best overlap.

    Words are runs of a-z (A-Z lower-cased), 0-9 and characters beyond ASCII. Each position of every text is hashed under each
    mask and looked up among the items' hashes; each diagonal with a hit is then aligned without the mask. An overlap has at
    least ``min_words`` equal words (all, for shorter items) and ``min_identity`` equal between its ends.

    Returns doc_id, item_id, hits, start_word, n_words, n_equal, identity. Rows are documents of their own, also when repeated
    or without id; null or empty texts and items overlap with nothing; repeated items give one row.
    """
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((docs, doc_id), (benchmark, item_id))}
    schema = f"doc_id {kinds[doc_id]}, " + PAIRS.format(kinds[item_id])
    item_type = benchmark.select(item_id).limit(0).toArrow().schema.field(0).type
    out = None
    for items, several in _passes(benchmark, text, item_id):
        def find(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            seeds = _Seeds(items, masks, min_words, min_identity)
            for b in batches:
                data, off = text_bytes(b.column(1))
                for i, j in blocks(off, CHUNK):
                    rows = seeds.overlaps(Words(data[off[i]:off[j]], off[i:j + 1] - off[i], plain_words()))
                    if rows:
                        row, item, n, start, size, same = map(list, zip(*rows))
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array([i + r for r in row])), pa.array([seeds.ids[k] for k in item], item_type), pa.array(n, pa.int64()),
                             pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(same, pa.int64()),
                             pa.array([s / z for s, z in zip(same, size)], pa.float64())],
                            ["doc_id", "item_id", "hits", "start_word", "n_words", "n_equal", "identity"])

        part = docs.select(doc_id, text).mapInArrow(find, schema)
        part = settle(part, "overlaps") if several else part
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, masks=MASKS, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY,
          item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The documents without any overlap, all columns kept (no join: each pass filters the rows that the one before left)."""
    place = docs.columns.index(text)
    for items, several in _passes(benchmark, text, item_id):
        def keep(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            seeds = _Seeds(items, masks, min_words, min_identity)
            for b in batches:
                data, off = text_bytes(b.column(place))
                ok = np.ones(b.num_rows, bool)
                for i, j in blocks(off, CHUNK):
                    for row in seeds.overlaps(Words(data[off[i]:off[j]], off[i:j + 1] - off[i], plain_words())):
                        ok[i + row[0]] = False
                yield b.filter(pa.array(ok))

        docs = docs.mapInArrow(keep, docs.schema)
        docs = settle(docs, "decontaminated") if several else docs
    return docs


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with the table benchmark go."""
    return clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
