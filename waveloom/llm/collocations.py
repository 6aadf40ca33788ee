"""Phrase collocations: every count from one table of the longest windows.

Each word opens one window of three words, the later ones padded where its piece ends. Only these windows are counted; a ROLLUP over
(lang, first, second, third word) sums their shorter prefixes, so phrases of one and two words are never listed on their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import settle, table
from .textbytes import Words, blocks, mixed, text_bytes

# Fixed values of the definition.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"
MIN_COUNT = 10
COVER_PERCENT = 50
TOP = 2000

UNIT = 1 << 20  # bytes of text taken apart together
WORDS = 1 << 21  # words a task numbers before it sends what it has
HELD = 1 << 21  # windows a task counts before it sends what it has
CELLS = 1 << 14  # word pairs are watched by the cell of their hash
SHARE = 1 << 12  # the pairs of a cell with more than this part of all words are dealt over SPREAD tasks each
SPREAD = 64

_INSIDE, _ENDS = np.ones(256, bool), np.zeros(256, bool)
_INSIDE[list(PIECE_ENDS + BLANKS)] = False
_ENDS[list(PIECE_ENDS)] = True

ROWS = "window string, salt int, c bigint"


def _slices(text: np.ndarray):
    """A long text in parts of about UNIT bytes: (bytes, whether it goes on). The last two words of a part open the next one."""
    at, size = 0, UNIT
    while True:
        end = min(len(text), at + size)
        while end < len(text) and _INSIDE[text[end]]:
            end += 1
        part = text[at:end]
        more = end < len(text)
        if not more:
            yield part, False
            return
        starts = Words(part, np.array([0, len(part)]), _INSIDE, hashed=False).start
        if len(starts) < 3:
            size *= 2
            continue
        yield part, True
        at, size = at + int(starts[-2]), UNIT


def _units(batches):
    """(bytes, offsets, langs, whether the text goes on) of about UNIT bytes each, over the borders of batches."""
    held: list = []
    size = 0
    for batch in batches:
        data, off = text_bytes(batch.column(1))
        langs = batch.column(0).to_pylist()
        for i, j in blocks(off, UNIT):
            part = data[off[i]:off[j]]
            if len(part) > UNIT and j == i + 1:
                for piece, more in _slices(part):
                    yield piece, np.array([0, len(piece)]), [langs[i]], more
                continue
            held.append((part, off[i:j + 1] - off[i], langs[i:j]))
            size += len(part)
            if size >= UNIT // 2:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    ends = np.cumsum([0] + [len(d) for d, _, _ in held])
    off = np.concatenate([[0]] + [o[1:] + e for (_, o, _), e in zip(held, ends)])
    return np.concatenate([d for d, _, _ in held]), off, [x for _, _, langs in held for x in langs], False


class _Opened:
    """The windows of a unit: words by number (0: padding) in three columns; word, language and hash of each number."""

    def __init__(self, data, offsets, langs, more):
        words = Words(data, offsets, _INSIDE)
        self.words, size = words, len(words)
        self.opens = size - 2 if more else size  # the last two words of a part open windows in the next one
        if size == 0:
            return
        piece = np.cumsum(_ENDS[words.low], dtype=np.int32)[words.start]
        self.on = (words.doc[1:] == words.doc[:-1]) & (piece[1:] == piece[:-1])
        named = {x: k for k, x in enumerate(dict.fromkeys(langs))}
        self.langs = list(named)
        self.lang = np.array([named[x] for x in langs])[words.doc]
        self.hash = words.hash + np.array([zlib.crc32(x.encode()) for x in self.langs], np.uint64)[self.lang]

    def numbered(self):
        """(language number, word) of each different one, its first place, and the number from 0 of every word."""
        words = self.words
        ends = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
        text = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(words.low[_INSIDE[words.low]])])
        coded = text.dictionary_encode()
        width = len(coded.dictionary)
        both, first, ids = np.unique(self.lang * width + coded.indices.to_numpy(), return_index=True, return_inverse=True)
        return zip((both // width).tolist(), coded.dictionary.take(pa.array(both % width)).to_pylist()), first, ids

    def leads(self, x: np.ndarray, none) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x of the words that open a window, and of the next word and the one after inside the piece (else none)."""
        second, third = np.full(len(x), none, x.dtype), np.full(len(x), none, x.dtype)
        second[:-1] = np.where(self.on, x[1:], none)
        third[:-1] = np.where(self.on, second[1:], none)
        return x[:self.opens], second[:self.opens], third[:self.opens]


def _cell(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mixed(first * np.uint64(0x9E3779B97F4A7C15) + second) % np.uint64(CELLS)).astype(np.int64)


def _cells(batches):
    """Windows of each cell of word pairs."""
    seen = np.zeros(CELLS, np.int64)
    for unit in _units(batches):
        got = _Opened(*unit)
        if len(got.words):
            first, second, _ = got.leads(got.hash, np.uint64(0))
            seen += np.bincount(_cell(first, second), minlength=CELLS)
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["cell", "n"])


class _Counts:
    """Windows counted over the units of a task: words get numbers, three of them are one 63-bit key."""

    def __init__(self, spread: np.ndarray):
        self.spread = spread
        self.clear()

    def clear(self):
        self.ids: dict = {}
        self.names, self.hash, self.parts, self.pending = [""], [0], [], 0

    def add(self, got: _Opened):
        """Rows to send first, if the unit would not fit; then the unit is counted."""
        found, first, ids = got.numbered()
        if len(self.ids) + len(first) >= WORDS or self.pending + len(ids) > HELD:
            yield from self.rows()
        here = np.empty(len(first), np.int64)
        for k, (lang, word) in enumerate(found):
            key = (got.langs[lang], word)
            here[k] = self.ids.setdefault(key, len(self.names))
            if here[k] == len(self.names):
                self.names.append(word)
                self.hash.append(int(got.hash[first[k]]))
        a, b, c = got.leads(here[ids], 0)
        self.parts.append(a << 42 | b << 21 | c)
        self.pending += len(a)

    def rows(self):
        """window (`first second third language`, a missing word is empty), salt, c."""
        if self.pending:
            keys = np.concatenate(self.parts)
            self.parts = []
            keys.sort()
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts, keys = np.diff(at, append=len(keys)), keys[at]
            words, langs = pa.array(self.names, pa.large_string()), pa.array([""] + [lang for lang, _ in self.ids], pa.large_string())
            hashes = np.array(self.hash, np.uint64)
            for k in range(0, len(keys), 1 << 17):
                s = slice(k, k + (1 << 17))
                a, b, c = keys[s] >> 42, keys[s] >> 21 & (WORDS - 1), keys[s] & (WORDS - 1)
                text = pc.binary_join_element_wise(*[words.take(pa.array(x)) for x in (a, b, c)], langs.take(pa.array(a)), pa.scalar(" ", pa.large_string()))
                salt = np.where(self.spread[_cell(hashes[a], hashes[b])], (mixed(hashes[c]) % np.uint64(SPREAD)).astype(np.int32), np.int32(-1))
                yield pa.RecordBatch.from_arrays([text.cast(pa.string()), pa.array(salt.astype(np.int32)), pa.array(counts[s].astype(np.int64))], ["window", "salt", "c"])
        self.clear()


def _window_rows(hot: list[int]):
    def rows(batches):
        spread = np.zeros(CELLS, bool)
        spread[hot] = True
        held = _Counts(spread)
        for unit in _units(batches):
            got = _Opened(*unit)
            if len(got.words):
                yield from held.add(got)
        yield from held.rows()
    return rows


def window_counts(docs: DataFrame) -> DataFrame:
    """Counts of windows by task: window (`first second third language`), salt, c.

    A task counts as far as its two bounds go before anything is shuffled. salt is -1, or one of SPREAD numbers by the third word for the
    pairs of the (at most SHARE) cells that hold too many words; a window always has the same salt.
    """
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    cells = settle(texts.mapInArrow(_cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    hot = [r.cell for r in cells.filter(F.col("n") > total // SHARE).select("cell").collect()]  # at most SHARE cells
    return texts.mapInArrow(_window_rows(hot), ROWS)


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, w1, w2, w3, level, f: words (level 1), pairs (2) and triples (3) with f >= min_count, and all words of a language (0).

    Where a window is too rare its third word is padded, where a pair is too rare its second, before the ROLLUP: their occurrences go
    on counting in the shorter prefixes. A pair that is dealt over several tasks is left as it is.
    """
    pair = F.substring_index("window", " ", 2)
    windows = window_counts(docs).repartition(pair, "salt").groupBy(pair.alias("pair"), "salt", "window").agg(F.sum("c").alias("c"))
    head = F.substring_index("window", " ", 3)
    lang = F.substr("window", F.length(head) + 2)
    third = F.when(F.col("c") >= min_count, F.substring_index(head, " ", -1)).otherwise(F.lit(""))
    short = windows.select("pair", "salt", lang.alias("lang"), third.alias("w3"), "c").groupBy("pair", "salt", "lang", "w3").agg(F.sum("c").alias("c"))
    known = (F.sum("c").over(Window.partitionBy("pair", "salt", "lang")) >= min_count) | (F.col("salt") >= 0)
    padded = short.select("lang", F.substring_index("pair", " ", 1).alias("w1"),
                          F.when(known, F.substring_index("pair", " ", -1)).otherwise(F.lit("")).alias("w2"), "w3", "c")
    counted = padded.groupBy("lang", "w1", "w2", "w3").agg(F.sum("c").alias("c"))
    summed = counted.rollup("lang", "w1", "w2", "w3").agg(F.sum("c").alias("f"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, 3).when(F.col("g") == 1, 2).when(F.col("g") == 3, 1).when(F.col("g") == 7, 0)
    full = "level = 0 OR (f >= {0} AND (level = 1 OR (level = 2 AND w2 <> '') OR (level = 3 AND w3 <> '')))".format(int(min_count))
    return summed.select("lang", "w1", "w2", "w3", level.alias("level"), "f").filter(full)


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in exact decimals: counts below 10^15 fit 38 digits, larger ones are an error."""
    wide = "CAST({} AS DECIMAL(15,0))".format
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * {wide(a)} * {wide(a)}) div ({wide(left)} * {wide(right)})")


def candidates(counts: DataFrame, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that no longer phrase covers. counts: `phrase_counts`, stored."""
    def level(k: int, *cols) -> DataFrame:
        return counts.filter(F.col("level") == k).select("lang", *cols)

    one_left, one_right = level(1, "w1", F.col("f").alias("l1")), level(1, F.col("w1").alias("end"), F.col("f").alias("r1"))
    two = level(2, "w1", "w2", F.col("f").alias("a"))
    three = level(3, "w1", "w2", "w3", F.col("f").alias("a"))

    inner = three.select("lang", "a", F.inline(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))))
    cover = inner.groupBy("lang", "w1", "w2").agg(F.max("a").alias("cover"))
    short = two.join(cover, ["lang", "w1", "w2"], "left").filter(
        f"cover IS NULL OR CAST(100 AS DECIMAL(20,0)) * cover < CAST({int(cover_percent)} AS DECIMAL(20,0)) * a")
    short = short.join(one_left, ["lang", "w1"]).join(one_right.withColumnRenamed("end", "w2"), ["lang", "w2"]).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("l1").alias("l"), F.col("r1").alias("r"), _score("a", "l1", "r1").alias("score"))

    head = two.select("lang", "w1", "w2", F.col("a").alias("l2"))
    tail = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r2"))
    long = three.join(one_left, ["lang", "w1"]).join(tail, ["lang", "w2", "w3"]).join(head, ["lang", "w1", "w2"])
    long = long.join(one_right.withColumnRenamed("end", "w3"), ["lang", "w3"])
    long = long.withColumn("s1", _score("a", "l1", "r2")).withColumn("s2", _score("a", "l2", "r1"))
    early = F.col("s1") <= F.col("s2")
    long = long.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                       F.when(early, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"))
    return short.unionByName(long)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null language is `und`; repeated rows count as often as they stand; further columns are ignored, whatever
    their names. Empty tables, and languages without a frequent phrase, give no rows. Ties in score go to the larger count, then to
    the phrase in byte order. Ranks are found in two rounds, so no task sees all candidates of a language.
    """
    counts = settle(phrase_counts(docs, min_count), "phrases")
    found = settle(candidates(counts, cover_percent), "candidates")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    best = found.withColumn("_k", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("_k") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    n = counts.filter("level = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents", "lang", "text"))


OP11_SQL = r"""WITH T AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  P AS (SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM T),
  W AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM P),
  G AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM W),
  U AS (SELECT lang, w[i] AS x, count(*) AS f FROM G GROUP BY ALL),
  B AS (SELECT lang, w[i] AS x, w[i+1] AS y, count(*) AS f FROM G WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
  C AS (SELECT lang, w[i] AS x, w[i+1] AS y, w[i+2] AS z, count(*) AS f FROM G WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
  N AS (SELECT lang, sum(f)::BIGINT AS n FROM U GROUP BY lang),
  V AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM C UNION ALL SELECT lang, y, z, f FROM C) GROUP BY lang, x, y),
  K AS (SELECT B.lang, B.x || ' ' || B.y AS phrase, B.f AS a, l.f AS l, r.f AS r, 1 AS k FROM B JOIN U l ON l.lang = B.lang AND l.x = B.x
      JOIN U r ON r.lang = B.lang AND r.x = B.y LEFT JOIN V ON V.lang = B.lang AND V.x = B.x AND V.y = B.y WHERE V.f IS NULL OR 100 * V.f < 50 * B.f
    UNION ALL SELECT C.lang, C.x || ' ' || C.y || ' ' || C.z, C.f, l.f, r.f, 1 FROM C JOIN U l ON l.lang = C.lang AND l.x = C.x
      JOIN B r ON r.lang = C.lang AND r.x = C.y AND r.y = C.z
    UNION ALL SELECT C.lang, C.x || ' ' || C.y || ' ' || C.z, C.f, l.f, r.f, 2 FROM C JOIN B l ON l.lang = C.lang AND l.x = C.x AND l.y = C.y
      JOIN U r ON r.lang = C.lang AND r.x = C.z),
  S AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM K),
  D AS (SELECT * FROM S QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  R AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM D)
  SELECT R.lang, rank, phrase, a, l, r, n, score FROM R JOIN N ON N.lang = R.lang WHERE rank <= 2000"""
