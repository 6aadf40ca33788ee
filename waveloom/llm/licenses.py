"""License scan: exact containment join between text blocks and license templates, with prefix, length and position filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table
from .textbytes import Words, blocks, plain_words, text_bytes, word_hash

CHUNK = 1 << 20
CONTAINMENT = 0.9

# Phrases that give a label wherever their words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Sentences of public licenses, in lower-case words.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4"),
    ("cc-by-sa", "licensed under cc by sa 4"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


class _Vocabulary:
    """Ids of the words of templates and phrases; every other word is -1. Its size is fixed by the templates."""

    def __init__(self, words: list[str]):
        hashes = np.array([word_hash(w) for w in words], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        at = np.flatnonzero(self.flags[(h >> np.uint64(48)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        hit = self.sorted[spot] == h[at]
        out[at[hit]] = self.order[spot[hit]]
        return out


def _vocabulary(templates: list[tuple[str, str]], phrases: dict[str, str]) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()} | {w for p in phrases for w in p.split()})


def token_counts(docs: DataFrame, words: list[str], text: str = "text") -> dict[str, int]:
    """Occurrences of each given word in all texts (one row per word and task is summed)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = _Vocabulary(words), np.zeros(len(words), np.int64)
        for b in batches:
            data, off = text_bytes(b.column(0))
            for i, j in blocks(off, CHUNK):
                ids = vocabulary.ids(Words(data[off[i]:off[j]], off[i:j + 1] - off[i], plain_words()).hash)
                total += np.bincount(ids[ids >= 0], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int32()), pa.array(total)], ["word", "n"])

    found = docs.select(text).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = dict.fromkeys(words, 0)
    n.update({words[r.word]: r.n for r in found.collect()})  # one row per template word
    return n


class _Templates:
    """Templates as sorted ranks in the global order (rare words first) with their prefixes."""

    def __init__(self, templates, phrases, ordered: list[str], threshold: float):
        rank = {w: k for k, w in enumerate(ordered)}
        self.vocabulary, self.size = _Vocabulary(ordered), len(ordered)
        self.phrases = [(label, [rank[w] for w in p.split()]) for p, label in phrases.items()]
        self.items = []
        for label, t in templates:
            own = np.array(sorted({rank[w] for w in t.split()}))
            need = math.ceil(threshold * len(own) - 1e-9)
            place = np.full(self.size, -1, np.int64)
            place[own] = np.arange(len(own))
            self.items.append((label, len(own), need, len(own) - need + 1, place))

    def matches(self, block: np.ndarray, rank: np.ndarray, n_words: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """block, rank: distinct pairs in order. Yields label, blocks and containment for each template."""
        if not len(block):
            return
        head = np.concatenate([[True], block[1:] != block[:-1]])
        begin = np.flatnonzero(head)[np.cumsum(head) - 1]
        size = np.diff(np.append(np.flatnonzero(head), len(block)))[np.cumsum(head) - 1]
        pos = np.arange(len(block)) - begin
        for label, k, need, prefix, place in self.items:
            at = place[rank]
            lead = np.flatnonzero((at >= 0) & (at < prefix))                      # prefix filter
            if not len(lead):
                continue
            lead = lead[np.concatenate([[True], block[lead][1:] != block[lead][:-1]])]  # the first shared word of each block
            lead = lead[n_words[block[lead]] >= need]                             # length filter
            lead = lead[1 + np.minimum(k - at[lead] - 1, size[lead] - pos[lead] - 1) >= need]  # position filter
            if not len(lead):
                continue
            sure = np.isin(block, block[lead]) & (at >= 0)                        # verification
            got, n = np.unique(block[sure], return_counts=True)
            yield label, got[n >= need], n[n >= need] / k


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = CONTAINMENT, text: str = "text",
         id_col: str = "doc_id") -> DataFrame:
    """Labels of every text: phrases and license templates.

    A block is a line of a text (words in a-z, 0-9 and beyond ASCII, A-Z lower-cased). A block matches a template if it holds at
    least ``threshold`` of the template's distinct words. Returns doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score: the phrases' places and labels, all labels (sorted, comma-joined, empty without any), and the highest
    containment of a match (1 with a phrase, 0 without any label). Null and blank texts have no words and no labels; every row
    gives one row, repeated or with a null id as well; an empty table gives an empty result.
    """
    words = _vocabulary(templates, phrases)
    n = token_counts(docs, words, text)
    ordered = sorted(words, key=lambda w: (n[w], w))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Templates(templates, phrases, ordered, threshold)
        for b in batches:
            data, off = text_bytes(b.column(1))
            parts = [_scan_block(known, data[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in blocks(off, CHUNK)]
            cols = [pa.concat_arrays([p[k] for p in parts]) if parts else None for k in range(7)]
            if parts:
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], NAMES)

    NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(find, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, "
                                                      "base_labels string, labels string, score double")


def _scan_block(known: _Templates, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    w = Words(data, off, plain_words())
    rows = len(off) - 1
    ids = known.vocabulary.ids(w.hash)
    base, extra = [set() for _ in range(rows)], [set() for _ in range(rows)]
    n_base, score = np.zeros(rows, np.int64), np.zeros(rows)
    first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
    for label, seq in known.phrases:
        at = np.flatnonzero(ids[: max(len(ids) - len(seq) + 1, 0)] == seq[0])
        for k in range(1, len(seq)):
            at = at[(ids[at + k] == seq[k]) & (w.doc[at + k] == w.doc[at])]
        doc, place = w.doc[at], at - w.first[w.doc[at]]
        np.add.at(n_base, doc, 1)
        np.minimum.at(first, doc, place)
        np.maximum.at(last, doc, place)
        score[doc] = 1.0
        for d in set(doc.tolist()):
            base[d].add(label)
    lines = np.union1d(off[1:-1], np.flatnonzero(data == 10))
    line = np.searchsorted(lines, w.start, "right")
    n_words = np.bincount(line, minlength=len(lines) + 1)
    used = np.flatnonzero(ids >= 0)
    pairs = np.unique(line[used].astype(np.int64) * known.size + ids[used])
    doc_of = np.zeros(len(lines) + 1, np.int64)
    doc_of[line] = w.doc
    for label, found, share in known.matches(pairs // known.size, pairs % known.size, n_words):
        np.maximum.at(score, doc_of[found], share)
        for d in doc_of[found].tolist():
            extra[d].add(label)
    none = n_base == 0
    join = lambda sets: pa.array([",".join(sorted(s)) if s else "" for s in sets], pa.string())
    return [pa.array(np.diff(w.first)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), join(base),
            join([a | b for a, b in zip(base, extra)]), pa.array(score)]


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _sql() -> str:
    tpl = ", ".join(f"('{label}', {k}, [{', '.join(repr(x) for x in sorted(set(t.split())))}])" for k, (label, t) in enumerate(TEMPLATES))
    base = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, unnest(list_filter(range(len(w) - {n} + 1), lambda i: {' AND '.join(f'w[i + {k + 1}] = {x!r}' for k, x in enumerate(p.split()))})) AS i FROM W"
        for p, label in PHRASES.items() for n in [len(p.split())])
    return f"""WITH D AS (SELECT row_number() OVER () AS r, doc_id,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    W AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM D),
    P AS ({base}),
    B AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM P GROUP BY r),
    L AS (SELECT r, list_distinct(regexp_extract_all(line, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS s
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM D)),
    T AS (SELECT * FROM (VALUES {tpl}) AS v(label, k, words)),
    M AS (SELECT r, label, len(list_intersect(s, words)) / len(words) AS share FROM L, T
          WHERE len(list_intersect(s, words)) >= ceil({CONTAINMENT} * len(words) - 1e-9)),
    A AS (SELECT r, label, 1.0 AS share, true AS base FROM P UNION ALL SELECT r, label, share, false FROM M),
    G AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
          string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, max(share) AS score FROM A GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM W LEFT JOIN B USING (r) LEFT JOIN G USING (r)"""


OP2_SQL = _sql()
