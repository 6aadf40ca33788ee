"""Phrase collocations, the filter audit and the digest index against brute force."""

import hashlib
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from waveloom.llm import collocations, digestindex, filteraudit

DOCS = "doc_id bigint, text string, lang string, salt int, pair string, c string"


def phrase_docs():
    rng = np.random.default_rng(11)
    pool = ["new", "york", "City", "of", "the", "x\x00y", "ça", "a", "0"]
    out = []
    for i in range(160):
        words = [pool[k] for k in rng.choice(len(pool), rng.integers(0, 25), p=[0.2, 0.2, 0.15, 0.1, 0.15, 0.05, 0.05, 0.05, 0.05])]
        text = "".join(w + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", ";"], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) for w in words)
        out.append((i, text, [None, "en", "en", "de", ""][i % 5], 1, "p", "c"))
    same = ("New  York\tcity. " * 7, "en", 1, "p", "c")
    return out + [(500, *same), (500, *same), (None, *same), (501, None, "en", 1, "p", "c"), (502, "", None, 1, "p", "c"), (503, ".;,\n \t", "fr", 1, "p", "c"),
                  (504, " ".join(["long", "text", "goes", "on"] * 400), "en", 1, "p", "c"), (505, "w" * 3000 + " end", "en", 1, "p", "c")]


def brute_phrases(rows, least=10, cover=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(odd.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cand.items():
        if any(q[0] == lang and len(q[1]) > len(p) and 100 * b >= cover * a and any(q[1][i:i + len(p)] == p for i in range(len(q[1]))) for q, b in cand.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(own[:top], 1)]
    return sorted(ranked)


@pytest.mark.parametrize("unit, held, share, top", [(2 << 20, 1 << 22, 1 << 12, 2000), (64, 20, 1 << 12, 3), (50, 1 << 22, 1 << 40, 2000)])
def test_collocations(spark, monkeypatch, unit, held, share, top):
    """In whole units, in units that cut every text and are sent at once, and with every pair dealt over many tasks."""
    monkeypatch.setattr(collocations, "UNIT", unit)
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "SHARE", share)
    rows = phrase_docs()
    got = collocations.collocations(spark.createDataFrame(rows, DOCS).repartition(3), top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, top=top)
    assert sorted(tuple(r) for r in got.collect()) == want and len({r[0] for r in want}) == 4
    assert any(len(r[2].split(" ")) == 3 for r in want)


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, 1, "p", "c"), (2, "a b", "en", 1, "p", "c")], DOCS)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 10**15 - 1, 10**15 - 1, 10**15 - 7
    df = spark.createDataFrame([(a, left, right), (3037000500, 3037000501, 3037000502)], "a bigint, l bigint, r bigint")
    got = [r[0] for r in df.select(collocations._score("a", "l", "r").alias("s")).collect()]
    assert got == [10**6 * a * a // (left * right), 10**6 * 3037000500**2 // (3037000501 * 3037000502)]


def test_window_counts_cut_nothing(spark, monkeypatch):
    """Every word opens one window, whatever the units."""
    rows = phrase_docs()
    words = sum(len(re.findall(r"[^\x20\x09]+", p)) for r in rows for p in re.split(r"[.,;:!?\x0a-\x0d]", r[1] or ""))
    for unit in (40, 1000, 6 << 20):
        monkeypatch.setattr(collocations, "UNIT", unit)
        assert collocations.window_counts(spark.createDataFrame(rows, DOCS)).agg(F.sum("c")).first()[0] == words


def audit_docs():
    rng, out = np.random.default_rng(12), []
    for i in range(120):
        n = int(rng.choice([3, 99, 100, 101, 140]))
        kinds = rng.integers(0, 2, 3)
        words = [f"w{k % (n if kinds[0] else max(1, n // 2))}" for k in range(n)]
        text = " ".join(w.upper() if kinds[1] else w for w in words) + (" #" if kinds[2] else "")
        out.append((i, text, [None, "", "en", "de"][i % 4], 1, "p", "c"))
    again = [(i + 60, out[i][1], out[i][2], 1, "p", "c") for i in range(0, 60, 3)]
    return out + again + [(7, out[7][1], "en", 1, "p", "c"), (None, out[7][1], "en", 1, "p", "c"), (None, None, "en", 1, "p", "c"), (900, "", "fr", 1, "p", "c"),
                          (-900, None, "fr", 1, "p", "c"), (901, "Ünï ÇÀ é" * 40, "fr", 1, "p", "c")]


def brute_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for part in {r[2] or "" for r in rows}:
        docs = []
        for d, t, lang, *_ in rows:
            if (lang or "") == part:
                t = t or ""
                w = odd.words(t)
                docs.append((d, [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)),
                                 d is not None and least[t] < d]))
        total = Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                fails = sum(x[1][k] for x in docs)
                steps.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(x[1][k] and sum(x[1]) == 1 for x in docs),
                              sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), letter))
                total[letter] += len(gone)
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def test_filter_audit(spark):
    rows = audit_docs()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 100, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (8, None, None), (5000, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id bigint, quality int, toxic int, text string")
    got = filteraudit.audit(docs, marks)
    assert got.columns == ["part", "filter_order", "step", *filteraudit.MEASURES]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, labels)
    assert filteraudit.audit(docs.limit(0), marks).count() == 0 and filteraudit.audit(docs, marks.limit(0)).count() == got.count()


@pytest.mark.parametrize("m", [2, 3, 5])
def test_least_squares_give_shapley_values(m):
    """Against the mean of the marginal values over all orders, for games of any shape."""
    rng = np.random.default_rng(m)
    for _ in range(20):
        game = [0, *(int(x) for x in rng.integers(-1000, 1000, (1 << m) - 1))]
        want = [Fraction(0)] * m
        for order in permutations(range(m)):
            members = 0
            for k in order:
                want[k] += Fraction(game[members | 1 << k] - game[members], factorial(m))
                members |= 1 << k
        assert filteraudit.kernel_shapley(game) == want


def dedup_docs():
    rng = np.random.default_rng(13)
    texts = [None, "", " ", "a", "A", "ä", "ä", "long " * 20000, *[f"t{k}" for k in range(30)]]
    out = [(int(rng.integers(-50, 400)), texts[k]) for k in rng.integers(0, len(texts), 300)]
    out += [(7, "hot")] * 3 + [(k, "hot") for k in range(1000, 1200)] + [(None, "hot"), (None, "only null"), (None, "only null"), (None, None)]
    return [(d, t, "h", 1, "s", "x") for d, t in out]


DIGEST_DOCS = "doc_id bigint, text string, digest string, slice int, keep_id string, batch string"


def brute_dedup(rows):
    ids, n = {}, Counter()
    for d, t, *_ in rows:
        t = t or ""
        n[t] += 1
        ids[t] = max((x for x in (d, ids.get(t)) if x is not None), default=None)
    return sorted(((d, ids[t or ""], n[t or ""], d == ids[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows), key=repr)


def test_exact_dedup(spark):
    rows = dedup_docs()
    docs = spark.createDataFrame(rows, DIGEST_DOCS).repartition(5)
    got = digestindex.dedup(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_dedup(rows)
    assert digestindex.dedup(docs.limit(0)).count() == 0


def test_index_lasts_and_grows(spark):
    index = digestindex.DigestIndex(spark, buckets=4)
    first = spark.createDataFrame([(1, "a"), (5, "b"), (3, "b")], "doc_id bigint, text string")
    more = spark.createDataFrame([(9, "b"), (10, "c"), (11, "c"), (12, None)], "doc_id bigint, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in digestindex.dedup(first, index).collect()} == {(1, 1, True), (5, 5, True), (3, 5, False)}
    again = digestindex.DigestIndex(spark, index.path, 4)  # as another session would open it
    index.close()
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in digestindex.dedup(more, again).collect()}
    assert got == {(9, 5, 1, False), (10, 11, 2, False), (11, 11, 2, True), (12, 12, 1, True)}
    held = sorted((r.digest, r.keep_id) for r in again.rows().collect())
    again.add(more.select("doc_id", digestindex.text_digest(F.col("text")).alias("digest")), "repeated")
    assert sorted((r.digest, r.keep_id) for r in again.rows().collect()) == held and len(held) == 4
    small = again.compacted()
    assert sorted((r.digest, r.keep_id) for r in small.rows().collect()) == held


def test_the_index_is_not_shuffled(spark):
    index = digestindex.DigestIndex(spark, buckets=4)
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(100)], "doc_id bigint, text string")
    digests = docs.select("doc_id", digestindex.text_digest(F.col("text")).alias("digest"))
    index.add(digests, "one")
    plan = index.new_texts(digests)._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):]
    assert "LeftAnti" in join and join.count("Exchange") == 1 and "Bucketed: true" in join
