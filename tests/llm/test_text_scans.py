"""License scan, decontamination and language ID."""

import itertools

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from waveloom.llm import decontam, langid, licenses
from waveloom.llm.textbytes import LONG, byte_hashes


def test_license_places_and_labels(spark):
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(odd.docs(spark)).collect()}
    rows = odd.docs(spark).select("doc_id", "text").collect()
    assert licenses.scan(odd.docs(spark)).count() == len(rows)
    for r in rows:
        w = odd.plain(r.text)
        places = sorted((i, label) for p, label in licenses.PHRASES.items() for n in [len(p.split())] for i in range(len(w)) if w[i:i + n] == p.split())
        g = got[(r.doc_id, len(w))]
        assert g.n_base == len(places) and g.base_labels == ",".join(sorted({x for _, x in places}))
        assert (g.first_word, g.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1
    assert licenses.scan(odd.no_docs(spark)).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_containment_join_finds_every_block(spark, threshold):
    templates = [("t1", "p q r s t"), ("t2", "p p q u v w x y"), ("t3", "z")]
    rng = np.random.default_rng(1)
    texts = ["\n".join(" ".join(rng.choice(list("pqrstuvwxyzab"), rng.integers(0, 9))) for _ in range(rng.integers(1, 5))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan(docs, templates, {}, threshold).collect()}
    for i, t in enumerate(texts):
        found = [(label, len(set(line.split()) & set(x.split())) / len(set(x.split()))) for line in t.split("\n") for label, x in templates]
        found = [f for f in found if f[1] >= threshold]
        assert got[i] == (",".join(sorted({f[0] for f in found})), round(max([f[1] for f in found], default=0.0), 9)), t


def test_overlaps_survive_substitutions(spark):
    items = [(1, odd.prose(50, 40)), (2, odd.prose(51, 12)), (3, "Only five words in here"), (4, None), (5, ""), (1, odd.prose(50, 40))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    swap = lambda k, every: " ".join("other" if i % every == every - 1 else w for i, w in enumerate(items[k][1].split()))
    around = [odd.prose(60 + k, 80) for k in range(6)]
    texts = {1: around[0] + " " + items[0][1].upper() + ", " + around[1], 2: around[2] + " " + swap(0, 9), 3: swap(0, 2) + " " + around[3], 4: "x " + items[1][1] + " y",
             5: "only FIVE words in here!", 6: " ".join(items[0][1].split()[5:20]) + " " + around[4], 7: None, 8: "", 9: around[5]}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [(None, texts[1], 1), (1, texts[1], 1)], "doc_id bigint, text string, item_id int")
    got = decontam.overlaps(docs, bench).collect()
    assert sorted({(r.doc_id, r.item_id) for r in got if r.doc_id}) == [(1, 1), (2, 1), (4, 2), (5, 3), (6, 1)]
    full = next(r for r in got if r.doc_id == 1)
    assert (full.start_word, full.n_words, full.n_equal) == (80, 40, 40) and sum(r.doc_id is None for r in got) == 1
    kept = decontam.clean(docs, bench)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [3, 7, 8, 9]
    assert decontam.overlaps(docs, bench.limit(0)).count() == 0 and decontam.clean(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.8, 0.9, 1.0])
def test_every_overlap_of_a_diagonal_is_found(share):
    rng = np.random.default_rng(5)
    for k in range(250):
        n = int(rng.integers(5, 70))
        item, same = [f"w{i}" for i in range(n)], rng.random(n) < rng.choice([0.6, 0.75, 0.8, 0.9])
        seeds = decontam._Seeds([(1, " ".join(item))], decontam.MASKS, 9, share)
        raw = np.frombuffer(" ".join(w if s else "x" for w, s in zip(item, same)).encode(), np.uint8)
        found = seeds._verify(decontam.Words(raw, np.array([0, len(raw)]), decontam.plain_words()), 0, 0, 0)
        right = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if (e := same[i:j].sum()) >= min(9, n) and e >= share * (j - i) - 1e-9]
        assert (found is not None) == bool(right), same
        assert found is None or ((found[0], found[0] + found[1]) in right and found[2] == same[found[0]:found[0] + found[1]].sum())


def unhit_overlap(masks, least, equal_share):
    """An overlap of the rule, of any length, that no mask hits (None: there is none).

    Walks all sequences of equal and different words that no mask hits, kept by their last words and the best score of each: an
    equal word counts 1, a different one what the share costs, so that a score of 0 meets it. A start below -least - 3 can
    go, for what follows it is then an overlap by itself.
    """
    span = max(map(len, masks))
    cost, seeds = round(equal_share / (1 - equal_share)), [int(m, 2) for m in masks]
    best, front = {(0, 0): 0}, [(0, 0, 0)]
    while front:
        new = {}
        for tail, count, score in front:
            for equal in (1, 0):
                now = tail * 2 + equal
                if equal and any(now & m == m for m in seeds):
                    continue
                key, total = (now % (1 << (span - 1)), min(least, count + equal)), score + (1 if equal else -cost)
                if key[1] == least and total >= 0:
                    return now
                if total >= -least - 3 and total > best.get(key, -99):
                    best[key] = new[key] = total
        front = [(*k, v) for k, v in new.items()]
    return None


def test_masks_hit_every_overlap_of_the_rule():
    assert unhit_overlap(decontam.MASKS, decontam.MIN_WORDS, decontam.MIN_IDENTITY) is None
    assert unhit_overlap(decontam.MASKS[1:], decontam.MIN_WORDS, decontam.MIN_IDENTITY) is not None


def test_short_overlaps_with_every_choice_of_substitutions(spark):
    rows = []
    for n in range(9, 16):
        for miss in itertools.combinations(range(1, n - 1), n - max(9, -(-4 * n // 5))):
            rows.append((len(rows), f"before {' '.join('x' if i in miss else f'w{i}' for i in range(n))} after"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(15)))], "item_id bigint, text string")
    assert {r.doc_id for r in decontam.overlaps(docs, bench).collect()} == set(range(len(rows)))
    assert decontam.clean(docs, bench).count() == 0


def test_several_passes_give_what_one_gives(spark, monkeypatch):
    items = [(k, odd.prose(500 + k, 30)) for k in range(12)]
    docs = spark.createDataFrame([(k, odd.prose(700 + k, 50) + " " + items[k][1]) for k in range(0, 12, 2)] + [(99, "z " * 30)], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(tuple, decontam.overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontam, "PASS_WORDS", 100)
    assert sorted(map(tuple, decontam.overlaps(docs, bench).collect())) == one and {(r[0], r[1]) for r in one} == {(k, k) for k in range(0, 12, 2)}
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [99]


def test_a_text_longer_than_a_block(spark, monkeypatch):
    item = odd.prose(800, 40)
    docs = spark.createDataFrame([(1, odd.prose(801, 4000) + " " + item + " " + odd.prose(802, 4000)), (2, "short"), (3, odd.prose(803, 4000))], "doc_id bigint, text string")
    monkeypatch.setattr(decontam, "CHUNK", 1000)
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert [(r.doc_id, r.start_word, r.n_words) for r in decontam.overlaps(docs, bench).collect()] == [(1, 4000, 40)]


def test_hashes_of_structured_strings_differ():
    rng = np.random.default_rng(11)
    for n in (64, 256, 504, 511, LONG, 1024, 4096):
        bit = np.array([bin(i).count("1") % 2 for i in range(n)], np.uint8)
        for letters in (b"ab", b"xy"):
            a, b = (np.frombuffer(letters, np.uint8)[v] for v in (bit, 1 - bit))
            pair = byte_hashes(np.concatenate([a, b]), np.array([0, n]), np.array([n, 2 * n]))
            assert pair[0] != pair[1]
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    start = rng.integers(0, 2400, 4000)
    end = start + rng.integers(0, 600, 4000)
    strings = [data[s:e].tobytes() for s, e in zip(start, end)]
    named = dict(zip(strings, byte_hashes(data, start, end).tolist()))
    assert [named[s] for s in strings] == byte_hashes(data, start, end).tolist() and len(set(named.values())) == len(named)


def test_overlaps_beside_edited_words(spark):
    item = [f"w{i}" for i in range(110)]
    short = [f"v{i}" for i in range(10)]
    texts = {1: short[:2] + ["x"] + short[3:], 2: item[:10] + ["x" if i % 9 in (3, 6) else w for i, w in enumerate(item[10:])], 3: ["x" if i % 4 == 3 else w for i, w in enumerate(short)]}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()) == [(1, 2), (2, 1)]
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [3]


def test_overlaps_in_several_passes(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = decontam.overlaps(docs, bench).collect()
    monkeypatch.setattr(decontam, "PASS_WORDS", 300)
    assert sorted(map(tuple, decontam.overlaps(docs, bench).collect())) == sorted(map(tuple, want)) and want
    # Brute force: documents that hold nine words of an item in a row are all found.
    nine = {tuple(w[i:i + 9]): r.item_id for r in bench.collect() for w in [odd.plain(r.text)] for i in range(len(w) - 8)}
    hit = {(r.doc_id, nine[g]) for r in docs.collect() for w in [odd.plain(r.text)] for g in zip(*[w[k:] for k in range(9)]) if g in nine}
    assert hit <= {(r.doc_id, r.item_id) for r in want}


def test_gradients_of_the_network():
    net = langid.Network(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    text, label = np.random.default_rng(1).integers(0, 4, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, g = net.gradients(text, label)
    rng = np.random.default_rng(2)
    for k, v in net.p.items():
        for _ in range(4):
            i = tuple(rng.integers(0, 4 if n == 256 else n) for n in v.shape)
            v[i] += 1e-5
            up = net.gradients(text, label)[0]
            v[i] -= 2e-5
            down = net.gradients(text, label)[0]
            v[i] += 1e-5
            assert abs((up - down) / 2e-5 - g[k][i]) < 1e-7, k


def test_reader_equals_the_network_and_pools_whole_texts():
    net = langid.Network(["a", "b"], hidden=4)
    texts = [b"", b"abc", bytes(range(97, 123)) * 11, b"z" * langid.WINDOW]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    got = net.ready().texts(data, off)
    for t, g in zip(texts, got):
        total = np.zeros(2)
        for i in range(0, len(t), langid.WINDOW):
            w = np.frombuffer(t[i:i + langid.WINDOW], np.uint8)[:, None]
            states = {d: net._forward(d, w) for d in "fb"}
            for k in range(len(w)):
                e = np.exp(states["f"][k][5] @ net.p["of"] + states["b"][k][5] @ net.p["ob"] + net.p["c"])[0]
                total += e / e.sum()
        assert np.allclose(g, total / max(1, len(t)), atol=1e-4)


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.op8(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 0.2 < len(held) / len(rows) < 0.5
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 5)
    docs = odd.docs(spark).withColumn("text", F.expr("CASE WHEN doc_id = 26 THEN '12 345 !' ELSE text END"))
    net = langid.learn(docs)
    assert set(net.langs) <= {"en", "de", "fr"}
    out = langid.predict(docs, net).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.lang_pred == "und") == (r.row.text is None or not any(c.isalpha() for c in r.row.text)), r.row.text
        assert r.score == 0 if r.lang_pred == "und" else 0 < r.score <= 1
    assert langid.learn(odd.no_docs(spark)) is None
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, None).collect()} == {("und", 0.0)}
    assert langid.language_stage(spark, docs, "").schema == docs.schema and langid.language_stage(spark, odd.no_docs(spark), "").count() == 0
