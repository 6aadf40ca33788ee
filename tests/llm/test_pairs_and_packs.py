"""N-gram join, repeated strings, WARC bundles, prefix trees and exact search."""

import hashlib
import random

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from waveloom.llm import balltree, chat, ngramjoin, repeats, warc
from waveloom.session import new_path


def shingles(text, n=3):
    w = odd.words((text or "").translate(odd.LOWER))
    return frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_groups(rows, percent=90):
    sets, top = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def near_rows():
    """Chains of copies around the threshold, in groups that differ in size."""
    out, rng = [], random.Random(3)
    for g, n in enumerate((40, 120, 400)):
        base = odd.prose(100 + g, n)
        out += [(1000 * g + k, odd.edited(base, rng.choice([0, 1, 1, 2, 3, n // 40, n // 20]), rng.randrange(6))) for k in range(40)]
    passage = odd.prose(200, 60)
    return out + [(9000 + k, odd.prose(300 + k, 100) + " " + passage + " " + odd.prose(400 + k, 80)) for k in range(30)]


@pytest.mark.parametrize("few", [1, 8])
@pytest.mark.parametrize("which", ["odd", "near"])
def test_components(spark, monkeypatch, which, few):
    monkeypatch.setattr(ngramjoin, "FEW", few)
    monkeypatch.setattr(ngramjoin, "BLOCK", 16)
    rows = [r[:2] for r in odd.rows()] if which == "odd" else near_rows()
    docs = odd.docs(spark) if which == "odd" else spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((tuple(r) for r in ngramjoin.groups(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute_groups(rows)


def test_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    for sizes in ((1, 1, 2, 3), (80, 90, 100, 200), (340, 343, 700, 9000)):
        sets = [np.sort(rng.choice(pool, n, replace=False)) for n in sizes]
        bits = ngramjoin._differing([ngramjoin._sketch(s) for s in sets])
        for i, x in enumerate(sets):
            assert bits[i, i] == 0
            assert all(bits[i, j] <= len(set(x.tolist()) ^ set(y.tolist())) for j, y in enumerate(sets))
    near = [pool[:300], pool[10:310], pool[4000:4300]]
    bits = ngramjoin._differing([ngramjoin._sketch(s) for s in near])
    assert bits[0, 1] <= 20 < 60 < bits[0, 2]


def test_thue_morse_words_stay_apart(spark):
    bit = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(1, "".join("ab"[v] for v in bit)), (2, "".join("ba"[v] for v in bit))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, ngramjoin.groups(docs).collect())) == [(1, 1, 1), (2, 1, 2)]


def test_components_of_nothing_and_the_stage(spark):
    assert ngramjoin.groups(odd.no_docs(spark)).count() == 0
    docs = odd.docs(spark)
    kept = ngramjoin.dedup_stage(spark, docs, "")
    want = stage_rows([r[:2] for r in odd.rows()])
    assert kept.schema == docs.schema and [d for d, _ in want].count(20) == 2
    assert sorted(((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None), key=repr) == want and kept.where("doc_id is null").count() == 2


def stage_rows(rows):
    """What the stage keeps: of each group the first by doc_id and digest; rows of one doc_id with other texts are other documents."""
    rows = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], hashlib.sha256((r[1] or "").encode()).digest())) + [r for r in rows if r[0] is None]
    sets = [shingles(t, 5) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return sorted((rows[i] for i in range(len(rows)) if root(i) == i and rows[i][0] is not None), key=repr)


def test_stage_keeps_every_text_of_a_repeated_id(spark):
    a, b = odd.prose(71, 60), odd.prose(72, 60)
    rows = [(1, a), (1, b), (1, b), (2, odd.edited(a, 1)), (3, odd.edited(b, 1, 4)), (4, odd.prose(73, 60)), (None, a)]
    kept = ngramjoin.dedup_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (1, b), (4, rows[5][1]), (None, a)], key=repr)


def test_stage_joins_five_word_near_copies(spark, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    copy = " ".join("x" if i in (30, 60) else w for i, w in enumerate(base))  # 5 words: 86 / 106; 3 words: 92 / 104
    rows = [(-2, " ".join(base)), (-1, copy), *near_rows()]
    kept = ngramjoin.dedup_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), "")
    three = shingles
    monkeypatch.setitem(globals(), "shingles", lambda text: three(text, 5))
    want = {c for _, _, c in brute_groups(rows, 80)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and -2 in want and -1 not in want


def brute_repeats(rows, length):
    first, out = {}, []
    for d, t in rows:
        if d is not None:
            for k in range(len(t) - length + 1):
                s = t[k:k + length]
                first[s] = min(d, first.get(s, d))
    for d, t in rows:
        gone = [False] * len(t)
        if d is not None:
            for k in range(len(t) - length + 1):
                if first[t[k:k + length]] < d:
                    gone[k:k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [5, 50])
def test_removed_repeats(spark, length):
    rows = odd.rows() if length == 50 else [(k, "".join(random.Random(k).choice("abcé") for _ in range(k * 3)), "s", "l", 1, 2, 3, "t") for k in range(40)]
    got = [tuple(r) for r in repeats.remove_repeats(odd.docs(spark, rows), length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=repr) == brute_repeats([(r[0], (r[1] or "").encode()) for r in rows], length)
    assert repeats.remove_repeats(odd.no_docs(spark)).count() == 0


@pytest.mark.parametrize("length", [3, 7, 9, 50])
def test_interval_expansion_gives_the_classes_of_common_prefixes(length):
    rng = np.random.default_rng(length)
    for n in (1, 5, 60, 900):
        codes = np.concatenate([np.tile(rng.integers(1, 4, n), 2), rng.integers(1, 4, 7), [0]]).astype(np.uint16)
        order, group = repeats.bounded_classes(codes, length)
        doubled = np.concatenate([codes, np.zeros(length, np.uint16)])
        texts = [doubled[i:i + length].tobytes() for i in range(len(codes))]
        by_class = {}
        for i, g in zip(order.tolist(), group.tolist()):
            if i + length <= len(codes):
                by_class.setdefault(g, set()).add(texts[i])
        assert all(len(v) == 1 for v in by_class.values())
        assert len({t for i, t in enumerate(texts) if i + length <= len(codes)}) == len(by_class)


def test_warc_read_back_and_index(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, "ünï\r\n\r\nWARC/1.1"), (4, "u", None), (5, "u", ""), (6, "u", "x" * 3_000_000),
            (2, "http://b/", "same"), (None, "n", "same"), (None, "n", "alone")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    index = warc.write_archives(pages, new_path(spark, "warc"), frame_bytes=400, bundle_bytes=1500)
    got = sorted((tuple(r) for r in warc.read_archives(index).collect()), key=repr)
    top = {}
    for p, _, h in rows:
        top[h or ""] = max(p if p is not None else -1, top.get(h or "", -1))
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        revisit = top[h or ""] >= 0 and (p is None or p < top[h or ""])
        want.append((p, len(raw), warc.payload_digest(raw), "revisit" if revisit else "response", top[h or ""] if revisit else None))
    assert got == sorted(want, key=repr)
    assert index.select("path").distinct().count() > 1
    for r in index.where("page_id IN (3, 6)").collect():  # one record through the seek table
        head, block = warc.opened(r.path).record(r.frame, r.offset)
        assert block.split(b"\r\n\r\n", 1)[1].decode() == next(h for p, _, h in rows if p == r.page_id)
    assert warc.read_archives(warc.write_archives(pages.limit(0), new_path(spark, "warc"))).count() == 0


@pytest.mark.parametrize("bundles", [1, 4, 9])
def test_read_back_is_spread_over_tasks(spark, monkeypatch, bundles):
    monkeypatch.setattr(warc, "READ_FRAMES", 8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    pages = spark.createDataFrame([(k, "u", f"{k} " * 40) for k in range(360)], "page_id bigint, url string, html string").repartition(bundles)
    index = warc.write_archives(pages, new_path(spark, "warc"), frame_bytes=1500)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", index.select("path").distinct().count())
        frames = index.select("path", "frame").distinct().count()
        dealt = warc.dealt_frames(index)
        per_task = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(per_task) == frames and len(per_task) > frames // 16 and max(per_task) <= 24
        assert warc.read_archives(index).count() == 360
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_prefix_trees(spark):
    turns = lambda c, *texts: [(c, k, r, t, "x") for k, (r, t) in enumerate(texts)]
    u, a = "user", "assistant"
    rows = [*turns(1, (u, "hi"), (a, "yes"), (u, "more")), *turns(2, (u, "hi"), (a, "yes"), (u, "other"), (a, "<|end|>\n\\l[INST]")), *turns(3, (u, "hi")),
            *turns(4, (None, None), (a, None)), *turns(5, (u, "hi"), (a, "yes"), (u, "more")), *turns(6, ("a|<b>", "日本 \\ ]")), *turns(None, (a, "free")),
            (7, None, u, "first", "x"), (7, 0, u, "second", "x"), (7, 0, u, "second", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, tokens string").repartition(3)
    packed = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(packed, chat.vocabulary_text()).collect()}
    byconv = {}
    for c, t, r, x, _ in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0)):
        byconv.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(byconv)
    for c, ts in byconv.items():
        learned = "".join(x for r, x in ts if r == a)
        assert got[c].n_turns == len(ts) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.escape(r)) + len(chat.escape(x)) + 13 for r, x in ts)
    packs = packed.collect()
    assert len(packs) == 1 or sum(len(p.nodes) for p in packs) >= 1
    one = next(p for p in packs if any(leaf.conv_id == 1 for leaf in p.leaves))
    path = {}
    for leaf in one.leaves:
        line, k = [], leaf.node
        while k >= 0:
            line.insert(0, k)
            k = one.nodes[k].parent
        path[leaf.conv_id] = line
    assert path[1] == path[5] and path[1][:2] == path[2][:2] and path[3] == path[1][:1]  # shared turns are one node
    for k, n in enumerate(one.nodes):
        above, p = [], n.parent
        while p >= 0:
            above.insert(0, p)
            p = one.nodes[p].parent
        seen = sorted(t for s in one.attends[k] for t in range(s.start, s.stop))
        assert seen == [t for q in above for t in range(one.nodes[q].start, one.nodes[q].stop)] and n.position == len(seen)
        assert one.positions[n.start:n.stop] == list(range(n.position, n.position + n.stop - n.start))
    assert chat.read_back(chat.format_conversations(df.limit(0)), chat.vocabulary_text()).count() == 0


def test_many_packs_keep_every_conversation(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    whole = chat.read_back(chat.format_conversations(df), chat.vocabulary_text())
    small = chat.read_back(chat.packs(chat.by_conversation(df), chat.vocabulary_text(), pack_chars=500), chat.vocabulary_text())
    assert whole.exceptAll(small).count() == 0 and whole.count() == small.count() == df.select("conv_id").distinct().count()


@pytest.mark.parametrize("shard_rows", [7, 10_000])
def test_exact_search_of_odd_vectors(spark, shard_rows):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 3) / 4], k) for k in range(200)]
    nan, inf = float("nan"), float("inf")
    rows += [(300, None, 1), (400, [1.0, None, 0.0], 1), (401, [nan, 0.0, 0.0], 1), (500, [inf, 0.0, 1.0], 1), (600, [1.0, 2.0], 1), (601, [1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1),
             (700, [], 1), (0, rows[0][1], 1), (800, [1e6, -1e6, 3e6], 1), (801, [-2e6, 1e6, 1e6], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int").repartition(3)
    got = sorted(tuple(r) for r in balltree.top_k(df, shard_rows=shard_rows).collect())
    good = {(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, a in good:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert balltree.top_k(df.limit(0)).count() == 0


def test_search_prunes_what_it_may(monkeypatch):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((20, 8)) * 1000
    vecs = np.concatenate([c + rng.standard_normal((100, 8)) * 10 for c in centers]).astype(np.int64)
    order, c, r, nodes = balltree.build_tree(vecs)
    ids = np.arange(len(vecs))
    q = vecs[::200]
    s = balltree.Search(ids[::200], q, 10, np.full(len(q), -(1 << 63)))
    s.run(ids[order], vecs[order], c, r, nodes)
    for k, i in enumerate(range(0, len(vecs), 200)):
        score = vecs @ vecs[i]
        best = sorted((-score[j], j) for j in range(len(vecs)) if j != i)[:10]
        assert list(zip(-s.score[k], s.found[k])) == best
    assert s.visited < 0.5 * len(q) * (nodes[:, 2] < 0).sum()


def test_a_task_sends_a_row_of_a_crowd_once(spark, monkeypatch):
    """Rows that fit in many blocks come out once for a task, not once for each two blocks."""
    import numpy as np
    from waveloom.llm import ngramjoin as nj
    crowd = spark.createDataFrame([(1, k, 50, k) for k in range(96)], "t long, node long, n int, label long")
    compared = spark.sparkContext.accumulator(0)
    packed = nj._packed

    def blocks(*args):
        pairs, stored = packed(*args)
        return pairs.coalesce(1), stored

    monkeypatch.setattr(nj, "BLOCK", 8)
    monkeypatch.setattr(nj, "_packed", blocks)
    fits = lambda rows: (compared.add(1), np.ones((len(rows), len(rows)), bool))[1]
    wide = spark.range(96).selectExpr("id AS node", "id AS extra")
    found = nj._selected(crowd, wide, 80, fits)
    assert found.count() == 96 and compared.value < 60  # 12 blocks in each of two size classes meet 156 times
