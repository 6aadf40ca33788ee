"""Work of the repeat removal grows with the runs, not with groups times buckets; lonely runs are not sorted."""

import hashlib
import random

import numpy as np
import odd
import pyarrow as pa

from waveloom.llm import repeats


def test_runs_of_all_buckets_are_packed_in_no_call_of_their_own(monkeypatch):
    texts = [odd.prose(k, 200).encode() for k in range(40)]
    docs = pa.table({"doc_id": pa.array(range(40), pa.int64()), "check": pa.array(range(40), pa.int64()), "text": pa.array(texts, pa.binary())})
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    runs = repeats.Runs(np.frombuffer(b"".join(texts), np.uint8), off, 50)
    rows = runs.row.astype(np.int64)
    group = repeats._Group(docs, [(rows, rows, runs.pos.astype(np.uint32))], 50)
    scans, plain = [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda a: (scans.append(1), plain(a))[1])
    buckets, order, ends = group.sent(500)
    assert len(scans) <= 2 and len(buckets) > 400  # evenly, though minimizers are small numbers
    assert sorted(order.tolist()) == list(range(len(group.first))) and ends[-1] == len(order) and (np.diff(buckets) > 0).all()
    bucket = repeats._spread(group.value[group.first], 500)
    for p, lo, hi in zip(buckets, [0, *ends[:-1]], ends):
        assert (bucket[order[lo:hi]] == p).all()


def test_cut_values_come_back_whole():
    column = np.arange(10, dtype=np.int64) - 5
    cut = repeats._cut(column, np.array([3, 4, 10]))
    assert [len(x.as_py()) for x in cut] == [24, 8, 48]
    assert (repeats._whole(pa.chunked_array([cut[:1], cut[1:]]), np.int64) == column).all()
    assert len(repeats._whole(pa.chunked_array([cut[:0]]), np.int64)) == 0


def test_many_small_groups_give_the_same_removals(spark, monkeypatch):
    rng = random.Random(3)
    shared = [odd.prose(k, 30) for k in range(6)] + ["z" * 90]
    rows = [(k, f"{odd.prose(100 + k, 20)} {rng.choice(shared)} {odd.prose(200 + k, 10)} {rng.choice(shared)}"[: rng.randint(60, 900)]) for k in range(120)]
    rows += [(k % 7, t) for k, t in rows[:9]] + [(None, rows[3][1]), (500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(repeats, "GROUP_BYTES", 3000)
    got = sorted(map(tuple, repeats.remove_repeats(df).collect()), key=repr)
    least = {}
    for i, t in rows:
        for k in range(len((t or "").encode()) - 49):
            if i is not None:
                w = t.encode()[k:k + 50]
                least[w] = min(i, least.get(w, i))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49 if i is not None else 0):
            if least[b[k:k + 50]] < i:
                gone[k:k + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=repr) and any(r[2] for r in got)
