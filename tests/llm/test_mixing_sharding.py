"""Source mixing and sharding against brute force."""

import heapq
import zlib
from collections import Counter, defaultdict

import odd
import pytest

from waveloom.llm import mixing, sharding


def one_by_one(weights, seats):
    heap = [(-w, k, w, 1) for k, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    won = [0] * len(weights)
    for _ in range(seats if heap else 0):
        _, k, w, n = heapq.heappop(heap)
        won[k] += 1
        heapq.heappush(heap, (-w / (2 * n + 1), k, w, n + 1))
    return won


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 12_345])
def test_seats_are_those_of_single_awards(spark, seats):
    groups = {"x": [5.0, 3.0, 1.0], "y": [1.0] * 9, "z": [0.0, 2.5, 1e4, 7.25, 0.0], "w": [0.0, 0.0]}
    df = spark.createDataFrame([(g, k, w, seats) for g, ws in groups.items() for k, w in enumerate(ws)], "g string, k int, w double, seats bigint")
    got = defaultdict(dict)
    for r in mixing.sainte_lague(df, ["g"], "w", "seats", ["k"], "won").collect():
        got[r.g][r.k] = r.won
    assert {g: [got[g][k] for k in range(len(ws))] for g, ws in groups.items()} == {g: one_by_one(ws, seats) for g, ws in groups.items()}


def reshared(words):
    """Targets by repeated resharing of what is above a limit."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    fixed, total = {}, sum(words.values())
    while True:
        free = [s for s in words if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * words[s]]
        if not over:
            return fixed | share
        fixed.update({s: 3.0 * words[s] for s in over})


@pytest.mark.parametrize("which", ["odd", "given"])
def test_mix(spark, sf_dir, which):
    docs = odd.docs(spark) if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).collect()
    want = docs.select("doc_id", "text", "source").collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == Counter((r.doc_id, r.source, len(odd.words(r.text))) for r in want)
    sizes = Counter()
    for r in want:
        sizes[r.source] += len(odd.words(r.text))
    targets, taken = reshared(dict(sizes)), Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
    for s in sizes:
        # One seat more or less, and a short last block that is taken up to three times.
        assert abs(taken[s] - targets[s]) <= 4 * mixing.BLOCK_WORDS, s
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr)


def test_mix_of_nothing_and_the_stage(spark):
    assert mixing.mix(odd.no_docs(spark)).count() == 0
    assert mixing.mix_stage(spark, odd.no_docs(spark), "").columns == odd.docs(spark).columns
    docs = odd.docs(spark)
    out = mixing.mix_stage(spark, docs, "")
    assert out.schema == docs.schema
    have, got = Counter(map(tuple, docs.collect())), Counter(map(tuple, out.collect()))
    assert all(n <= 3 * have[r] for r, n in got.items())


@pytest.mark.parametrize("which,n", [("odd", 4), ("odd", 24), ("given", 24)])
def test_shards(spark, sf_dir, which, n):
    docs = odd.docs(spark) if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sharding.assign(docs, n).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[k]) for k in range(n)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_groups_stay_together_and_large_ones_fill_shards(spark):
    # 40 groups of 3, a group that holds a third of all rows, and single texts.
    rows = [(k, f"g{k % 40}") for k in range(120)] + [(1000 + k, "same") for k in range(180)] + [(5000 + k, f"s{k}") for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    placed = {r.doc_id: r.shard for r in sharding.assign(docs, 12).collect()}
    split = sum(len({placed[k] for k in range(g, 120, 40)}) > 1 for g in range(40))
    assert split <= 4
    assert len({placed[1000 + k] for k in range(180)}) <= 8  # 45 rows a shard; four shards would hold the group
    assert sharding.assign(docs.limit(0), 12).count() == 0
    stage = sharding.shard_stage(spark, odd.docs(spark), "")
    assert stage.columns == [*odd.docs(spark).columns, "shard_", "slot"] and stage.drop("shard_", "slot").schema == odd.docs(spark).schema


@pytest.mark.parametrize("sizes", [[5] * 192, [80] * 12, [2] * 150 + [11] * 30 + [50] * 6 + [30]])
def test_links_are_kept_without_single_texts(spark, sizes):
    rows = [(1000 * g + k, f"g{g}") for g, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    cells = Counter((r.doc_id // 1000, r.shard) for r in sharding.assign(docs, 12).collect())
    shards = Counter()
    for (_, s), n in cells.items():
        shards[s] += n
    assert sum(shards.values()) == len(rows) and max(shards.values()) - min(shards.values()) <= 1
    # Links kept: pairs of one text in one shard.
    assert sum(n * (n - 1) for n in cells.values()) >= 0.95 * sum(n * (n - 1) for n in sizes)
