"""Exact search in groups of shards: a tree is sent once for many blocks of queries, never once for each block."""

import numpy as np
import pytest

from waveloom.llm import balltree


@pytest.mark.parametrize("scale", [8, 1 << 12, 1 << 30])
def test_groups_of_shards_and_blocks(spark, monkeypatch, scale):
    monkeypatch.setattr(balltree, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(balltree, "TASK_BLOCKS", 2)
    monkeypatch.setattr(balltree, "GROUP_SHARDS", 2)
    rng = np.random.default_rng(scale & 255)
    vecs = rng.integers(-4, 5, (600, 3))
    vecs[100:300] = vecs[7]  # one very common vector: ties go to the smaller id, whatever the shard
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    found = balltree.top_k(df, every=5, k=4, scale=scale, shard_rows=60)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow find" not in plan
    score = (vecs * scale) @ (vecs * scale).T
    want = []
    for q in range(0, 600, 5):
        best = sorted((-int(score[q, j]), j) for j in range(600) if j != q)[:4]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == want


def test_a_block_meets_leaves_in_one_product(monkeypatch):
    rng = np.random.default_rng(2)
    vecs = rng.integers(-300, 300, (4000, 16))
    order, *tree = balltree.build_tree(vecs, 512)
    ids = np.arange(4000)
    s = balltree.Search(ids[::20], vecs[::20], 10, np.full(200, -(1 << 63)))
    calls, meet = [], balltree.Search._meet
    monkeypatch.setattr(balltree.Search, "_meet", lambda self, *a: (calls.append(1), meet(self, *a))[1])
    s.run(ids[order], vecs[order], *tree)
    leaves = int((tree[2][:, 2] < 0).sum())
    assert len(calls) <= 2 * leaves
    for k, i in enumerate(range(0, 4000, 20)):
        score = vecs @ vecs[i]
        assert list(zip(-s.score[k], s.found[k])) == sorted((-score[j], j) for j in range(4000) if j != i)[:10]
