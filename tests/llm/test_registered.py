"""Registered queries against their SQL, and the pipeline stage by stage."""

from collections import Counter

import compare
import corpus_pipeline
import odd
import pytest
import test_pairs_and_packs as pairs

from waveloom.llm import langid, ngramjoin, queries
from waveloom.llm.base import settle


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare.differences(queries.QUERIES[name](spark, sf_dir), compare.connect(sf_dir), queries.SQL[name]) == ""


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["language ID", "n-gram Jaccard join", "decontamination", "source mix", "sharding"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(settle(stage(spark, seen[-1], sf_dir), "stage"))
    assert all(d.columns == columns for d in seen[:-1]) and seen[-1].columns == [*columns, "shard", "slot"]
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    good = {r.row.doc_id for r in langid.predict(docs, langid.learn(docs)).collect() if r.lang_pred != "und" and r.score >= langid.MIN_SCORE}
    assert set(ids[1]) == good and len(good) >= 0.99 * len(ids[0])
    three = pairs.shingles  # the stage is looser than op9: five words, 80 %
    monkeypatch.setattr(pairs, "shingles", lambda text: three(text, ngramjoin.STAGE_SHINGLE))
    assert (ngramjoin.STAGE_SHINGLE, ngramjoin.STAGE_PERCENT) == (5, 80)
    assert ids[2] == sorted({c for _, _, c in pairs.brute_groups([(r.doc_id, r.text) for r in seen[1].collect()], ngramjoin.STAGE_PERCENT)})
    bench = {tuple(w[i:i + 9]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in [odd.plain(r.text)] for i in range(len(w) - 8)}
    dirty = {r.doc_id for r in seen[2].collect() for w in [odd.plain(r.text)] if any(g in bench for g in zip(*[w[k:] for k in range(9)]))}
    assert set(ids[3]) == set(ids[2]) - dirty
    copies = Counter(ids[4])
    assert set(copies) <= set(ids[3]) and max(copies.values()) <= 3
    assert ids[5] == ids[4]
    shards = Counter(r.shard for r in seen[5].collect())
    assert max(shards.values()) - min(shards.values()) <= 1 and set(shards) <= set(range(24))
    assert corpus_pipeline.run(spark, sf_dir).columns == seen[5].columns
