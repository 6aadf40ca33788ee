"""Rows of a crowded token leave the blocks once for each of two size classes, however many tasks meet its blocks."""

import numpy as np

from waveloom.llm import ngramjoin


def made_by(spark, name):
    """Output rows of the last MapInArrow of a function."""
    store, found = spark._jsparkSession.sharedState().statusStore(), []
    runs = store.executionsList()
    for i in range(runs.size()):
        e = runs.apply(i)
        nodes, values = store.planGraph(e.executionId()).allNodes(), store.executionMetrics(e.executionId())
        for j in range(nodes.size()):
            n = nodes.apply(j)
            if n.name().startswith("MapInArrow") and n.desc().startswith(f"MapInArrow {name}("):
                metrics = [n.metrics().apply(k) for k in range(n.metrics().size())]
                found.append(next(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if "output rows" in m.name()))
    return found[-1]


def test_rows_of_a_crowd_are_made_once_for_all_tasks(spark, monkeypatch):
    skew = "spark.sql.adaptive.skewJoin.skewedPartition"
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", f"{skew}ThresholdInBytes": "2k",
             f"{skew}Factor": "0.1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in small}
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    crowd = spark.createDataFrame([(1, k, 50, k) for k in range(400)], "t long, node long, n int, label long")
    wide = spark.range(400).selectExpr("id AS node", "id AS extra")
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        # Each fits exactly one other, which is mostly in another block: every row is found, and found late.
        mates = lambda rows: (n := np.array([v["node"] for v in rows]))[:, None] == (n ^ 1)[None, :]
        assert ngramjoin._selected(crowd, wide, 80, mates).count() == 400
        assert made_by(spark, "select") <= 800
        everything = lambda rows: np.ones((len(rows), len(rows)), bool)
        assert ngramjoin._selected(crowd, wide, 80, everything).count() == 400
        assert made_by(spark, "select") <= 800
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
