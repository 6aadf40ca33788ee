"""The n-gram join's use of disk: shuffle files go with the write that made them, sets are shipped to blocks in passes."""

import glob
import os

import numpy as np
from pyspark.sql import functions as F

from waveloom.llm import base, ngramjoin


def _shuffle_bytes(spark) -> int:
    folders = spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(f) for d in folders for f in glob.glob(f"{d}/**/shuffle_*", recursive=True))


def test_shuffle_files_go_with_their_write(spark):
    before, setting = _shuffle_bytes(spark), spark.conf.get(base.SHUFFLES_GO)
    stored = base.settle(spark.range(300_000).select(F.xxhash64("id").alias("h")).repartition("h"))
    assert stored.count() == 300_000
    assert _shuffle_bytes(spark) - before < 500_000  # 2.4 MB were shuffled
    assert spark.conf.get(base.SHUFFLES_GO) == setting


def test_passes_lose_no_link(spark):
    rng = np.random.default_rng(5)
    core = np.sort(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    sets = {k: core.copy() for k in range(12)}
    for k in sets:
        sets[k][k] += np.uint64(1 + k)
    other = {100 + k: np.sort(rng.integers(0, 1 << 63, 60).astype(np.uint64)) for k in range(3)}
    rows = [(k, bytearray(np.sort(s).tobytes())) for k, s in {**sets, **other}.items()]
    stored = spark.createDataFrame(rows, "node long, s binary")
    members = {7: list(range(12)), 8: list(range(12)), 9: [0, 1, 100, 101], 10: [100, 101, 102], 11: [3, 4]}
    crowd = spark.createDataFrame([(t, k, 60, k) for t, ks in members.items() for k in ks], "t long, node long, n int, label long")

    def parts(links):
        return {(r.node, r.label) for r in base.components(links).collect()}
    whole = parts(ngramjoin.linked_in_blocks(crowd, stored, 90))
    assert whole == {(k, 0) for k in range(12)}
    assert parts(ngramjoin.linked_in_blocks(crowd, stored, 90, most_bytes=16 * 60 * 8)) == whole
