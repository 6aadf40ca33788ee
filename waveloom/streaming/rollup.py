"""Rollup of samples that arrive in micro-batches.

Bucket states merge, so no streaming state is kept: each batch writes the partial states of the
buckets it touches, and a reader merges the partials of a bucket. The answer does not depend on
how the samples were cut into batches, and a replayed batch overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import finite
from ..operators.envelope import bucket_of
from ..operators.rollup import BASE, covered_prefix
from ..operators.stats import close_state, merge_once, state_columns
from ..session import bounded, hash_parts


def batch_states(batch: DataFrame, base: int = BASE, pivots: DataFrame | None = None, n_channels: int | None = None) -> DataFrame:
    """Partial level-0 states of one batch; start = index of the pivot (last place if there is none)."""
    rows = batch.select("channel_id", "sample_idx", "v")
    ok = finite("v")
    if pivots is None:
        pivots = rows.groupBy("channel_id").agg(
            F.min_by(F.when(ok, F.col("v")), F.when(ok, F.col("sample_idx"))).alias("pivot"))
    rows = rows.join(bounded(pivots, n_channels), "channel_id", "left").withColumn("bucket", bucket_of("sample_idx", base))
    start = F.coalesce(F.min(F.when(ok, F.col("sample_idx"))), F.lit(1 << 62))
    agg = rows.groupBy("channel_id", "bucket").agg(start.alias("start"), *state_columns())
    return close_state(agg, ["channel_id", "bucket", "start"])


def start_rollup(samples: DataFrame, declared: DataFrame | None, path: str, checkpoint: str, base: int = BASE,
                 **trigger) -> StreamingQuery:
    """Append partial states to `path`/batch_id=N; samples beyond the declared length go to `path`_overrun.

    declared: channel_id, length and optionally pivot (None: lengths are open). A known pivot saves
    a pass over each batch.
    """
    n = None if declared is None else declared.count()
    pivots = declared.select("channel_id", "pivot") if declared is not None and "pivot" in declared.columns else None

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        kept = batch
        if declared is not None:
            marked = batch.join(bounded(declared.select("channel_id", "length"), n), "channel_id", "left")
            over = F.coalesce(F.col("sample_idx") >= F.col("length"), F.lit(False)) | (F.col("sample_idx") < 0)
            marked.filter(over).drop("length").write.mode("overwrite").parquet(f"{path}_overrun/batch_id={batch_id}")
            kept = marked.filter(~over).drop("length")
        batch_states(kept, base, pivots, n).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.unpersist()

    return (
        samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Level-0 states so far: the partials of a bucket (at most one per sample) merged in sample order."""
    partials = spark.read.parquet(path).drop("batch_id")
    return merge_once(hash_parts(partials, partials.count(), "channel_id", "bucket"), ["channel_id", "bucket"], "start")


def stream_coverage(states: DataFrame, channels: DataFrame, base: int = BASE) -> DataFrame:
    """Covered prefix and completeness of each channel while its samples still arrive."""
    return covered_prefix(states, channels, base)
