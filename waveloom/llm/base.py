"""Helpers of the training-data operators: table access, partition counts, two-level ranks, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_path

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD_BREAK = "[^\\x20\\x09-\\x0D]+"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write df to the shared folder and read it back, so that its input is not computed again.

    zstd frees its buffers with each file; the direct buffers of snappy wait for a garbage collection of the heap. The write's shuffle
    files go when it ends: nothing reads them again, and otherwise they would stay until the driver's heap is collected.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.settled_path = path
    return stored


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``settle`` once everything made from them is stored itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.settled_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no working column can clash with a column of the table."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def ranked(df: DataFrame, keys: list[str], order: list[str], spread: int, out: str = "rank") -> DataFrame:
    """0-based gapless rank within keys, without one task per key.

    Rows of a key are dealt to ``spread`` sub-groups by the hash of the first order column, numbered there, and moved by the
    counts of the earlier sub-groups. Rows equal in the first order column get consecutive ranks.
    """
    dealt = df.withColumn("_sub", F.pmod(F.xxhash64(order[0]), F.lit(spread)).cast("int"))
    counts = dealt.groupBy(*keys, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_sub").orderBy(*order)) - 1)
    return inner.join(starts, [*keys, "_sub"]).withColumn(out, F.col("_start") + F.col("_i")).drop("_sub", "_start", "_i")


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label = smallest node of the component.

    Labels spread to neighbours and are then shortened through the label's own label, which halves long chains.
    Every round is a partially aggregated minimum and one join and is written to the shared folder; the round before is deleted.
    Labels that still change after ``most`` rounds are an error, not a partial result.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), name)
    stored = labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name)
    for _ in range(most):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = settle(spread.join(up, "label", "left").select("node", "old", F.least("label", "top").alias("label")), name)
        forget(stored)
        stored, labels = new, new.select("node", "label")
        if new.where("label <> old").isEmpty():
            forget(both)
            return labels
    raise RuntimeError("labels still change; raise the round limit")
