"""Exact deduplication against a persistent index of text digests, bucketed and sorted by digest.

The index is a Parquet table in buckets of the digest. New documents are grouped by digest, dealt once over the same buckets and
anti-joined with it by a merge join that moves no row of the index; what is left is appended. The index holds one row per different text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from .base import settle, table

BUCKETS = 64
ROWS_PER_SLICE = 1_000_000  # rows of one digest that meet in one task, about


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, 32 bytes; a null text is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """Digests seen so far: digest, keep_id (the document that stands for the text), batch (the name of the batch that added it).

    The table lies in a folder of its own in the shared folder and can be opened again by another session from that path and its number of
    buckets. Batches are added one after the other.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or new_path(spark, "digests")
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(f"""CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet
            CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{self.path}'""")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def new_texts(self, groups: DataFrame) -> DataFrame:
        """Rows of groups (digest, ...; a digest at most once) whose digest is not in the index."""
        return groups.repartition(self.buckets, "digest").join(self.rows().hint("merge"), "digest", "left_anti")

    def add(self, digests: DataFrame, batch: str) -> None:
        """Append the texts of a batch that the index does not hold; of equal ones in the batch the largest doc_id is kept.

        digests: doc_id, digest. Adding a batch again, after a failure or a success, changes nothing.
        """
        groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        fresh = self.new_texts(groups).select("digest", "keep_id", F.lit(batch).alias("batch"))
        # One sorted file per bucket and batch: the rows lie in the index's buckets already.
        fresh.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)

    def compacted(self) -> "DigestIndex":
        """A copy with one file per bucket, for an index that has taken many batches."""
        out = DigestIndex(self.spark, buckets=self.buckets)
        self.rows().repartition(self.buckets, "digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option(
            "path", out.path).saveAsTable(out.name)
        return out

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def resolve(index: DigestIndex, digests: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size of every row, once its batch is in the index. digests: doc_id, digest, stored.

    A text that very many rows share is cut into slices by doc_id: rows are counted per (digest, slice), the slices of a digest carry
    its answer back, and rows meet it on both columns. The number of slices follows the number of rows.
    """
    slices = max(64, -(-digests.count() // ROWS_PER_SLICE))
    rows = digests.select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"))
    parts = rows.groupBy("digest", "slice").agg(F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("digest").agg(F.sum("n").alias("group_size"), F.collect_list("slice").alias("slices"))  # `slices` entries at most
    known = groups.repartition(index.buckets, "digest").join(index.rows().select("digest", "keep_id").hint("merge"), "digest")
    answers = known.select("digest", "keep_id", "group_size", F.explode("slices").alias("slice"))
    return rows.join(answers, ["digest", "slice"]).select("doc_id", "digest", "keep_id", "group_size")


def dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; of equal texts the row with the largest doc_id stays.

    The rows go into the index in two batches, the larger half of the ids first, so a text that both halves hold is found by the anti-join
    of the second. With an index that holds texts of earlier documents, these stay instead (keep_id is then theirs, kept is false), and
    group_size counts rows of docs only. Null texts are empty. A null doc_id is smaller than any other; a text with null ids only has a null
    keep_id and keeps its rows, as equal rows of the largest doc_id are all kept. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    digests = settle(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(F.col("text")).alias("digest")), "digests")
    index = index or DigestIndex(spark)
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else low + (high - low) // 2
    name = uuid.uuid4().hex
    index.add(digests.filter(F.col("doc_id") > middle), f"{name}-upper")
    index.add(digests.filter(F.col("doc_id").isNull() | (F.col("doc_id") <= middle)), f"{name}-lower")
    return resolve(index, digests).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                                          F.lower(F.hex("digest")).alias("text_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


OP13_SQL = """WITH T AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
  SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM T"""
