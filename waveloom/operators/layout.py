"""Physical layout of segmented files as DataFrames: runs, coverage, gaps, probes, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bounded, hash_parts, settle
from .envelope import bucket_of
from .scan import BLOCK, running

# ToC bits of a segment.
TOC_META, TOC_NEW_LIST, TOC_RAW = 1 << 1, 1 << 2, 1 << 3
TOC_INTERLEAVED, TOC_BIG_ENDIAN, TOC_DAQMX = 1 << 5, 1 << 6, 1 << 7


def run_compress(parts: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Merge consecutive segments of one layout at a constant distance into runs.

    parts: *keys, seg_no (dense), pos, layout, cnt. Result: *keys, run, seg_no, n_segs, cnt, pos, stride,
    layout, start (sum of the counts of earlier runs).

    The second segment of a run sets its stride, so a changed distance opens a run only when the
    segment before it did not. In a row of changed distances every second one opens a run: the
    parity of the distance to the last segment whose role is known decides.
    """
    ks = list(keys)
    blk = bucket_of("seg_no", BLOCK)
    # Each block also sees the two segments before it, so all comparisons stay inside one block.
    halo = F.when(F.col("seg_no") % BLOCK >= BLOCK - 2, F.array(blk, blk + 1)).otherwise(F.array(blk))
    w = Window.partitionBy(*ks, "_blk").orderBy("seg_no")
    d = parts.select(*ks, "seg_no", "pos", "layout", "cnt", F.explode(halo).alias("_blk"))
    d = hash_parts(d, parts.count(), *ks, "_blk")
    d = d.withColumn("_new", ~F.lag("layout").over(w).eqNullSafe(F.col("layout")))
    d = d.withColumn("_step", F.col("pos") - F.lag("pos").over(w))
    d = d.withColumn("_changed", ~F.col("_new") & ~F.col("_step").eqNullSafe(F.lag("_step").over(w)))
    d = settle(d.filter(blk == F.col("_blk")).drop("_blk", "_step"))
    # The last segment with a known role: 1 if it opened a run (new layout), 0 if it continued one.
    anchor = F.when(~F.col("_changed"), F.col("seg_no") * 2 + F.col("_new").cast("int"))
    d = running(d, ks, "seg_no", anchor, "max", "_anchor")
    away = F.col("seg_no") - F.shiftright("_anchor", 1)
    opens = F.when(F.col("_changed"), (away + F.col("_anchor").bitwiseAND(F.lit(1))) % 2 == 1).otherwise(F.col("_new"))
    d = settle(d.select(*ks, "seg_no", "pos", "layout", "cnt", opens.cast("int").alias("_open")))
    d = running(d, ks, "seg_no", F.col("_open"), "sum", "run")
    runs = d.groupBy(*ks, "run").agg(
        F.min("seg_no").alias("seg_no"), F.count(F.lit(1)).alias("n_segs"), F.sum("cnt").alias("cnt"),
        F.min("pos").alias("pos"), F.max("pos").alias("_last"), F.first("layout").alias("layout"))
    stride = F.when(F.col("n_segs") > 1, F.call_function("div", F.col("_last") - F.col("pos"), F.col("n_segs") - 1))
    runs = settle(runs.withColumn("stride", stride).drop("_last"))
    return running(runs, ks, "run", F.col("cnt"), "sum", "start", inclusive=False)


def coverage_check(parts: DataFrame, channels: DataFrame, n_channels: int | None = None) -> DataFrame:
    """Do the parts cover each channel exactly once? channel_id, length, covers.

    parts: channel_id, start, cnt. Every start adds one and every end removes one; the parts are
    an exact cover if all counts are positive and only position 0 (+1) and the length (-1) remain.
    """
    edges = parts.selectExpr("channel_id", "cnt <= 0 AS bad", """inline(array(
        named_struct('p', start, 'd', 1), named_struct('p', start + cnt, 'd', -1)))""")
    left = edges.groupBy("channel_id", "p").agg(F.sum("d").alias("d"), F.bool_or("bad").alias("bad")).filter("d <> 0 OR bad")
    rest = left.join(bounded(channels.select("channel_id", "length"), n_channels), "channel_id").groupBy("channel_id").agg(
        F.expr("count_if(d <> 0) = 2 AND count_if(p = 0 AND d = 1) = 1 AND count_if(p = length AND d = -1) = 1 AND NOT bool_or(bad)").alias("_exact"))
    out = channels.select("channel_id", "length").join(bounded(rest, n_channels), "channel_id", "left")
    return out.select("channel_id", "length", F.coalesce("_exact", F.col("length") == 0).alias("covers"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Compare two catalogs row by row on `digest`: per group whether all rows agree, and the counts."""
    a = left.select(*keys, F.col("digest").alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(*keys, F.col("digest").alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, keys, "full_outer")
    same = F.col("_in_a").eqNullSafe(F.col("_in_b")) & F.col("_a").eqNullSafe(F.col("_b"))
    return both.groupBy(group).agg(
        F.bool_and(same).alias("matches"), F.count(F.lit(1)).alias("n_rows"), F.count_if(~same).alias("n_diff"))


def reconcile_values(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Bit-exact comparison of v at every position of two sample tables: per channel the positions and the differences.

    A position that only one side has is a difference.
    """
    keys = ["channel_id", "sample_idx"]
    a = rows.select(*keys, F.col("v").alias("_a"), F.lit(True).alias("_in_a"))
    b = reference.select(*keys, F.col("v").alias("_b"), F.lit(True).alias("_in_b"))
    same = F.col("_in_a").eqNullSafe(F.col("_in_b")) & F.col("_a").eqNullSafe(F.col("_b"))
    return a.join(b, keys, "full_outer").groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~same).alias("n_diff"))


def mixed_layout(segments: DataFrame) -> DataFrame:
    """Per file: does any segment hold interleaved or DAQmx data?"""
    bits = F.col("toc").bitwiseAND(F.lit(TOC_INTERLEAVED | TOC_DAQMX))
    return segments.groupBy("file_id").agg(F.bool_or(bits != 0).alias("mixed"))


def gap_cuts(parts: DataFrame) -> DataFrame:
    """Channel offsets at segments (after the first) without values of the channel.

    parts: channel_id, seg_no, cnt for every segment of the file.
    """
    offs = running(parts, ["channel_id"], "seg_no", F.col("cnt"), "sum", "cut")
    return offs.filter((F.col("cnt") == 0) & (F.col("seg_no") > 0)).select("channel_id", "cut").distinct()


def file_snapshot(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size and modification time of the files; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(
        path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def source_drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """Sources (path, size, modified) that were changed, removed or added since a snapshot."""
    a = before.select("path", F.struct("size", "modified").alias("_a"))
    b = now.select("path", F.struct("size", "modified").alias("_b"))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("path", state.alias("state"))


def linear_scale(samples: DataFrame, channels: DataFrame, n_channels: int | None = None) -> DataFrame:
    """v * slope + intercept; the scale comes from the channel, else its group, else its file.

    channels: channel_id, scaled (already done), ch_/grp_/file_ slope and intercept.
    """
    slope = F.coalesce("ch_slope", "grp_slope", "file_slope")
    # The intercept belongs to the level that gave the slope.
    intercept = (F.when(F.col("ch_slope").isNotNull(), F.col("ch_intercept"))
                 .when(F.col("grp_slope").isNotNull(), F.col("grp_intercept"))
                 .when(F.col("file_slope").isNotNull(), F.col("file_intercept")))
    scales = channels.select(
        "channel_id", F.when(~F.col("scaled"), slope).alias("_slope"), F.when(~F.col("scaled"), intercept).alias("_icpt"))
    rows = samples.join(bounded(scales, n_channels), "channel_id")
    v = F.col("v").cast("double")
    return rows.withColumn("v", F.when(F.col("_slope").isNull(), v).otherwise(
        v * F.col("_slope") + F.coalesce("_icpt", F.lit(0.0)))).drop("_slope", "_icpt")


def explode_chunks(chunks: DataFrame) -> DataFrame:
    """Samples of file-order chunks: channel_id, sample_idx = offset + position, v."""
    return chunks.select("channel_id", "offset", F.posexplode("values").alias("_i", "v")).select(
        "channel_id", (F.col("offset") + F.col("_i")).alias("sample_idx"), "v")
