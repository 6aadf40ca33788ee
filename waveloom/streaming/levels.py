"""A multi-level rollup kept up to date by micro-batches, each sample counted once by its position.

A level-0 bucket carries the set of positions it has received as a bit mask beside its state. A batch adds only positions that are
new: repeats inside a batch, replayed samples and appends to a complete channel change nothing, and a bucket is complete when its mask is.

The table lies in slices of `slice_buckets` buckets of a level. A batch rewrites the slices it touches, and of the levels above only the
ancestors of touched buckets; each slice is one place in the files, so a read costs the same after one batch or a thousand. A version is a
list of (level, slice, batch that wrote it), written last: a batch that dies leaves the version before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import finite
from ..operators.envelope import bucket_of
from ..operators.rollup import BASE, FACTOR, covered_prefix, level_count, next_level, seen_words, word_names
from ..operators.stats import STATE, close_state, merge_once, state_columns
from ..session import bounded, settle

SLICE_SAMPLES = 1 << 20  # of a level-0 slice, unless a table is made with its own slice_buckets
_TYPES = "n bigint, total bigint, mn double, mx double, pv double, dl double, m2 double"
_VERSIONS = "level int, slice bigint, v bigint, version bigint"


class LevelTable:
    """The slices and versions of a maintained rollup. slice_buckets: a multiple of FACTOR, the same over the life of the table.

    By default a level-0 slice spans SLICE_SAMPLES positions whatever the base, so that small buckets do not make a file of every few
    thousand samples.
    """

    def __init__(self, spark: SparkSession, path: str, base: int = BASE, slice_buckets: int | None = None):
        if slice_buckets is None:
            slice_buckets = max(1, SLICE_SAMPLES // (base * FACTOR)) * FACTOR
        if slice_buckets % FACTOR:
            raise ValueError(f"slice_buckets must be a multiple of {FACTOR}")
        self.spark, self.path, self.base, self.slice_buckets = spark, path.rstrip("/"), base, slice_buckets

    def create(self) -> "LevelTable":
        """Start an empty table; one that is there is left as it is."""
        self.spark.createDataFrame([], _VERSIONS).write.mode("append").partitionBy("version").parquet(f"{self.path}/versions")
        return self

    def _log(self) -> DataFrame:
        return self.spark.read.schema(_VERSIONS).parquet(f"{self.path}/versions")

    def version(self) -> int:
        """The last whole version, -1 for an empty table."""
        last = self._log().agg(F.max("version")).first()[0]
        return -1 if last is None else last

    def slices(self, version: int | None = None) -> DataFrame:
        """level, slice, v of a version."""
        return self._log().filter(F.col("version") == (self.version() if version is None else version)).select("level", "slice", "v")

    def places(self, version: int | None = None) -> dict[int, dict[int, int]]:
        """The slices of a version on the driver: level -> slice -> v, one entry per slice."""
        out: dict[int, dict[int, int]] = {}
        for r in self.slices(version).collect():
            out.setdefault(r.level, {})[r.slice] = r.v
        return out

    def schema(self, level: int) -> str:
        marks = "".join(f", {w} bigint" for w in word_names(self.base)) if level == 0 else ""
        return f"channel_id string, bucket bigint, start bigint, {_TYPES}{marks}"

    def rows(self, level: int, slices: list[int] | None = None, version: int | None = None, places: dict | None = None) -> DataFrame:
        """States of a level, of the given slices only if there are any. places: of the version, where they are known."""
        found = (self.places(version) if places is None else places).get(level, {})
        paths = [f"{self.path}/data/v={found[s]}/level={level}/slice={s}" for s in (found if slices is None else slices) if s in found]
        if not paths:
            return self.spark.createDataFrame([], self.schema(level))
        return self.spark.read.schema(self.schema(level)).parquet(*paths)

    def write(self, states: DataFrame, level: int, batch: int) -> DataFrame:
        """Store whole slices of a level for a batch and read them back."""
        path = f"{self.path}/data/v={batch}/level={level}"
        names = [c.split(" ")[0] for c in self.schema(level).split(", ")]
        rows = states.select(*names, bucket_of("bucket", self.slice_buckets).alias("slice"))
        # A task gets slices of single channels: bounded, and the states are not computed a second time to sample their ranges.
        rows.repartition("slice", "channel_id").sortWithinPartitions("slice", "channel_id", "bucket").write.mode("overwrite").partitionBy("slice").parquet(path)
        return self.spark.read.schema(self.schema(level)).parquet(path)

    def commit(self, touched: list[tuple[int, int]], batch: int, places: dict | None = None) -> None:
        """Make the slices that a batch wrote part of a new version: one small file that appears as a whole. places: of the version before."""
        before = self.places() if places is None else places
        all_slices = {(level, s): v for level, held in before.items() for s, v in held.items()} | {place: batch for place in touched}
        new = self.spark.createDataFrame([(*place, v) for place, v in all_slices.items()], "level int, slice bigint, v bigint")
        new.withColumn("version", F.lit(batch).cast("bigint")).coalesce(1).write.mode("append").partitionBy("version").parquet(
            f"{self.path}/versions")

    def vacuum(self, keep: int = 2) -> int:
        """Delete the slices that none of the last `keep` versions names, and the older versions; returns how many slices went."""
        log = self._log()
        last = [r[0] for r in log.select("version").distinct().orderBy(F.desc("version")).limit(keep).collect()]
        used = log.filter(F.col("version").isin(last)).select("level", "slice", "v")
        gone = [f"data/v={r.v}/level={r.level}/slice={r.slice}" for r in log.select("level", "slice", "v").distinct().join(used, ["level", "slice", "v"], "left_anti").collect()]
        old = [f"versions/version={r[0]}" for r in log.select("version").distinct().collect() if r[0] not in last]
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in gone + old:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            p.getFileSystem(conf).delete(p, True)
        return len(gone)


def _numbers(df: DataFrame, column: Column) -> list[int]:
    """Slice numbers of what a batch touches: as many as slices, not as buckets."""
    return sorted(r[0] for r in df.select(column.alias("s")).distinct().collect())


def _new_states(rows: DataFrame, base: int) -> DataFrame:
    """States, masks and first places of the buckets of a batch; rows: channel_id, sample_idx, v, bucket, pivot."""
    start = F.coalesce(F.min(F.when(finite("v"), F.col("sample_idx"))), F.lit(1 << 62)).alias("start")
    words = word_names(base)
    agg = rows.groupBy("channel_id", "bucket").agg(start, *state_columns(), *seen_words(base))
    return close_state(agg, ["channel_id", "bucket", "start", *words])


def _unseen(states: DataFrame, rows: DataFrame, table: LevelTable, places: dict) -> DataFrame:
    """States of the positions of a batch that are new. states: `_new_states` of its rows, stored. places: of the version before.

    Where a bucket's count equals its mask and the mask is new, the state stands as it is: only the buckets that hold a repeat are made
    again from their samples. Of a position that a batch repeats, the smallest value counts.
    """
    words = word_names(table.base)
    slices = _numbers(states, bucket_of("bucket", table.slice_buckets))
    before = table.rows(0, slices, places=places).select("channel_id", "bucket", *[F.col(w).alias(f"old_{w}") for w in words])
    both = states.join(before, ["channel_id", "bucket"], "left")
    held = " + ".join(f"bit_count({w})" for w in words)
    again = f"total <> {held} OR " + " OR ".join(f"({w} & coalesce(old_{w}, 0L)) <> 0" for w in words)
    both = settle(both.withColumn("again", F.expr(again)), "batch-states")
    clean = both.filter("NOT again").select(states.columns)
    if both.filter("again").isEmpty():
        return clean
    odd = both.filter("again").select("channel_id", "bucket", *[f"old_{w}" for w in words])
    pos = f"(sample_idx - bucket * {table.base})"
    bit = " ".join(f"WHEN {k} THEN shiftright(coalesce(old_{w}, 0L), int({pos} % 64)) & 1L" for k, w in enumerate(words))
    new = rows.join(odd, ["channel_id", "bucket"]).filter(f"(CASE int({pos} div 64) {bit} END) = 0")
    once = new.groupBy("channel_id", "bucket", "sample_idx").agg(F.min("v").alias("v"), F.first("pivot").alias("pivot"))
    return clean.unionByName(_new_states(once, table.base))


def apply_batch(table: LevelTable, batch: DataFrame, number: int, declared: DataFrame) -> None:
    """Add the samples of a batch (channel_id, sample_idx, v) to the table as version `number`.

    declared: channel_id, length and optionally pivot. Samples of other channels, before 0 or beyond the length go to
    `<path>/overrun/v=<number>`. A number that is a version already is a replay and changes nothing.
    """
    spark, base = table.spark, table.base
    version = table.version()
    if version >= number:
        return
    places = table.places(version)
    n = declared.count()
    known = declared.select("channel_id", "length", *[c for c in ("pivot",) if c in declared.columns])
    marked = batch.select("channel_id", "sample_idx", F.col("v").cast("double").alias("v")).join(bounded(known, n), "channel_id", "left")
    marked = settle(marked, "batch")
    inside = F.coalesce((F.col("sample_idx") >= 0) & (F.col("sample_idx") < F.col("length")), F.lit(False))
    marked.filter(~inside).select("channel_id", "sample_idx", "v").write.mode("overwrite").parquet(f"{table.path}/overrun/v={number}")
    rows = marked.filter(inside).withColumn("bucket", bucket_of("sample_idx", base)).drop("length")
    if "pivot" not in rows.columns:
        ok = finite("v")
        first = rows.groupBy("channel_id").agg(F.min_by(F.when(ok, F.col("v")), F.when(ok, F.col("sample_idx"))).alias("pivot"))
        rows = rows.join(bounded(first, n), "channel_id")
    fresh = settle(_unseen(settle(_new_states(rows, base), "batch-states"), rows, table, places), "batch-states")
    touched: list[tuple[int, int]] = []

    slices = _numbers(fresh, bucket_of("bucket", table.slice_buckets))
    words = word_names(base)
    both = table.rows(0, slices, places=places).unionByName(fresh)
    masks = both.groupBy("channel_id", "bucket").agg(F.min("start").alias("start"), *[F.bit_or(w).alias(w) for w in words])
    below = table.write(merge_once(both, ["channel_id", "bucket"], "start").join(masks, ["channel_id", "bucket"]), 0, number) if slices else None
    touched += [(0, s) for s in slices]

    # What changes on the levels above, in one table and one list: the number of an ancestor is the bucket's without its last bits.
    bits = FACTOR.bit_length() - 1
    sizes = declared.select("channel_id", F.expr(level_count("length", base)).alias("levels")).filter("levels > 1")
    marks = fresh.select("channel_id", F.shiftright("bucket", bits).alias("bucket")).distinct().join(bounded(sizes, n), "channel_id")
    marks = settle(marks, "dirty")
    above = marks.select(F.explode(F.expr("sequence(1, levels - 1)")).alias("level"), "bucket").select(
        "level", bucket_of(F.expr(f"shiftright(bucket, {bits} * (level - 1))"), table.slice_buckets).alias("slice"))
    changed: dict[int, list[int]] = {}
    for r in above.distinct().orderBy("level", "slice").collect():  # a number per slice
        changed.setdefault(r.level, []).append(r.slice)
    for level, slices in changed.items():
        dirty = marks.filter(F.col("levels") > level).select("channel_id", F.shiftright("bucket", bits * (level - 1)).alias("bucket")).distinct()
        # The FACTOR children of a dirty bucket lie in one slice, which this batch has just written.
        children = below.join(dirty.withColumnRenamed("bucket", "_parent"), (below.channel_id == dirty.channel_id) & (bucket_of(below.bucket, FACTOR) == F.col("_parent")), "left_semi")
        made = next_level(children.select("channel_id", "bucket", *STATE)).withColumn("start", F.lit(None).cast("bigint"))
        rest = table.rows(level, slices, places=places).join(dirty, ["channel_id", "bucket"], "left_anti")
        below = table.write(rest.unionByName(made), level, number)
        touched += [(level, s) for s in slices]
    table.commit(touched, number, places)


def start_levels(samples: DataFrame, declared: DataFrame, table: LevelTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep `table` up to date with a stream of samples; a batch that is run again finds its version or writes it anew."""
    table.create()

    def write(batch: DataFrame, number: int) -> None:
        apply_batch(table, batch, number, declared)

    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_levels(table: LevelTable, version: int | None = None) -> DataFrame:
    """The rollup (channel_id, level, bucket, states) of the last or an earlier version, as `build_rollup` gives it."""
    version = table.version() if version is None else version
    places = table.places(version)
    parts = [table.rows(k, places=places).select("channel_id", F.lit(k).alias("level"), "bucket", *STATE) for k in sorted(places) or [0]]
    return reduce(DataFrame.unionByName, parts)


def level_coverage(table: LevelTable, declared: DataFrame) -> DataFrame:
    """Covered prefix and completeness of each channel, from positions: repeats do not stand in for missing samples."""
    return covered_prefix(table.rows(0), declared, table.base)
