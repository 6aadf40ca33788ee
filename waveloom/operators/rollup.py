"""Multi-level rollup of bucket states and the answers it gives.

Level 0 has buckets of `base` samples; each level merges FACTOR buckets of the one below, until a
channel has at most TOP_BUCKETS buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded, settle
from .envelope import bucket_of, finish_envelope
from .stats import STATE, close_state, merge_once, merge_states, raw_states, state_columns, with_pivot

BASE = 256
# Size ratio between levels, and the bucket count at which a level is the top.
FACTOR = 8
TOP_BUCKETS = 64


def word_names(base: int) -> list[str]:
    """Columns of a bucket's mask of received positions, 64 in each."""
    return [f"w{k}" for k in range(-(-base // 64))]


def seen_words(base: int) -> list[Column]:
    """Aggregates of the mask: bit p of word k is set if position 64 k + p of the bucket was received."""
    pos = f"(sample_idx - bucket * {base})"
    return [F.expr(f"bit_or(CASE WHEN {pos} div 64 = {k} THEN shiftleft(1L, int({pos} % 64)) ELSE 0L END) AS {w}") for k, w in enumerate(word_names(base))]


def level0(samples: DataFrame, channels: DataFrame, base: int = BASE, n_channels: int | None = None, positions: bool = False) -> DataFrame:
    """Bucket states of `base` samples: one pass with partial aggregation, no raw shuffle.

    positions: add the masks of received positions, for samples that may repeat (`covered_prefix` then counts each once).
    """
    rows = with_pivot(samples.select("channel_id", "sample_idx", "v"), channels, n_channels).withColumn("bucket", bucket_of("sample_idx", base))
    if not positions:
        return raw_states(rows, ["channel_id", "bucket"])
    return close_state(rows.groupBy("channel_id", "bucket").agg(*state_columns(), *seen_words(base)), ["channel_id", "bucket", *word_names(base)])


def next_level(states: DataFrame) -> DataFrame:
    """Merge each run of FACTOR buckets (at most FACTOR rows per group)."""
    grouped = states.withColumn("_child", F.col("bucket")).withColumn("bucket", bucket_of("bucket", FACTOR))
    return merge_once(grouped, ["channel_id", "bucket"], "_child")


def level_limits(base: int) -> list[int]:
    """Lengths beyond which a channel has one level more, up to the largest BIGINT."""
    out = [TOP_BUCKETS * base]
    while out[-1] * FACTOR < 1 << 63:
        out.append(out[-1] * FACTOR)
    return out


def n_levels(length: int, base: int) -> int:
    """Number of levels of a channel of `length` samples."""
    return 1 + sum(limit < length for limit in level_limits(base))


def level_count(length: str, base: int) -> str:
    """`n_levels` as a SQL expression: one more for each level that has more than TOP_BUCKETS buckets."""
    limits = ", ".join(f"{n}L" for n in level_limits(base))
    return f"size(filter(array({limits}), x -> x < {length})) + 1"


def build_rollup(spark: SparkSession, samples: DataFrame, channels: DataFrame, path: str, base: int = BASE,
                 n_channels: int | None = None) -> DataFrame:
    """Write the rollup to `path`, partitioned by level; each level reads the one below from disk."""
    if base < 2 or base & (base - 1):
        raise ValueError("base must be a power of two")
    sizes = channels.select("channel_id", F.expr(level_count("length", base)).alias("levels"))
    most = n_levels(channels.agg(F.max("length")).first()[0] or 0, base)
    states = level0(samples, channels, base, n_channels)
    for level in range(most):
        if level:
            below = spark.read.parquet(f"{path}/part={level - 1}").drop("level")
            tall = bounded(sizes.filter(F.col("levels") > level).select("channel_id"), n_channels)
            states = next_level(below.join(tall, "channel_id", "left_semi"))
        # The level is a stored column, so its filters reach the row groups together with the bucket range.
        states.withColumn("level", F.lit(level)).sortWithinPartitions("channel_id", "bucket").write.parquet(f"{path}/part={level}")
    return spark.read.parquet(path).drop("part")


def rollup_base(channels: DataFrame, budget: int, base: int = BASE) -> int:
    """Smallest doubled base whose level-0 buckets fit the budget, from the total length."""
    total = channels.agg(F.sum("length")).first()[0] or 0
    while base < total / max(1, budget):
        base *= 2
    return base


def bucket_mean(buckets: DataFrame) -> DataFrame:
    """Mean of each stored bucket (NULL for a bucket without values)."""
    return buckets.withColumn("mean", F.when(F.col("n") > 0, F.col("pv") + F.col("dl")))


def _within(level: int, spans: list[tuple[int, int]]) -> str:
    """Pushable filter: this level and a bucket inside one of the (inclusive) spans."""
    return f"(level = {level} AND ({' OR '.join(f'bucket BETWEEN {lo} AND {hi}' for lo, hi in spans)}))"


def range_states(samples: DataFrame, buckets: DataFrame, channels: DataFrame, ranges: DataFrame, base: int = BASE,
                 n_channels: int | None = None, levels: int | None = None) -> DataFrame:
    """State of [i0, i1) per key from the fewest stored buckets plus the raw edges.

    channels: channel_id, length, pivot. ranges: channel_id, i0, i1 and optionally `key` columns
    that tell several ranges of a channel apart. A range is covered as follows: going up from
    level 0, each level contributes the buckets that the level above cannot cover whole; the walk
    stops at the top level or where the level above has no whole bucket inside. At most
    2 * (FACTOR - 1) buckets per level, TOP_BUCKETS at the top and 2 * (base - 1) samples per range.
    levels: how many levels the rollup has, if fewer than the lengths call for (then more buckets of its last one are read).

    The rollup must hold every bucket of the ranges; `complete_range_states` answers from one that does not.

    One row of bounds over all ranges becomes literal filters of the two scans.
    """
    keys = [c for c in ranges.columns if c not in ("i0", "i1")]
    r = ranges.join(bounded(channels.select("channel_id", "length", "pivot"), n_channels), "channel_id").selectExpr(
        *keys, "length", "pivot", "greatest(i0, 0L) AS i0", "least(i1, length) AS i1").filter("i1 > i0")
    r = r.selectExpr("*", f"ceil(i0 / {base}D) AS j0", f"floor(i1 / {base}D) AS j1",
                     f"{level_count('length', base)} AS levels" if levels is None else f"least({levels}, {level_count('length', base)}) AS levels")
    row = r.selectExpr("min(i0)", "max(i0)", "min(i1)", "max(i1)", "max(levels)").first()
    lo0, lo1, hi0, hi1, most = (0 if x is None else x for x in row)
    r = bounded(r, n_channels)

    # Raw edges: the samples before the first and after the last whole bucket (all of a short range).
    near = f"sample_idx BETWEEN {lo0} AND {lo1 + 2 * base} OR sample_idx BETWEEN {hi0 - 2 * base} AND {hi1}"
    edge = samples.select("channel_id", "sample_idx", "v").filter(near).join(r, "channel_id").filter(
        f"sample_idx >= i0 AND sample_idx < i1 AND (j1 <= j0 OR sample_idx < j0 * {base} OR sample_idx >= j1 * {base})")
    edge = edge.selectExpr("*", f"CASE WHEN j1 > j0 AND sample_idx >= j1 * {base} THEN j1 * {base} ELSE i0 END AS start")
    edges = raw_states(edge, [*keys, "start"])

    # Stored buckets: near each end of the range, at most TOP_BUCKETS away on every level.
    spans = []
    for k in range(most):
        unit = base * FACTOR ** k
        spans.append(_within(k, [(lo0 // unit, -(-lo1 // unit) + TOP_BUCKETS), (hi0 // unit - TOP_BUCKETS, hi1 // unit)] if levels is None or k + 1 < levels else [(lo0 // unit, hi1 // unit)]))
    stored = buckets.filter(" OR ".join(spans) or "false").withColumnRenamed("bucket", "_at")
    got = stored.join(r.drop("pivot"), "channel_id").selectExpr("*", f"power({FACTOR}D, level) AS _unit")
    got = got.filter("_at >= ceil(j0 / _unit) AND _at < floor(j1 / _unit)").filter(f"""NOT (level + 1 < levels
        AND ceil(j0 / (_unit * {FACTOR})) < floor(j1 / (_unit * {FACTOR}))
        AND _at >= ceil(j0 / (_unit * {FACTOR})) * {FACTOR} AND _at < floor(j1 / (_unit * {FACTOR})) * {FACTOR})""")
    got = got.withColumn("start", F.expr(f"bigint(_at * _unit * {base})"))

    # At most 2 + levels * 2 * (FACTOR - 1) + TOP_BUCKETS states per range.
    cols = [*keys, "start", *STATE]
    # With fewer levels there may be any number of states: they are merged as a tree.
    both = edges.select(cols).unionByName(got.select(cols))
    return merge_once(both, keys, "start") if levels is None else merge_states(both, keys, "start", int(hi1) + 1)


def complete_range_states(samples: DataFrame, buckets: DataFrame, channels: DataFrame, ranges: DataFrame, base: int = BASE,
                          n_channels: int | None = None, levels: int | None = None) -> DataFrame:
    """`range_states` while the rollup is being built: buckets as far as the complete leading ones go, raw samples beyond.

    Adds ``from_rollup``: whether the whole range came from the rollup and its edges.
    """
    reach = covered_prefix(buckets, channels, base, n_channels).select("channel_id", "covered")
    r = ranges.join(bounded(reach, n_channels), "channel_id")
    keys = [c for c in ranges.columns if c not in ("i0", "i1")]
    head = r.select(*keys, "i0", F.least("i1", "covered").alias("i1"))
    rest = r.select(*keys, F.greatest("i0", "covered").alias("i0"), "i1").filter("i1 > i0")
    rest = settle(rest.join(bounded(channels.select("channel_id", "pivot", "length"), n_channels), "channel_id").withColumn("i1", F.least("i1", "length")))
    low = rest.agg(F.min("i0")).first()[0]
    tail = samples.select("channel_id", "sample_idx", "v").filter(F.col("sample_idx") >= low if low is not None else F.lit(False))
    tail = tail.join(bounded(rest, n_channels), "channel_id").filter("sample_idx >= i0 AND sample_idx < i1")
    states = range_states(samples, buckets, channels, head, base, n_channels, levels).withColumn("_part", F.lit(0))
    states = states.unionByName(raw_states(tail, keys).withColumn("_part", F.lit(1)).select(states.columns))
    known = r.select(*keys, (F.col("i1") <= F.col("covered")).alias("from_rollup"))
    return merge_once(states, keys, "_part").join(known, keys)


def rollup_envelope(samples: DataFrame, buckets: DataFrame, channels: DataFrame, ranges: DataFrame,
                    base: int = BASE, n_channels: int | None = None) -> DataFrame:
    """Envelope of [i0, i1) with buckets of b >= base samples, from the largest level that fits b.

    Whole buckets are regrouped stored buckets; the clipped first and last bucket are exact range
    states. Same columns as `envelope`.
    """
    sizes = ", ".join(f"{base * FACTOR ** k}L" for k in range(1, len(level_limits(base)) + 1) if base * FACTOR ** k < 1 << 63)
    plan = ranges.select("channel_id", "i0", "i1", "b").join(
        bounded(channels.select("channel_id", "length"), n_channels), "channel_id")
    plan = plan.selectExpr("channel_id", "i0", "i1", "b", "least(i1, ceil(i0 / double(b)) * b) AS a",
                           f"least({level_count('length', base)} - 1, size(filter(array({sizes}), x -> x <= b))) AS level")
    plan = plan.selectExpr("*", "greatest(a, floor(i1 / double(b)) * b) AS z", f"bigint(power({FACTOR}D, level) * {base}) AS size")

    bounds = plan.groupBy("level").agg(F.min("a"), F.max("z")).collect()  # one row per level in use
    used = [_within(k, [(lo // (base * FACTOR ** k), hi // (base * FACTOR ** k))]) for k, lo, hi in bounds]
    body = buckets.filter(" OR ".join(used) or "false").join(bounded(plan, n_channels), ["channel_id", "level"])
    body = body.filter("bucket * size >= a AND bucket * size < z").selectExpr(
        "channel_id", "(bucket * size) DIV b AS bucket", "i0", "i1", "b", "n", "total", "mn", "mx")
    body = body.groupBy("channel_id", "bucket", "i0", "i1", "b").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))

    ends = plan.selectExpr("channel_id", "b", "i0 AS w0", "i1 AS w1", """inline(array(
        named_struct('i0', i0, 'i1', a), named_struct('i0', z, 'i1', i1)))""").filter("i1 > i0")
    ends = ends.withColumn("bucket", F.expr("i0 DIV b"))
    states = range_states(samples, buckets, channels, ends, base, None if n_channels is None else 2 * n_channels)
    clipped = states.selectExpr("channel_id", "bucket", "w0 AS i0", "w1 AS i1", "b", "n", "total", "mn", "mx")
    return finish_envelope(clipped.unionByName(body.select(clipped.columns)))


def covered_prefix(buckets: DataFrame, channels: DataFrame, base: int = BASE, n_channels: int | None = None) -> DataFrame:
    """Samples of each channel covered by complete leading level-0 buckets.

    The final partial bucket counts only when it closes the declared length. Where the buckets carry masks (`level0` with positions,
    the streamed levels) different positions are counted, else samples, which must then be different. No window over the
    buckets of a channel: the prefix ends at the smallest bucket that is not complete although it
    is the first one or follows a complete one.
    """
    level = buckets.filter("level = 0") if "level" in buckets.columns else buckets
    sizes = bounded(channels.select("channel_id", "length"), n_channels)
    masked = set(word_names(base)) <= set(level.columns)
    there = F.expr(" + ".join(f"bit_count({w})" for w in word_names(base)) if masked else "total").alias("there")
    done = level.select("channel_id", "bucket", there).join(sizes, "channel_id").filter(f"there >= least({base}, length - bucket * {base})")
    marks = done.selectExpr("channel_id", """inline(array(
        named_struct('b', bucket, 'done', 1, 'next', 0), named_struct('b', bucket + 1, 'done', 0, 'next', 1)))""")
    marks = marks.unionByName(channels.selectExpr("channel_id", "0L AS b", "0 AS done", "1 AS next"))
    ends = marks.groupBy("channel_id", "b").agg(F.max("done").alias("done"), F.max("next").alias("next")).filter("done = 0 AND next = 1")
    gap = ends.groupBy("channel_id").agg(F.min("b").alias("gap"))
    return channels.select("channel_id", "length").join(bounded(gap, n_channels), "channel_id").selectExpr(
        "channel_id", "length", f"least(gap * {base}, length) AS covered", f"least(gap * {base}, length) = length AS complete")


def overrun(samples: DataFrame, channels: DataFrame, n_channels: int | None = None) -> DataFrame:
    """Samples beyond the declared length: the quarantine of an append."""
    declared = channels.select("channel_id", "length")
    return samples.join(bounded(declared, n_channels), "channel_id").filter(
        (F.col("sample_idx") >= F.col("length")) | (F.col("sample_idx") < 0)).drop("length")


__all__ = ["BASE", "FACTOR", "TOP_BUCKETS", "build_rollup", "bucket_mean", "complete_range_states", "covered_prefix", "level0",
           "merge_states", "n_levels", "next_level", "overrun", "range_states", "rollup_base", "rollup_envelope"]
