"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import settle, table, whole_row, WORD_BREAK

BLOCK_WORDS = 16      # words of a block
MAX_EPOCHS = 3        # a source is used at most so many times
SEED = 11
SHARD_ROWS = 20_000   # documents of a source in one shard, about


def sainte_lague(df: DataFrame, within: list[str], weight: str, seats: str, order: list[str], out: str) -> DataFrame:
    """Whole seats for the rows of each group, highest quotients weight / (2k - 1) first, ties by ``order``.

    No seat is dealt one by one: seats won below a divisor that is surely too strict are counted in closed form, and only the
    quotients between it and one that is surely too lax (at most three a row) are ranked. Rows without weight get none.
    """
    g = Window.partitionBy(*within)
    total, n = F.sum(weight).over(g), F.count(F.lit(1)).over(g)
    w = df.withColumn("_sum", total).withColumn("_rows", n)

    def at(shift: Column) -> Column:
        scale = F.greatest(F.col(seats) + shift, F.lit(0)) / F.col("_sum")
        return F.when((F.col("_sum") > 0) & (F.col(weight) > 0), F.floor(scale * F.col(weight) + 0.5)).otherwise(0).cast("long")

    w = w.withColumn("_low", at(-F.col("_rows"))).withColumn("_high", at(F.col("_rows")))
    w = w.withColumn("_left", F.col(seats) - F.sum("_low").over(g))
    rows = w.withColumn("_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    quotient = F.col(weight) / (2 * F.col("_k") - 1)
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(quotient.desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order]))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))
    keep = [c for c in df.columns if c not in within + order]
    return (rows.withColumn("_rank", rank).groupBy(*within, *order)
            .agg(*[F.first(c).alias(c) for c in keep], F.first("_low").alias("_low"), won.alias("_won"))
            .select(*df.columns, (F.col("_low") + F.col("_won")).alias(out)))


def source_targets(words: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """words(source, words) -> with weight 1, 2, 3 by code-point order (null last) and target.

    All sizes are shared by weight; a target stops at ``max_epochs`` times its source and the excess is shared again by weight,
    until none is above. That end state is one level: target = min(limit, level * weight), found by the ratio limit / weight.
    """
    one = F.lit(1).alias("_g")
    w = words.select("source", "words", one)
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(F.col("source").asc_nulls_last()))
    w = w.withColumn("weight", (rank - 1) % 3 + 1).withColumn("limit", F.col("words") * max_epochs)
    w = w.withColumn("ratio", F.col("limit") / F.col("weight"))
    g = Window.partitionBy("_g")
    before = g.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("words").over(g) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    level = left / (F.sum("weight").over(g) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", level)
    free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(g)["level"]
    return w.select("source", "words", "weight", F.coalesce(F.least(F.col("limit").cast("double"), free * F.col("weight")),
                                                            F.col("limit").cast("double")).alias("target"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, carry: bool = False) -> DataFrame:
    """Words that the mix takes from each document.

    docs(doc_id, text, source, ...). Every source's documents are laid out in seeded order in shards, cut into blocks of
    ``block_words`` words. Sainte-Lague gives each source its number of blocks (weights: the targets), and again each shard of
    a source its whole quota (weights: the blocks of the shard). A shard takes all its blocks quota // blocks times and a seeded
    choice of quota % blocks more.

    Returns doc_id, source, size, source_size, target, taken; with ``carry`` also ``row``, a struct of all columns of docs.
    Null or blank texts have size 0 and are never taken. A null source is a source of its own, last in order. Rows with the
    same doc_id are documents of their own. Null doc_ids are allowed. Empty input gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_BREAK)), F.lit(0)).cast("long")
    n_shards = max(1, -(-docs.count() // SHARD_ROWS))
    h = F.xxhash64("doc_id", F.lit(seed))
    base = docs.select("doc_id", "source", size.alias("size"), h.alias("h"), F.pmod(h, F.lit(n_shards)).alias("shard"),
                       *([whole_row(docs).alias("row")] if carry else []))
    if not carry:
        base = settle(base, "mix")
    shards = settle(base.groupBy("source", "shard").agg(F.sum("size").alias("words")), "mix-shards")
    targets = source_targets(shards.groupBy("source").agg(F.sum("words").alias("words")), max_epochs)
    targets = settle(targets.withColumn("blocks", F.ceil(F.col("words") / block_words)), "mix-targets")

    whole = Window.partitionBy("_g")
    asked = targets.withColumn("_g", F.lit(1)).withColumn("seats", F.round(F.sum("target").over(whole) / block_words).cast("long"))
    quota = sainte_lague(asked, ["_g"], "target", "seats", ["source"], "won")
    quota = quota.select("source", "words", "target", F.least("won", F.col("blocks") * max_epochs).alias("quota"))

    by_shard = shards.select("source", "shard", F.ceil(F.col("words") / block_words).alias("blocks"))
    both = by_shard.join(quota, by_shard.source.eqNullSafe(quota.source)).select(
        by_shard.source, "shard", "blocks", "quota", F.col("words").alias("source_size"), "target")
    both = sainte_lague(both, ["source"], "blocks", "quota", ["shard"], "shard_quota")
    plan = settle(both.select(F.col("source").alias("s"), F.col("shard").alias("j"), "source_size", "target", "blocks",
                              F.least("shard_quota", F.col("blocks") * max_epochs).alias("q"),
                              F.xxhash64("source", "shard", F.lit(seed + 1)).alias("turn")), "mix-plan")

    order = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size")
    placed = base.withColumn("pos", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = placed.join(plan, placed.source.eqNullSafe(plan.s) & (placed.shard == plan.j))
    b, n = F.lit(block_words), F.col("blocks")

    def taken_of(i: Column) -> Column:
        # The blocks with place < rest get one turn more; the place is a permutation of the shard's blocks (a prime step).
        place = F.pmod(i * F.lit(2654435761) + F.pmod(F.col("turn"), n), n)
        times = F.floor(F.col("q") / n) + F.when(place < F.col("q") % n, 1).otherwise(0)
        span = F.least((i + 1) * b, F.col("pos") + F.col("size")) - F.greatest(i * b, F.col("pos"))
        return times * span

    blocks = F.sequence(F.floor(F.col("pos") / b), F.floor((F.col("pos") + F.col("size") - 1) / b))
    taken = F.when(F.col("size") > 0, F.aggregate(blocks, F.lit(0).cast("long"), lambda acc, i: acc + taken_of(i))).otherwise(0)
    return rows.select("doc_id", placed.source.alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"),
                       *(["row"] if carry else []))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix: each repeated taken / size times on average (0 to 3), rounded by a seeded draw."""
    m = mix(docs, carry=True)
    draw = F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED + 2)), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor(F.col("taken") / F.col("size") + draw).cast("int")
    return (m.where("size > 0").select("row", copies.alias("n")).where("n > 0")
            .select(F.explode(F.array_repeat("row", F.col("n"))).alias("row")).select("row.*"))
