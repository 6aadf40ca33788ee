"""Sharding by balanced label propagation: linked documents move to their neighbours' shards under capacity quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import ranked, settle, table, whole_row

N_SHARDS = 24
ROUNDS = 6
SUB_ROWS = 500_000  # rows of a shard that are numbered in one task, about


def _spread(rows: int, n_shards: int) -> int:
    return max(4, -(-rows // (n_shards * SUB_ROWS)))


def _laid(cells: DataFrame, keys: list[str], weight: str, order: list[str], spread: int) -> DataFrame:
    """``start``: the sum of ``weight`` over the earlier cells of the same keys, large communities first, without one task per key.

    Cells of one community follow each other: they are dealt by its size class and hash.
    """
    dealt = cells.withColumn("_c", -F.floor(F.log2("size")).cast("int")).withColumn("_s", F.pmod(F.xxhash64("com"), F.lit(spread)).cast("int"))
    sums = dealt.groupBy(*keys, "_c", "_s").agg(F.sum(weight).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_c", "_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_c", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys, "_c", "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_i", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    return rows.join(starts, [*keys, "_c", "_s"]).withColumn("start", F.col("_start") + F.col("_i")).drop("_c", "_s", "_start", "_i")


def propagate(linked: DataFrame, capacity: int, n_shards: int, rounds: int) -> tuple[DataFrame, int]:
    """linked(uid, group, tie) -> uid, ``shard``, ``turn``; and the number of rows without a shard.

    A community is a group of equal texts, or a part of one that is larger than a shard. All rows start at hashed shards. In each
    round a community wants the shard that holds most of its rows (ties by hash) among those with room for all of it. Rows that
    leave a shard give their room to those that come: only communities that have their shard for good count against its
    quota, and of those that want it, as many whole ones are let in as fit, large ones first. It ends when none is let in.
    Communities that fit nowhere have a null shard, and a turn in which the rows of each follow each other.
    """
    spread = _spread(linked.count(), n_shards) * n_shards
    full = max(1, capacity)
    # Fewer than n_shards groups (all rows, if these are fewer) are larger than a shard: the bound of this broadcast is the parameter.
    large = linked.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > full).select("group", F.lit(True).alias("large"))
    rows = settle(linked.join(F.broadcast(large), "group", "left"), "label-rows")
    parts = ranked(rows.where("large"), ["group"], ["uid"], spread, "part").withColumn("part", F.floor(F.col("part") / full))
    rows = rows.where("large is null").withColumn("part", F.lit(0).cast("long")).unionByName(parts)
    rows = rows.select("uid", F.xxhash64("group", "part").alias("com"), F.pmod(F.xxhash64("tie", F.lit(3)), F.lit(n_shards)).cast("int").alias("start_shard"))
    rows = settle(rows, "labels")
    cells = rows.groupBy("com", "start_shard").agg(F.count(F.lit(1)).alias("n"))
    cells = settle(cells.join(cells.groupBy("com").agg(F.sum("n").alias("size")), "com"), "label-cells")
    room, left, seated, waiting = [capacity] * n_shards, rows.count(), None, cells
    for _ in range(rounds):
        if not left:
            break
        has = lambda shard: F.element_at(F.array(*[F.lit(r).cast("long") for r in room]), shard + 1)  # noqa: E731, B023
        best = F.max(F.struct("n", F.xxhash64("com", "start_shard").alias("t"), "start_shard"))["start_shard"].alias("want")
        wants = waiting.where(has(F.col("start_shard")) >= F.col("size")).groupBy("com").agg(best, F.first("size").alias("size"))
        laid = _laid(wants, ["want"], "size", ["com"], spread)
        let_in = settle(laid.where(F.col("start") + F.col("size") <= has(F.col("want"))).select("com", "want", "size"), "label-seats")
        got = {r.want: r.n for r in let_in.groupBy("want").agg(F.sum("size").alias("n")).collect()}  # n_shards rows
        if not got:
            break
        room, left = [r - got.get(k, 0) for k, r in enumerate(room)], left - sum(got.values())
        seats = let_in.select("com", "want")
        seated = seats if seated is None else seated.unionByName(seats)
        waiting = settle(waiting.join(seats, "com", "left_anti"), "label-cells")
    kept = cells.select("com", "start_shard")
    kept = kept.withColumn("want", F.lit(None).cast("int")) if seated is None else kept.join(seated, "com", "left")
    turns = _laid(waiting, [], "n", ["com", "start_shard"], spread).select("com", "start_shard", F.col("start").alias("turn"))
    placed = rows.join(kept.join(turns, ["com", "start_shard"], "left"), ["com", "start_shard"])
    open_rows = placed.where("want is null").withColumn(
        "turn", F.col("turn") + F.row_number().over(Window.partitionBy("com", "start_shard").orderBy("uid")) - 1)
    done = placed.where("want is not null").unionByName(open_rows)
    return done.select("uid", F.col("want").alias("shard"), "turn"), left


def assign(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int = ROUNDS, text: str = "text", carry: bool = False) -> DataFrame:
    """Shard and slot of each row of docs(doc_id, text, ...), shard sizes at most one row apart.

    Rows with equal texts are linked (null texts with nothing). Linked rows get their shard from label propagation within the
    capacities; then other rows fill up the shards, so that shard k has one row more than the smallest only if k < rows %
    n_shards: first communities that fitted nowhere, one after the other from the emptiest shard on, then rows without links.
    Slots are gapless from 0 in each shard.

    Returns doc_id, size, text_crc32, shard, slot; with ``carry`` also ``row``, a struct of all columns. Repeated rows are rows of
    their own (they are linked, their texts are equal); null doc_ids are allowed; empty input gives an empty result.
    """
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    base = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                       F.when(F.col(text).isNotNull(), F.md5(raw)).alias("group"), F.monotonically_increasing_id().alias("uid"),
                       F.xxhash64("doc_id", text).alias("tie"), *([whole_row(docs).alias("row")] if carry else []))
    stored = settle(base, "shard-rows")
    base = stored.drop("row") if carry else stored
    groups = base.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    groups = settle(groups, "shard-groups")
    total = base.count()
    spread = _spread(total, n_shards)
    capacity = total // n_shards
    # The row number is stored with the rows, so decisions can be joined back to one row even where rows repeat.
    links = base.select("uid", "group", "tie").join(groups, "group", "left_semi")
    labels, waiting = propagate(links, capacity, n_shards, rounds)
    labels = settle(labels, "shard-labels")
    seated = ranked(labels.where("shard is not null").drop("turn"), ["shard"], ["uid"], spread, "slot").withColumn("turn", F.lit(None).cast("long"))
    labels = settle(seated.unionByName(labels.where("shard is null").withColumn("slot", F.lit(None).cast("long"))).select(
        "uid", "shard", "slot", "turn"), "shard-linked")
    placed = base.join(labels, "uid", "left")
    fixed = placed.where("shard is not null")

    used = labels.where("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("used"))
    every = docs.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(used, "shard", "left")
    free = every.select("shard", F.coalesce("used", F.lit(0)).alias("used"),
                        (F.lit(capacity) + (F.col("shard") < total % n_shards).cast("int") - F.coalesce("used", F.lit(0))).alias("free"))
    upto = F.sum("free").over(Window.orderBy(F.desc("free"), "shard").rowsBetween(Window.unboundedPreceding, 0))
    free = free.select("shard", "used", (upto - F.col("free")).alias("lo"), upto.alias("hi"))
    # n_shards rows: the bound of this broadcast is the parameter.
    rest = placed.where("shard is null").drop("shard", "slot")
    single = ranked(rest.where("turn is null").drop("turn"), [], ["uid"], spread * n_shards, "turn").withColumn("turn", F.col("turn") + waiting)
    pool = rest.where("turn is not null").unionByName(single)
    filled = pool.join(F.broadcast(free), (F.col("turn") >= F.col("lo")) & (F.col("turn") < F.col("hi")))
    filled = filled.withColumn("slot", F.col("used") + F.col("turn") - F.col("lo"))
    out = ["doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")]
    if not carry:
        return fixed.select(*out).unionByName(filled.select(*out))
    decided = fixed.select("uid", *out).unionByName(filled.select("uid", *out))
    return stored.select("uid", "row").join(decided, "uid").drop("uid")  # whole rows move once


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assign(table(spark, sf_dir, "documents", "doc_id", "text"))
    return a.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot (placed under other names if the table has these already)."""
    a = assign(docs, carry=True)

    def free(name: str) -> str:
        while name in docs.columns:
            name = f"{name}_"
        return name
    return a.select("row.*", F.col("shard").alias(free("shard")), F.col("slot").alias(free("slot")))
