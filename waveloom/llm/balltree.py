"""Exact top-k inner products: ball trees per shard, searched by branch and bound with a shared k-th score."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import settle, table

SCALE = 1024
LEAF = 32             # vectors of a leaf, at most
SHARD_LEAF = 512      # the same in shards, whose leaves meet whole blocks of queries
SHARD_ROWS = 1 << 15  # vectors of a shard, about
GROUP_SHARDS = 8      # shards that a task searches
BLOCK_QUERIES = 2048  # queries that search a tree together, about
TASK_BLOCKS = 32      # blocks of queries that a task searches for
LOWEST = np.iinfo(np.int64).min
NOBODY = np.iinfo(np.int64).max
TREE = "dim int, shard int, ids binary, vecs binary, centers binary, radii binary, nodes binary"
BLOCK = "dim int, block int, ids binary, vecs binary, floors binary"


def quantized(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v array<long>, dim: floor(scale * x) of the rows without null or non-finite values; equal rows count once."""
    x = F.col(vector)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")))
    return rows.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(x).alias("dim")).dropDuplicates(["vec_id", "v"])


def build_tree(vecs: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, centers, radii and nodes (lo, hi, left, right; left is -1 at leaves). Children follow their parent.

    A node is halved along the line through two far points, so depth and leaf sizes depend on the row count only.
    """
    x = vecs.astype(np.float64)
    order = np.arange(len(x))
    centers, radii, nodes = [], [], []
    waiting = [(0, len(x), -1)]
    while waiting:
        lo, hi, parent = waiting.pop()
        rows = x[order[lo:hi]]
        center = rows.mean(0)
        far = ((rows - center) ** 2).sum(1)
        me = len(nodes)
        centers.append(center)
        radii.append(np.sqrt(far.max()) * (1 + 1e-9) + 1e-6)
        nodes.append([lo, hi, -1, -1])
        if parent >= 0:
            nodes[parent][2 if nodes[parent][2] < 0 else 3] = me
        if hi - lo > leaf and far.max() > 0:
            a = rows[far.argmax()]
            b = rows[((rows - a) ** 2).sum(1).argmax()]
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(rows @ (b - a), mid)]
            waiting += [(lo + mid, hi, me), (lo, lo + mid, me)]
    return order, np.array(centers), np.array(radii), np.array(nodes, np.int64)


class Search:
    """Best k candidates of a block of queries over any number of trees; the k-th score so far prunes the next leaf."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int, floor: np.ndarray):
        self.q_ids, self.q, self.k, self.floor = ids, vecs, k, floor
        self.norm = np.sqrt((vecs.astype(np.float64) ** 2).sum(1))
        self.score = np.full((len(ids), k), LOWEST)
        self.found = np.full((len(ids), k), NOBODY)
        self.visited = 0

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def run(self, ids: np.ndarray, vecs: np.ndarray, centers: np.ndarray, radii: np.ndarray, nodes: np.ndarray) -> None:
        # No sum on the way to a score is larger than the two lengths: below 2^24 and 2^53 floats are exact.
        top = float(self.norm.max(initial=0)) * (float(np.sqrt((centers[0] ** 2).sum())) + float(radii[0])) * (1 + 1e-6)
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
        slack = self.norm[:, None] * np.sqrt((centers ** 2).sum(1))[None, :] * 1e-9 + 1e-6
        bound = self.q.astype(np.float64) @ centers.T + self.norm[:, None] * radii[None, :] + slack
        if top >= 1 << 63:
            bound[:] = np.inf  # scores wrap
        alive = np.ones(bound.shape, bool)
        for n in np.flatnonzero(nodes[:, 2] >= 0):  # parents come before their children
            alive[:, nodes[n, 2:]] &= (alive[:, n] & (bound[:, n] >= self.kth()))[:, None]
        leaves = np.flatnonzero(nodes[:, 2] < 0)
        tops = np.where(alive[:, leaves], bound[:, leaves], -np.inf)
        q = self.q.astype(kind)
        # A query without a k-th score begins with its best leaf.
        new = np.flatnonzero((self.kth() == LOWEST) & (tops.max(1) > -np.inf))
        best = tops[new].argmax(1)
        for leaf in np.unique(best):
            lo, hi = nodes[leaves[leaf], :2]
            self._meet(q, new[best == leaf], ids[lo:hi], vecs[lo:hi])
        tops[new, best] = -np.inf
        for leaf in np.argsort(-tops.max(0, initial=-np.inf), kind="stable"):
            rows = np.flatnonzero((tops[:, leaf] > -np.inf) & (tops[:, leaf] >= self.kth()))
            if len(rows):
                lo, hi = nodes[leaves[leaf], :2]
                self._meet(q, rows, ids[lo:hi], vecs[lo:hi])

    def _meet(self, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> None:
        """The queries of these rows meet the vectors of a leaf in one product; few scores reach the k-th one."""
        self.visited += len(rows)
        s = (q if len(rows) == len(q) else q[rows]) @ vecs.astype(q.dtype).T
        kth = self.kth()[rows]
        limit = kth.astype(q.dtype)
        live = np.flatnonzero(s.max(1) >= limit)
        s = s[live]
        r, c = np.nonzero(s >= limit[live, None])
        score, who, at = s[r, c].astype(np.int64), ids[c], rows[live[r]]
        last = np.where(self.score[at, -1] == score, self.found[at, -1], NOBODY)
        keep = (who != self.q_ids[at]) & (score >= kth[live[r]]) & (who < last)
        score, who, at = score[keep], who[keep], at[keep]
        if not len(at):
            return
        some, place = np.unique(at, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(some)), self.k), place])
        score, who = np.concatenate([self.score[some].ravel(), score]), np.concatenate([self.found[some].ravel(), who])
        order = np.lexsort((who, ~score, place))  # ~: falling, without the overflow of a minus
        place = place[order]
        pick = order[np.arange(len(order)) - np.searchsorted(place, place) < self.k]
        self.score[some], self.found[some] = score[pick].reshape(-1, self.k), who[pick].reshape(-1, self.k)


def _numbers(b: pa.Scalar, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b.as_buffer(), kind)


def _packed(vecs: np.ndarray) -> bytes:
    """Two bytes a component where they do, else eight."""
    small = not len(vecs) or max(-int(vecs.min()), int(vecs.max())) < 1 << 15
    return vecs.astype(np.int16 if small else np.int64).tobytes()


def _unpacked(b: pa.Scalar, n: int, dim: int) -> np.ndarray:
    blob = b.as_buffer()
    return np.frombuffer(blob, np.int16 if len(blob) == 2 * n * dim else np.int64).reshape(n, dim)


def _rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group of one length."""
    return t["vec_id"].to_numpy(), t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), t["dim"][0].as_py())


def trees(vectors: DataFrame, n_shards: int) -> DataFrame:
    """A stored ball tree of every shard of vectors(vec_id, v, dim)."""
    def build(t: pa.Table) -> pa.Table:
        ids, vecs = _rows(t)
        order, centers, radii, nodes = build_tree(vecs, SHARD_LEAF)
        return pa.table({"dim": t["dim"][:1], "shard": t["shard"][:1], "ids": [ids[order].tobytes()], "vecs": [_packed(vecs[order])],
                         "centers": [centers.tobytes()], "radii": [radii.tobytes()], "nodes": [nodes.tobytes()]})

    dealt = vectors.where("dim > 0").withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_shards)).cast("int"))
    return settle(dealt.groupBy("dim", "shard").applyInArrow(build, TREE), "ball-trees")


def _blocks(queries: DataFrame, n_blocks: int) -> DataFrame:
    """Blocks of queries(vec_id, v, dim, floor), stored."""
    def pack(t: pa.Table) -> pa.Table:
        ids, vecs = _rows(t)
        return pa.table({"dim": t["dim"][:1], "block": t["block"][:1], "ids": [ids.tobytes()], "vecs": [_packed(vecs)], "floors": [t["floor"].to_numpy().tobytes()]})

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int"))
    return settle(dealt.groupBy("dim", "block").applyInArrow(pack, BLOCK), "query-blocks")


def _search(blocks: DataFrame, n_blocks: int, index: DataFrame, groups: range, k: int) -> DataFrame:
    """Best k of each query in each of these groups of trees. A task has one group and up to TASK_BLOCKS blocks."""
    def find(key: tuple, shards: pa.Table, asked: pa.Table) -> pa.Table:
        dim, out = key[0].as_py(), []
        for b in range(len(asked) if len(shards) else 0):
            ids = _numbers(asked["ids"][b])
            s = Search(ids, _unpacked(asked["vecs"][b], len(ids), dim), k, _numbers(asked["floors"][b]))
            for r in range(len(shards)):
                own = _numbers(shards["ids"][r])
                s.run(own, _unpacked(shards["vecs"][r], len(own), dim), _numbers(shards["centers"][r], np.float64).reshape(-1, dim),
                      _numbers(shards["radii"][r], np.float64), _numbers(shards["nodes"][r]).reshape(-1, 4))
            hit = s.found != NOBODY
            out.append((np.repeat(ids, hit.sum(1)), s.found[hit], s.score[hit]))
        cols = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols)))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = F.floor(F.col("block") / TASK_BLOCKS).cast("int")
    tree_group = F.floor(F.col("shard") / GROUP_SHARDS).cast("int")
    left = index.withColumn("group", tree_group).where(F.col("group").between(groups[0], groups[-1])).withColumn("part", every(-(-n_blocks // TASK_BLOCKS)))
    right = blocks.withColumn("part", part).withColumn("group", F.explode(F.sequence(F.lit(groups[0]), F.lit(groups[-1]))))
    keys = ["dim", "group", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.select("query_id", "vec_id", "score").repartition("query_id").distinct()
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, every: int = 100, k: int = 10, scale: int = SCALE, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query over all other rows.

    Queries are the rows whose id is divisible by ``every``; components become floor(scale * x), scores are whole numbers
    (64 bits, as Spark's long). Ties go to the smaller id. A vector with a null or non-finite component, a null vector and a null
    id take no part; vectors of other lengths are no candidates, and empty vectors score 0 with nothing (no rows). Equal rows
    count once; rows that share the query's id are not its candidates. No queries or no candidates: no rows.

    Every shard has its own tree; a task searches GROUP_SHARDS of them for up to TASK_BLOCKS blocks of queries. The k-th scores over
    about the square root of the groups then prune the others, so few candidates leave those.
    """
    vectors = settle(quantized(rows, id_col, vector, scale), "vectors")
    n_shards = max(1, -(-vectors.count() // shard_rows))
    index = trees(vectors, n_shards)
    asked = settle(vectors.where((F.col("vec_id") % every == 0) & (F.col("dim") > 0)), "queries")
    n_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    n_groups = -(-n_shards // GROUP_SHARDS)
    n_first = math.isqrt(n_groups - 1) + 1

    def found(floor: Column, queries: DataFrame, groups: range) -> DataFrame:
        return _search(_blocks(queries.select("vec_id", "v", "dim", floor.alias("floor")), n_blocks), n_blocks, index, groups, k)

    lowest = F.lit(LOWEST).cast("long")
    first = settle(_best(found(lowest, asked, range(n_first)), k), "top-first")
    if n_first == n_groups:
        return first
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    rest = found(F.coalesce("kth", lowest), asked.join(kth, "vec_id", "left"), range(n_first, n_groups))
    return _best(first.select("query_id", "vec_id", "score").unionByName(rest), k)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


OP10_SQL = """WITH V AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    S AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(len(q.v)), lambda i: q.v[i + 1] * c.v[i + 1]))::BIGINT AS score
      FROM V q JOIN V c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
    R AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM S)
    SELECT query_id, rank, vec_id, score FROM R WHERE rank <= 10"""
