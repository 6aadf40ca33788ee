"""Jaccard join on word shingles: candidates share prefix tokens under several token orders, then the sets are compared."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import components, forget, settle, table, whole_row
from .textbytes import Words, blocks, grams, mixed, spaced_words, text_bytes

CHUNK = 1 << 20
CELL_BITS, SLICE_BITS = 22, 8
N_ORDERS = 2
FEW = 8      # texts of a token that are compared as pairs
BLOCK = 128  # texts of a block of a crowded token
PASS_BYTES, PASS_SHARE = 1 << 28, 4  # sets shipped to blocks in one pass: so many bytes, or this part of the bytes of all sets
KNOWN = 1 << 17  # labels whose links a task remembers
LEAD = 4     # crowded tokens of a text in whose buckets it meets the others that have one of them
FILTER_BITS = 24
SKETCH_BITS = (64, 2048)  # least and most bits of a set's parity sketch
PERCENT = 90        # of op9
SHINGLE = 3
STAGE_PERCENT = 80  # of the pipeline's stage
STAGE_SHINGLE = 5


def _sets(text: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, off = text_bytes(text)
    for i, j in blocks(off, CHUNK):
        g, row = grams(Words(data[off[i]:off[j]], off[i:j + 1] - off[i], spaced_words()), size)
        order = np.argsort(row, kind="stable")
        g, ends = g[order], np.searchsorted(row[order], np.arange(j - i + 1))
        for k in range(j - i):
            s = np.sort(g[ends[k]:ends[k + 1]])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def cell_counts(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Distinct shingles of all texts counted in 2^22 hash cells: a table of fixed size, whatever the data."""
    cells, per = 1 << CELL_BITS, 1 << (CELL_BITS - SLICE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(cells, np.int64), 0
        for b in batches:
            waiting, held = [], 0
            for s in _sets(b.column(0), size):
                waiting.append((s >> np.uint64(64 - CELL_BITS)).astype(np.int32))
                held += len(s)
                if held > 1 << 20:
                    total += np.bincount(np.concatenate(waiting), minlength=cells)
                    seen, waiting, held = seen + held, [], 0
            if held:
                total += np.bincount(np.concatenate(waiting), minlength=cells)
                seen += held
        if seen:
            part = int(total.sum()) % 64
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(cells // per), pa.int32()), pa.array([part] * (cells // per), pa.int32()),
                 pa.array([zlib.compress(total[k * per:(k + 1) * per].tobytes(), 1) for k in range(cells // per)])], ["slice", "part", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(per, np.int64)
        for blob in t["n"]:
            total += np.frombuffer(zlib.decompress(blob.as_py()), np.int64)
        return pa.table({"slice": t["slice"][:1], "part": pa.array([0], pa.int32()), "n": pa.array([zlib.compress(total.tobytes(), 1)])})

    schema = "slice int, part int, n binary"
    sums = docs.select(text).mapInArrow(count, schema).groupBy("slice", "part").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema)
    out = np.zeros(cells, np.int64)
    for r in sums.collect():  # 256 rows of 16,384 counts
        out[r.slice * per:(r.slice + 1) * per] = np.frombuffer(zlib.decompress(bytes(r.n)), np.int64)
    return out


def commonness(counts: np.ndarray) -> np.ndarray:
    """Class of each cell by its count, 64 classes up to the mean (shingles of the emptiest cells are surely rare and come first)."""
    return np.minimum(counts * 64 // max(1, int(counts.mean())), 255).astype(np.uint8)


def _order(s: np.ndarray, classes: np.ndarray, k: int, length: int) -> np.ndarray:
    """Keys of the first ``length`` shingles in order k: the class, then 56 bits of the k-th scrambling.

    Two shingles with one key (about once in 10^17 pairs) make a false candidate at most; sets are compared by full hashes.
    """
    key = mixed(s + np.uint64((2 * k + 1) * 0x632BE59BD9B4E019 & ((1 << 64) - 1))) >> np.uint64(8)
    key |= classes[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
    return np.sort(key)[:length] if length < len(s) else np.sort(key)


def _sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles in each of some cells, a power of two near their number: what two sets share cancels out, so the
    sketches differ in at most as many bits as the sets differ in shingles. The halves of a sketch add up to the next smaller one."""
    least, most = SKETCH_BITS
    cells = min(max(least, 1 << max(0, (3 * len(s) // 4 - 1).bit_length())), most)
    return np.packbits(np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).tobytes()


def _differing(sketches: list[bytes]) -> np.ndarray:
    """Bits in which each two sketches differ, all folded to the size of the smallest."""
    least, rows = min(map(len, sketches)), []
    for x in sketches:
        v = np.frombuffer(x, np.uint8)
        while len(v) > least:
            v = v[: len(v) // 2] ^ v[len(v) // 2:]
        rows.append(v)
    words = np.stack(rows).view(np.uint64)
    return np.bitwise_count(words[:, None, :] ^ words[None, :, :]).sum(2, dtype=np.int64)


def prefixes(docs: DataFrame, classes: np.ndarray, percent: int, size: int, orders: int, text: str, id_col: str) -> DataFrame:
    """doc_id, n (shingles), node (digest of the set, null without shingles), bits (sketch), p0..: prefix tokens under each order."""
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, bits, found = [], [], [], [[] for _ in range(orders)]
            for s in _sets(b.column(1), size):
                n.append(len(s))
                node.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                bits.append(_sketch(s))
                length = len(s) - -(-percent * len(s) // 100) + 1
                for k in range(orders):
                    found[k].append(_order(s, classes, k, length).view(np.int64))
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in f])]).astype(np.int32),
                                              np.concatenate([*f, np.zeros(0, np.int64)])) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()), *lists],
                                             ["doc_id", "n", "node", "bits", *[f"p{k}" for k in range(orders)]])

    schema = f"doc_id {id_type}, n int, node long, bits binary, " + ", ".join(f"p{k} array<long>" for k in range(orders))
    return docs.select(id_col, text).mapInArrow(make, schema)


def _marks(ids: DataFrame) -> np.ndarray:
    """Bits of the hashed doc_ids: a filter of fixed size (2 MB) that lets some unwanted ids pass."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    words = ids.select(F.shiftright(h, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int")).alias("bit"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    out[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _text_sets(docs: DataFrame, wanted: DataFrame, size: int, text: str, id_col: str) -> DataFrame:
    """node, s (the sorted shingle hashes as bytes) of the wanted(doc_id, node); only sets are shuffled, no texts."""
    bits = _marks(wanted)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy()
            rows = np.flatnonzero((bits[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1))
            sets = [s.tobytes() for s in _sets(b.column(1).take(pa.array(rows)), size)]
            node = [int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], ["node", "s"])

    hashed = docs.select(F.pmod(F.xxhash64(id_col), F.lit(1 << FILTER_BITS)).alias("h"), F.col(text).alias("t"))
    return hashed.mapInArrow(make, "node long, s binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                ok[k] = 100 * shared >= percent * (len(both) - shared)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    return full.mapInArrow(check, "a long, b long")


def _root(top: dict[int, int], v: int) -> int:
    while top.setdefault(v, v) != v:
        top[v] = top[top[v]]
        v = top[v]
    return v


def _linked_in_block(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int, top: dict[int, int]) -> list[tuple[int, int]]:
    """Links of a bounded block between labels that ``top`` does not join yet, as a spanning forest: all pairs are compared by one
    matrix product. ``top`` learns them."""
    sizes = np.array([len(s) for s in sets])
    tokens, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.cumsum(times > 1) - 1
    use = times[column] > 1
    row, column = row[use], shared[column[use]]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(sets), min(4096, width - lo)), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        inter += m @ m.T
    union = sizes[:, None] + sizes[None, :] - inter
    x, y = np.nonzero(np.triu(100 * inter >= percent * union, 1) & (labels[:, None] != labels[None, :]))
    out = []
    for i, j in zip(x, y):
        u, v = _root(top, int(labels[i])), _root(top, int(labels[j]))
        if u != v:
            top[max(u, v)] = min(u, v)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _packed(crowd: DataFrame, columns: list[str], percent: int, wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of bounded blocks (x, y, k, a, b) in which the texts of each token meet: every block with every one of its token and
    class k, in both orders; a and b are their numbers, y is null for a block with itself.

    crowd(t, node, n, ...): linked texts have near sizes, so each goes into its size class and the next one. Long columns come
    from wide(node, ...) only after the narrow rows are dealt, for tokens and classes with two labels at least. An outer join is
    split on its left side only, so one task meets all pairs of a block x, one after the other. Also returns the stored blocks, which
    can go when the pairs are done with.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)) + 1e-9).cast("int")
    near = crowd.withColumn("near", size_class).withColumn("near", F.explode(F.array(F.col("near"), F.col("near") + 1)))
    sizes = near.groupBy("t", "near").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.count(F.lit(1)).alias("c"),
                                          F.min("label").alias("lo"), F.max("label").alias("hi")).where("c > 1 and lo <> hi")
    dealt = near.join(sizes.drop("c", "lo", "hi"), ["t", "near"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(wide, "node")
    packed = settle(dealt.groupBy("t", "near", "block", "blocks").agg(F.collect_list(F.struct(*columns)).alias("x")), "ngram-blocks")
    keys = ["t", "near"]
    right = packed.select(*keys, F.col("block").alias("b"), F.col("x").alias("y"))
    pairs = packed.select(*keys, F.col("block").alias("a"), "x").join(right, keys, "left")
    return pairs.select("x", F.expr("if(a = b, null, y)").alias("y"), F.struct(*keys).alias("k"), "a", "b"), packed


def linked_in_blocks(crowd: DataFrame, sets: DataFrame, percent: int, most_bytes: int | None = None) -> DataFrame:
    """Links (a, b) among the texts of each crowded token. crowd(t, node, n, label), rows distinct.

    What is shipped and held is bounded by two blocks of sets, and only links that connect different labels come out, those that a
    task has already joined only once (beyond KNOWN labels it forgets them). Of tokens with the same texts one is enough. A set is shipped for each of its tokens: beyond ``most_bytes`` the tokens go in several passes,
    so that the disk holds the copies of one pass.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        for b in batches:
            out = []
            for x, y in zip(b.column(0), b.column(1)):
                rows = [v for side in (x, y) if side.is_valid for v in side.values.to_pylist()]
                if len(top) > KNOWN:
                    top.clear()
                if len({_root(top, v["label"]) for v in rows}) > 1:
                    out += _linked_in_block(np.array([v["node"] for v in rows]), np.array([v["label"] for v in rows]),
                                            [np.frombuffer(v["s"], np.uint64) for v in rows], percent, top)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int64())], ["a", "b"])

    same = crowd.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    crowd = settle(crowd.join(same.groupBy("c", "x", "y").agg(F.min("t").alias("t")), "t", "left_semi"), "ngram-crowd")
    shipped = 16 * (crowd.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0)  # two size classes, 8 bytes a shingle
    passes = 1 if most_bytes is None else max(1, -(-shipped // most_bytes))
    parts = []
    for k in range(passes):
        mine = crowd.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == k) if passes > 1 else crowd
        pairs, packed = _packed(mine, ["node", "label", "s"], percent, sets)
        parts.append(settle(pairs.where("a <= b").select("x", "y").mapInArrow(compare, "a long, b long").distinct(), "ngram-links"))
        forget(packed)
    links = parts[0] if passes == 1 else settle(reduce(DataFrame.union, parts).distinct(), "ngram-links")
    forget(crowd, *(parts if passes > 1 else []))
    return links


def _selected(crowd: DataFrame, wide: DataFrame, percent: int, fits) -> DataFrame:
    """The rows of crowd(t, node, n, label), with the columns of wide, that fit another label's text of their token.

    ``fits`` gives a matrix over rows. What comes out are rows, never pairs: a task meets all pairs of a block x in turn and sends
    only rows of x, each once, so a row comes out once for each of its tokens and two classes, however many blocks it fits. Only
    the rows of x that are still open are compared.
    """
    names, kinds = ["t", "node", "n", "label"], [pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for batch in batches:
            out = []
            for x, y, k, a in zip(*(batch.column(i) for i in range(4))):
                if (this := (*k.as_py().values(), a.as_py())) != block:
                    block, rows = this, x.values.to_pylist()
                if not rows:
                    continue
                both = rows + (y.values.to_pylist() if y.is_valid else [])
                label = np.array([v["label"] for v in both])
                if (label == label[0]).all():
                    continue
                ok = (fits(both) & (label[:, None] != label[None, :]))[: len(rows)].any(1)
                out += [rows[i] for i in np.flatnonzero(ok)]
                rows = [rows[i] for i in np.flatnonzero(~ok)]
            yield pa.RecordBatch.from_arrays([pa.array([v[c] for v in out], kind) for c, kind in zip(names, kinds)], names)

    pairs, packed = _packed(crowd, [*names, *[c for c in wide.columns if c != "node"]], percent, wide)
    found = settle(pairs.select("x", "y", "k", "a").mapInArrow(select, "t long, node long, n int, label long").distinct(), "ngram-near")
    forget(packed)
    return found


def _shares(lists: list[np.ndarray]) -> np.ndarray:
    """Whether each two of some lists of distinct keys have one in common."""
    _, column, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    use = times[column] > 1
    row, column = row[use], (np.cumsum(times > 1) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(lists), len(lists)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(lists), min(4096, width - lo)), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        common += m @ m.T
    return common > 0


def near_by_sketch(crowd: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Rows of crowd(t, node, n, label), with wide(node, lead, bits), whose sets may be near enough to another one's.

    Two texts count in the buckets of the leading tokens that they share, or in any common bucket if they share none. Linked
    sets of n and m shingles differ in n + m - 2 * least overlap of them at most, and their sketches in no more bits.
    """
    def fits(rows: list[dict]) -> np.ndarray:
        n = np.array([v["n"] for v in rows])
        lead = [np.array(v["lead"], np.int64) for v in rows]
        leads = np.array([v["t"] in v["lead"] for v in rows])
        meet = (leads[:, None] & leads[None, :]) | ~_shares(lead)
        both = n[:, None] + n[None, :]
        return meet & (_differing([v["bits"] for v in rows]) <= both - 2 * -(-percent * both // (100 + percent)))

    return _selected(crowd, wide, percent, fits)


def near_by_orders(crowd: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Rows of crowd(t, node, n, label), with wide(node, p1, ...), that share a prefix token with another one under every order."""
    orders = [c for c in wide.columns if c != "node"]

    def fits(rows: list[dict]) -> np.ndarray:
        ok = np.ones((len(rows), len(rows)), bool)
        for c in orders:
            ok &= _shares([np.array(v[c], np.int64) for v in rows])
        return ok

    return _selected(crowd, wide, percent, fits)


def groups(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, orders: int = N_ORDERS, text: str = "text",
           id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A text's set: distinct ``size``-word shingles of its words (A-Z lower-cased, split at blanks); with fewer words, the whole
    sequence as one. Two texts link when 100 * intersection >= percent * union. component_id is the smallest doc_id that links
    reach. Equal sets are one node. Null, empty and blank texts have no shingles and link with nothing (component_id = doc_id).
    Rows with a null doc_id count as nodes, and a component of only such rows has a null component_id. Every row gives one row.

    Tokens are ordered ``orders`` times: shingles of cells with small counts over all texts first, by another scrambling within
    a class in each order. Linked sets share a token of their prefixes under every order. Tokens of the first order are joined. First each
    token's texts are compared with one of them only, so a large group of near copies costs one pair per member. Then the texts
    of a token that are still in different components are compared: as pairs up to FEW texts; beyond, in bounded blocks, from
    which rows that still have a candidate go on, never pairs: first by a sketch of the sets, then by the prefixes under the other
    orders, then by the whole sets, whose links come out as a spanning forest. Working tables are deleted when they are used up.
    """
    classes = commonness(cell_counts(docs, text, size))
    pre = settle(prefixes(docs, classes, percent, size, orders, text, id_col), "ngram-prefixes")
    cols = [f"p{k}" for k in range(1, orders)]
    whole = pre.where("node is not null")
    nodes = settle(whole.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "ngram-nodes")

    # One shuffle of (node, t) serves the counts and the join; n comes back for the few rows that are left.
    tokens = whole.groupBy("node").agg(F.first("p0").alias("p0")).select("node", F.explode("p0").alias("t")).repartition("t")
    shared = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("pivot")).where("c > 1")
    held = settle(tokens.join(shared.select("t", "pivot"), "t").join(nodes.select("node", "n"), "node"), "ngram-tokens")
    ends = held.select("node").distinct()
    info = settle(whole.select("node", "bits", "p0", *cols).join(ends, "node", "left_semi").dropDuplicates(["node"]).join(nodes, "node"), "ngram-info")
    unsigned = F.element_at("p0", -1).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    facts = settle(info.select("node", "n", F.size("p0").alias("p"), unsigned.alias("last")).join(
        held.groupBy("node").agg(F.count(F.lit(1)).alias("h")), "node"), "ngram-facts")

    def likely(pairs: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
        """Length, position and other orders' filters of pairs(a, b, c), c being the common tokens in uncrowded buckets, if known.

        Of two prefixes, the one that ends first is known whole: each of its keys that is not common is no member of the other
        set, so the common keys (c and the crowded ones, at most the shared ones of either) must leave the least overlap possible.
        """
        known = facts if crowded is None else facts.join(crowded, "node", "left")
        known = known.withColumn("k", F.coalesce("k", F.lit(0)) if crowded is not None else F.lit(0))
        a = known.select(*[F.col(c).alias(f"{c}_a") for c in known.columns])
        b = known.select(*[F.col(c).alias(f"{c}_b") for c in known.columns])
        j = pairs.join(a, pairs.a == a.node_a).join(b, pairs.b == b.node_b)
        j = j.where((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent))
        common = F.least("h_a", "h_b", F.col("c") + F.least("k_a", "k_b"))
        least = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
        fits = F.when(F.col("last_a") <= F.col("last_b"), F.col("p_a") - common <= F.col("n_a") - least).otherwise(
            F.col("p_b") - common <= F.col("n_b") - least)
        j = settle(j.where(fits).select("a", "b"), "ngram-pairs")
        filtered = j
        for c in cols:
            filtered = filtered.join(info.select(F.col("node").alias("a"), F.col(c).alias("x")), "a").join(info.select(F.col("node").alias("b"), F.col(c).alias("y")), "b")
            filtered = filtered.where(F.arrays_overlap("x", "y")).select("a", "b")
        filtered = settle(filtered, "ngram-pairs")
        forget(j)
        return filtered

    def sets_of(wanted: DataFrame) -> DataFrame:
        ids = settle(nodes.join(wanted, "node", "left_semi").select("doc_id", "node"), "ngram-wanted")
        sets = settle(_text_sets(docs, ids, size, text, id_col), "ngram-sets")
        forget(ids)
        return sets

    def ends_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))

    star = likely(held.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct().withColumn("c", F.lit(None).cast("long")))
    sets = sets_of(ends_of(star).distinct())
    links = settle(verified(star, sets, percent), "ngram-links")
    forget(star)
    labels = components(links, "ngram-labels")

    marked = held.drop("pivot").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_tokens = marked.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    rest = settle(marked.join(mixed_tokens.select("t", "c"), "t").select("t", "c", "node", "n", "label"), "ngram-open")
    few = rest.where(F.col("c") <= FEW)
    other = few.select("t", F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("label_b"))
    near = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    pairs = few.join(other, "t").where(near & F.expr("node < b and label <> label_b")).select(F.col("node").alias("a"), "b")
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))

    crowd = settle(rest.where(F.col("c") > FEW).select("t", "node", "n", "label"), "ngram-crowd")
    order = F.sort_array(F.collect_list(F.struct(F.xxhash64("t").alias("h"), "t")))
    lead = crowd.groupBy("node").agg(F.slice(order, 1, LEAD)["t"].alias("lead"), F.count(F.lit(1)).alias("k"))
    crowded = settle(lead.join(info.select("node", "bits"), "node"), "ngram-crowded")
    by_sketch = near_by_sketch(crowd, crowded.select("node", "lead", "bits"), percent)
    near_rows = near_by_orders(by_sketch, info.select("node", *cols), percent) if cols else by_sketch
    pairs = likely(pairs, crowded.select("node", "k"))
    new_sets = sets_of(ends_of(pairs).union(near_rows.select("node")).distinct().join(sets.select("node"), "node", "left_anti"))
    both_sets = sets.unionByName(new_sets)
    all_bytes = 8 * (nodes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0)
    inside = linked_in_blocks(near_rows, both_sets, percent, max(PASS_BYTES, all_bytes // PASS_SHARE))
    more = settle(links.union(verified(pairs, both_sets, percent)).union(inside), "ngram-links")
    labels = components(more, "ngram-labels")
    forget(held, info, facts, rest, crowd, crowded, by_sketch, pairs, sets, new_sets, links, inside, more)
    if cols:
        forget(near_rows)

    best = nodes.join(labels, "node").groupBy("label").agg(F.min("doc_id").alias("least"))
    own = nodes.select("node", F.col("doc_id").alias("first_id")).join(labels.join(best, "label"), "node", "left").select(
        "node", F.coalesce("least", "first_id").alias("component_id"))
    return pre.select("doc_id", "n", "node").join(own, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the group's smallest doc_id; of rows that repeat it with the same text, one.

    Texts link at STAGE_PERCENT on STAGE_SHINGLE-word shingles. Rows of one doc_id with different texts are documents of their own, told
    apart by the SHA-256 of their texts (the smaller digest goes first); only if there are such rows does the join carry both. Rows without
    doc_id stay.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    short = F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("long")  # 60 bits
    some = docs.where("doc_id is not null")
    spread = some.groupBy("doc_id").agg(F.min(short).alias("a"), F.max(short).alias("b")).where("a <> b")
    if spread.isEmpty():
        keep = groups(docs, STAGE_PERCENT, STAGE_SHINGLE).where("doc_id = component_id").select("doc_id").distinct()
        ranked = some.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        return ranked.unionByName(docs.where("doc_id is null"))
    key = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), F.unhex(digest).alias("digest")))
    found = groups(docs.select(key.alias("doc_id"), "text"), STAGE_PERCENT, STAGE_SHINGLE).where("doc_id = component_id")
    keep = found.select("doc_id.id", "doc_id.digest").distinct()
    rows = some.select(whole_row(docs).alias("row"), F.col("doc_id").alias("id"), F.unhex(digest).alias("digest"))
    kept = rows.join(keep, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
    return kept.unionByName(docs.where("doc_id is null"))
