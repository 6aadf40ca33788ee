"""How filters interact: for every order of five filters what each step removes, and the Shapley value of each filter.

Documents are counted by the set of filters they fail (32 sets). From these counts the removals of all 32 coalitions follow; a step of an
order is the difference of two coalitions, and the Shapley values are the least-squares fit of an additive removal to the coalitions,
weighted by the Shapley kernel and constrained to the removal of all filters together, solved in rationals.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
# Fixed values of the definition.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 100, 80, 10, "#$%&*|"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
OUT = "part string, filter_order string, step int, " + ", ".join(f"{m} bigint" for m in MEASURES)


def text_bits(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text (never null) fails. Each condition is one built-in expression."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words).cast("bigint")
    upper = (F.length(text) - F.length(F.translate(text, _UPPER, ""))).cast("bigint")
    marks = F.length(F.translate(text, SYMBOLS, "")) < F.length(text)
    fails = [n < MIN_WORDS, F.size(F.array_distinct(words)).cast("bigint") * 100 < n * MIN_DISTINCT_PERCENT,
             upper * 100 > F.length(text).cast("bigint") * MAX_UPPER_PERCENT, marks]
    return sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(fails)), F.lit(0))


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bit k: filter k), n, good, toxic: documents counted by the filters they fail, at most 32 rows a part.

    Texts are the same if their SHA-256 is. A text repeats (E) where a smaller doc_id has it: the rows join the smallest doc_id of each
    text on (digest, doc_id), so a text that very many documents share is dealt over tasks by doc_id.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text_bits(text).alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest"))
    marked = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(least, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
    again = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), F.lit(16)).otherwise(F.lit(0))
    return rows.select("part", (F.col("bits") + again).alias("fails"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).groupBy(
        "part", "fails").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def coalition_removals(counts: list[int]) -> list[int]:
    """Removed by each coalition of filters: all documents but those that fail none of its filters. counts: by the set failed."""
    return [sum(c for fails, c in enumerate(counts) if fails & members) for members in range(len(counts))]


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """Solution of a regular system by elimination in rationals."""
    rows = [[*r, b] for r, b in zip(matrix, right)]
    for k in range(len(rows)):
        at = next(i for i in range(k, len(rows)) if rows[i][k] != 0)
        rows[k], rows[at] = rows[at], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(len(rows)):
            if i != k and rows[i][k] != 0:
                f = rows[i][k]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[k])]
    return [r[-1] for r in rows]


def kernel_shapley(values: list[int]) -> list[Fraction]:
    """Shapley values of a game (values by coalition as a bit set, 0 for none) by constrained least squares.

    Minimise the squared errors of additive values over all coalitions but none and all, weighted by (m - 1) / (C(m, s) s (m - s)) for s of m
    members, where the values add up to that of all: normal equations with one multiplier for the constraint.
    """
    m = len(values).bit_length() - 1
    normal = [[Fraction(0)] * (m + 1) for _ in range(m + 1)]
    right = [Fraction(0)] * (m + 1)
    for members in range(1, len(values) - 1):
        inside = [k for k in range(m) if members >> k & 1]
        weight = Fraction(m - 1, comb(m, len(inside)) * len(inside) * (m - len(inside)))
        for i in inside:
            right[i] += weight * values[members]
            for j in inside:
                normal[i][j] += weight
    for i in range(m):
        normal[i][m] = normal[m][i] = Fraction(1)
    right[m] = Fraction(values[-1])
    return solve(normal, right)[:m]


def _steps(part: str, n: list[int], good: list[int], toxic: list[int]):
    """The 600 rows of a part."""
    total, every = sum(n), factorial(len(FILTERS))
    gone, good_gone, toxic_gone = coalition_removals(n), coalition_removals(good), coalition_removals(toxic)
    worth = [int(x * every) for x in kernel_shapley(gone)]  # the sum over all orders is a whole number
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            removed = gone[after] - gone[before]
            yield (part, "".join(FILTERS[i] for i in order), step, total - gone[after], removed, gone[1 << k] - removed, n[1 << k],
                   good_gone[after] - good_gone[before], toxic_gone[after] - toxic_gone[before], worth[k])
            before = after


def _audit_parts(batches):
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [(m, pa.int64()) for m in MEASURES])
    for batch in batches:
        for r in batch.to_pylist():
            tables = [[0] * SETS for _ in range(3)]
            for x in r["sets"]:
                for t, key in zip(tables, ("n", "good", "toxic")):
                    t[x["fails"]] = x[key]
            cols = zip(*_steps(r["part"], *tables))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every step of all 120 filter orders for each part (language; null: empty): see OUT.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; other columns are ignored. Null texts are empty. Rows with a null doc_id repeat
    nothing and have no label; rows of one doc_id and one text do not repeat each other. A document is good (toxic) if any of its labels
    says 1. Empty tables give no rows. The tabulated sets of a part (32 at most) are one row.
    """
    sets = failed_sets(docs, labels).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    return sets.mapInArrow(_audit_parts, OUT)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


OP12_SQL = r"""WITH T AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
  M AS (SELECT t, min(doc_id) AS least FROM T GROUP BY t),
  W AS (SELECT T.*, M.least, regexp_extract_all(T.t, '[^\x20\x09-\x0D]+') AS w FROM T JOIN M ON M.t = T.t),
  Q AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
  F AS (SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(W.doc_id > least, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM W LEFT JOIN Q ON Q.doc_id = W.doc_id),
  S AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM F GROUP BY part, fails),
  L AS (SELECT unnest(range(1, 6)) AS i),
  O AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM L a, L b, L c, L d, L e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
  X AS (SELECT part, o, step, n, good, toxic, fails, fails[o[step]] AS own, len(list_filter(o[:step - 1], lambda k: fails[k])) > 0 AS gone,
      len(list_filter(fails, lambda x: x)) = 1 AS sole FROM S, O, (SELECT unnest(range(1, 6)) AS step)),
  Y AS (SELECT part, o, step, o[step] AS letter, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT own), 0)::BIGINT AS kept,
      coalesce(sum(n) FILTER (WHERE NOT gone AND own), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE gone AND own), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (WHERE own AND sole), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE NOT gone AND own), 0)::BIGINT AS good_lost,
      coalesce(sum(toxic) FILTER (WHERE NOT gone AND own), 0)::BIGINT AS toxic_lost FROM X GROUP BY part, o, step)
  SELECT part, list_aggregate(list_transform(o, lambda k: substr('ABCDE', k::INT, 1)), 'string_agg', '') AS filter_order, step::INT AS step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM Y"""
