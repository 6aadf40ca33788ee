"""Physical layout and reconciliation of tables of segments, chunks and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as lay
from ..operators import rows as rw
from ..sources.tables import table
from .base import L, S, event_store, lineitem_store, rnd, rnd_sql

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


@query("chunks_explode", """SELECT label::BIGINT AS channel_id, vec_id * len(embedding) + i - 1 AS sample_idx, embedding[i]::DOUBLE AS v
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) t""")
def chunks_explode(spark, sf_dir):
    """Embeddings as file-order chunks: channel = label, offset = vec_id * chunk length."""
    chunks = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("channel_id"), (F.col("vec_id") * F.size("embedding")).alias("offset"),
        F.col("embedding").alias("values"))
    return lay.explode_chunks(chunks).withColumn("v", F.col("v").cast("double"))


def _segments(spark, sf_dir):
    """Line items as segments: position, layout and value count of each."""
    return lineitem_store(spark, sf_dir).samples.select(
        F.col("channel_id").alias("file_id"), F.col("sample_idx").alias("seg_no"),
        (F.col("sample_idx") * 64 + F.when(F.col("k") % 4 == 0, F.col("l_linenumber").cast("bigint")).otherwise(F.lit(0))).alias("pos"),
        F.when(F.col("q") > 45, "b").otherwise("a").alias("layout"), F.col("q").cast("bigint").alias("cnt"))


@query("run_compress", f"""WITH {L}, D AS (SELECT channel_id AS file_id, sample_idx AS seg_no,
    sample_idx * 64 + CASE WHEN k % 4 = 0 THEN l_linenumber ELSE 0 END AS pos, CASE WHEN q > 45 THEN 'b' ELSE 'a' END AS layout, q::BIGINT AS cnt FROM L),
  E AS (SELECT *, layout IS DISTINCT FROM lag(layout) OVER w AS fresh, pos - lag(pos) OVER w AS step FROM D
    WINDOW w AS (PARTITION BY file_id ORDER BY seg_no)),
  G AS (SELECT *, NOT fresh AND step IS DISTINCT FROM lag(step) OVER (PARTITION BY file_id ORDER BY seg_no) AS changed FROM E),
  H AS (SELECT *, sum((NOT changed)::INT) OVER (PARTITION BY file_id ORDER BY seg_no) AS stretch FROM G),
  I AS (SELECT *, row_number() OVER (PARTITION BY file_id, stretch ORDER BY seg_no) - 1 AS away,
    first_value(fresh) OVER (PARTITION BY file_id, stretch ORDER BY seg_no) AS anchor FROM H),
  J AS (SELECT *, CASE WHEN changed THEN (away + anchor::INT) % 2 = 1 ELSE fresh END AS opens FROM I),
  K AS (SELECT *, sum(opens::INT) OVER (PARTITION BY file_id ORDER BY seg_no) AS run FROM J),
  R AS (SELECT file_id, run::BIGINT AS run, min(seg_no) AS seg_no, count(*) AS n_segs, sum(cnt)::BIGINT AS cnt, min(pos)::BIGINT AS pos, any_value(layout) AS layout,
    CASE WHEN count(*) > 1 THEN ((max(pos) - min(pos)) // (count(*) - 1))::BIGINT END AS stride FROM K GROUP BY file_id, run)
  SELECT *, (sum(cnt) OVER (PARTITION BY file_id ORDER BY run) - cnt)::BIGINT AS start FROM R""")
def run_compress(spark, sf_dir):
    return lay.run_compress(_segments(spark, sf_dir))


@query("coverage_check", """WITH P AS (SELECT conv_id AS channel_id, turn AS start, CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN 2 WHEN conv_id % 11 = 5 AND turn = 0 THEN 0 ELSE 1 END AS cnt
    FROM conversations), N AS (SELECT channel_id, count(*) AS length FROM P GROUP BY channel_id),
  Q AS (SELECT P.channel_id, length, start, cnt, lag(start + cnt) OVER (PARTITION BY P.channel_id ORDER BY start) AS before,
    lead(start) OVER (PARTITION BY P.channel_id ORDER BY start) AS after FROM P JOIN N ON P.channel_id = N.channel_id)
  SELECT channel_id, any_value(length) AS length, bool_and(cnt > 0 AND start = coalesce(before, 0) AND (after IS NOT NULL OR start + cnt = length)) AS covers
  FROM Q GROUP BY channel_id""")
def coverage_check(spark, sf_dir):
    """Turns of a conversation as parts; some parts are too long or empty."""
    cnt = F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 1), 2).when((F.col("conv_id") % 11 == 5) & (F.col("turn") == 0), 0).otherwise(1)
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("channel_id"), F.col("turn").alias("start"), cnt.alias("cnt"))
    return lay.coverage_check(parts, parts.groupBy("channel_id").agg(F.count(F.lit(1)).alias("length")))


@query("gap_cuts", f"""WITH {L}, P AS (SELECT channel_id, sample_idx AS seg_no, CASE WHEN k % 5 = 0 THEN 0 ELSE q::BIGINT END AS cnt FROM L),
  O AS (SELECT channel_id, seg_no, sum(cnt) OVER (PARTITION BY channel_id ORDER BY seg_no)::BIGINT AS cut FROM P),
  D AS (SELECT *, lag(cut) OVER (PARTITION BY channel_id ORDER BY seg_no) AS before FROM O)
  SELECT DISTINCT channel_id, cut FROM D WHERE cut = before""")
def gap_cuts(spark, sf_dir):
    """Segments without values of the channel (every fifth part key) and where they lie."""
    cnt = F.when(F.col("k") % 5 == 0, F.lit(0)).otherwise(F.col("q").cast("bigint"))
    return lay.gap_cuts(lineitem_store(spark, sf_dir).samples.select("channel_id", F.col("sample_idx").alias("seg_no"), cnt.alias("cnt")))


@query("reconcile_catalog", """WITH A AS (SELECT lang AS file_id, doc_id AS seg_no, n_chars::BIGINT AS digest FROM documents),
  B AS (SELECT lang AS file_id, d.doc_id AS seg_no, CASE WHEN quality = 0 THEN -1 ELSE length(text) END AS digest FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    WHERE toxic IS DISTINCT FROM 1)
  SELECT coalesce(A.file_id, B.file_id) AS file_id, bool_and(A.digest IS NOT DISTINCT FROM B.digest) AS matches, count(*) AS n_rows,
    count(*) FILTER (WHERE A.digest IS DISTINCT FROM B.digest) AS n_diff
  FROM A FULL OUTER JOIN B ON A.file_id = B.file_id AND A.seg_no = B.seg_no GROUP BY 1""")
def reconcile_catalog(spark, sf_dir):
    """Declared text lengths against measured ones; labelled rows are altered or absent on one side."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    declared = docs.select(F.col("lang").alias("file_id"), F.col("doc_id").alias("seg_no"), F.col("n_chars").alias("digest"))
    measured = docs.join(labels, "doc_id", "left").filter(~F.col("toxic").eqNullSafe(F.lit(1))).select(
        F.col("lang").alias("file_id"), F.col("doc_id").alias("seg_no"),
        F.when(F.col("quality") == 0, -1).otherwise(F.length("text")).cast("bigint").alias("digest"))
    return lay.reconcile(declared, measured, ["file_id", "seg_no"], "file_id")


@query("reconcile_probe", f"""WITH {L}, A AS (SELECT channel_id, sample_idx, v FROM L WHERE k % 50 <> 7),
  B AS (SELECT channel_id, sample_idx, CASE WHEN k % 3 = 0 THEN v + 1 ELSE v END AS w FROM L)
  SELECT B.channel_id, count(*) AS n_rows, count(*) FILTER (WHERE A.channel_id IS NULL OR v IS DISTINCT FROM w) AS n_diff
  FROM B LEFT JOIN A ON A.channel_id = B.channel_id AND A.sample_idx = B.sample_idx GROUP BY B.channel_id""")
def reconcile_probe(spark, sf_dir):
    """All samples against altered ones; one side lacks some."""
    rows = lineitem_store(spark, sf_dir).samples.select("channel_id", "sample_idx", "v", "k")
    return lay.reconcile_values(rows.filter("k % 50 <> 7"), rows.withColumn("v", F.when(F.col("k") % 3 == 0, F.col("v") + 1).otherwise(F.col("v"))))


@query("mixed_layout", """SELECT o_custkey AS file_id, bool_or((toc & 160) <> 0) AS mixed FROM (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 46 WHEN '2-HIGH' THEN 142
    WHEN '3-MEDIUM' THEN 78 ELSE 14 END AS toc FROM orders) t GROUP BY o_custkey""")
def mixed_layout(spark, sf_dir):
    """Orders as segments of a customer's file; the priority stands for the ToC mask."""
    p = F.col("o_orderpriority")
    toc = F.when(p == "1-URGENT", 14 | lay.TOC_INTERLEAVED).when(p == "2-HIGH", 14 | lay.TOC_DAQMX).when(
        p == "3-MEDIUM", 14 | lay.TOC_BIG_ENDIAN).otherwise(14)
    return lay.mixed_layout(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), toc.alias("toc")))


@query("source_drift", """WITH N AS (SELECT source AS path, sum(n_chars)::BIGINT AS size, max(doc_id) AS modified FROM documents GROUP BY source),
  O AS (SELECT d.source AS path, sum(n_chars)::BIGINT AS size, max(d.doc_id) AS modified FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    WHERE toxic IS DISTINCT FROM 1 AND d.doc_id % 5 <> 0 GROUP BY d.source)
  SELECT coalesce(N.path, O.path) AS path, CASE WHEN O.path IS NULL THEN 'added' WHEN N.path IS NULL THEN 'removed' ELSE 'changed' END AS state
  FROM N FULL OUTER JOIN O ON N.path = O.path WHERE (N.size, N.modified) IS DISTINCT FROM (O.size, O.modified)""")
def source_drift(spark, sf_dir):
    """The sources of the documents as files; the snapshot is from before some documents came."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")

    def as_files(d):
        return d.groupBy(F.col("source").alias("path")).agg(F.sum("n_chars").alias("size"), F.max("doc_id").alias("modified"))
    early = docs.join(labels, "doc_id", "left").filter(~F.col("toxic").eqNullSafe(F.lit(1)) & (F.col("doc_id") % 5 != 0))
    return lay.source_drift(as_files(early), as_files(docs))


@query("linear_scale", f"""WITH {L}, K AS (SELECT *, channel_id = 'AO' AS scaled, CASE WHEN channel_id IN ('AF', 'AO') THEN 0.0625::DOUBLE END AS cs,
    CASE WHEN channel_id LIKE 'R%' THEN 1.75::DOUBLE END AS gs FROM L)
  SELECT channel_id, sample_idx, {rnd_sql("CASE WHEN scaled THEN v WHEN cs IS NOT NULL THEN v * cs + 12.5 WHEN gs IS NOT NULL THEN v * gs + -8.0 ELSE v * 3.0 + 0.75 END")} AS v FROM K""")
def linear_scale(spark, sf_dir):
    """Scales on channel, group and file level; one channel is already scaled."""
    s = lineitem_store(spark, sf_dir)
    own, group = F.col("channel_id").isin("AF", "AO"), F.col("channel_id").startswith("R")
    cat = s.channels.select(
        "channel_id", (F.col("channel_id") == "AO").alias("scaled"),
        F.when(own, 0.0625).alias("ch_slope"), F.when(own, 12.5).alias("ch_intercept"),
        F.when(group, 1.75).alias("grp_slope"), F.when(group, -8.0).alias("grp_intercept"),
        F.lit(3.0).alias("file_slope"), F.lit(0.75).alias("file_intercept"))
    return lay.linear_scale(s.samples.select("channel_id", "sample_idx", "v"), cat, s.n_channels).withColumn("v", rnd("v"))


@query("interval_merge", f"""WITH {S}, T AS (SELECT channel_id, t_us // 1000000 - 1704067200 AS r0, t_us // 1000000 - 1704067200 + floor(v * 25)::BIGINT AS r1 FROM S),
  O AS (SELECT *, max(r1) OVER (PARTITION BY channel_id ORDER BY r0, r1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM T),
  I AS (SELECT *, sum((seen IS NULL OR r0 > seen)::INT) OVER (PARTITION BY channel_id ORDER BY r0, r1) AS island FROM O)
  SELECT channel_id, min(r0) AS r0, max(r1) AS r1 FROM I GROUP BY channel_id, island""")
def interval_merge(spark, sf_dir):
    """Events as busy intervals (whole seconds), merged per channel."""
    r0 = F.call_function("div", F.col("t_us"), F.lit(1_000_000)) - 1704067200
    spans = event_store(spark, sf_dir).samples.select("channel_id", r0.cast("bigint").alias("r0"), (r0 + F.floor(F.col("v") * 25)).alias("r1"))
    return rw.interval_merge(spans, "channel_id")
