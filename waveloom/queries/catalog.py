"""Catalog rules on catalogs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import iso_reference
from ..operators import catalog as cat
from ..sources.tables import epoch_us, event_channels, table
from .base import C, L, LC, S, event_store, lineitem_store

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


_CODES = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 25, 32, 33, 68, 524300, 1048589, 0]
_KIND_SQL = f"""K AS (SELECT p_partkey AS channel_id, list_extract({_CODES}, (p_partkey % 17)::INT + 1) AS type_code, p_size - 1 AS length, p_brand AS grp, p_name AS name FROM part),
  KK AS (SELECT *, CASE WHEN length = 0 THEN 'empty' WHEN type_code IN (9, 10, 25) THEN 'float' WHEN type_code BETWEEN 1 AND 8 THEN 'int' WHEN type_code = 33 THEN 'bool'
    WHEN type_code = 68 THEN 'time' WHEN type_code IN (524300, 1048589) THEN 'complex' WHEN type_code = 32 THEN 'string' ELSE 'empty' END AS kind FROM K)"""


def part_channels(spark, sf_dir):
    """Parts as channels: brand = group, name, a type code and a length."""
    codes = F.array(*[F.lit(c) for c in _CODES])
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("channel_id"), F.col("p_type").alias("file_id"), F.col("p_brand").alias("grp"), F.col("p_name").alias("name"),
        F.element_at(codes, (F.col("p_partkey") % 17 + 1).cast("int")).alias("type_code"), (F.col("p_size") - 1).alias("length"), "p_size", "p_retailprice")
    return p.withColumn("kind", cat.kind_of("type_code", "length"))


@query("kind_class", f"WITH {_KIND_SQL} SELECT channel_id, type_code, length, kind FROM KK")
def kind_class(spark, sf_dir):
    return part_channels(spark, sf_dir).select("channel_id", "type_code", "length", "kind")


@query("plottable", f"WITH {_KIND_SQL} SELECT channel_id, kind FROM KK WHERE kind NOT IN ('string', 'empty')")
def plottable(spark, sf_dir):
    return cat.plottable(part_channels(spark, sf_dir)).select("channel_id", "kind")


@query("labels_fmt", """SELECT p_partkey AS channel_id, p_brand || '/' || p_name AS label,
  '/''' || p_brand || '''/''' || replace(replace(p_name, ' ', ''''), '''', '''''') || '''' AS path FROM part""")
def labels_fmt(spark, sf_dir):
    p = part_channels(spark, sf_dir).withColumn("quoted", F.replace("name", F.lit(" "), F.lit("'")))
    return p.select("channel_id", cat.label_of().alias("label"), cat.object_path("grp", "quoted").alias("path"))


def _with_props(spark, sf_dir):
    """Properties as a map: some keys are absent, some empty."""
    pairs = F.array(
        F.when(F.col("p_size") % 3 != 0, F.struct(F.lit("unit_string").alias("k"), F.when(F.col("p_size") % 3 == 1, "").otherwise("V").alias("v"))),
        F.when(F.col("p_size") % 2 == 0, F.struct(F.lit("Unit").alias("k"), F.when(F.col("p_size") % 4 == 0, "").otherwise("A").alias("v"))),
        F.when(F.col("p_size") % 5 != 0, F.struct(F.lit("unit").alias("k"), F.lit("counts").alias("v"))),
        F.when(F.col("p_size") % 7 == 0, F.struct(F.lit("NI_ChannelLength").alias("k"), F.lit("own").alias("v"))))
    return part_channels(spark, sf_dir).withColumn("props", F.map_from_entries(F.filter(pairs, lambda e: e.isNotNull())))


@query("unit_coalesce", """SELECT p_partkey AS channel_id, CASE WHEN p_size % 3 = 2 THEN 'V' WHEN p_size % 4 = 2 THEN 'A' WHEN p_size % 5 <> 0 THEN 'counts' ELSE '' END AS unit FROM part""")
def unit_coalesce(spark, sf_dir):
    return _with_props(spark, sf_dir).select("channel_id", cat.unit_of().alias("unit"))


@query("display_props", f"""WITH {_KIND_SQL} SELECT p_partkey AS channel_id, 'NI_ChannelLength=' || CASE WHEN p_size % 7 = 0 THEN 'own' ELSE (p_size - 1)::VARCHAR END
  || ';NI_DataType=' || type_code || CASE WHEN p_size % 2 = 0 THEN ';Unit=' || CASE WHEN p_size % 4 = 0 THEN '' ELSE 'A' END ELSE '' END
  || CASE WHEN p_size % 5 <> 0 THEN ';unit=counts' ELSE '' END
  || CASE p_size % 3 WHEN 1 THEN ';unit_string=' WHEN 2 THEN ';unit_string=V' ELSE '' END AS props FROM part JOIN KK ON p_partkey = channel_id""")
def display_props(spark, sf_dir):
    p = _with_props(spark, sf_dir).withColumn("all", cat.display_props("props", "length", "type_code"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("all"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return p.select("channel_id", text.alias("props"))


_DX = """CASE p_size % 8 WHEN 0 THEN 'fast' WHEN 1 THEN 'nan' WHEN 2 THEN 'Infinity' WHEN 3 THEN '-0.001' WHEN 4 THEN '0.0' WHEN 5 THEN NULL ELSE p_retailprice::VARCHAR END"""


def _with_dx(spark, sf_dir):
    m = F.col("p_size") % 8
    text = F.when(m == 0, "fast").when(m == 1, "nan").when(m == 2, "Infinity").when(m == 3, "-0.001").when(m == 4, "0.0").when(
        m != 5, F.col("p_retailprice").cast("string"))
    return part_channels(spark, sf_dir).withColumn("dx_text", text)


@query("float_prop", f"""SELECT p_partkey AS channel_id, CASE WHEN isfinite(TRY_CAST({_DX} AS DOUBLE)) THEN TRY_CAST({_DX} AS DOUBLE) END AS f FROM part""")
def float_prop(spark, sf_dir):
    return _with_dx(spark, sf_dir).select("channel_id", cat.float_prop("dx_text").alias("f"))


@query("increment_check", f"""SELECT p_type AS file_id, p_partkey AS seq, p_brand || '/' || p_name || ' has no usable wf_increment (' || t || '): one second per sample' AS message
  FROM (SELECT *, {_DX} AS t FROM part) x
  WHERE t IS NOT NULL AND NOT coalesce(isfinite(TRY_CAST(t AS DOUBLE)) AND TRY_CAST(t AS DOUBLE) > 0, false)""")
def increment_check(spark, sf_dir):
    p = _with_dx(spark, sf_dir).withColumn("label", cat.label_of()).withColumn("channel_no", F.col("channel_id"))
    return cat.increment_warnings(cat.check_increment(p))


_START = "epoch_us(o_orderdate) * 1000 - 2903040000000000000"  # 92 years of 365.22 days earlier


@query("time_prop", f"""WITH T AS (SELECT o_orderkey, {_START} AS ns FROM orders)
  SELECT o_orderkey, CASE WHEN ns >= -2051222400000000000 THEN ns END AS start_ns, CASE WHEN ns < -2051222400000000000 THEN (ns + 2082844800000000000) / 1e9 ELSE 0 END AS rel_s FROM T""")
def time_prop(spark, sf_dir):
    """Order dates moved to 1903-1909 as start times: those before 1905 are relative."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (epoch_us("o_orderdate") * 1000 - 2903040000000000000).alias("ns"))
    return o.select("o_orderkey", cat.start_ns("ns").alias("start_ns"), cat.start_relative_s("ns").alias("rel_s"))


_ORD = """O AS (SELECT o_orderpriority AS file_id, o_orderkey AS channel_id, o_custkey AS length, epoch_us(o_orderdate) * 1000 + o_orderkey AS ns FROM orders
    UNION ALL SELECT 'Y' || year(o_orderdate), o_orderkey, o_custkey, epoch_us(o_orderdate) * 1000 + o_orderkey FROM orders),
  LO AS (SELECT file_id, min(ns) AS lo, max(ns) AS hi, sum(greatest(1, length)) AS w FROM O GROUP BY file_id),
  AC AS (SELECT O.file_id, ns, sum(greatest(1, length)) OVER (PARTITION BY O.file_id ORDER BY ns) AS acc FROM O),
  MD AS (SELECT AC.file_id, min(ns) AS med FROM AC JOIN LO ON AC.file_id = LO.file_id WHERE acc * 2 >= w AND hi - lo > 31536000000000000 GROUP BY AC.file_id),
  TR AS (SELECT LO.file_id, coalesce((SELECT min(ns) FROM O WHERE O.file_id = LO.file_id AND abs(ns - med) <= 31536000000000000), lo) AS t_ref, med
    FROM LO LEFT JOIN MD ON LO.file_id = MD.file_id)"""


def _order_channels(spark, sf_dir):
    """Orders as channels with a start time, in files by priority (years apart) and by year."""
    o = table(spark, sf_dir, "orders")
    ns = epoch_us("o_orderdate") * 1000 + F.col("o_orderkey")
    def as_file(name):
        return o.select(name.alias("file_id"), F.col("o_orderkey").alias("channel_id"), F.col("o_custkey").alias("length"), ns.alias("wf_start_ns"))
    return as_file(F.col("o_orderpriority")).unionByName(as_file(F.concat(F.lit("Y"), F.year("o_orderdate").cast("string"))))


@query("time_reference", f"""WITH {_ORD} SELECT O.file_id, any_value(t_ref) AS t_ref, count(*) FILTER (WHERE abs(ns - med) > 31536000000000000) AS n_far
  FROM O JOIN TR ON O.file_id = TR.file_id GROUP BY O.file_id""")
def time_reference(spark, sf_dir):
    ch = _order_channels(spark, sf_dir)
    return cat.with_reference(ch).groupBy("file_id").agg(F.first("t_ref").alias("t_ref"), F.count_if("far").alias("n_far"))


@query("start_seconds", f"WITH {_ORD} SELECT O.file_id, channel_id, 1.5::DOUBLE + (ns - t_ref) / 1e9 AS start_s FROM O JOIN TR ON O.file_id = TR.file_id")
def start_seconds(spark, sf_dir):
    ch = _order_channels(spark, sf_dir).withColumn("wf_start_offset", F.lit(1.5))
    return cat.start_seconds(cat.with_reference(ch)).select("file_id", "channel_id", "start_s")


@query("prop_list", """SELECT event_id AS object_id, k AS name, json_extract_string(props, '$.' || k) AS value FROM events, (SELECT unnest(['k']) AS k) t
  WHERE json_extract_string(props, '$.' || k) IS NOT NULL AND (contains(lower(k), '9') OR contains(lower(json_extract_string(props, '$.' || k)), '9'))""")
def prop_list(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("object_id"), F.from_json("props", "map<string,string>").alias("props"))
    return cat.property_list(ev, "9")


@query("tree_filter", "SELECT p_partkey AS channel_id FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')")
def tree_filter(spark, sf_dir):
    return cat.tree_filter(part_channels(spark, sf_dir), " Ring ").select("channel_id")


@query("select_union", """SELECT p_partkey AS channel_id FROM part WHERE p_type = 'ECONOMY' OR p_type || '/' || p_brand IN ('STANDARD/Brand#3', 'ECONOMY/Brand#2') OR p_partkey IN (5, 17)""")
def select_union(spark, sf_dir):
    picks = spark.sql("""SELECT * FROM VALUES ('file', 'ECONOMY'), ('group', 'STANDARD/Brand#3'), ('group', 'ECONOMY/Brand#2'), ('chan', '5'), ('chan', '17') AS t(kind, key)""")
    return cat.select_union(part_channels(spark, sf_dir), picks, 5).select("channel_id")


@query("dedupe_labels", f"""WITH {_KIND_SQL}, N AS (SELECT name, count(*) AS c FROM KK GROUP BY name) SELECT channel_id,
  CASE WHEN c > 1 THEN grp || '/' || KK.name ELSE KK.name END || CASE WHEN kind = 'complex' THEN ' |z|' ELSE '' END AS shown FROM KK JOIN N ON KK.name = N.name""")
def dedupe_labels(spark, sf_dir):
    return cat.dedupe_labels(part_channels(spark, sf_dir)).select("channel_id", "shown")


@query("range_clamp", f"WITH {L}, {LC} SELECT channel_id, least(9000, length) AS s, least(length, 9000 + 1010) AS e FROM LC")
def range_clamp(spark, sf_dir):
    return cat.range_clamp(lineitem_store(spark, sf_dir).channels, 9000, 1010).select("channel_id", "s", "e")


@query("warn_dedupe", """SELECT o_orderpriority AS file_id, 'clock of ' || (o_custkey % 400) AS message, min(o_orderkey) AS seq, count(*) AS n FROM orders GROUP BY 1, 2""")
def warn_dedupe(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("file_id"),
                                              F.concat(F.lit("clock of "), (F.col("o_custkey") % 400).cast("string")).alias("message"), F.col("o_orderkey").alias("seq"))
    return cat.warn_dedupe(m)


@query("path_collision", "SELECT p_type AS file_id, p_name AS path, count(DISTINCT p_brand) AS n_raw FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_brand) > 1")
def path_collision(spark, sf_dir):
    p = part_channels(spark, sf_dir)
    return cat.path_collision(p.select("file_id", F.col("name").alias("path"), F.col("grp").alias("raw")))


@query("x_header", f"""WITH {S}, {C}, T AS (SELECT strftime(make_timestamp(min(wf_start_ns) // 1000), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS r FROM C)
  SELECT channel_id, channel_id || ' x [sample index]' AS by_index, channel_id || ' x [s since ' || r || CASE WHEN channel_id = 'view' THEN ', no wf_increment: 1 s per sample' ELSE '' END || ']' AS by_time,
    channel_id || ' x = t/Time [s]' AS by_channel, channel_id <> 'view' AS timed FROM C, T""")
def x_header(spark, sf_dir):
    s = event_store(spark, sf_dir)
    ch = cat.with_reference(event_channels(s), 1).withColumn("label", F.col("channel_id"))
    ch = ch.withColumn("wf_increment", F.when(F.col("channel_id") != "view", F.col("wf_increment")))
    return ch.select("channel_id", cat.x_header("index").alias("by_index"), cat.x_header("waveform", reference=iso_reference("t_ref")).alias("by_time"),
                     cat.x_header("channel", "t/Time", "s").alias("by_channel"), cat.timed_for_export("waveform").alias("timed"))
