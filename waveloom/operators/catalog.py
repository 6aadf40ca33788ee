"""Catalog operators: kinds, labels, units, waveform properties, selections and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import EPOCH_1904_S, NS_PER_S, finite
from ..session import bounded, settle
from .scan import running

# Type codes of the measurement-file format and their kinds.
INT_CODES = [1, 2, 3, 4, 5, 6, 7, 8]
FLOAT_CODES = [9, 10, 11, 0x19, 0x1A, 0x1B]
STRING_CODE, BOOL_CODE, TIME_CODE = 0x20, 0x21, 0x44
COMPLEX_CODES = [0x08000C, 0x10000D]
PLOTTABLE = ["float", "int", "bool", "time", "complex"]

# A start before 1905-01-01 is relative; starts spread more than a year are suspect.
EPOCH_1904_NS = -EPOCH_1904_S * NS_PER_S
RELATIVE_BEFORE_NS = EPOCH_1904_NS + 366 * 86_400 * NS_PER_S
MAX_SPREAD_NS = 365 * 86_400 * NS_PER_S

START_BLOCK_NS = 3_600 * NS_PER_S  # block of the running weight over start times


def kind_of(type_code: str, length: str) -> Column:
    """Kind of a channel from its type code; a channel without samples is `empty`."""
    t = F.col(type_code)
    return (
        F.when(F.col(length) == 0, "empty")
        .when(t.isin(FLOAT_CODES), "float").when(t.isin(INT_CODES), "int").when(t == BOOL_CODE, "bool")
        .when(t == TIME_CODE, "time").when(t.isin(COMPLEX_CODES), "complex").when(t == STRING_CODE, "string")
        .otherwise("empty")
    )


def plottable(channels: DataFrame) -> DataFrame:
    return channels.filter(F.col("kind").isin(PLOTTABLE))


def label_of(grp: str = "grp", name: str = "name") -> Column:
    return F.concat_ws("/", grp, name)


def object_path(*parts: str) -> Column:
    """Object path with quoted parts; quotes in a part are doubled."""
    return F.concat(*[c for p in parts for c in (F.lit("/'"), F.replace(F.col(p), F.lit("'"), F.lit("''")), F.lit("'"))])


def unit_of(props: str = "props") -> Column:
    """First non-empty of unit_string, Unit and unit."""
    names = ["unit_string", "Unit", "unit"]
    return F.coalesce(*[F.nullif(F.try_element_at(F.col(props), F.lit(k)), F.lit("")) for k in names], F.lit(""))


def display_props(props: str, length: str, type_code: str) -> Column:
    """Properties plus NI_ChannelLength and NI_DataType where the file does not have them."""
    extra = F.map_from_arrays(
        F.array(F.lit("NI_ChannelLength"), F.lit("NI_DataType")),
        F.array(F.col(length).cast("string"), F.col(type_code).cast("string")))
    extra = F.map_filter(extra, lambda k, v: v.isNotNull() & ~F.map_contains_key(F.col(props), k))
    return F.map_concat(F.col(props), extra)


def float_prop(text: str | Column) -> Column:
    """A property as a finite double, else NULL. Only plain decimal notation counts (a cast alone would take "1.5d")."""
    text = F.col(text) if isinstance(text, str) else text
    v = F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), text.try_cast("double"))
    return F.when(finite(v), v)


def start_ns(ns: str) -> Column:
    """Absolute start, or NULL when the property is a relative time (before 1905)."""
    return F.when(F.col(ns) >= RELATIVE_BEFORE_NS, F.col(ns))


def start_relative_s(ns: str) -> Column:
    """Relative seconds since 1904 of a start before 1905, else 0."""
    rel = (F.col(ns) - F.lit(EPOCH_1904_NS)) / F.lit(1e9)
    return F.coalesce(F.when(F.col(ns) < RELATIVE_BEFORE_NS, rel), F.lit(0.0))


def check_increment(channels: DataFrame) -> DataFrame:
    """wf_increment if it is finite and > 0, else NULL; `bad` flags a property that was refused."""
    dx = float_prop("dx_text")
    good = F.coalesce(dx > 0, F.lit(False))
    return channels.withColumn("wf_increment", F.when(good, dx)).withColumn(
        "bad", F.col("dx_text").isNotNull() & ~good)


def increment_warnings(channels: DataFrame) -> DataFrame:
    """Every channel whose increment was refused: file_id, seq (its number), message."""
    text = F.concat(F.col("label"), F.lit(" has no usable wf_increment ("), F.col("dx_text"), F.lit("): one second per sample"))
    return channels.filter("bad").select("file_id", F.col("channel_no").alias("seq"), text.alias("message"))


def time_reference(channels: DataFrame) -> DataFrame:
    """Reference time per file: file_id, t_ref.

    The earliest start; if the starts spread over more than a year, the earliest start within a
    year of the median start, weighted by max(1, length). channels: file_id, channel_id, length,
    wf_start_ns. Equal starts are summed first, so the running weight sees distinct starts only.
    """
    timed = channels.filter(F.col("wf_start_ns").isNotNull())
    starts = settle(timed.groupBy("file_id", "wf_start_ns").agg(
        F.sum(F.greatest(F.lit(1), F.col("length"))).alias("w")))
    ends = starts.groupBy("file_id").agg(
        F.min("wf_start_ns").alias("lo"), F.max("wf_start_ns").alias("hi"), F.sum("w").alias("all_w"))
    wide = ends.filter(F.col("hi") - F.col("lo") > MAX_SPREAD_NS)
    acc = running(starts, ["file_id"], "wf_start_ns", F.col("w"), "sum", "acc", block=START_BLOCK_NS)
    median = acc.join(wide, "file_id").filter(F.col("acc") * 2 >= F.col("all_w")).groupBy(
        "file_id").agg(F.min("wf_start_ns").alias("med"))
    near = starts.join(median, "file_id").filter(F.abs(F.col("wf_start_ns") - F.col("med")) <= MAX_SPREAD_NS).groupBy(
        "file_id").agg(F.min("wf_start_ns").alias("near_lo"), F.first("med").alias("med"))
    return ends.join(near, "file_id", "left").select(
        "file_id", F.coalesce("near_lo", "lo").alias("t_ref"), "med")


def with_reference(channels: DataFrame, n_files: int | None = None) -> DataFrame:
    """Attach t_ref and `far` (start more than a year from the median start of its file)."""
    joined = channels.join(bounded(time_reference(channels), n_files), "file_id", "left")
    far = F.coalesce(F.abs(F.col("wf_start_ns") - F.col("med")) > MAX_SPREAD_NS, F.lit(False))
    return joined.withColumn("far", far).drop("med")


def start_seconds(channels: DataFrame) -> DataFrame:
    """start_s = offset + (start - reference), exact to 1 ns before the division. Needs t_ref."""
    rel = F.coalesce((F.col("wf_start_ns") - F.col("t_ref")) / F.lit(1e9), F.lit(0.0))
    return channels.withColumn("start_s", F.coalesce("wf_start_offset", F.lit(0.0)) + rel)


def property_list(objects: DataFrame, text: str = "") -> DataFrame:
    """Properties of each object as rows, filtered by a text in name or value (any case)."""
    rows = objects.select("object_id", F.explode("props").alias("name", "value"))
    if text:
        t = text.lower()
        rows = rows.filter(F.lower("name").contains(t) | F.lower(F.coalesce("value", F.lit(""))).contains(t))
    return rows


def tree_filter(channels: DataFrame, text: str) -> DataFrame:
    """Channels whose name or group contains the text (any case)."""
    t = text.strip().lower()
    if not t:
        return channels
    return channels.filter(F.lower("grp").contains(t) | F.lower("name").contains(t))


def select_union(channels: DataFrame, picks: DataFrame, n_picks: int | None = None) -> DataFrame:
    """Channels picked by file, group or channel, each once, in file order.

    picks: kind ('file', 'group', 'chan'), key (file_id, file_id/grp or channel_id as text).
    """
    def picked(kind: str, key: Column) -> DataFrame:
        wanted = bounded(picks.filter(F.col("kind") == kind).select(F.col("key").alias("_key")).distinct(), n_picks)
        return channels.withColumn("_key", key).join(wanted, "_key", "left_semi").drop("_key")

    return (
        picked("file", F.col("file_id").cast("string"))
        .unionByName(picked("group", F.concat_ws("/", F.col("file_id").cast("string"), "grp")))
        .unionByName(picked("chan", F.col("channel_id").cast("string")))
        .dropDuplicates(["channel_id"])
    )


def dedupe_labels(channels: DataFrame) -> DataFrame:
    """Shown name: group/name where the name occurs twice in the selection; |z| for complex."""
    counts = channels.groupBy("name").agg(F.count(F.lit(1)).alias("_same"))
    shown = F.when(F.col("_same") > 1, label_of()).otherwise(F.col("name"))
    return channels.join(counts, "name").withColumn(
        "shown", F.concat(shown, F.when(F.col("kind") == "complex", " |z|").otherwise(""))).drop("_same")


def unit_text(kind: str = "kind", unit: str = "unit", zero_text: Column | None = None) -> Column:
    """Unit of the summarised values: |z| [u] for complex, `s since t0` for time, else the unit.

    zero_text: text of the first valid sample of a time channel (NULL where it is not known).
    """
    u = F.col(unit)
    since = F.lit("s since first sample") if zero_text is None else F.coalesce(
        F.concat(F.lit("s since "), zero_text), F.lit("s since first sample"))
    return (
        F.when(F.col(kind) == "complex", F.when(F.length(u) > 0, F.concat(F.lit("|z| ["), u, F.lit("]"))).otherwise("|z|"))
        .when(F.col(kind) == "time", since)
        .otherwise(u)
    )


def range_clamp(channels: DataFrame, start: int, count: int | None) -> DataFrame:
    """[s, e) of a start index and a sample count (None: all)."""
    s = F.least(F.lit(start).cast("bigint"), F.col("length"))
    e = F.col("length") if count is None else F.least(F.col("length"), F.lit(start + count).cast("bigint"))
    return channels.withColumn("s", s).withColumn("e", e)


def warn_dedupe(messages: DataFrame) -> DataFrame:
    """Distinct messages per file with their first place (seq) and count (n)."""
    return messages.groupBy("file_id", "message").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))


def path_collision(objects: DataFrame) -> DataFrame:
    """Decoded paths that come from different raw bytes: file_id, path, n_raw."""
    return objects.groupBy("file_id", "path").agg(F.count_distinct("raw").alias("n_raw")).filter("n_raw > 1")


def timed_for_export(x_source: str) -> Column:
    """Channels with an absolute time column in an export."""
    if x_source == "channel":
        return F.lit(True)
    return F.col("wf_start_ns").isNotNull() & F.coalesce(F.col("wf_increment") > 0, F.lit(False))


def x_header(x_source: str, x_label: str = "", x_unit: str = "", reference: Column | None = None) -> Column:
    """Header of the x column of a channel.

    x_source: 'index', 'waveform' or 'channel'. reference: UTC text of the reference time or NULL.
    """
    if x_source == "index":
        return F.concat(F.col("label"), F.lit(" x [sample index]"))
    since = F.lit(None).cast("string") if reference is None else F.concat(F.lit("s since "), reference)
    if x_source == "waveform":
        note = F.when(F.coalesce(F.col("wf_increment") > 0, F.lit(False)), "").otherwise(", no wf_increment: 1 s per sample")
        return F.concat(F.col("label"), F.lit(" x ["), F.coalesce(since, F.lit("s")), note, F.lit("]"))
    tail = F.lit(f" [{x_unit}]" if x_unit else "")
    tail = tail if reference is None else F.coalesce(F.concat(F.lit(" ["), since, F.lit("]")), tail)
    return F.concat(F.col("label"), F.lit(f" x = {x_label}"), tail)
