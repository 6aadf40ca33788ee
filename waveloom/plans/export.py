"""CSV / TSV export of the samples of a range, channels side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_float, iso_ns
from ..operators.axis import inner_range, x_of
from ..operators.envelope import clip
from ..operators.rows import side_by_side
from ..operators.scan import running


def export_rows(samples: DataFrame, axes: DataFrame, xa: float, xb: float, n_channels: int | None = None) -> DataFrame:
    """Long form of the export: row_no (position in the channel's range), channel_id, sample_idx, x, v."""
    ranges = inner_range(axes, xa, xb)
    inside = clip(samples.select("channel_id", "sample_idx", "v"), ranges, n_channels)
    return inside.select((F.col("sample_idx") - F.col("i0")).alias("row_no"), "channel_id", "sample_idx",
                         x_of("sample_idx").alias("x"), "v")


def export_rows_xy(points: DataFrame, xa: float, xb: float) -> DataFrame:
    """Long form of an X-Y export: the kept samples are numbered in index order."""
    kept = F.when(~F.isnan("x") & F.col("x").between(xa, xb), 1).otherwise(0)
    numbered = running(points.withColumn("_kept", kept), ["channel_id"], "sample_idx", F.col("_kept"), "sum", "row_no", inclusive=False)
    return numbered.filter("_kept = 1").select("row_no", "channel_id", "sample_idx", "x", F.col("y").alias("v"))


def export_wide(rows: DataFrame, channel_ids: list, text: Column | None = None, time_ref: tuple[int, float] | None = None,
                timed: list | None = None) -> DataFrame:
    """Wide export table: row_no and, per channel, index, x [, UTC time], value as exact text.

    channel_ids is the fixed list of the selection. Shorter channels leave blank cells.
    """
    cell = [F.col("sample_idx").cast("string").alias("i"), format_float("x").alias("x")]
    if time_ref is not None:
        stamp = iso_ns(F.lit(time_ref[0]), F.lit(time_ref[1]), "x")
        cell.append(F.when(F.col("channel_id").isin(timed or []), stamp).otherwise("").alias("t"))
    cell.append((format_float("v") if text is None else text).alias("v"))
    wide = side_by_side(rows.select("row_no", "channel_id", F.struct(*cell).alias("cell")), "row_no", channel_ids, "cell")
    fields = ["i", "x", "t", "v"] if time_ref is not None else ["i", "x", "v"]
    return wide.select("row_no", *[F.coalesce(F.col(f"`{c}`.{f}"), F.lit("")).alias(f"{c}_{f}")
                                   for c in channel_ids for f in fields])


def header_line(names: list[str], sep: str) -> str:
    """The header under the quoting rule of the cells."""
    def cell(name: str) -> str:
        odd = any(c in name for c in (sep, '"', "\n", "\r"))
        return '"' + name.replace('"', '""') + '"' if odd else name
    return sep.join(map(cell, names))


def _write(table: DataFrame, path: str, headers: list[str], sep: str) -> None:
    """Parts in order without header lines, and one header in the folder ``<path>_header``: joined, they are one file."""
    table.sparkSession.createDataFrame([(header_line(headers, sep),)], "line string").coalesce(1).write.text(f"{path}_header")
    table.write.option("header", False).option("sep", sep).option("quote", '"').option("escape", '"') \
        .option("emptyValue", "").option("nullValue", "").csv(path)


def write_csv(wide: DataFrame, path: str, headers: list[str] | None = None, sep: str = ",") -> None:
    """Write an export ordered by row. The commit of the job makes the files visible only when complete."""
    out = wide.orderBy("row_no").drop("row_no")
    _write(out, path, headers or out.columns, sep)


def write_tsv(table: DataFrame, path: str) -> None:
    """Write a table (statistics, box selection) as tab-separated text, in the order of its first column."""
    _write(table.orderBy(F.col(f"`{table.columns[0]}`")), path, table.columns, "\t")
