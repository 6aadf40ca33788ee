"""Row ranges: windows of samples, merged intervals, box selections and pages."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .scan import running_rows


def sample_window(samples: DataFrame, channel_ids: list, start: int, stop: int) -> DataFrame:
    """Samples [start, stop) of some channels; both predicates reach the scan."""
    return samples.filter(F.col("channel_id").isin(channel_ids) & (F.col("sample_idx") >= max(0, start))
                          & (F.col("sample_idx") < stop))


def interval_merge(intervals: DataFrame, key: str) -> DataFrame:
    """Merge overlapping or touching intervals [r0, r1) (of any ordered type) per key, however far apart the starts lie.

    Equal starts are combined first; a key with very many intervals is spread over tasks by its starts.
    """
    starts = settle(intervals.groupBy(key, "r0").agg(F.max("r1").alias("r1")))
    seen = running_rows(starts, [key], ["r0"], F.col("r1"), "max", "_seen", inclusive=False)
    opens = F.col("_seen").isNull() | (F.col("r0") > F.col("_seen"))
    seen = settle(seen.select(key, "r0", "r1", opens.cast("int").alias("_open")))
    marked = running_rows(seen, [key], ["r0"], F.col("_open"), "sum", "island")
    return marked.groupBy(key, "island").agg(F.min("r0").alias("r0"), F.max("r1").alias("r1")).drop("island")


def merged_rows(boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Merged row intervals of a few user-selected boxes (top, bottom, left, right), inclusive."""
    out: list[list[int]] = []
    for top, bottom, _left, _right in sorted(boxes):
        if out and top <= out[-1][1]:
            out[-1][1] = max(out[-1][1], bottom + 1)
        else:
            out.append([top, bottom + 1])
    return [(a, b) for a, b in out]


def box_select(samples: DataFrame, columns: list, boxes: list[tuple[int, int, int, int]], text: Column | None = None) -> DataFrame:
    """Cells of the selected boxes as a wide table: row_no and one column per selected channel.

    columns: channel ids in table order. Cells outside every box are NULL. The answer is a DataFrame of any size.
    """
    intervals = merged_rows(boxes)
    used = sorted({c for _t, _b, left, right in boxes for c in range(left, right + 1) if c < len(columns)})
    idx, ch = F.col("sample_idx"), F.col("channel_id")
    rows = reduce(or_, [(idx >= a) & (idx < b) for a, b in intervals])
    inside = reduce(or_, [idx.between(t, b) & ch.isin(columns[left:right + 1]) for t, b, left, right in boxes])
    cell = F.when(inside, F.col("v").cast("string") if text is None else text)
    names = [columns[c] for c in used]
    picked = samples.filter(rows & ch.isin(names)).select(idx.alias("row_no"), "channel_id", cell.alias("cell"))
    return side_by_side(picked, "row_no", names, "cell")


WIDE_BY_CONDITION = 64  # up to this many columns one conditional aggregate each needs only one shuffle


def side_by_side(rows: DataFrame, key: str, channel_ids: list, cell: str) -> DataFrame:
    """One row per key and one column per channel (NULL where a channel has no cell).

    A pivot groups by (key, channel) and then by key; for a short list of channels conditional
    aggregates give the same table with a single shuffle. Both take the first cell that is not NULL.
    """
    if len(channel_ids) > WIDE_BY_CONDITION:
        return rows.groupBy(key).pivot("channel_id", channel_ids).agg(F.first(cell, ignorenulls=True))
    return rows.groupBy(key).agg(*[
        F.first(F.when(F.col("channel_id") == c, F.col(cell)), ignorenulls=True).alias(str(c)) for c in channel_ids])


def values_page(samples: DataFrame, channel_ids: list, i0: int, i1: int, value: str = "v") -> DataFrame:
    """Page [i0, i1) of many channels side by side; shorter channels give NULL cells."""
    page = sample_window(samples, channel_ids, i0, i1)
    return side_by_side(page.select("sample_idx", "channel_id", value), "sample_idx", channel_ids, value)


def page_info(channels: DataFrame, start: int, count: int | None, row_limit: int) -> DataFrame:
    """One row: total rows of the range, rows shown, whether the limit cuts it, next start."""
    s = F.lit(max(0, start)).cast("bigint")
    stop = F.col("length") if count is None else F.least(F.col("length"), s + count)
    total = channels.agg(F.coalesce(F.max(F.greatest(stop, s) - s), F.lit(0)).alias("total_rows"))
    shown = F.least(F.lit(row_limit).cast("bigint"), F.col("total_rows"))
    return total.select("total_rows", shown.alias("rows"), (F.col("total_rows") > shown).alias("clamped"),
                        F.when(F.col("total_rows") > shown, s + shown).alias("next_start"))
