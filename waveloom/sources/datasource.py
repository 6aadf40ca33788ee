"""Segmented files as a Spark data source with pushed filters.

``source_samples(spark, plan, where)`` is a DataFrame over a stored plan (`store_plan`: the layout families of a header scan, a Parquet
table). Conditions on path, kind, file and sample_idx reach the reader: families without a wanted channel, kind or sample never become a
partition, so their files are not opened. A partition is a byte range of about PARTITION_BYTES of one file; values come in their own types.

Spark keeps what a query has pushed with the loaded relation, where the next query on the same relation finds it. So each call loads a
relation of its own, and filters that are added later stay above the scan.
"""

from __future__ import annotations

import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
                                    LessThanOrEqual)

from ..session import new_path, range_parts
from .families import KIND_OF, KINDS, PIECE_BYTES, PIECE_VALUES, decoded_pieces, family_arrow, family_schema, layout_families
from .segments import filesystem_of, value_runs

NAME = "waveloom_segments"
PARTITION_BYTES = 64 << 20
_COLUMNS = ["file", "big", "base", "stride", "npc", "chunk", "blob", "rows", "members"]


def store_plan(scan: DataFrame, path: str | None = None) -> str:
    """Write the layout families of a header scan, in the order of the files' bytes, and return their path."""
    path = path or new_path(scan.sparkSession, "source-plan")
    families = layout_families(value_runs(scan))
    range_parts(families, families.count(), "file", "base").write.parquet(path)
    return path


def source_samples(spark: SparkSession, plan: str, where: Column | str | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """file, path, sample_idx, kind and one column for each of `kinds`, of the samples that meet the condition."""
    spark.dataSource.register(SegmentSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format(NAME).option("plan", plan).option("kinds", ",".join(kinds)).load()
    if where is not None:
        rows = rows.filter(where)
    return rows.filter(F.monotonically_increasing_id() >= 0)  # always true, but no later filter passes it; the optimizer drops rand() >= 0


class _Bytes(InputPartition):
    """Pieces of one file that lie near each other."""

    def __init__(self, pieces: list[dict]):
        self.pieces = pieces


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def kinds(self) -> tuple[str, ...]:
        return tuple((self.options.get("kinds") or ",".join(KINDS)).split(","))

    def schema(self) -> str:
        return family_schema(self.kinds())

    def reader(self, schema) -> DataSourceReader:
        return SegmentReader(self.options["plan"], self.kinds())


class SegmentReader(DataSourceReader):
    """Plans partitions from the stored families; the filters it takes are exact, the others stay with Spark."""

    def __init__(self, plan: str, kinds: tuple[str, ...]):
        self.plan, self.kinds = plan, kinds
        self.start, self.stop = 0, None
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in ("path", "kind", "file") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            elif column == "sample_idx" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and isinstance(f.value, int):
                self.start = max(self.start, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo):
                    self._before(f.value + 1)
            elif column == "sample_idx" and isinstance(f, (LessThan, LessThanOrEqual)) and isinstance(f.value, int):
                self._before(f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def _before(self, stop: int) -> None:
        self.stop = stop if self.stop is None else min(self.stop, stop)

    def _families(self):
        """Rows of the plan, row group by row group; row groups of other files are skipped by their statistics."""
        fs, root = filesystem_of(self.plan)
        chosen = [("file", "in", list(self.wanted["file"]))] if self.wanted.get("file") else None
        for info in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                yield from pq.read_table(info.path, columns=_COLUMNS, filters=chosen, filesystem=fs).to_pylist()

    def _kept(self, m: dict, rows: int) -> bool:
        kind = KIND_OF.get(m["type_code"])
        last = m["start"] + rows
        return (kind in self.kinds and kind in self.wanted.get("kind", {kind}) and m["path"] in self.wanted.get("path", {m["path"]})
                and last > self.start and (self.stop is None or m["start"] < self.stop))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        held: list[dict] = []
        size = 0
        for f in self._families():
            members = [m for m in f["members"] if self._kept(m, f["rows"])] if f["file"] in self.wanted.get("file", {f["file"]}) else []
            if not members:
                continue
            lo = min(max(0, self.start - m["start"]) for m in members)
            hi = f["rows"] if self.stop is None else max(min(f["rows"], self.stop - m["start"]) for m in members)
            step = max(1, PIECE_BYTES // f["stride"]) if f["stride"] else PIECE_VALUES
            for a in range(lo, hi, step):
                b = min(a + step, hi)
                piece = {**{k: f[k] for k in _COLUMNS[:-2]}, "members": members, "a": a, "b": b}
                nbytes = (b - a) * f["stride"] or f["blob"]
                if held and (held[-1]["file"] != f["file"] or size + nbytes > PARTITION_BYTES):
                    out.append(_Bytes(held))
                    held, size = [], 0
                held.append(piece)
                size += nbytes
        if held:
            out.append(_Bytes(held))
        return out or [_Bytes([])]

    def read(self, partition: _Bytes):
        yield from decoded_pieces(iter(partition.pieces), family_arrow(self.kinds), self.start, self.stop)
