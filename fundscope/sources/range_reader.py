"""A partitioned reader as a Spark data source: one task per key range or per source partition, filters pushed down.

``spark.read.format("key_ranges")`` reads through a *cursor*, an object that a function named by the option ``cursor``
(``module:function``, called with all options) builds on the driver and again in each task.  A cursor tells

* ``arrow_schema()``: the columns;
* ``profile(key)``: (least, greatest, rows) of some stretches of the source, from its statistics, and whether null keys may occur;
* ``parts()``: names of the source's own partitions;
* ``batches(where, part)``: Arrow batches of the rows for which an Arrow expression holds, of one part or all.

``ParquetCursor`` is the cursor of a folder of Parquet files.  The option ``ranges`` asks for so many key ranges of about equal rows, whose
bounds come from the profile; ``by=parts`` makes one task per source partition, and neither is one sequential
read.  A range is open below and closed above, the first has no lower and the last no upper bound, and null keys are a range of their
own, so every row is in just one.  Comparisons, IN, null tests and prefixes of top-level columns are pushed to the
cursor; Spark evaluates the rest.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs as pfs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import from_arrow_schema

FORMAT = "key_ranges"


class ParquetCursor:
    """Parquet files under ``path``, read with row groups skipped by their statistics."""

    def __init__(self, options: dict):
        where, path = pfs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") \
            else (pfs.LocalFileSystem(), options["path"])
        self.data = ds.dataset(path, filesystem=where, format="parquet")

    def arrow_schema(self) -> pa.Schema:
        return self.data.schema.remove_metadata()

    def profile(self, key: str) -> tuple[list[tuple], bool]:
        stretches, nulls = [], False
        for part in self.data.get_fragments():
            for group in part.row_groups:
                known = group.statistics.get(key)
                if known is not None:
                    stretches.append((known["min"], known["max"], group.num_rows))
                column = part.metadata.row_group(group.id).column(part.metadata.schema.to_arrow_schema().get_field_index(key))
                nulls |= not column.is_stats_set or column.statistics.null_count != 0
        return stretches, nulls

    def parts(self) -> list[str]:
        return list(self.data.files)

    def batches(self, where: pc.Expression | None, part: str | None) -> Iterator[pa.RecordBatch]:
        data = self.data if part is None else ds.dataset(part, filesystem=self.data.filesystem, format="parquet")
        yield from data.to_batches(filter=where)


def parquet_cursor(options: dict) -> ParquetCursor:
    return ParquetCursor(options)


def split_points(stretches: Sequence[tuple], ranges: int) -> list:
    """Bounds that cut the rows of the stretches (least, greatest, rows) into about equal shares.

    Numbers are taken to lie evenly inside a stretch; of other keys the stretches' greatest values are the bounds to choose from."""
    rows = sum(n for *_, n in stretches)
    if ranges < 2 or not rows:
        return []
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for a, b, _ in stretches for v in (a, b)):
        least, greatest = min(a for a, *_ in stretches), max(b for _, b, _ in stretches)

        def upto(x) -> float:
            return sum(n * (1.0 if x >= b else 0.0 if x < a else (x - a + 1) / (b - a + 1)) for a, b, n in stretches)

        out = []
        for i in range(1, ranges):
            low, high = least, greatest
            for _ in range(60):
                mid = (low + high) // 2 if isinstance(least, int) and isinstance(greatest, int) else (low + high) / 2
                low, high = (low, mid) if upto(mid) >= rows * i / ranges else (mid, high)
            out.append(high)
    else:
        out, seen = [], 0
        for _, b, n in sorted(stretches, key=lambda s: s[1]):
            seen += n
            if seen >= rows * (len(out) + 1) / ranges and len(out) < ranges - 1:
                out.append(b)
    return sorted(set(out))


@dataclass
class Range(D.InputPartition):
    """Rows with key in (low, high], with a null key, or of one part of the source."""

    low: object = None
    high: object = None
    nulls: bool = False
    part: str | None = None

    def __init__(self, low=None, high=None, nulls=False, part=None):
        super().__init__(None)
        self.low, self.high, self.nulls, self.part = low, high, nulls, part


def _pushed(f: D.Filter, columns: set[str]) -> pc.Expression | None:
    """The filter as an Arrow expression with the same truth (null is not true), or None."""
    attribute = getattr(f, "attribute", None)
    if isinstance(f, D.Not):
        inner = f.child
        field = pc.field(inner.attribute[0]) if len(getattr(inner, "attribute", ())) == 1 and inner.attribute[0] in columns else None
        if field is None:
            return None
        if isinstance(inner, D.EqualTo):
            return field != pa.scalar(inner.value)
        return None
    if attribute is None or len(attribute) != 1 or attribute[0] not in columns:
        return None
    field = pc.field(attribute[0])
    if isinstance(f, D.IsNull):
        return field.is_null()
    if isinstance(f, D.IsNotNull):
        return field.is_valid()
    if isinstance(f, D.StringStartsWith):
        return pc.starts_with(field, pattern=f.value)
    if isinstance(getattr(f, "value", None), float):
        return None  # Spark orders NaN above all numbers, Arrow does not
    if isinstance(f, D.In):
        return field.isin(list(f.value)) if all(v is not None and not isinstance(v, float) for v in f.value) else None
    for kind, make in ((D.EqualTo, lambda v: field == v), (D.GreaterThan, lambda v: field > v), (D.GreaterThanOrEqual, lambda v: field >= v),
                       (D.LessThan, lambda v: field < v), (D.LessThanOrEqual, lambda v: field <= v)):
        if type(f) is kind:
            return make(pa.scalar(f.value))
    return None


class RangeReader(D.DataSourceReader):
    def __init__(self, options: dict, columns: set[str]):
        self.options, self.columns, self.where = options, columns, []

    def _cursor(self):
        module, function = self.options.get("cursor", f"{__name__}:parquet_cursor").split(":")
        return getattr(importlib.import_module(module), function)(self.options)

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if _pushed(f, self.columns) is None:
                yield f
            else:
                self.where.append(f)

    def partitions(self) -> Sequence[Range]:
        cursor, key = self._cursor(), self.options.get("key")
        if self.options.get("by") == "parts":
            return [Range(part=p) for p in cursor.parts()] or [Range()]
        if not key:
            return [Range()]
        stretches, nulls = cursor.profile(key)
        points = split_points(stretches, int(self.options.get("ranges", "1")))
        out = [Range(low, high) for low, high in zip([None, *points], [*points, None])]
        # without bounds the one range also holds null keys
        return out + ([Range(nulls=True)] if nulls and points else [])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where = [_pushed(f, self.columns) for f in self.where]
        if partition.nulls:
            where.append(pc.field(self.options["key"]).is_null())
        if partition.low is not None:
            where.append(pc.field(self.options["key"]) > pa.scalar(partition.low))
        if partition.high is not None:
            where.append(pc.field(self.options["key"]) <= pa.scalar(partition.high))
        yield from self._cursor().batches(reduce(lambda a, b: a & b, where) if where else None, partition.part)


class RangeStream(D.DataSourceStreamReader):
    """The source as a stream of what has come above a key: the offset is the greatest key that was read.

    A micro-batch reads (offset, greatest key now] in ranges.  Spark logs the offsets before it runs a batch and the
    sink commits them with the rows, so a batch that died reads the same range again and none is read twice.  The key rises (a
    number or a text), as that of an incremental extract does; rows with a null key or one not above the option ``after`` never come."""

    def __init__(self, options: dict):
        self.reader_ = RangeReader(options, set())
        self.options = options

    def _typed(self, value):
        if value is None:
            return None
        kind = self.reader_._cursor().arrow_schema().field(self.options["key"]).type
        return int(value) if pa.types.is_integer(kind) else value

    def initialOffset(self) -> dict:
        return {"after": self._typed(self.options.get("after"))}

    def latestOffset(self) -> dict:
        stretches, _ = self.reader_._cursor().profile(self.options["key"])
        greatest = [b for _, b, _ in stretches]
        first = self.initialOffset()["after"]
        return {"after": max([*greatest, *([first] if first is not None else [])], default=None)}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        low, high = start["after"], end["after"]
        if high is None or low is not None and low >= high:
            return [Range(low=high, high=high)] if high is not None else [Range(nulls=True, high=None, part="")]
        stretches, _ = self.reader_._cursor().profile(self.options["key"])
        new = [(a if low is None else max(a, low), min(b, high), n) for a, b, n in stretches if (low is None or b > low) and a <= high]
        points = [p for p in split_points(new, int(self.options.get("ranges", "1"))) if (low is None or p > low) and p < high]
        return [Range(a, b) for a, b in zip([low, *points], [*points, high])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.part == "":
            return  # nothing has come yet
        if partition.low is None:  # the first range: everything with a key
            key = pc.field(self.options["key"])
            yield from self.reader_._cursor().batches(key <= pa.scalar(partition.high), None)
        else:
            yield from self.reader_.read(partition)

    def commit(self, end: dict) -> None:
        pass  # the source keeps its rows


class KeyRangeSource(D.DataSource):
    """Options: ``path`` (or whatever the cursor asks for), ``key`` and ``ranges``, or ``by=parts``; ``cursor``; for streams ``after``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _given(self) -> dict:
        return {k.lower(): v for k, v in dict(self.options).items()}

    def schema(self):
        return from_arrow_schema(RangeReader(self._given(), set())._cursor().arrow_schema(), prefer_timestamp_ntz=True)

    def reader(self, schema) -> RangeReader:
        return RangeReader(self._given(), set(schema.names))

    def streamReader(self, schema) -> RangeStream:
        return RangeStream(self._given())


def read_ranges(spark: SparkSession, path: str, **options: str):
    """A table of the source; filters are pushed to the cursor in a session that allows it, as this sets it."""
    spark.dataSource.register(KeyRangeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).options(path=path, **options).load()


def stream_ranges(spark: SparkSession, path: str, key: str, **options: str):
    """A stream of the rows that come above the greatest key read so far."""
    spark.dataSource.register(KeyRangeSource)
    return spark.readStream.format(FORMAT).options(path=path, key=key, **options).load()
