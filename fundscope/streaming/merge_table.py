"""A table that is merged when it is read: sorted delta files, newest first, compacted by size.

A write adds one *segment* and touches nothing else, so the bytes written are those of the delta.  A segment holds
at most one row per key, range-partitioned and sorted by the keys, with Parquet's row-group bounds and a Bloom
filter on the first key; ``about`` beside it has the segment's rows and bounds of the first key.  Segments carry the numbers of
the deltas they hold: ``s<first>-<last>``.

A read takes the newest version of each key over all segments, an aggregate with map-side combine, so a key that every
segment holds is one row per segment and task.  A range or a set of keys reads only the segments whose bounds meet it, and their row groups by
bounds and Bloom filter.  With an order column the row of the greatest order value wins, nulls least; equal ones go to the newer
delta, and so do all rows without an order column.  Null keys equal null keys.

``compact`` merges ``FANOUT`` neighbouring segments of one size class into one, so a row is written again about
log(rows) times in all.  A segment that a wider complete one covers is not read any more; it is deleted by the next
compaction, so readers that began before can finish.  A write or a compaction that failed has no ``_SUCCESS`` and
is written again; one that is repeated finds its numbers covered and does nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jobs import _fs

#: Segments of one size class that become one, and the rows of the smallest class.
FANOUT, SMALLEST = 4, 1_000
_NAME = re.compile(r"s(\d{12})-(\d{12})")


@dataclass(frozen=True)
class Segment:
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"s{self.first:012d}-{self.last:012d}"

    def covers(self, other: "Segment") -> bool:
        return self != other and self.first <= other.first and other.last <= self.last


@dataclass(frozen=True)
class MergeTable:
    """``schema`` of the rows, their key columns, and the column whose greatest value wins (None: the newest delta)."""

    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    order_col: str | None = None

    # ------------------------------------------------------------ segments
    def complete(self, spark: SparkSession) -> list[Segment]:
        """All complete segments; a listing of folders, as many as deltas since the last compactions."""
        fs, p, jvm = _fs(spark, self.root)
        if not fs.exists(p):
            return []
        out = []
        for st in fs.listStatus(p):
            m = _NAME.fullmatch(st.getPath().getName())
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "about/_SUCCESS")):
                out.append(Segment(int(m[1]), int(m[2])))
        return sorted(out, key=lambda s: (s.first, -s.last))

    def live(self, spark: SparkSession) -> list[Segment]:
        """The segments that are read, oldest first."""
        every = self.complete(spark)
        return [s for s in every if not any(o.covers(s) for o in every)]

    def about(self, spark: SparkSession, segments: Sequence[Segment]) -> dict[Segment, tuple]:
        """Per segment (rows, least first key, greatest first key, whether null keys occur)."""
        if not segments:
            return {}
        rows = spark.read.parquet(*[f"{self.root}/{s.name}/about" for s in segments]).collect()  # one row a segment
        return {Segment(r["first"], r["last"]): (r["n"], r["low"], r["high"], r["has_null"]) for r in rows}

    def _key_type(self) -> T.DataType:
        return self.schema[self.keys[0]].dataType

    # ------------------------------------------------------------ writing
    def _rank(self, seq: Column) -> Column:
        """Greater wins; columns beside the order only decide between rows of one delta."""
        rest = [F.col(f.name) for f in self.schema if f.name not in self.keys and f.name != self.order_col]
        return F.struct(*([F.col(self.order_col).alias("_o")] if self.order_col else []), seq.alias("_s"), *rest)

    def _merged(self, rows: DataFrame, seq: Column) -> DataFrame:
        """One row per key: the greatest rank; ``_seq`` of the row that won."""
        rest = [f.name for f in self.schema if f.name not in self.keys]
        new = F.max_by(F.struct(*rest, seq.alias("_seq")), self._rank(seq)).alias("_new")
        return rows.groupBy(*self.keys).agg(new).select(
            *[F.col(c) if c in self.keys else F.col(f"_new.{c}").alias(c) for c in self.schema.names], F.col("_new._seq").alias("_seq"))

    def _write(self, rows: DataFrame, segment: Segment) -> None:
        """Files first, then ``about``, whose success makes the segment complete."""
        spark, path, key = rows.sparkSession, f"{self.root}/{segment.name}", self.keys[0]
        (rows.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.mode("overwrite")
         .option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(f"{path}/rows"))
        back = spark.read.schema(rows.schema).parquet(f"{path}/rows")
        bounds = back.agg(F.lit(segment.first).cast("long").alias("first"), F.lit(segment.last).cast("long").alias("last"), F.count("*").alias("n"),
                          F.min(key).alias("low"), F.max(key).alias("high"), F.coalesce(F.max(F.col(key).isNull()), F.lit(False)).alias("has_null"))
        bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    def add(self, delta: DataFrame, number: int) -> bool:
        """Write a delta under its number; False if that number is already part of the table."""
        spark, mine = delta.sparkSession, Segment(number, number)
        if any(s == mine or s.covers(mine) for s in self.complete(spark)):
            return False
        self._write(self._merged(delta.select(*self.schema.names), F.lit(number).cast("long")), mine)
        return True

    def compact(self, spark: SparkSession) -> Segment | None:
        """Merge the newest run of ``FANOUT`` neighbours of one size class, if there is one; drop what earlier runs replaced."""
        live = self.live(spark)
        for s in self.complete(spark):
            if s not in live:
                fs, p, _ = _fs(spark, f"{self.root}/{s.name}")
                fs.delete(p, True)
        about = self.about(spark, live)
        size = [int(math.log(max(about[s][0], SMALLEST) / SMALLEST, FANOUT)) for s in live]
        for end in range(len(live), FANOUT - 1, -1):
            run = live[end - FANOUT:end]
            if len(set(size[end - FANOUT:end])) == 1:
                whole = Segment(run[0].first, run[-1].last)
                self._write(self._merged(self._rows(spark, run), F.col("_seq")), whole)
                return whole
        return None

    # ------------------------------------------------------------ reading
    def _rows(self, spark: SparkSession, segments: Sequence[Segment]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("_seq", T.LongType())])
        paths = [f"{self.root}/{s.name}/rows" for s in segments]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """The table: one row per key."""
        return self._newest(spark, self.live(spark))

    def _newest(self, spark: SparkSession, segments: Sequence[Segment], condition: Column | None = None) -> DataFrame:
        rows = self._rows(spark, segments)
        rows = rows if condition is None else rows.where(condition)
        return (rows if len(segments) == 1 else self._merged(rows, F.col("_seq"))).drop("_seq")

    def read_range(self, spark: SparkSession, low, high) -> DataFrame:
        """Rows whose first key is between ``low`` and ``high``, from the segments whose bounds meet them."""
        live = self.live(spark)
        about = self.about(spark, live)
        met = [s for s in live if about[s][1] is not None and about[s][1] <= high and about[s][2] >= low]
        kind = self._key_type()
        return self._newest(spark, met, F.col(self.keys[0]).between(F.lit(low).cast(kind), F.lit(high).cast(kind)))

    def look_up(self, spark: SparkSession, values: Sequence) -> DataFrame:
        """Rows whose first key is one of a few values: row groups are skipped by bounds and Bloom filter."""
        live, wanted = self.live(spark), sorted(set(values))
        about = self.about(spark, live)
        met = [s for s in live if about[s][1] is not None and any(about[s][1] <= v <= about[s][2] for v in wanted)]
        kind = self._key_type()
        same = [F.col(self.keys[0]) == F.lit(v).cast(kind) for v in wanted]
        return self._newest(spark, met, reduce(lambda a, b: a | b, same) if len(same) < 10 else F.col(self.keys[0]).isin(*wanted))


def merge_stream(spark: SparkSession, source_dir: str, table: MergeTable, checkpoint: str, available_now: bool = True,
                 max_files_per_trigger: int | None = None):
    """Start a stream that adds each micro-batch as a delta and compacts; returns the StreamingQuery.

    A batch that is replayed after a crash finds its number in the table, before or after a compaction."""
    reader = spark.readStream.schema(table.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.add(batch, batch_id)
        table.compact(batch.sparkSession)

    w = reader.parquet(source_dir).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
