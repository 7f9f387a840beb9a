"""Shared helpers: intermediate tables in the cluster's shared folder, reading."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests, bench) may lack the setting; it then gets a
    fresh temporary folder.  A cluster session without it is refused, because a
    machine-local folder would be invisible to the other executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage: later branches read one fixed result, and a lost executor
    re-reads files instead of recomputing the plan.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number of each row as ``name``, the same whenever the rows are read again.

    The rows of a table that is read from Parquet files as it is are named by a 64-bit hash of their file and place in it; others are
    numbered in a stored copy."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name))
        except AnalysisException:
            pass  # a file format without row numbers
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def is_held_out(doc_id) -> F.Column:
    """Rows no model learns from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


_HELD: dict[str, dict] = {}


def held_by_worker(owner: str, key, build):
    """``build()``, kept by this Python worker under ``key``: it outlives a task, and a worker keeps the tables of one owner at a time."""
    _drop_others(owner)
    mine = _HELD.setdefault(owner, {})
    if key not in mine:
        mine[key] = build()
    return mine[key]


def _drop_others(owner: str) -> None:
    for other in [o for o in _HELD if o != owner]:
        del _HELD[other]


def _give_back() -> None:
    """An idle worker keeps no read buffers and no freed memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500, owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that few texts at a time become Python objects."""
    _drop_others(owner)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    _give_back()


def byte_slices(batches: Iterable[pa.RecordBatch], column: int, most: int = 4 << 20, owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose texts or byte strings in ``column`` take about so many bytes; a longer one comes alone."""
    _drop_others(owner)
    for batch in batches:
        values = batch.column(column)
        wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
        ends = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset:values.offset + len(values) + 1] if len(values) else []
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    _give_back()
