"""Risk events with a life: an open event suppresses its repeats until feedback closes it.

A watermark can forget repeats after a time, but not "until an auditor closes the event".  ``open_events_stream`` keeps, per
(subject, risk type), whether an event is open, in Spark's state store.  Rows come in two kinds: a *signal* (with a score)
opens an event if none is open, else it is suppressed; *feedback* (with a verdict) closes the open one, if there is one.
State holds open events only: a close removes its key, so the state grows with what is open, not with what ever was.

Inside a micro-batch the rows of a key are taken in the order of (time, row id), signals of one time before feedback;
between batches the arrival decides, as with any state.  The rows of a hot key are sorted in runs that are merged from temporary
files, so a task holds ``RUN_ROWS`` of them at most.  Keys are many and their rows few: rows are taken as they are, without a
frame for each key, and the state store is asked once for a key and told once if the key has changed.  Rows with a null subject or
type are one key like any other.
"""

from __future__ import annotations

import math
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from heapq import merge
from itertools import chain, islice
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import own_session

#: What a stream of signals and feedback looks like.
ACTIONS = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("subject_id", T.StringType()), T.StructField("risk_type", T.StringType()),
    T.StructField("at", T.TimestampType()), T.StructField("score", T.DoubleType()), T.StructField("verdict", T.StringType())])
#: What it leaves: an opened or a closed event, named by the row that opened it.
CHANGES = T.StructType([
    T.StructField("subject_id", T.StringType()), T.StructField("risk_type", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("verdict", T.StringType()),
    T.StructField("at", T.TimestampType()), T.StructField("suppressed", T.LongType())])
CHANGE = Row(*CHANGES.names)
_STATE = "event_id long, score double, suppressed long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a key that are sorted in memory; of more, sorted runs go to a temporary file of the task and are merged.
RUN_ROWS = 50_000


def _action(r: Row) -> tuple:
    """(time, whether it is feedback, id), nulls last, then what the row brings."""
    at, row_id, score, verdict = r.at, r.row_id, r.score, r.verdict
    return ((at is None, at or 0, verdict is not None, row_id is None, row_id or 0),
            at, row_id, None if score is None or math.isnan(score) else score, verdict)


def _kept(run: list[tuple], files: list) -> Iterator[tuple]:
    """A run as it comes back from a file."""
    files.append(file := tempfile.TemporaryFile())
    for at in range(0, len(run), 1000):
        pickle.dump(run[at:at + 1000], file)
    file.seek(0)

    return chain.from_iterable(pickle.load(file) for _ in range(0, len(run), 1000))


def in_order(rows: Iterable[Row], run_rows: int = RUN_ROWS) -> Iterator[tuple]:
    """The actions of a key by time, signals of one time before feedback, then by id."""
    actions, first = map(_action, rows), itemgetter(0)
    run = sorted(islice(actions, run_rows), key=first)
    if len(run) < run_rows:
        yield from run
        return
    files, runs = [], []
    try:
        while run:
            runs.append(_kept(run, files))
            run = sorted(islice(actions, run_rows), key=first)
        yield from merge(*runs, key=first)
    finally:
        for file in files:
            file.close()


class OpenEvents(StatefulProcessor):
    """The open event of a key, if any: the row that opened it, its score, and how many signals it has suppressed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = now = self.open.get()
        for _, at, row_id, score, verdict in in_order(rows):
            if verdict is not None:
                if now is not None:
                    yield CHANGE(*key, now[0], "Closed", now[1], verdict, at, now[2])
                    now = None
            elif now is None:
                now = (row_id, score, 0)
                yield CHANGE(*key, row_id, "Pending", score, None, at, 0)
            else:
                now = (now[0], now[1], now[2] + 1)
        # every call goes to the state store by itself: what is as it was is not told again
        if now is not None and now != was:
            self.open.update(now)
        elif now is None and was is not None:
            self.open.clear()

    def close(self) -> None:
        pass


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own (same context, catalog and settings) whose streams keep their state in RocksDB, on disk and checkpointed."""
    own = own_session(spark)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own


def open_events_stream(actions: DataFrame) -> DataFrame:
    """Opened and closed events of a stream of ``ACTIONS``; its session must use the RocksDB state store."""
    return actions.groupBy("subject_id", "risk_type").transformWithState(
        statefulProcessor=OpenEvents(), outputStructType=CHANGES, outputMode="Append", timeMode="None")


def run_open_events(spark: SparkSession, source_dir: str, out: str, checkpoint: str, files_per_batch: int | None = 1):
    """Start the stream over files of ``ACTIONS``, oldest first; append changes as Parquet; returns the StreamingQuery.

    Without ``files_per_batch`` all files that are new are one batch."""
    own = stateful_session(spark)
    reader = own.readStream.schema(ACTIONS)
    actions = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source_dir)
    return (open_events_stream(actions).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def event_table(changes: DataFrame) -> DataFrame:
    """One row per event: its last status, with who closed it."""
    newest = F.max_by(F.struct("status", "verdict", "suppressed"), F.struct(F.col("status") == "Closed", "at")).alias("n")
    opened = F.min(F.when(F.col("status") == "Pending", F.col("at"))).alias("opened_at")
    closed = F.max(F.when(F.col("status") == "Closed", F.col("at"))).alias("closed_at")
    return changes.groupBy("subject_id", "risk_type", "event_id").agg(newest, opened, closed, F.max("score").alias("score")).select(
        "subject_id", "risk_type", "event_id", "score", F.col("n.status").alias("status"), F.col("n.verdict").alias("verdict"), "opened_at", "closed_at")
