"""Merge-on-read tables and streams whose state crosses batches."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundscope.sources import sync as SY
from fundscope.streaming import merge_table as MT
from fundscope.streaming import open_events as OE

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("o", T.IntegerType()), T.StructField("v", T.StringType())])


def deltas(seed, n=9, null_keys=True):
    rng = random.Random(seed)
    key = [None] if null_keys else []
    return [[(rng.choice([*range(25), *key]), rng.choice([None, *range(6)]), f"v{i}-{j}") for j in range(rng.randrange(1, 30))] for i in range(n)]


def replayed(parts, ordered):
    """Row by row: the greatest (order, delta, row) of each key, nulls least."""
    best = {}
    for i, rows in enumerate(parts):
        for k, o, v in rows:
            rank = ((o is not None, o or 0) if ordered else (), i, (o is not None, o or 0), v)
            if k not in best or rank > best[k][0]:
                best[k] = (rank, (k, o, v))
    return sorted((r for _, r in best.values()), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


@pytest.mark.parametrize("order", ["o", None])
def test_reads_equal_a_replay(spark, tmp_path, order):
    table, parts = MT.MergeTable(str(tmp_path / "t"), SCHEMA, ("k",), order), deltas(1)
    for i, rows in enumerate(parts):
        assert table.add(spark.createDataFrame(rows, SCHEMA), i)
        assert rows_of(table.read(spark)) == replayed(parts[:i + 1], order is not None)
        table.compact(spark)
        assert rows_of(table.read(spark)) == replayed(parts[:i + 1], order is not None)
        assert not table.add(spark.createDataFrame(rows, SCHEMA), i)  # a repeated delta changes nothing, compacted or not
    assert len(table.live(spark)) < len(parts)
    # what was replaced goes with the next compaction
    table.compact(spark)
    assert table.complete(spark) == table.live(spark)


def test_merge_equals_the_batch_upsert(spark, tmp_path):
    base, delta = deltas(2, 2, null_keys=False)
    first = SY.upsert(spark.createDataFrame([], SCHEMA), spark.createDataFrame(base, SCHEMA), ["k"], "o")
    want = SY.upsert(first, spark.createDataFrame(delta, SCHEMA), ["k"], "o")
    table = MT.MergeTable(str(tmp_path / "t"), SCHEMA, ("k",), "o")
    table.add(spark.createDataFrame(base, SCHEMA), 0)
    table.add(spark.createDataFrame(delta, SCHEMA), 1)
    assert rows_of(table.read(spark)) == rows_of(want)


def test_a_delta_writes_its_own_bytes(spark, tmp_path):
    table = MT.MergeTable(str(tmp_path / "t"), SCHEMA, ("k",), "o")
    table.add(spark.range(200_000).select(F.col("id").alias("k"), F.lit(1).alias("o"), F.md5(F.col("id").cast("string")).alias("v")), 0)
    before = size_of(tmp_path)
    table.add(spark.createDataFrame([(i, 2, "new") for i in range(0, 200_000, 500)], SCHEMA), 1)
    assert size_of(tmp_path) - before < before / 50
    assert table.compact(spark) is None  # one large and one small segment are no run
    assert table.read(spark).where("v = 'new'").count() == 400 and table.read(spark).count() == 200_000


def test_ranges_and_keys_read_the_segments_they_meet(spark, tmp_path):
    table = MT.MergeTable(str(tmp_path / "t"), SCHEMA, ("k",), "o")
    for i in range(3):
        table.add(spark.range(i * 100, i * 100 + 100).select(F.col("id").alias("k"), F.lit(i).alias("o"), F.lit(f"v{i}").alias("v")), i)
    table.add(spark.createDataFrame([(150, 9, "late"), (None, 1, "none")], SCHEMA), 3)
    got = table.read_range(spark, 120, 160)
    assert rows_of(got) == sorted([(k, 1, "v1") if k != 150 else (150, 9, "late") for k in range(120, 161)], key=str)
    files = {f.split("/rows/")[0].rsplit("/", 1)[1] for f in got.inputFiles()}
    assert files == {MT.Segment(1, 1).name, MT.Segment(3, 3).name}
    assert rows_of(table.look_up(spark, [7, 150, 999])) == sorted([(7, 0, "v0"), (150, 9, "late")], key=str)
    assert table.look_up(spark, [-5]).count() == 0 and table.read(spark).where("k IS NULL").count() == 1


def test_a_failed_write_is_not_read_and_is_written_again(spark, tmp_path):
    table = MT.MergeTable(str(tmp_path / "t"), SCHEMA, ("k",), None)
    table.add(spark.createDataFrame([(1, 1, "a")], SCHEMA), 0)
    half = table.root + "/" + MT.Segment(1, 1).name + "/rows"
    spark.createDataFrame([(1, 2, "half")], SCHEMA).write.parquet(half)  # the job died before its bounds were written
    assert rows_of(table.read(spark)) == [(1, 1, "a")]
    assert table.add(spark.createDataFrame([(1, 2, "whole")], SCHEMA), 1)
    assert rows_of(table.read(spark)) == [(1, 2, "whole")]


def test_empty_table(spark, tmp_path):
    table = MT.MergeTable(str(tmp_path / "t"), SCHEMA, ("k",), None)
    assert table.read(spark).count() == 0 and table.compact(spark) is None
    table.add(spark.createDataFrame([], SCHEMA), 0)
    assert table.read(spark).count() == 0 and table.read_range(spark, 1, 2).count() == 0


def test_stream_in_batches_and_a_restart(spark, tmp_path):
    parts = deltas(3, 6)
    table = MT.MergeTable(str(tmp_path / "t"), SCHEMA, ("k",), "o")
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")

    def arrive(some):
        for rows in some:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    arrive(parts[:4])
    MT.merge_stream(spark, source, table, progress, max_files_per_trigger=1).awaitTermination()
    assert sum(s.last - s.first + 1 for s in table.live(spark)) == 4
    # a crash after the table was written but before the batch was committed: the batch is replayed
    os.remove(f"{progress}/commits/3")
    if os.path.exists(f"{progress}/commits/.3.crc"):
        os.remove(f"{progress}/commits/.3.crc")
    arrive(parts[4:])
    MT.merge_stream(spark, source, table, progress, max_files_per_trigger=1).awaitTermination()
    assert rows_of(table.read(spark)) == replayed(parts, True)


# ---------------------------------------------------------------- open events
T0 = dt.datetime(2024, 1, 1)


def signal(i, subject, minute, score=1.0, kind="late"):
    return (i, subject, kind, T0 + dt.timedelta(minutes=minute), score, None)


def feedback(i, subject, minute, verdict="confirmed", kind="late"):
    return (i, subject, kind, T0 + dt.timedelta(minutes=minute), None, verdict)


def played(batches):
    """The state machine by hand, batch after batch."""
    now, out = {}, []
    for rows in batches:
        for i, s, t, at, score, verdict in sorted(rows, key=lambda r: (r[3], r[5] is not None, r[0])):
            if verdict is None and (s, t) not in now:
                now[s, t] = [i, score, 0]
                out.append((s, t, i, "Pending", score, None, at, 0))
            elif verdict is None:
                now[s, t][2] += 1
            elif (s, t) in now:
                i, score, n = now.pop((s, t))
                out.append((s, t, i, "Closed", score, verdict, at, n))
    return sorted(out, key=str)


def run(spark, tmp_path, batches):
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, OE.ACTIONS).coalesce(1).write.mode("append").parquet(source)
    OE.run_open_events(spark, source, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    return sorted(map(tuple, spark.read.schema(OE.CHANGES).parquet(str(tmp_path / "out")).collect()), key=str)


def test_events_stay_open_until_feedback(spark, tmp_path):
    batches = [[signal(1, "a", 0), signal(2, "a", 1), signal(3, "b", 0), feedback(4, "c", 0)],
               [signal(5, "a", 2 * 1440), feedback(6, "b", 5), signal(7, "b", 9)],  # days later a is still open; b opens again
               [feedback(8, "a", 3 * 1440, "false alarm"), signal(9, "b", 10), signal(10, None, 1)],
               [signal(11, "a", 4 * 1440), feedback(12, None, 2), feedback(13, None, 3)]]
    got = run(spark, tmp_path, batches)
    assert got == played(batches)
    assert ("a", "late", 1, "Closed", 1.0, "false alarm", T0 + dt.timedelta(days=3), 2) in got
    table = {r["event_id"]: r["status"] for r in OE.event_table(spark.createDataFrame(got, OE.CHANGES)).collect()}
    assert table == {1: "Closed", 3: "Closed", 7: "Pending", 10: "Closed", 11: "Pending"}


def test_state_survives_a_restart(spark, tmp_path):
    rng = random.Random(5)
    batches = [[(signal if rng.random() < 0.7 else feedback)(100 * b + i, rng.choice("abcdef"), b * 60 + i) for i in range(20)] for b in range(5)]
    run(spark, tmp_path, batches[:2])
    assert run(spark, tmp_path, batches[2:]) == played(batches)  # another query on the same checkpoint


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    batches = [[signal(1, "a", 0)], [feedback(2, "a", 5)], [signal(3, "a", 9)]]
    run(spark, tmp_path, batches)
    progress = tmp_path / "progress"
    for name in ("2", ".2.crc"):
        if (progress / "commits" / name).exists():
            os.remove(progress / "commits" / name)
    assert run(spark, tmp_path, [[signal(4, "a", 10)]]) == played([*batches, [signal(4, "a", 10)]])


def test_rows_of_a_hot_key_are_taken_in_order(spark, tmp_path):
    """More rows of a key than an Arrow batch holds, in no order and in several files of one micro-batch."""
    rng = random.Random(7)
    rows = [(feedback if rng.random() < 0.01 else signal)(i, "hot" if i % 50 else f"s{i}", i // 3) for i in range(24_000)]
    rng.shuffle(rows)
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, OE.ACTIONS).repartition(3).write.parquet(source)
    OE.run_open_events(spark, source, str(tmp_path / "out"), str(tmp_path / "progress"), files_per_batch=None).awaitTermination()
    got = sorted(map(tuple, spark.read.schema(OE.CHANGES).parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == played([rows])


def test_runs_merge_to_one_order():
    rng = random.Random(8)
    times = [None, *(T0 + dt.timedelta(minutes=m) for m in range(40))]
    rows = [Row(*OE.ACTIONS.names)(i, "a", "late", rng.choice(times), rng.choice([1.0, None, float("nan")]), rng.choice([None, None, "v"])) for i in range(5000)]
    got = list(OE.in_order(rows, 700))
    assert [r[1:3] for r in got] == [(r.at, r.row_id) for r in sorted(rows, key=lambda r: (r.at is None, r.at or 0, r.verdict is not None, r.row_id))]
    assert got == list(OE.in_order(rows)) and all(r[3] in (None, 1.0) for r in got)


def test_a_key_costs_few_calls_to_the_state_store():
    calls = []

    class State:
        def __init__(self, value):
            self.value = value

        def __getattr__(self, name):
            return lambda *a: calls.append(name) or (self.value if name == "get" else None)

    def names(value, *rows):
        calls.clear()
        of = OE.OpenEvents()
        of.open = State(value)
        out = list(of.handleInputRows(("a", "late"), iter([Row(*OE.ACTIONS.names)(*r) for r in rows]), None))
        return len(out), list(calls)

    assert names(None, signal(1, "a", 0), signal(2, "a", 1)) == (1, ["get", "update"])
    assert names((1, 1.0, 0), feedback(2, "a", 1)) == (1, ["get", "clear"])
    assert names(None, feedback(2, "a", 1)) == (0, ["get"])
    assert names(None, signal(1, "a", 0), feedback(2, "a", 1)) == (2, ["get"])


def test_the_state_has_as_many_stores_as_the_session_has_shuffle_partitions(spark, tmp_path):
    """Not as many as a new session would have: every store is a database on disk."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert OE.stateful_session(spark).conf.get("spark.sql.shuffle.partitions") == "3"
        run(spark, tmp_path, [[signal(1, "a", 0)]])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    stores = [n for n in os.listdir(tmp_path / "progress" / "state" / "0") if n.isdigit()]
    assert len(stores) == 3
