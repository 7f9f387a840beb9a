"""The partitioned reader: every row in one range, filters at the source, one task per range or part."""

import random

import pytest
from pyspark.sql import functions as F

from fundscope.sources import range_reader as RR


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(1000)]), f"s{i % 7}", None if i % 11 == 0 else i / 4, i) for i in range(3000)]
    path = str(tmp_path_factory.mktemp("src") / "t")
    df = spark.createDataFrame(rows, "k long, s string, v double, i long").withColumn("t", F.timestamp_seconds("i").cast("timestamp_ntz"))
    df.repartition(4).sortWithinPartitions("k").write.option("parquet.block.size", "20000").parquet(path)
    return df, path


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("options,tasks", [({}, 1), ({"key": "k", "ranges": "5"}, 6), ({"key": "s", "ranges": "3"}, None), ({"by": "parts"}, 4)])
def test_every_row_is_in_one_range(spark, source, options, tasks):
    df, path = source
    got = RR.read_ranges(spark, f"file:{path}", **options)
    assert got.schema == df.schema and rows_of(got) == rows_of(df)
    if tasks:
        assert got.rdd.getNumPartitions() == tasks


def test_ranges_are_balanced(spark, source):
    _, path = source
    sizes = [r["n"] for r in RR.read_ranges(spark, path, key="k", ranges="5").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * 3000 / 5


@pytest.mark.parametrize("condition", ["k > 500", "k >= 10 AND k < 20", "k = 7", "k IN (1, 2, 3)", "k IS NULL", "k IS NOT NULL AND s = 's3'", "s LIKE 's1%'",
                                       "NOT (s = 's2')", "v > 100", "k + 1 > 900", "t < TIMESTAMP_NTZ'1970-01-01 00:10:00'", "k > 5 OR s = 's1'", "v IS NULL"])
def test_filters_give_the_same_rows(spark, source, condition):
    df, path = source
    assert rows_of(RR.read_ranges(spark, path, key="k", ranges="4").where(condition)) == rows_of(df.where(condition))


def test_filters_reach_the_source(spark, source):
    reader = RR.RangeReader({"path": source[1], "key": "k", "ranges": "4"}, {"k", "s"})
    from pyspark.sql import datasource as D
    kept = list(reader.pushFilters([D.GreaterThan(("k",), 990), D.StringEndsWith(("s",), "3"), D.EqualTo(("v",), 1.5)]))
    assert [type(f).__name__ for f in kept] == ["StringEndsWith", "EqualTo"] and len(reader.where) == 1
    read = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert sum(read) == source[0].where("k > 990").count()
    plan = RR.read_ranges(spark, source[1], key="k", ranges="4").where("k > 990")._jdf.queryExecution().executedPlan().toString()
    assert "990" not in plan.split("BatchScan")[0]  # no filter above the scan: the source took it


def test_split_points():
    assert RR.split_points([], 4) == [] and RR.split_points([(1, 9, 10)], 1) == []
    assert RR.split_points([(0, 99, 100)], 4) == [24, 49, 74]
    assert RR.split_points([(0, 9, 90), (0, 999, 10)], 2) == [5]
    assert RR.split_points([("a", "c", 5), ("d", "f", 5), ("g", "i", 5)], 3) == ["c", "f"]


def run_stream(spark, path, out, progress, **options):
    stream = RR.stream_ranges(spark, path, "id", ranges="3", **options)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return [r["id"] for r in spark.read.parquet(out).collect()]


def test_a_stream_goes_on_after_the_greatest_key(spark, tmp_path):
    import os
    path, out, progress = (str(tmp_path / n) for n in ("src", "out", "progress"))

    def arrive(a, b):
        spark.range(a, b).withColumn("v", F.col("id") * 2).repartition(2).write.mode("append").parquet(path)

    arrive(0, 100)
    assert sorted(run_stream(spark, path, out, progress)) == list(range(100))
    assert sorted(run_stream(spark, path, out, progress)) == list(range(100))  # nothing new
    arrive(100, 250)
    assert sorted(run_stream(spark, path, out, progress)) == list(range(250))
    # a crash after the sink wrote and before the batch was committed: it runs again, and no row is lost or repeated
    last = max(int(n) for n in os.listdir(f"{progress}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{progress}/commits/{name}"):
            os.remove(f"{progress}/commits/{name}")
    arrive(250, 300)
    run_stream(spark, path, out, progress)
    assert sorted(run_stream(spark, path, out, progress)) == list(range(300))


def test_a_stream_may_start_after_a_key(spark, tmp_path):
    spark.range(50).repartition(2).write.parquet(str(tmp_path / "src"))
    assert sorted(run_stream(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "p"), after="19")) == list(range(20, 50))
