"""Deep pages by directory, and equality by bucket checksums."""

import random

import pytest
from pyspark.sql import functions as F

from fundscope.operators import quality as Q
from fundscope.operators import tables as TB
from fundscope.operators.windows import _ordinal  # noqa: F401


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is not None, v or 0) for v in r])


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(2)
    rows = [(rng.choice([7] * 6 + [None, *range(20)]), rng.randrange(40), i) for i in range(900)]
    return rows, spark.createDataFrame(rows, "a int, b int, c int").repartition(5).cache()


@pytest.mark.parametrize("page,per_page", [(1, 10), (3, 7), (40, 20), (45, 20), (46, 20), (900, 1), (901, 1), (1, 2000), (2, 600)])
def test_pages_of_a_directory(skewed, page, per_page):
    rows, df = skewed
    directory = TB.PageDirectory.build(df, ["a", "b", "c"], ranges=16)
    got = [tuple(r) for r in directory.page(df, page, per_page).collect()]
    want = ordered(rows)[(page - 1) * per_page:page * per_page]
    assert sorted(got, key=str) == sorted([(*r, 900) for r in want], key=str)


def test_a_page_sorts_its_ranges_only(spark):
    df = spark.range(10_000).withColumn("v", F.col("id") * 2)
    directory = TB.PageDirectory.build(df, "id", ranges=100)
    page = directory.page(df, 400, 20)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan
    asked = [n for line in plan.splitlines() if "Offset" in line or "offset" in line for n in [line]]
    assert asked and all(int(w) < 300 for line in asked for w in __import__("re").findall(r"(?:Offset |offset=)(\d+)", line))
    assert [r["id"] for r in page.collect()] == list(range(7980, 8000))


def test_a_hot_value_is_cut_by_the_next_key(spark):
    df = spark.range(4_000).select(F.when(F.col("id") < 50, F.col("id")).otherwise(99).alias("a"), (F.col("id") * 7919 % 4001).alias("b"))
    directory = TB.PageDirectory.build(df, ["a", "b"], ranges=20)
    page = directory.page(df, 300, 10)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "% 4001) <" in plan.split("Filter", 1)[1]  # a range of the second key
    assert [(r["a"], r["b"]) for r in page.collect()] == sorted(map(tuple, df.collect()))[2990:3000]


def test_empty_directory(spark):
    df = spark.createDataFrame([], "a int, b string")
    directory = TB.PageDirectory.build(df, ["a", "b"])
    assert directory.total_rows == 0 and directory.page(df, 1, 10).count() == 0
    with pytest.raises(ValueError):
        directory.page(df, 0, 10)


# ---------------------------------------------------------------- equality
def diff(a, b, **kw):
    return sorted(map(str, map(tuple, Q.equality(a, b, **kw).collect())))


def plain(a, b, strict):
    minus = (lambda x, y: x.exceptAll(y)) if strict else (lambda x, y: x.subtract(y))
    return sorted([str((*r, "a_minus_b")) for r in map(tuple, minus(a, b).collect())] + [str((*r, "b_minus_a")) for r in map(tuple, minus(b, a).collect())])


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("buckets", [1, 8, 4096])
def test_equality_by_checksums_equals_except(spark, strict, buckets):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, "x", "y", ""]), rng.choice([0.0, -0.0, float("nan"), 1.5, None])) for _ in range(120)]
    schema = "a int, b string, c double"
    a = spark.createDataFrame(rows, schema)
    for other in (rows, rows[::-1], rows[:-1], rows + rows[:3], rows[5:] + [(9, "z", 2.0)], []):
        b = spark.createDataFrame(other, schema)
        assert diff(a, b, strict=strict, buckets=buckets) == plain(a, b, strict)


def test_only_differing_buckets_are_compared(spark):
    a = spark.range(1000).withColumn("v", F.col("id") % 7)
    b = a.withColumn("v", F.when(F.col("id") == 500, 99).otherwise(F.col("v")))
    assert Q.differing_buckets(a, a, a.columns).count() == 0
    assert Q.differing_buckets(a, b, a.columns).count() == 2  # the old row's bucket and the new one's
    assert diff(a, b, strict=True) == ["(500, 3, 'a_minus_b')", "(500, 99, 'b_minus_a')"]


def test_unlike_types_are_compared_by_value(spark):
    a, b = spark.range(5).select(F.col("id").cast("int").alias("id")), spark.range(5)
    assert diff(a, b) == []
