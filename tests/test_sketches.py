"""Sketches against exact answers, whatever the way they were merged."""

import datetime as dt

from pyspark.sql import functions as F

from fundscope.operators import sketches as SK


def rows(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(10)]
    df = spark.range(40_000).select(
        F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("g"), F.element_at(F.array(*map(F.lit, days)), (F.col("id") % 10 + 1).cast("int")).alias("d"),
        F.when(F.col("id") % 50 != 7, F.col("id") % 9_000).alias("user"), (F.col("id") * 7919 % 40_009).cast("double").alias("v"))
    return df.cache()


def test_merged_days_keep_the_bounds(spark):
    df = rows(spark)
    days = SK.sketch_days(df, ["g"], F.col("d"), "user", "v")
    assert days.count() == df.select("g", "d").distinct().count()
    for some in (days, days.where("day < DATE'2024-01-04'"), days.unionByName(days)):  # a day merged twice adds no ids
        got = {r["g"]: r for r in SK.estimates(SK.merged(some, ["g"])).collect()}
        mine = df.join(some.select("g", F.col("day").alias("d")).distinct(), ["g", "d"], "left_semi")
        for r in mine.groupBy("g").agg(F.count_distinct("user").alias("ids")).collect():
            assert abs(got[r["g"]]["distinct_ids"] - r["ids"]) <= SK.DISTINCT_BOUND * r["ids"] + 1
            values = sorted(x["v"] for x in mine.where(F.col("g") == r["g"]).select("v").collect())
            for q in (25, 50, 75):
                below = sum(v <= got[r["g"]][f"q{q}"] for v in values)
                assert abs(below - q / 100 * len(values)) <= SK.RANK_BOUND * len(values) + 1


def test_overlap_of_groups(spark):
    df = rows(spark)
    got = SK.overlap(SK.merged(SK.sketch_days(df, ["g"], F.col("d"), "user", "v"), ["g"]), "g").collect()
    a, b = ({r["user"] for r in df.where(F.col("g") == g).select("user").distinct().collect()} - {None} for g in "ab")
    assert [(r["left"], r["right"]) for r in got] == [("a", "b")]
    assert abs(got[0]["both"] - len(a & b)) <= SK.DISTINCT_BOUND * max(len(a), len(b)) + 1


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([("x", dt.date(2024, 1, 1), None, None)], "g string, d date, user long, v double")
    got = SK.estimates(SK.merged(SK.sketch_days(df, ["g"], F.col("d"), "user", "v"), ["g"]), ()).collect()
    assert [(r["g"], r["n"], r["distinct_ids"]) for r in got] == [("x", 1, 0)]
    assert SK.merged(SK.sketch_days(df.limit(0), ["g"], F.col("d"), "user", "v"), ["g"]).count() == 0
