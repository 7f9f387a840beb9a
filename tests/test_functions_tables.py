"""Golden values for the column functions and table operators."""
import datetime as dt

from pyspark.sql import functions as F

from fundscope.functions import columns as C
from fundscope.operators import tables as TB


def one(spark, expr, schema="x string", row=("",)):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def test_slugify(spark):
    df = spark.createDataFrame([("!Hell0 world-hi",), ("0Hell0 world-hi",)], "s string")
    got = [r[0] for r in df.select(C.slugify("s")).collect()]
    assert got == ["hell0_world_hi", "_0hell0_world_hi"]


def test_urls(spark):
    df = spark.createDataFrame([("https://a.com",), ("http://b.org/x/y?z=1&utm_source=mail",), ("c.net?q=1",),
                                ("android-app://d.io/p",)], "u string")
    rows = df.select(C.url_host("u"), C.url_path("u"), C.url_parameter("u", "utm_source")).collect()
    assert rows[0][0] == "a.com" and rows[0][1] == "a.com"      # bare host: path is the host (kept)
    assert rows[1][0] == "b.org" and rows[1][1] == "x/y" and rows[1][2] == "mail"
    assert rows[2][0] == "c.net" and rows[2][1] == "" and rows[2][2] is None
    assert rows[3][0] == "d.io"


def test_width_bucket(spark):
    df = spark.createDataFrame([(4.0,), (-1.0,), (15.0,), (10.0,), (None,)], "x double")
    got = [r[0] for r in df.select(C.width_bucket("x", 0, 10, 5)).collect()]
    assert got == [3, 0, 6, 6, None]


def test_safe_math_and_keys(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (0.0, 2.0, None)], "a double, b double, c double")
    r = df.select(C.safe_add("a", "b", "c"), C.safe_subtract("a", "b", "c"), C.safe_divide("c", "a"),
                  C.safe_divide("c", "a", default=0.0)).collect()
    assert r[0][0] == 4.0 and r[0][1] == -2.0 and r[0][2] == 3.0
    assert r[1][0] == 2.0 and r[1][2] is None and r[1][3] == 0.0
    k = spark.createDataFrame([("a", None)], "x string, y string").select(C.surrogate_key("x", "y")).first()[0]
    import hashlib
    assert k == hashlib.md5(b"a-_dbt_utils_surrogate_key_null_").hexdigest()


def test_haversine(spark):
    mi = spark.range(1).select(C.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert abs(mi - 2 * 3961 * 0.0087266462599716) < 1e-6
    km = spark.range(1).select(C.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), unit="km")).first()[0]
    assert abs(km - mi * 1.60934) < 1e-9


def test_mask(spark):
    df = spark.createDataFrame([("张三丰", "11010119900307123X", "x")], "name string, id string, other string")
    r = TB.mask_pii(df).first()
    assert r["name"] == "张**" and r["id"] == "110101********123X" and r["other"] == "x"


def test_pivot_example(spark):
    df = spark.createDataFrame([("S", "red"), ("S", "red"), ("S", "blue"), ("M", "red")], "size string, color string")
    got = {r["size"]: (r["red"], r["blue"]) for r in TB.pivot(df, "size", "color", ["red", "blue"]).collect()}
    assert got == {"S": (2, 1), "M": (1, 0)}


def test_date_spine_and_series(spark):
    s = TB.date_spine(spark, "day", "2018-01-01", "2018-01-10").collect()
    assert len(s) == 9 and s[0][0] == dt.date(2018, 1, 1) and s[-1][0] == dt.date(2018, 1, 9)
    assert TB.date_spine(spark, "day", "2018-01-01", "2018-01-01").count() == 0
    m = TB.date_spine(spark, "month", "2024-01-31", "2024-04-01").collect()
    assert [r[0] for r in m] == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 31)]
    assert [r[0] for r in TB.series(spark, 10).collect()] == list(range(1, 11))


def test_dedupe_keeps_null_rows(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "b"), (2, 1, None), (None, 5, "n")],
                               "user_id int, version int, other string")
    got = sorted(TB.deduplicate(df, "user_id", "version").collect(), key=lambda r: str(r[0]))
    assert [tuple(r) for r in got] == [(1, 2, "b"), (2, 1, None), (None, 5, "n")]


def test_unpivot_keeps_nulls_and_bools(spark):
    df = spark.createDataFrame([(1, None, True)], "id int, name string, flag boolean")
    got = {(r["field_name"], r["value"]) for r in TB.unpivot(df, ["id"]).collect()}
    assert got == {("name", None), ("flag", "true")}


def test_union_and_star(spark):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([(2, 7)], "id int, favorite_number int")
    u = TB.union_relations({"a": a, "b": b})
    assert u.columns == ["_dbt_source_relation", "id", "name", "favorite_number"]
    assert u.where("_dbt_source_relation = 'b'").first()["name"] is None
    assert TB.star(u, except_=["NAME"]).columns == ["_dbt_source_relation", "id", "favorite_number"]
    n = TB.nullcheck(spark.createDataFrame([("", 1)], "s string, i int")).first()
    assert n["s"] is None and n["i"] == 1


def test_paginate(spark):
    df = spark.range(25).toDF("k")
    p = TB.paginate(df, "k", 3, 10).collect()
    assert [r["k"] for r in p] == list(range(20, 25)) and p[0]["total_rows"] == 25


def test_deduplicate_with_map_column(spark):
    from fundscope.operators import tables as TB
    df = spark.sql("SELECT * FROM VALUES (1, 1, map('a', 1)), (1, 2, map('a', 2)), (1, 2, map('a', 1)), (NULL, 1, NULL) AS t(k, v, m)")
    got = {r["k"]: (r["v"], r["m"]) for r in TB.deduplicate(df, ["k"], ["v"]).collect()}
    assert got == {1: (2, {"a": 2}), None: (1, None)}


def test_rows_of_a_hot_group_are_spread(spark):
    """A group of most rows meets its statistics in many tasks; small groups, NULL and missing ones as before."""
    from pyspark.sql import functions as F

    from fundscope.operators import stats as ST
    rows = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") < 50, F.concat(F.lit("g"), "id")).alias("g"))
    groups = rows.where("g <> 'g10' OR g IS NULL").groupBy("g").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1")):
            spark.conf.set(k, v)
        found = ST._with_groups(rows, groups, ["g"], size="n")
        want = {r["id"]: (r["top"], r["n"]) for r in ST._with_groups(rows, groups, ["g"]).collect()}
        assert {r["id"]: (r["top"], r["n"]) for r in found.collect()} == want and len(want) == 3999
        most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert most < 1500


def test_models_are_fitted_on_bounded_partitions(spark):
    from fundscope.plans import ml as ML
    cores = spark.sparkContext.defaultParallelism
    assert [ML.fit_partitions(spark, n) for n in (0, 10, 120_000, 10 ** 9)] == [1, 1, 2, 3 * cores]
