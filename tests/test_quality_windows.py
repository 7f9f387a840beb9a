"""Pass and fail fixture for each data-quality check; neighbour/rank helpers
against plain windows on skewed data."""
import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from fundscope.operators import quality as Q
from fundscope.operators import stats as ST
from fundscope.operators.windows import neighbour


def n(df):
    return df.count()


def test_row_checks(spark):
    ok = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "id int, v int, s string")
    bad = spark.createDataFrame([(1, 50, " "), (1, None, None)], "id int, v int, s string")
    assert n(Q.unique(ok, "id")) == 0 and n(Q.unique(bad, "id")) == 1
    assert n(Q.not_null(ok, "v")) == 0 and n(Q.not_null(bad, "v")) == 1
    assert n(Q.accepted_values(ok, "v", ["5", "6"])) == 0 and n(Q.accepted_values(bad, "v", [5])) == 1
    assert n(Q.not_accepted_values(ok, "v", [7])) == 0 and n(Q.not_accepted_values(bad, "v", [50])) == 1
    assert n(Q.accepted_range(ok, "v", 0, 10)) == 0 and n(Q.accepted_range(bad, "v", 0, 10)) == 1
    assert n(Q.expression_is_true(ok, "v < 10")) == 0 and n(Q.expression_is_true(bad, "v < 10")) == 1
    assert n(Q.not_empty_string(ok, "s")) == 0 and n(Q.not_empty_string(bad, "s")) == 1
    assert n(Q.not_empty_string(bad, "s", trim_whitespace=False)) == 0
    assert n(Q.assert_equal(ok, "v", "v")) == 0 and n(Q.assert_equal(bad, "v", "id")) == 2


def test_group_checks(spark):
    g = spark.createDataFrame([("a", 1), ("a", None), ("b", None), ("b", None)], "k string, v int")
    # grouped at_least_one: group b is all NULL and must fail
    assert [r["k"] for r in Q.at_least_one(g, "v", "k").collect()] == ["b"]
    assert n(Q.at_least_one(g, "v")) == 0
    assert n(Q.not_constant(g, "v", "k")) == 1                       # a: one distinct value; b: all NULL passes
    assert n(Q.not_null_proportion(g, "v", 0.5, group_by="k")) == 1  # b has 0
    assert n(Q.unique_combination_of_columns(g, ["k", "v"])) == 1    # (b, NULL) twice
    assert n(Q.not_constant(spark.createDataFrame([(1,), (2,)], "v int"), "v")) == 0


def test_two_table_checks(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x",), ("x",), ("z",)], "k string")
    # one-sided groups y and z fail (counts against 0)
    assert sorted(r["k"] for r in Q.equal_rowcount(a, b, ["k"]).collect()) == ["y", "z"]
    assert n(Q.equal_rowcount(a, a, ["k"])) == 0 and n(Q.equal_rowcount(a, b)) == 0
    f = {r["k"]: r["row_count_delta"] for r in Q.fewer_rows_than(a, b, ["k"]).collect()}
    assert f == {"x": 1, "y": 1}
    assert n(Q.equality(a, b)) == 2 and n(Q.equality(a, a)) == 0
    c = spark.createDataFrame([("x",), ("y",)], "k string")
    assert n(Q.equality(a, c)) == 0 and n(Q.equality(a, c, strict=True)) == 1
    assert n(Q.cardinality_equality(a, "k", a, "k")) == 0 and n(Q.cardinality_equality(a, "k", b, "k")) == 2
    assert [r["k"] for r in Q.relationships_where(a, "k", b, "k").collect()] == ["y"]


def test_ranges_and_sequences(spark):
    r = spark.createDataFrame([("p", 0, 5), ("p", 5, 9), ("p", 8, 10), ("q", 1, 1), ("q", 3, None)],
                              "g string, lo int, hi int")
    bad = {(x["g"], x["lower_bound"]) for x in Q.mutually_exclusive_ranges(r, "lo", "hi", ["g"]).collect()}
    assert bad == {("p", 5), ("q", 1), ("q", 3)}
    req = {(x["g"], x["lower_bound"]) for x in
           Q.mutually_exclusive_ranges(r.where("g = 'p' and lo < 8"), "lo", "hi", ["g"], gaps="required").collect()}
    assert req == {("p", 0)}
    s = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 7)], "g string, v int")
    assert [tuple(x) for x in Q.sequential_values(s, "v", 1, group_by="g").select("g", "v").collect()] == [("a", 4)]
    rec = spark.createDataFrame([("a", "2024-01-30 10:00:00"), ("b", "2024-01-01 00:00:00")], "g string, t string") \
        .withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert [x["g"] for x in Q.recency(rec, "t", "day", 1, "2024-01-31", group_by="g").collect()] == ["b"]
    assert n(Q.recency(rec.limit(0), "t", "day", 1, "2024-01-31")) == 0


def test_suite(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    res = {r["check"]: (r["failures"], r["status"]) for r in Q.run_suite([
        Q.Check("u", Q.unique(df, "id")), Q.Check("nn", Q.not_null(df, "id"), severity="warn"),
        Q.Check("ok", Q.accepted_range(df, "id", 0, 5)),
        Q.Check("thr", Q.not_null(df, "id"), error_if=">5", warn_if=">0"),
        Q.row_check("rc_null", df, F.col("id").isNull()), Q.row_check("rc_expr", df, "NOT (id < 1)")]).collect()}
    assert res == {"u": (1, "error"), "nn": (1, "warn"), "ok": (0, "pass"), "thr": (1, "warn"),
                   "rc_null": (1, "error"), "rc_expr": (2, "error")}


def _skewed(spark, n_rows=4000):
    # one key holds half of the rows; values are distinct so order is total
    return spark.range(n_rows).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 37).alias("g"),
                                      ((F.col("id") * 7919) % 100003).alias("v"))


def test_neighbour_matches_window_on_skew(spark):
    df = _skewed(spark)
    mine = neighbour(df, ["g"], ["v"], ["v"], direction="lag", num_partitions=16)
    ref = df.withColumn("lag_v", F.lag("v").over(Window.partitionBy("g").orderBy("v")))
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, ref.collect()))
    mine_g = neighbour(df, [], ["v"], ["v", "g"], direction="lead", num_partitions=16)
    w = Window.orderBy("v")
    ref_g = df.select("*", F.lead("v").over(w).alias("lead_v"), F.lead("g").over(w).alias("lead_g"))
    assert sorted(map(tuple, mine_g.collect())) == sorted(map(tuple, ref_g.collect()))


def test_rank_and_median(spark):
    df = _skewed(spark)
    r = ST.global_rank(df, ["g"], ["v"], num_partitions=16)
    ref = df.withColumn("_pos", F.row_number().over(Window.partitionBy("g").orderBy("v")) - 1)
    assert sorted(map(tuple, r.collect())) == sorted(map(tuple, ref.collect()))
    med = {x["g"]: x["median"] for x in ST.exact_median(df, "v", ["g"]).collect()}
    pdf = df.toPandas()
    for g, grp in pdf.groupby("g"):
        assert abs(med[g] - float(np.median(grp["v"]))) < 1e-9
    allm = ST.exact_median(df, "v").first()["median"]
    assert abs(allm - float(np.median(pdf["v"]))) < 1e-9


def test_quantiles_are_those_of_percentile(spark):
    rng, shares = np.random.default_rng(4), [0.0, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    for values in ([7], [1, 2], [None, 3, 3, 3, 9], [int(v) for v in rng.integers(0, 300, 1000)], list(range(0, 4001, 2))):
        df = spark.createDataFrame([(v,) for v in values], "x long").repartition(5)
        assert ST.exact_quantiles(df, "x", shares) == df.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0]
    assert ST.exact_quantiles(df.where("x < 0"), "x", shares) == [None] * len(shares)


def test_stats(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)] + [(None,)], "x double")
    s = ST.summary(df, "x").first()
    assert s["count"] == 5 and s["median"] == 3.0 and s["range"] == 99.0
    assert abs(s["std_dev"] - float(np.std([1, 2, 3, 4, 100]))) < 1e-9
    z = ST.zscore(df, "x", 1.5).collect()
    assert [r["x"] for r in z] == [100.0]
    t = ST.trend(spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 2, 4])], "i int, x double"),
                 "x", ["i"]).first()
    assert t["first_half_avg"] == 1.0 and t["second_half_avg"] == 3.0 and t["trend"] == "up"
    assert ST.trend(spark.createDataFrame([(1, 1.0), (2, 2.0)], "i int, x double"), "x", ["i"]).count() == 0


def test_neighbour_large_partial_sampling(spark):
    # large enough that range-partition bounds come from a partial sample
    df = spark.range(200000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1000003).alias("v"))
    mine = neighbour(df, ["g"], ["v"], ["v"], direction="lead", num_partitions=32)
    ref = df.withColumn("lead_v", F.lead("v").over(Window.partitionBy("g").orderBy("v")))
    diff = mine.exceptAll(ref).count() + ref.exceptAll(mine).count()
    assert diff == 0
    r = ST.global_rank(df, ["g"], ["v"], num_partitions=32)
    refr = df.withColumn("_pos", F.row_number().over(Window.partitionBy("g").orderBy("v")) - 1)
    assert r.exceptAll(refr).count() == 0


def test_neighbour_order_types(spark):
    """Ranges of text, dates, times and mostly equal values; NULL groups and NULL order values."""
    rows = spark.range(4000).selectExpr(
        "CASE WHEN id % 5 > 0 THEN id % 2 END AS g", "id AS tie", "concat('k', id * 7919 % 1009) AS s",
        "date_add(DATE'2020-01-01', cast(id % 700 AS int)) AS d", "timestamp_ntz'2020-01-01' + make_interval(0,0,0,0,0,0,id*31%997) AS t",
        "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 1.5 ELSE id * 0.5 END AS x", "id % 2 = 0 AS b")
    for order in "sdtxb":
        df = rows.select("g", order, "tie")
        for groups in (["g"], []):
            mine = neighbour(df, groups, [order], ["tie"], num_partitions=9)
            w = Window.partitionBy(*groups).orderBy(order, *(["tie"] if groups else ["g", "tie"]))
            ref = df.withColumn("lag_tie", F.lag("tie").over(w))
            assert sorted(map(str, mine.collect())) == sorted(map(str, ref.collect())), (order, groups)
