"""Retrieval against brute force, sync helpers, streaming against batch, and
plan-shape assertions."""
import shutil

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundscope.operators import retrieval as RT
from fundscope.plans import medallion as M
from fundscope.plans import rules as R
from fundscope.sources import adapters as A
from fundscope.sources import sync as SY
from fundscope.sources.tables import Catalog
from fundscope.streaming import jobs as J

TEXTS = ["The quick brown fox", "jumps over the lazy dog", "Fox and dog are friends", "xyz", "a b c"]
NEEDLES = ["fox", "the", "o", "og", "lazy dog", "fox and", "zzz", "Dog are", "x"]


def test_substring_hits_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").select(
        "doc_id", F.array(F.lower("text")).alias("terms"))
    nd = spark.createDataFrame([(str(i), [s.lower()]) for i, s in enumerate(NEEDLES)], "query_id string, terms array<string>")
    got = {(int(r["query_id"]), r["doc_id"]) for r in RT.term_hits(nd, docs, whole=False).collect()}
    exp = {(i, j) for i, s in enumerate(NEEDLES) for j, t in enumerate(TEXTS) if s.lower() in t.lower()}
    assert got == exp


def test_overlap_top_k_brute_force(spark, monkeypatch):
    """Many blocks, shards and ties: the k best by share of terms, then id."""
    monkeypatch.setattr(RT, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words, 6))) for i in range(700)]
    qs = [(i, " ".join(rng.choice(words, 4))) for i in range(23)]
    kb = spark.createDataFrame([(i, "c", "", t, "", None) for i, t in docs],
                               "id long, category string, title string, content string, tags string, created_at timestamp_ntz")
    q = spark.createDataFrame(qs, "query_id long, query string")
    whole, inside = RT.token_overlap(q, kb, k=5).collect(), RT.substring_overlap(q, kb, k=5).collect()
    for rows, top, holds in ((whole, 0.8, lambda w, t: w in t.split()), (inside, 0.9, lambda w, t: w in t)):
        got = {}
        for r in rows:
            got.setdefault(r["query_id"], set()).add((r["doc_id"], r["overlap"]))
        for i, text in qs:
            terms = set(text.split())
            hits = [(sum(holds(w, t) for w in terms), d) for d, t in docs]
            best = sorted((h for h in hits if h[0]), key=lambda h: (-min(h[0] / len(terms) * (0.8 if top == 0.8 else 1), top), h[1]))[:5]
            assert got[i] == {(d, n) for n, d in best}


def test_overlap_copies_no_text(spark, monkeypatch):
    """However many blocks the queries fill, a text is sent to one cell."""
    monkeypatch.setattr(RT, "BLOCK_QUERIES", 5)
    sent, spread = [], RT._spread
    monkeypatch.setattr(RT, "_spread", lambda *a: sent.append(spread(*a)) or sent[-1])
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.array(F.lit("some words of a text")).alias("terms"))
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.array(F.lit("some"), F.lit("other")).alias("terms"))
    assert RT.term_hits(queries, docs, whole=True, k=3).select("query_id").distinct().count() == 40
    assert sent[0].where(F.size("payload") == 1).count() == 50


def test_whole_words_of_odd_rows(spark):
    """Repeated ids, a term given twice, words that all or few documents hold, more than 255 terms, and a cap that makes counts tie."""
    docs = spark.createDataFrame([(1, ["a b"]), (1, ["a b"]), (2, ["a"]), (3, ["a b c"]), (4, [" "])] + [(i, ["a"]) for i in range(5, 200)],
                                 "doc_id long, terms array<string>")
    queries = spark.createDataFrame([(1, ["a", "b", "b", "c"]), (2, ["a"] * 300), (3, ["zz"])], "query_id long, terms array<string>")
    got = sorted((r["query_id"], r["doc_id"], r["hits"]) for r in RT.term_hits(queries, docs, whole=True).where("doc_id < 5").collect())
    assert got == [(1, 1, 3), (1, 1, 3), (1, 2, 1), (1, 3, 4), (2, 1, 300), (2, 1, 300), (2, 2, 300), (2, 3, 300)]
    cell = RT._WordCell([3, 1, 2, 4], [["a b c"], ["a b"], ["a"], ["a b c"]], 2, 0.6, (pa.int64(), pa.int64(), pa.int64()))
    (rows,) = cell.add([7], [["a", "b", "c"]])
    assert list(zip(rows["doc_id"].to_pylist(), rows["hits"].to_pylist())) == [(1, 2), (3, 3)]  # two of three is more than the cap


@pytest.mark.parametrize("rare,lookup,rows", [(8, 64, 1 << 20), (2, 0, 1), (1 << 40, 64, 5000), (1, 1 << 40, 64)])
def test_best_of_a_shard_by_any_way_of_counting(rare, lookup, rows, monkeypatch):
    """Rare words first or all words by rows of bits: the k largest counts, of equals the least ids, as counted one by one."""
    for name, value in (("RARE", rare), ("LOOKUP", lookup), ("ROWS", rows), ("TEXTS", 300), ("PLACES", 4000)):
        monkeypatch.setattr(RT._WordCell, name, value)
    rng = np.random.default_rng(rare % 7)
    words = np.array([f"w{i}" for i in range(400)])
    chance = 1 / np.arange(2, 402) ** 1.1
    texts = [" ".join(words[rng.random(400) < chance * rng.uniform(0.3, 3)]) for _ in range(900)] + ["", " \t\n ", "w0\x0bw1\x0cw2\rw3", "w1\x1cw2 \u00a0 w5\u3000w6"]
    ids = rng.permutation(len(texts)).tolist()
    queries = [rng.choice(words, n, replace=False, p=chance / chance.sum()).tolist() for n in (1, 2, 3, 5, 9, 20, 60, 200) * 4] + [
        texts[5].split(), ["none"], [], ["w1", "w1", "w7"], ["\u00a0", "w1\x1cw2"], words[-20:].tolist()]
    held = [set(t.encode().split()) for t in texts]
    for k in (1, 5, 2000):
        cell = RT._WordCell(ids, [[t] for t in texts], k, 1.0, (pa.int64(),) * 3)
        got = {}
        for batch in cell.add(list(range(len(queries))), queries):
            for r in batch.to_pylist():
                got.setdefault(r["query_id"], []).append((-r["hits"], r["doc_id"]))
        for i, q in enumerate(queries):
            best = sorted((-n, d) for d, h in zip(ids, held) if (n := sum(w.encode() in h for w in q)))[:k]
            assert sorted(got.get(i, [])) == best, (k, i)


def test_cells_are_dealt_out_evenly(spark):
    """A shard for each core is one shard in each partition."""
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.array(F.lit("some words")).alias("terms"))
    queries = spark.range(9).select(F.col("id").alias("query_id"), F.array(F.lit("some")).alias("terms"))
    found, spread = [], RT._spread
    try:
        RT._spread = lambda *a: found.append(spread(*a)) or found[-1]
        RT.term_hits(queries, docs, whole=True, k=3)
    finally:
        RT._spread = spread
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = found[0].groupBy(F.spark_partition_id()).agg(F.count_distinct("cell").alias("n")).collect()
    assert sum(r["n"] for r in cells) == cores and max(r["n"] for r in cells) == -(-cores // parts)


def test_hybrid_reads_each_side_once_and_keeps_odd_rows(spark, small_dir):
    v = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.5), (1, 2, 0.4), (2, None, 0.1), (None, 4, 0.2), (3, 9, -1.0)], "query_id int, doc_id int, score double")
    kw = spark.createDataFrame([(1, 1, 0.9), (1, 3, 0.9), (1, 3, 0.9), (2, None, 0.8), (None, 4, 0.7), (4, 1, 0.6)], "query_id int, doc_id int, score double")
    got = sorted(map(str, RT.hybrid_merge(v, kw, 5).collect()))
    left = kw.join(v.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    assert got == sorted(map(str, v.withColumn("source", F.lit("vector")).unionByName(left.withColumn("source", F.lit("keyword"))).collect()))
    from fundscope.plans.registry import entries
    plan = entries()["ret_hybrid"].fn(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the vector search and the overlap


def test_keyword_and_overlap(spark):
    kb = spark.createDataFrame([(i, "c", f"title{i}", t, "tag", None) for i, t in enumerate(TEXTS)],
                               "id long, category string, title string, content string, tags string, "
                               "created_at timestamp_ntz")
    q = spark.createDataFrame([(1, "fox DOG zebra")], "query_id long, query string")
    kw = {r["doc_id"]: r["score"] for r in RT.keyword_search(q, kb, k=None).collect()}
    # keywords: fox, DOG, zebra -> 'dog' lower-cased substring search
    assert kw == {0: 1, 1: 1, 2: 2}
    ov = {r["doc_id"]: r["score"] for r in RT.token_overlap(q, kb).collect()}
    assert ov == {0: round(1 / 3 * 0.8, 6), 1: round(1 / 3 * 0.8, 6), 2: round(2 / 3 * 0.8, 6)}


def test_vector_topk_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    lab = rng.integers(0, 2, 60)
    rows = [(i, [float(v) for v in x[i]], int(lab[i])) for i in range(60)]
    base = spark.createDataFrame(rows, "doc_id long, vec array<float>, label int")
    q = base.withColumnRenamed("doc_id", "query_id")
    got = {}
    for r in RT.vector_topk(q, base, k=3, filter_cols=["label"], exclude_self=True, block_rows=7).collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    xd = x.astype(np.float64)
    for i in range(60):
        d = ((xd - xd[i]) ** 2).sum(1)
        d[lab != lab[i]] = np.inf
        d[i] = np.inf
        assert sorted(got[i]) == sorted(np.argsort(d, kind="stable")[:3].tolist())


def test_hybrid_and_related(spark):
    v = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5)], "query_id long, doc_id long, score double")
    k = spark.createDataFrame([(1, 11, 0.8), (1, 12, 0.7)], "query_id long, doc_id long, score double")
    h = {r["doc_id"]: r["source"] for r in RT.hybrid_merge(v, k, 2).collect()}
    assert h == {10: "vector", 11: "vector", 12: "keyword"}
    e = spark.createDataFrame([(10, 20), (11, 10)], "doc_id long, related_id long")
    x = {(r["doc_id"], r["is_related"]) for r in RT.expand_related(v, e).collect()}
    assert x == {(10, False), (11, False), (20, True)}


def test_key_ranges_cover_disjoint(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id")).alias("k"))
    ranges = SY.key_ranges(df, "k", 6)
    tagged = SY.assign_chunks(df.withColumn("rid", F.monotonically_increasing_id()), "k", ranges)
    per = tagged.groupBy("rid").count()
    assert per.count() == 1000 and per.agg(F.max("count")).first()[0] == 1
    preds = SY.jdbc_predicates("k", [10, 20])
    assert preds == ["k <= 10", "k > 10 AND k <= 20", "k > 20", "k IS NULL"]


def test_upsert_and_reconcile(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    delta = spark.createDataFrame([(2, "B", 2), (3, "c", 1), (1, "old", 0)], "k int, v string, ver int")
    got = sorted(tuple(r) for r in SY.upsert(base, delta, ["k"], "ver").collect())
    assert got == [(1, "a", 1), (2, "B", 2), (3, "c", 1)]
    src = spark.createDataFrame([("t1", 100), ("t2", 0), ("t3", 10), ("t4", 100)], "table_name string, row_count long")
    tgt = spark.createDataFrame([("t1", 100), ("t2", 5), ("t4", 98)], "table_name string, row_count long")
    st = {r["table_name"]: (r["status"], r["error_rate"]) for r in SY.reconcile(src, tgt, 0.01).collect()}
    assert st == {"t1": ("success", 0.0), "t2": ("mismatch", 1.0), "t3": ("error", 1.0), "t4": ("mismatch", 0.02)}
    s = SY.reconcile_summary(SY.reconcile(src, tgt, 0.01)).first()
    assert (s["success"], s["mismatch"], s["error"], s["all_passed"]) == (1, 2, 1, False)


def test_type_mapping_and_files(spark, tmp_path):
    assert SY.source_type_to_spark("NUMBER", 4, 0) == T.ShortType()
    assert SY.source_type_to_spark("NUMBER", 12, 0) == T.LongType()
    assert SY.source_type_to_spark("NUMBER", None, None) == T.DecimalType(38, 0)
    assert SY.source_type_to_spark("NUMBER", 12, 2) == T.DecimalType(12, 2)
    assert SY.source_type_to_spark("DATE") == T.TimestampNTZType()
    assert SY.source_type_to_spark("TIMESTAMP(6) WITH TIME ZONE") == T.TimestampNTZType()
    assert SY.source_type_to_spark("XMLTYPE") == T.StringType()
    assert SY.source_type_to_spark("VARCHAR2") == SY.source_type_to_spark("LONG") == T.StringType()
    assert SY.source_type_to_spark("LONG RAW") == T.BinaryType()
    p = tmp_path / "in.csv"
    p.write_text("id,amount\n1,2.5\n2,oops\n3,4\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("amount", T.DoubleType())])
    df = SY.read_files(spark, str(p), "csv", schema, header="true")
    good, obs = SY.ingest_with_report(df, "t")
    good.write.mode("overwrite").parquet(str(tmp_path / "out"))
    m = obs.get
    assert (m["total_rows"], m["success_rows"], m["failed_rows"]) == (3, 2, 1)
    h = SY.import_history_row(spark, "in.csv", "t", m).first()
    assert h["failed_rows"] == 1


def test_streams_match_batch(spark, small_dir, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    shutil.copy(f"{small_dir}/events.parquet", src / "part-0.parquet")
    events = spark.readStream.schema(J.LEDGER_SCHEMA).parquet(str(src))
    q = J.off_hours_stream(events).writeStream.format("memory").queryName("offh").trigger(availableNow=True) \
        .option("checkpointLocation", str(tmp_path / "ck1")).start()
    q.awaitTermination()
    batch = R.off_hours_operations(R.AuditTables.from_catalog(Catalog(spark, small_dir)))
    assert spark.table("offh").count() == batch.count()
    d = J.daily_withdrawals_stream(events).writeStream.format("memory").queryName("daily").outputMode("append") \
        .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    d.awaitTermination()
    daily = spark.table("daily")
    roll = {r["person_id"]: r["times"] for r in J.rollup_daily(daily, "2024-01-31", min_count=1).collect()}
    ref = {r["person_id"]: r["times"] for r in
           R.frequent_withdrawals(R.AuditTables.from_catalog(Catalog(spark, small_dir)), "2024-01-31",
                                  min_count=1).collect()}
    # windows still open at the end of the input (watermark not passed) are not emitted yet
    assert roll and all(roll[p] <= ref[p] for p in roll)
    up = J.upsert_stream(spark, str(src), J.LEDGER_SCHEMA, str(tmp_path / "tbl"), ["user_id"], "ts",
                         str(tmp_path / "ck3"))
    up.awaitTermination()
    latest = J.read_table(spark, str(tmp_path / "tbl"), J.LEDGER_SCHEMA)
    n_users = spark.read.parquet(f"{small_dir}/events.parquet").select("user_id").distinct().count()
    assert latest.count() == n_users


def test_plans_have_no_cartesian_or_python(spark, small_dir):
    cat = Catalog(spark, small_dir)
    t = R.AuditTables.from_catalog(cat)
    for df in (M.build_gold(cat), R.pre_loan_surge(t, A.AUDIT_AS_OF), R.findings(t, A.AUDIT_AS_OF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    inc = SY.incremental(cat.events, "ts", "2024-01-20 00:00:00")
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in inc._jdf.queryExecution().executedPlan().toString()
    # column pruning: the gold model reads only the columns it uses from lineitem
    gold_plan = M.build_gold(cat)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in gold_plan


def test_copy_profile_union_pattern_save(spark, small_dir, tmp_path):
    cat = Catalog(spark, small_dir)
    bad = spark.createDataFrame([("1",), ("x",)], "v string")
    rep = {r["table_name"]: (r["mode"], r["row_count"]) for r in SY.copy_tables(
        spark, {"nation": cat.nation, "empty": cat.nation.limit(0), "bad": bad}, str(tmp_path / "copy"),
        dictionaries={"bad": {"v": ("NUMBER", 9, 0)}}).collect()}
    assert rep["nation"] == ("typed", 25) and rep["empty"] == ("skipped", 0) and rep["bad"] == ("string", 2)
    chk = SY.reconcile(SY.table_counts({"nation": cat.nation}),
                       SY.table_counts({"nation": spark.read.parquet(str(tmp_path / "copy" / "nation"))}))
    assert chk.first()["status"] == "success"
    prof = SY.table_profile(cat.orders, "orders").first()
    assert prof["row_count"] > 0 and prof["size_bytes"] > 0 and prof["n_files"] == 1 and prof["n_columns"] == 6
    from fundscope.operators import tables as TB
    for i in range(3):
        spark.createDataFrame([(i, f"e{i}")], "user_id int, event string").createOrReplaceTempView(f"events_day_{i}")
    u = TB.union_matching(spark, "events_day_%", exclude="events_day_2")
    assert sorted(r["_dbt_source_relation"] for r in u.collect()) == ["events_day_0", "events_day_1"]
    gold = M.materialise(M.build_gold(cat), str(tmp_path / "gold"))
    assert gold.count() == M.build_gold(cat).count()


def test_jdbc_literals():
    import datetime as dt
    preds = SY.jdbc_predicates("k", [dt.date(2024, 1, 1), dt.datetime(2024, 5, 6, 7, 8, 9)])
    assert preds[1] == "k > DATE '2024-01-01' AND k <= TIMESTAMP '2024-05-06 07:08:09'"
    assert SY.jdbc_predicates("k", ["O'Hara"])[0] == "k <= 'O''Hara'"
    assert SY.jdbc_predicates("k", []) == ["k IS NOT NULL", "k IS NULL"]


def test_vector_topk_ties_by_id(spark):
    from fundscope.operators import retrieval as RT
    base = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20, 0, -1)], "doc_id long, vec array<double>").coalesce(1)
    q = spark.createDataFrame([(0, [1.0, 2.5])], "query_id long, vec array<double>")
    for metric in ("l2sq", "cosine"):
        assert sorted(r["doc_id"] for r in RT.vector_topk(q, base, 3, metric).collect()) == [1, 2, 3]


def test_statistics_keep_the_null_group(spark):
    from fundscope.operators import stats as ST
    df = spark.createDataFrame([(None, i, float(x)) for i, x in enumerate([1, 1, 1, 1, 1, 1, 1, 1, 50])] + [("a", 1, 2.0)], "g string, t long, x double")
    assert {r["g"]: r["median"] for r in ST.summary(df, "x", ["g"]).collect()} == {None: 1.0, "a": 2.0}
    assert [r["g"] for r in ST.trend(df, "x", ["t"], ["g"]).collect()] == [None]
    assert [r["x"] for r in ST.zscore(df, "x", 2.0, ["g"]).collect()] == [50.0]


def test_duplicate_collateral_of_one_person(spark):
    from types import SimpleNamespace
    loans = spark.createDataFrame([(1, 1, "home", 5.0, R.ACTIVE_LOAN_STATUSES[0]), (2, 2, "home", 7.0, R.ACTIVE_LOAN_STATUSES[0])],
                                  "loan_id long, person_id long, address string, amount double, status string")
    t = SimpleNamespace(loans=loans)
    assert [r["loan_count"] for r in R.duplicate_collateral(t, subject=1).collect()] == [2]
    assert R.duplicate_collateral(t).count() == 2


def test_upsert_stream_touches_few_buckets_and_replays(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("ver", T.LongType()), T.StructField("x", T.StringType())])
    rows = {}

    def step(i, batch):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "src" / f"d{i}"))
        J.upsert_stream(spark, str(tmp_path / "src" / "*"), schema, str(tmp_path / "tbl"), ["k"], "ver", str(tmp_path / "ck"),
                        n_buckets=8).awaitTermination()
        for r in batch:
            if r[0] not in rows or r[1] >= rows[r[0]][1]:
                rows[r[0]] = r
        assert {tuple(r) for r in J.read_table(spark, str(tmp_path / "tbl"), schema).collect()} == set(rows.values())

    step(0, [(k, 1, "a") for k in range(100)] + [(None, 1, "n")])
    step(1, [(3, 2, "b"), (3, 1, "old"), (500, 1, "c")])
    assert 1 <= len([p for p in (tmp_path / "tbl" / "v0000000001").iterdir() if p.name.startswith("_bucket")]) <= 2
    step(2, [(3, 1, "late"), (None, 5, "m")])
    step(3, [(3, 9, "d")])
    # a lost last version is written again from the state before it
    shutil.rmtree(tmp_path / "tbl" / "v0000000003")
    (tmp_path / "ck" / "commits" / "3").unlink()
    (tmp_path / "ck" / "commits" / ".3.crc").unlink(missing_ok=True)
    step(4, [(4, 2, "e")])


def test_models_are_shipped_after_an_observed_ingest(spark, tmp_path):
    """What an ingest observes is not the session that models are fitted in; its settings are the same."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    (tmp_path / "in.csv").write_text("a,b\n1,2\nx,3\n")
    df = SY.read_files(spark, str(tmp_path / "in.csv"), "csv", T.StructType([T.StructField(c, T.IntegerType()) for c in "ab"]), header="true")
    assert df.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    good, seen = SY.ingest_with_report(df, "t")
    assert good.collect() == [(1, 2)] and seen.get == {"total_rows": 2, "success_rows": 1, "failed_rows": 1}
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame([(float(i), i // 5) for i in range(10)], "x double, y int"))
    model = RandomForestClassifier(numTrees=3, labelCol="y", seed=1).fit(rows)
    assert len(model.transform(rows).select("prediction").collect()) == 10
