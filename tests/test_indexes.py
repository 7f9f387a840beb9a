"""Stored indexes against the scans they replace, and what their plans read."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundscope.operators import retrieval as RT
from fundscope.operators import text_index as TI
from fundscope.operators import vector_index as VI
from tests.conftest import SF_CHECK


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- vectors
def vectors(spark, n=600, dim=8, seed=1, groups=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(i, (centres[i % 12] + 0.2 * rng.normal(size=dim)).tolist(), int(i % groups)) for i in range(n)]
    rows += [(n + i, rows[0][1], 0) for i in range(40)]  # copies of one vector tie
    return spark.createDataFrame([*rows, (9000, None, 0), (9001, rows[3][1], None)], "doc_id long, vec array<double>, label int")


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("filter_cols", [[], ["label"]])
def test_probing_all_lists_is_exact(spark, tmp_path, metric, filter_cols, monkeypatch):
    monkeypatch.setattr(VI, "CELL_ROWS", 30)  # several cells a list, several blocks a cell
    monkeypatch.setattr(VI, "BLOCK_ROWS", 7)
    monkeypatch.setattr(VI, "BLOCK_QUERIES", 5)
    base = vectors(spark)
    if metric == "cosine":  # products of copies differ in the last digit with the block they stand in
        base = base.where("doc_id < 600 OR doc_id >= 9000")
    queries = base.where("doc_id % 4 = 0").withColumnRenamed("doc_id", "query_id")
    index = VI.build_index(base, str(tmp_path / "i"), filter_cols, metric, n_lists=9)
    want = RT.vector_topk(queries, base.dropna(subset=filter_cols) if filter_cols else base, 5, metric, filter_cols, exclude_self=True)
    for one in (index, VI.open_index(spark, index.path)):
        got = VI.search(one, queries, 5, None, exclude_self=True)
        keep = ["query_id", "doc_id", F.round("distance", 9).alias("d")]
        assert rows_of(got.select(*keep)) == rows_of(want.select(*keep))


def test_few_lists_reach_recall(spark, tmp_path):
    base = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    queries = base.withColumnRenamed("doc_id", "query_id")
    index = VI.build_index(base, str(tmp_path / "i"))
    assert len(index.centroids) == 22
    exact = RT.vector_topk(queries, base, 5, exclude_self=True).cache()
    curve = {r["nprobe"]: r["recall"] for r in VI.recall_curve(index, queries, 5, True, sample=501).collect()}
    few = VI.probes_for(index, queries, 0.9, exclude_self=True)
    shares = {n: VI.recall(VI.search(index, queries, 5, n, exclude_self=True), exact).first()["recall"] for n in (2, few)}
    assert 2 < few < 22 and shares[2] < 0.9 <= shares[few]
    assert all(abs(shares[n] - curve[n]) < 1e-9 for n in shares)  # the sample was all 500 queries, so the curve is exact
    assert max(curve.values()) == 1.0


def test_search_does_not_shuffle_the_base(spark, tmp_path):
    index = VI.build_index(vectors(spark), str(tmp_path / "i"), n_lists=9)
    queries = vectors(spark).withColumnRenamed("doc_id", "query_id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = VI.search(index, queries)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scan = plan.index("Bucketed: true")
    path = plan[:scan].splitlines()[plan[:scan].count("\n")::-1]
    depth = path[0].index("FileScan")
    for line in path[1:]:  # up from the scan to the join
        at = len(line) - len(line.lstrip(" :+-"))
        if at < depth:
            depth = at
            assert "Exchange" not in line
            if "SortMergeJoin" in line:
                break
    else:
        raise AssertionError(plan)


@pytest.mark.parametrize("nprobe", [None, 30])
def test_a_query_is_sent_by_cell_not_by_list(spark, tmp_path, nprobe):
    """600 rows in 40 lists lie in one cell of 1,024 rows a label: a query goes there once, however many lists it probes."""
    base = vectors(spark)
    index = VI.build_index(base, str(tmp_path / "i"), ["label"], n_lists=40)
    sent = VI._sent(base.withColumnRenamed("doc_id", "query_id"), index, nprobe)
    assert sent.count() == sent.select("id").distinct().count() == 640
    if nprobe:
        assert 10 < sent.agg(F.max(F.size("lists")).alias("n")).first()["n"] <= nprobe


def test_empty_index(spark, tmp_path):
    base = spark.createDataFrame([], "doc_id long, vec array<double>, label int")
    index = VI.build_index(base, str(tmp_path / "i"), ["label"])
    queries = vectors(spark).withColumnRenamed("doc_id", "query_id")
    assert VI.search(VI.open_index(spark, index.path), queries).count() == 0


# ---------------------------------------------------------------- texts
TEXTS = ["Alpha beta gamma", "alphabet soup beta", "beta", "  gamma\tdelta\n alpha ", None, "", "x", "İstanbul ǅ straße", "a b c d e f g h",
         "delta delta delta alpha", "zeta.alpha-beta", "aaa aaaa aaaaa", "soup, of the day", "the the the", "gamma delta alpha"]
QUERIES = ["alpha beta", "a", "AAA aa", "the day of", "gamma delta", "unknown words", "soup", "x y z", "ta ga", " ", "alpha alpha delta İs", "aaaaaa", "delta\n alpha"]


def knowledge(spark):
    rows = [(i, "t%d" % (i % 3), "tag", t, "2024-01-%02d" % (1 + i)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, title string, tags string, content string, created_at string")


def asked(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")


@pytest.fixture(scope="module")
def kb(spark):
    return knowledge(spark).cache()


def index_of(kb, text, path, **kw):
    TI.build_index(kb.select(F.col("id").alias("doc_id"), text.alias("text")), str(path), parts=5, **kw)
    return TI.open_index(kb.sparkSession, str(path))


@pytest.mark.parametrize("k", [None, 1, 3])
@pytest.mark.parametrize("common", [0.0, 0.25, 0.6])
def test_searches_equal_the_scans(spark, kb, tmp_path, k, common, monkeypatch):
    monkeypatch.setattr(TI, "COMMON", common)
    search = index_of(RT.knowledge_text(kb), F.col("search_text"), tmp_path / "a", chunk_docs=4)
    assert rows_of(TI.keyword_search(search, asked(spark), k)) == rows_of(RT.keyword_search(asked(spark), kb, k))
    forward = index_of(kb, F.concat_ws(" ", "content", "title"), tmp_path / "b", chunk_docs=4)
    assert rows_of(TI.overlap(forward, asked(spark), True, k, 0.8, 0.8)) == rows_of(RT.token_overlap(asked(spark), kb, k))
    back = index_of(kb, F.concat_ws(" ", "title", "content"), tmp_path / "c", chunk_docs=4)
    assert rows_of(TI.overlap(back, asked(spark), False, k, 1.0, 0.9)) == rows_of(RT.substring_overlap(asked(spark), kb, k))
    if common == 0.25:
        cols = ["query_id", "doc_id", "title", "created_at"]
        got = TI.substring_search(search, asked(spark), kb, k)
        assert rows_of(got.select(cols)) == rows_of(RT.substring_search(asked(spark), kb, k).select(cols))


def test_first_pass_closes_queries(spark, tmp_path):
    """A query whose best documents hold many rare words takes common words only where they can matter."""
    rare = " ".join(f"rare{i}" for i in range(12))
    texts = [f"{rare} the of" if i < 3 else "the of and" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    index = index_of(docs, F.col("content"), tmp_path / "i", chunk_docs=5)
    queries = spark.createDataFrame([(1, f"{rare} the of and")], "query_id long, query string")
    hits = TI.term_hits(index, RT.query_keywords(queries), True, 3)
    assert sorted((r["doc_id"], r["hits"]) for r in hits.collect()) == [(0, 14), (1, 14), (2, 14)]  # 57 documents never met
    every = TI.term_hits(index, RT.query_keywords(queries), True, None)
    assert every.count() == 60


def test_only_folders_of_the_terms_are_read(spark, kb, tmp_path):
    index = index_of(kb, F.col("content"), tmp_path / "i")
    words = spark.createDataFrame([("alpha",)], "key string")
    rows = index.table(spark, "postings", words)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*part#\d+ (=|IN)", plan) and re.search(r"PushedFilters: \[.*key", plan)
    folders = {re.search(r"part=(\d+)", f)[1] for f in rows.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(folders) == 1


def test_a_term_of_all_documents_is_many_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the") for i in range(400)], "id long, content string")
    index = index_of(docs, F.col("content"), tmp_path / "i", chunk_docs=50)
    sizes = [len(r["docs"]) for r in index.table(spark, "postings").collect()]
    assert len(sizes) == 8 and sum(sizes) == 400


def test_empty_text_index(spark, tmp_path):
    docs = spark.createDataFrame([], "id long, content string")
    index = index_of(docs, F.col("content"), tmp_path / "i")
    assert TI.term_hits(index, RT.query_keywords(asked(spark)), False, 3).count() == 0


def test_a_keyword_of_many_terms_leaves_its_cell_once():
    """A query's k best leave the cell, whatever the number of terms that hold a keyword; a gram of many terms is one row a folder."""
    import pyarrow as pa
    cell = TI._Cell(False, 2, False, 0.25)
    cell.ask(1, ["ab", "x"], [1, 1], [1 << 62])
    cell.ask(2, ["ab"], [3], [2])
    cell.documents(pa.array([10, 11, 12, 13]))
    cell.add(["abc", "cab", "zz", "x"], pa.array([[13, 11], [12, 11], [10], [12]]))
    got = [(q, b, [int(i) for i in at], hits.tolist(), counted.tolist()) for q, b, at, hits, counted in cell.rows()]
    assert got[0] == (1, 0, [2, 1], [2, 1], [2, 1])
    assert got[1] == (2, 0, [1, 2], [3, 3], [2, 2])  # the bound makes them equal, the least ids are taken


def test_grams_grow_by_folder_not_by_term(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"term{i:03d}") for i in range(400)], "id long, content string")
    index = index_of(docs, F.col("content"), tmp_path / "i")
    grams = index.table(spark, "grams")
    assert grams.count() == grams.select("key", "folder").distinct().count() <= 5 * grams.select("key").distinct().count()
