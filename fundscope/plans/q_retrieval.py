"""Registered retrieval queries (RET-1..9) over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as RT
from ..operators import text_index as TI
from ..operators import vector_index as VI
from ..session import written_table_dir
from ..sources import adapters as A
from ..sources.tables import Catalog
from .registry import register

KB = A.with_ctes("knowledge")
WS_SQL = r"'[ \t\n\x0B\f\r]+'"
STOP_SQL = ", ".join(f"'{w}'" for w in RT.STOP_WORDS)


def _kb(spark, d):
    return A.knowledge(Catalog(spark, d))


def _bench_queries(spark, d):
    return Catalog(spark, d).benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_SUBSTRING_SQL = KB + """
SELECT b.item_id AS query_id, k.id AS doc_id, k.title, k.created_at
FROM benchmark b JOIN knowledge k ON instr(lower(concat_ws('', k.title, k.tags, k.content)), lower(b.text)) > 0
"""


@register("ret_substring_search", _SUBSTRING_SQL, "RET-1")
def ret_substring_search(spark, d):
    return RT.substring_search(_bench_queries(spark, d), _kb(spark, d))


_KW = KB + f""",
kw AS (SELECT DISTINCT query_id, kw FROM (
         SELECT item_id AS query_id, unnest(regexp_split_to_array(text, {WS_SQL})) AS kw FROM benchmark)
       WHERE length(kw) > 1 AND kw NOT IN ({STOP_SQL})),
kt AS (SELECT id, lower(concat_ws('', title, tags, content)) AS st FROM knowledge),
hits AS (SELECT kw.query_id, kt.id AS doc_id FROM kw JOIN kt ON instr(kt.st, lower(kw.kw)) > 0),
scored AS (SELECT query_id, doc_id, count(*) AS score FROM hits GROUP BY query_id, doc_id)"""


_KEYWORD_SQL = _KW + """
SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3"""


@register("ret_keyword_search", _KEYWORD_SQL, "RET-2")
def ret_keyword_search(spark, d):
    return RT.keyword_search(_bench_queries(spark, d), _kb(spark, d), k=3)


_OV = KB + f""",
qt AS (SELECT DISTINCT query_id, tok FROM (
         SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(text), {WS_SQL})) AS tok FROM benchmark)
       WHERE length(tok) > 0),
qn AS (SELECT query_id, count(*) AS n_query_tokens FROM qt GROUP BY query_id)"""


_TOKEN_SQL = _OV + f""",
dt AS (SELECT DISTINCT doc_id, tok FROM (
         SELECT id AS doc_id, unnest(regexp_split_to_array(lower(concat_ws(' ', content, title)), {WS_SQL})) AS tok
         FROM knowledge) WHERE length(tok) > 0),
ov AS (SELECT qt.query_id, dt.doc_id, count(*) AS overlap FROM qt JOIN dt USING (tok) GROUP BY 1, 2)
SELECT query_id, doc_id, overlap, round(least(overlap / n_query_tokens * 0.8, 0.8), 6) AS score
FROM ov JOIN qn USING (query_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5"""


@register("ret_token_overlap", _TOKEN_SQL, "RET-3")
def ret_token_overlap(spark, d):
    return RT.token_overlap(_bench_queries(spark, d), _kb(spark, d), k=5)


_SUBSTRING_OVERLAP_SQL = _OV + """,
kt AS (SELECT id AS doc_id, lower(concat_ws(' ', title, content)) AS t FROM knowledge),
ov AS (SELECT qt.query_id, kt.doc_id, count(*) AS overlap FROM qt JOIN kt ON instr(kt.t, qt.tok) > 0 GROUP BY 1, 2)
SELECT query_id, doc_id, overlap, round(least(overlap / n_query_tokens, 0.9), 6) AS score
FROM ov JOIN qn USING (query_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5"""


@register("ret_substring_overlap", _SUBSTRING_OVERLAP_SQL, "RET-3")
def ret_substring_overlap(spark, d):
    return RT.substring_overlap(_bench_queries(spark, d), _kb(spark, d), k=5)


_VEC = """vt AS (
  SELECT q.vec_id AS query_id, b.vec_id AS doc_id,
         list_sum(list_transform(range(1, len(q.embedding) + 1),
                  lambda i: pow(CAST(q.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2))) AS distance
  FROM embeddings q JOIN embeddings b ON q.label = b.label AND q.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, b.vec_id) <= 5)"""


def _vector_hits(spark, d):
    e = Catalog(spark, d).embeddings
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "label")
    b = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")
    return RT.vector_topk(q, b, k=5, filter_cols=["label"], exclude_self=True)


_VECTOR_SQL = "WITH " + _VEC + """
SELECT query_id, doc_id, round(distance, 4) AS distance, round(1.0 - distance, 4) AS score FROM vt"""


@register("ret_vector_topk", _VECTOR_SQL, "RET-4")
def ret_vector_topk(spark, d):
    h = _vector_hits(spark, d)
    return h.select("query_id", "doc_id", F.round("distance", 4).alias("distance"), F.round("score", 4).alias("score"))


_HYB = KB + ",\n" + _VEC + f""",
qt AS (SELECT DISTINCT query_id, tok FROM (
         SELECT e.vec_id AS query_id, unnest(regexp_split_to_array(lower(k.title), {WS_SQL})) AS tok
         FROM embeddings e JOIN knowledge k ON k.id = e.vec_id) WHERE length(tok) > 0),
qn AS (SELECT query_id, count(*) AS n_query_tokens FROM qt GROUP BY query_id),
dt AS (SELECT DISTINCT doc_id, tok FROM (
         SELECT id AS doc_id, unnest(regexp_split_to_array(lower(concat_ws(' ', content, title)), {WS_SQL})) AS tok
         FROM knowledge) WHERE length(tok) > 0),
ov AS (SELECT qt.query_id, dt.doc_id, count(*) AS overlap FROM qt JOIN dt USING (tok) GROUP BY 1, 2),
kwh AS (SELECT query_id, doc_id, round(least(overlap / n_query_tokens * 0.8, 0.8), 6) AS score
        FROM ov JOIN qn USING (query_id)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5),
u AS (SELECT query_id, doc_id, 1.0 - distance AS score, 'vector' AS source FROM vt
      UNION ALL
      SELECT query_id, doc_id, score, 'keyword' FROM kwh k
      WHERE NOT EXISTS (SELECT 1 FROM vt WHERE vt.query_id = k.query_id AND vt.doc_id = k.doc_id))"""


@register("ret_hybrid", _HYB + """
SELECT query_id, doc_id, round(score, 4) AS score, source FROM u
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source DESC, doc_id) <= 10""", "RET-5")
def ret_hybrid(spark, d):
    cat = Catalog(spark, d)
    kb = A.knowledge(cat)
    vec = _vector_hits(spark, d)
    emb = cat.embeddings
    q = emb.join(kb, emb.vec_id == kb.id).select(
        F.col("vec_id").alias("query_id"), F.col("title").alias("query"))
    kw = RT.token_overlap(q, kb, k=5)
    h = RT.hybrid_merge(vec, kw, k=5)
    return h.select("query_id", "doc_id", F.round("score", 4).alias("score"), "source")


@register("ret_related_expand", KB + """,
hits AS (SELECT b.item_id AS query_id, k.id AS doc_id, CAST(1.0 AS DOUBLE) AS score
         FROM benchmark b JOIN knowledge k ON instr(lower(concat_ws('', k.title, k.tags, k.content)), lower(b.text)) > 0),
canon AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS related_id FROM documents),
edges AS (SELECT doc_id, related_id FROM canon WHERE related_id <> doc_id),
rel AS (SELECT DISTINCT h.query_id, e.related_id AS doc_id FROM hits h JOIN edges e USING (doc_id))
SELECT query_id, doc_id, score, false AS is_related FROM hits
UNION ALL
SELECT query_id, doc_id, CAST(0.0 AS DOUBLE), true FROM rel r
WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = r.query_id AND h.doc_id = r.doc_id)""", "RET-6")
def ret_related_expand(spark, d):
    cat = Catalog(spark, d)
    hits = RT.substring_search(_bench_queries(spark, d), A.knowledge(cat)).select(
        "query_id", "doc_id", F.lit(1.0).alias("score"))
    docs = cat.documents.select("doc_id", F.md5("text").alias("h"))
    canon = docs.groupBy("h").agg(F.min("doc_id").alias("related_id"))
    edges = docs.join(canon, "h").where(F.col("related_id") != F.col("doc_id")).select("doc_id", "related_id")
    return RT.expand_related(hits, edges)


@register("ret_upsert_vectors", """
WITH delta AS (
  SELECT vec_id, list_transform(embedding, lambda x: x + x) AS embedding, label FROM embeddings WHERE label = 3
  UNION ALL
  SELECT vec_id + 1000000, embedding, label FROM embeddings WHERE label = 7),
merged AS (SELECT * FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM delta d WHERE d.vec_id = e.vec_id)
           UNION ALL SELECT * FROM delta)
SELECT * FROM merged WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 9)""", "RET-7")
def ret_upsert_vectors(spark, d):
    e = Catalog(spark, d).embeddings
    delta = (e.where(F.col("label") == 3).select("vec_id", F.transform("embedding", lambda x: x + x).alias("embedding"),
                                                  "label")
             .unionByName(e.where(F.col("label") == 7).select((F.col("vec_id") + 1000000).alias("vec_id"),
                                                               "embedding", "label")))
    merged = RT.upsert_vectors(e, delta)
    return RT.delete_vectors(merged, e.where(F.col("label") == 9).select("vec_id"))


@register("ret_pca2", None, "RET-8")
def ret_pca2(spark, d):
    return RT.pca_2d(Catalog(spark, d).embeddings)


@register("ret_index_text", KB + """
SELECT id, concat_ws('', title, tags, content) AS search_text, left(coalesce(content, ''), 200) AS snippet
FROM knowledge""", "RET-9")
def ret_index_text(spark, d):
    return RT.knowledge_text(_kb(spark, d)).select("id", "search_text", "snippet")


# ---------------------------------------------------------------- stored indexes
def _text_index(spark, docs, text):
    """The index of one text of each document, written and opened again as another session would."""
    path = written_table_dir(spark, "text-index")
    TI.build_index(docs.select(F.col("id").alias("doc_id"), text.alias("text")), path)
    return TI.open_index(spark, path)


@register("ret_index_keyword_search", _KEYWORD_SQL, "RET-2")
def ret_index_keyword_search(spark, d):
    index = _text_index(spark, RT.knowledge_text(_kb(spark, d)), F.col("search_text"))
    return TI.keyword_search(index, _bench_queries(spark, d), k=3)


@register("ret_index_token_overlap", _TOKEN_SQL, "RET-3")
def ret_index_token_overlap(spark, d):
    return TI.overlap(_text_index(spark, _kb(spark, d), F.concat_ws(" ", "content", "title")), _bench_queries(spark, d), True, 5, 0.8, 0.8)


@register("ret_index_substring_overlap", _SUBSTRING_OVERLAP_SQL, "RET-3")
def ret_index_substring_overlap(spark, d):
    return TI.overlap(_text_index(spark, _kb(spark, d), F.concat_ws(" ", "title", "content")), _bench_queries(spark, d), False, 5, 1.0, 0.9)


@register("ret_index_substring_search", _SUBSTRING_SQL, "RET-1")
def ret_index_substring_search(spark, d):
    kb = _kb(spark, d)
    index = _text_index(spark, RT.knowledge_text(kb), F.col("search_text"))
    return TI.substring_search(index, _bench_queries(spark, d), kb).select("query_id", "doc_id", "title", "created_at")


def _vector_index(spark, d):
    """The index of all vectors by label, opened again, and the queries: every vector."""
    e, path = Catalog(spark, d).embeddings, written_table_dir(spark, "vector-index")
    VI.build_index(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label"), path, ["label"])
    return VI.open_index(spark, path), e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "label")


@register("ret_vector_index_exact", _VECTOR_SQL, "RET-4")
def ret_vector_index_exact(spark, d):
    index, queries = _vector_index(spark, d)
    h = VI.search(index, queries, k=5, nprobe=None, exclude_self=True)
    return h.select("query_id", "doc_id", F.round("distance", 4).alias("distance"), F.round("score", 4).alias("score"))


@register("ret_vector_index_recall", """
WITH n AS (SELECT label, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL GROUP BY label)
SELECT sum(n * least(n - 1, 5))::BIGINT AS exact_hits, true AS recall_reached FROM n""", "RET-4")
def ret_vector_index_recall(spark, d):
    """The share of the exact 5 nearest that the probed lists find, over all vectors as queries: 0.9 or more.

    The number of lists is chosen on a sample of the queries."""
    index, queries = _vector_index(spark, d)
    found = VI.search(index, queries, 5, VI.probes_for(index, queries, 0.9, exclude_self=True), exclude_self=True)
    return VI.recall(found, _vector_hits(spark, d)).select("exact_hits", (F.col("recall") >= 0.9).alias("recall_reached"))
