"""A stored inverted index over texts: postings by term, and n-grams of the vocabulary for parts of words.

``build_index`` lower-cases each text, splits it at ASCII white space and writes, once,

* ``vocabulary``: every distinct term with the number of its documents;
* ``postings``: per term and chunk of documents the ids of the documents that hold the term.  A chunk is a hash range of
  documents of about ``CHUNK_DOCS``, so a term that all documents hold is many rows, never one;
* ``chunks``: the ids of each chunk's documents, in order;
* ``grams``: for every 1, 2 and 3 characters in a row, the folders whose terms hold them.

All but the chunks lie in folders by a hash of their key and are sorted by it; a term's folder is the same in vocabulary and postings.
A search reads only the folders of its terms, as partition filters, and inside them the row groups that hold a term.  Texts are read by
``substring_search`` alone, to verify the candidates it found in the postings.

A keyword without white space is part of a text just if it is part of one of its terms.  So keywords as substrings
are looked for in the terms of the folders that hold all their grams, by an automaton of a block's keywords.

The postings of a chunk meet a block of queries in a cell.  There a keyword's postings are put together once, however many terms hold it and
however many queries ask for it, and each query's documents are counted; the k best leave the cell.  So a search shuffles the postings it
reads once per block of queries, and k x queries x chunks rows after that.

The k best documents of a query are found in two passes.  The first counts the query's rarest keywords, those beyond the
``COMMON`` share of its weight.  If the k-th best partial count exceeds what the common keywords could add, no
document outside the first pass can enter, and the common keywords are counted only for the documents that can still
reach the k-th count.  Otherwise they are counted whole.  The result is the same as that of the scans in ``retrieval``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import retrieval as RT

#: Documents of a chunk, about; folders of each table, at most, and documents for one more.
CHUNK_DOCS, PARTS, PART_DOCS = 8_192, 256, 4_096
#: The share of a query's keywords, the most frequent ones, that the first pass leaves out.
COMMON = 0.25
#: Up to so many looked-up keys also become a filter on the key, so that row groups are skipped by their statistics.
PUSHED_KEYS = 2_000
#: Up to so many keywords also become a filter on the terms that hold them.
PUSHED_WORDS = 32
GRAM = 3
#: Keywords that more than one document of a chunk in so many holds are a row of flags, others lists of documents.
DENSE = 64
#: Rows that leave a cell at a time, about.
OUT_ROWS = 50_000


_SCHEMAS = {"postings": "key string, chunk int, docs array<ID>", "vocabulary": "key string, n_docs long",
            "grams": "key string, folder int"}


@dataclass(frozen=True)
class TextIndex:
    path: str
    chunks: int
    parts: int
    id_type: str

    def table(self, spark: SparkSession, name: str, keys: DataFrame | None = None) -> DataFrame:
        """A table of the index; with ``keys`` (one text column ``key``) only the folders and row groups of those keys."""
        rows = spark.read.schema(f"{_SCHEMAS[name].replace('ID', self.id_type)}, part int").parquet(f"{self.path}/{name}")
        if keys is None:
            return rows
        folders = [r[0] for r in keys.select(part_of(F.col("key"), self.parts)).distinct().collect()]  # at most ``parts``
        rows = rows.where(F.col("part").isin(folders)) if folders else rows.where(F.lit(False))
        few = [r[0] for r in keys.select("key").distinct().limit(PUSHED_KEYS + 1).collect()]
        return rows.where(F.col("key").isin(few)) if 0 < len(few) <= PUSHED_KEYS else rows


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def terms_of(text: Column) -> Column:
    """Distinct non-empty lower-case terms."""
    return RT._words(F.lower(F.coalesce(text, F.lit(""))))


def grams_of(term: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters."""
    n = F.char_length(term)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(term, i, F.lit(size))))) \
        .otherwise(F.array().cast("array<string>"))


def _write(rows: DataFrame, path: str, parts: int) -> None:
    """In folders by the hash of ``key``, sorted by it; a folder is cut by ranges of keys into several files where it is large."""
    rows = rows.withColumn("part", part_of(F.col("key"), parts))
    (rows.repartitionByRange("part", "key").sortWithinPartitions("part", "key").write.partitionBy("part")
     .option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.block.size", str(8 << 20)).parquet(path))


def build_index(docs: DataFrame, path: str, parts: int | None = None, chunk_docs: int = CHUNK_DOCS) -> TextIndex:
    """Write an index of ``docs(doc_id, text)`` under ``path``; null texts hold no terms, null ids are left out."""
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull())
    n = docs.count()
    chunks, parts = max(1, -(-n // chunk_docs)), parts or max(4, min(PARTS, n // PART_DOCS))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk")
    held = docs.select("doc_id", chunk, F.explode(terms_of(F.col("text"))).alias("key"))
    index = TextIndex(path, chunks, parts, docs.schema["doc_id"].dataType.simpleString())
    # at most a chunk's documents in a group; repeated ids are one document
    postings = held.groupBy("key", "chunk").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))
    _write(postings, f"{path}/postings", parts)
    _write(index.table(spark, "postings").groupBy("key").agg(F.sum(F.size("docs").cast("long")).alias("n_docs")), f"{path}/vocabulary", parts)
    (docs.select("doc_id", chunk).groupBy("chunk").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))
     .write.parquet(f"{path}/chunks"))  # at most a chunk's documents in a group
    grams = F.concat(*(grams_of(F.col("key"), size) for size in range(1, GRAM + 1)))
    # a folder's terms lie together, so the pairs are few before they are shuffled
    _write(index.table(spark, "vocabulary").select(F.col("part").alias("folder"), F.explode(grams).alias("key")).distinct(), f"{path}/grams", parts)
    spark.createDataFrame([(chunks, parts, index.id_type)], "chunks int, parts int, id_type string").coalesce(1).write.parquet(f"{path}/about")
    return index


def open_index(spark: SparkSession, path: str) -> TextIndex:
    about = spark.read.parquet(f"{path}/about").first()
    return TextIndex(path, about["chunks"], about["parts"], about["id_type"])


# ---------------------------------------------------------------- looking up
def _whole(index: TextIndex, words: DataFrame) -> DataFrame:
    """Postings of the words (``key``) that are terms themselves."""
    return index.table(words.sparkSession, "postings", words).join(words.select("key"), "key", "left_semi")


def _folders(index: TextIndex, words: DataFrame) -> DataFrame:
    """The folders (``folder``) where some word (``key``) may be inside a term: those that hold all its grams."""
    words = words.select(F.col("key").alias("word"))
    size = F.least(F.char_length("word"), F.lit(GRAM))
    grams = words.select("word", F.explode(F.when(size == 1, F.array("word")).when(size == 2, grams_of(F.col("word"), 2))
                                           .otherwise(grams_of(F.col("word"), GRAM))).alias("key"))
    asked = grams.groupBy("word").agg(F.count("*").alias("n"))
    held = grams.join(index.table(words.sparkSession, "grams", grams).select("key", "folder"), "key").groupBy("word", "folder").agg(F.count("*").alias("found"))
    return held.join(asked, "word").where(F.col("found") == F.col("n")).select("folder").distinct()


def _inside(index: TextIndex, words: DataFrame) -> DataFrame:
    """Postings among which are those of all terms that hold a word (``key``) anywhere inside; the cells drop the others."""
    folders = [r[0] for r in _folders(index, words).collect()]  # at most ``parts``
    rows = index.table(words.sparkSession, "postings")
    rows = rows.where(F.col("part").isin(folders)) if folders else rows.where(F.lit(False))
    few = [r[0] for r in words.limit(PUSHED_WORDS + 1).collect()]
    return rows.where(reduce(lambda a, b: a | b, [F.contains(F.col("key"), F.lit(w)) for w in few])) if 0 < len(few) <= PUSHED_WORDS else rows


class _Cell:
    """A block of queries and the postings of a chunk: the documents of each query, counted."""

    def __init__(self, whole: bool, k: int | None, every: bool, common: float):
        self.whole, self.k, self.every, self.common = whole, k, every, common
        self.queries, self.place, self.find = [], {}, None

    def ask(self, query_id, words: list, weights: list, bounds: list) -> None:
        self.queries.append((query_id, [self.place.setdefault(w, len(self.place)) for w in words], weights, bounds))

    def documents(self, ids: pa.Array) -> None:
        """The chunk's documents, in the order of their ids, after all queries."""
        self.ids = ids
        #: Of the postings that hold a keyword: documents' places and how many a posting has; (keyword, posting) pairs.
        self.docs, self.lengths, self.words, self.postings, self.seen = [], [], [], [], 0
        if self.whole:
            self.find = lambda term: (self.place[term],) if term in self.place else ()
        else:
            import ahocorasick
            automaton = ahocorasick.Automaton()
            for w, i in self.place.items():
                automaton.add_word(w, i)
            automaton.make_automaton()
            self.find = lambda term: {i for _, i in automaton.iter(term)}

    def add(self, terms: list, docs: pa.ListArray) -> None:
        if self.find is None:  # no query, or no document
            return
        found = [self.find(term) for term in terms]
        words = np.array([len(x) for x in found], np.int64)
        rows = np.flatnonzero(words)
        docs = docs.take(pa.array(rows))
        self.docs.append(pc.index_in(docs.flatten(), value_set=self.ids).to_numpy(zero_copy_only=False).astype(np.int32))
        self.lengths.append(pc.list_value_length(docs).to_numpy(zero_copy_only=False).astype(np.int32))
        self.words.append(np.fromiter((i for x in found for i in x), np.int32, words.sum()))
        self.postings.append(np.repeat(np.arange(self.seen, self.seen + len(rows), dtype=np.int32), words[rows]))
        self.seen += len(rows)

    def _put_together(self) -> None:
        """``held``: by keyword, flags or documents; ``size``: how many documents hold it."""
        n, self.held, self.size = len(self.ids), [], []
        docs, lengths, words, postings = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (self.docs, self.lengths, self.words, self.postings))
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        by_word = postings[np.argsort(words, kind="stable")]
        ends = np.cumsum(np.bincount(words, minlength=len(self.place)))
        for start, end in zip([0, *ends], ends):
            mine = by_word[start:end]
            size = lengths[mine]
            before = np.cumsum(size) - size
            flags = np.zeros(n, bool)
            flags[docs[np.repeat(starts[mine] - before, size) + np.arange(size.sum())]] = True
            found = np.flatnonzero(flags)
            self.held.append(flags if len(found) * DENSE > n else found.astype(np.int32))
            self.size.append(len(found))
        self.docs = self.lengths = self.words = self.postings = None

    def _count(self, total: np.ndarray, words: list) -> None:
        for i, weight in words:
            if self.held[i].dtype == bool:
                total += self.held[i] * np.int64(weight)
            else:
                total[self.held[i]] += weight  # a document is in a list once

    def _hits(self, words: list, weights: list, least: int) -> np.ndarray:
        asked = sorted(((i, w) for i, w in zip(words, weights) if self.size[i]), key=lambda x: self.size[x[0]])
        total = np.zeros(len(self.ids), np.int64)
        if not self.k:
            self._count(total, asked)
            return total
        after, split = sum(w for _, w in asked), len(asked)
        most = after * self.common
        for j, (_, w) in enumerate(asked):
            if after <= most:
                split = j
                break
            after -= w
        left_out = sum(w for _, w in asked[split:])
        self._count(total, asked[:split])
        kth = min(least, int(np.partition(total, -self.k)[-self.k])) if len(total) >= self.k else 0
        if kth > left_out:  # who has none of the rare keywords cannot enter
            able = np.flatnonzero(total + left_out >= kth)
            for i, w in asked[split:]:
                total[able] += w * (self.held[i][able] if self.held[i].dtype == bool else np.isin(able, self.held[i]))
        else:
            self._count(total, asked[split:])
        return total

    def rows(self) -> Iterator[tuple]:
        """Per query and bound (query_id, bound's number, documents' places, hits, hits that count)."""
        if self.find is None:
            return
        self._put_together()
        for query_id, words, weights, bounds in self.queries:
            total = self._hits(words, weights, min(bounds))
            if not self.k:
                at = np.flatnonzero(total == sum(weights) if self.every else total)
                yield query_id, 0, at, total[at], total[at]
                continue
            for b, bound in enumerate(bounds):
                counted = np.minimum(total, bound)
                at = np.flatnonzero(counted)
                if len(at) > self.k:
                    kth = np.partition(counted, -self.k)[-self.k]
                    over = np.flatnonzero(counted > kth)
                    at = np.concatenate([over, np.flatnonzero(counted == kth)[:self.k - len(over)]])
                yield query_id, b, at, total[at], counted[at]


def _met(whole: bool, k: int | None, every: bool, common: float, schema: pa.Schema):
    """A ``mapInArrow`` function over cells: their queries, then their documents' ids, then their postings."""

    def left(cell: _Cell) -> Iterator[pa.RecordBatch]:
        def batch(some):
            ids = cell.ids.take(pa.array(np.concatenate([r[2] for r in some])))
            numbers = [pa.array(np.concatenate([r[c] for r in some]), pa.int64()) for c in (3, 4)]
            of = [len(r[2]) for r in some]
            queries = pa.array([q for r, n in zip(some, of) for q in [r[0]] * n], schema.field("query_id").type)
            bounds = pa.array(np.repeat([r[1] for r in some], of), pa.int32())
            return pa.RecordBatch.from_arrays([queries, bounds, ids.cast(schema.field("doc_id").type), *numbers], schema=schema)

        some, n = [], 0
        for row in cell.rows():
            if len(row[2]):
                some.append(row)
                n += len(row[2])
            if n >= OUT_ROWS:
                yield batch(some)
                some, n = [], 0
        if some:
            yield batch(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, None
        for rows in batches:
            names = rows.schema.names
            column = lambda name, part: part.column(names.index(name))
            block, chunk, kind = (column(c, rows).to_numpy(zero_copy_only=False) for c in ("block", "chunk", "kind"))
            ends = [*(1 + np.flatnonzero((np.diff(block) != 0) | (np.diff(chunk) != 0) | (np.diff(kind) != 0))).tolist(), rows.num_rows]
            start = 0
            for end in ends if rows.num_rows else ():
                if now != (block[start], chunk[start]):
                    if cell is not None:
                        yield from left(cell)
                    now, cell = (block[start], chunk[start]), _Cell(whole, k, every, common)
                part = rows.slice(start, end - start)
                if kind[start] == 0:
                    for r in zip(*(column(c, part).to_pylist() for c in ("query_id", "words", "weights", "bounds"))):
                        cell.ask(*r)
                elif kind[start] == 1:
                    if cell.queries:
                        cell.documents(column("docs", part).flatten())
                else:
                    cell.add(column("term", part).to_pylist(), column("docs", part))
                start = end
        if cell is not None:
            yield from left(cell)
    return run


def term_hits(index: TextIndex, queries: DataFrame, whole: bool, k: int | None = None, cap: float | None = None, every: bool = False) -> DataFrame:
    """``query_id, doc_id, hits``: how many of the query's ``terms`` (an array) a document holds, where any.

    ``whole``: as its words; else anywhere inside it.  A term given twice counts twice.  With ``k``, the k documents
    of most hits per query, the least ids of equals; documents that hold the share ``cap`` of the terms or more are equals.
    ``every``: only documents that hold all terms."""
    spark = queries.sparkSession
    if k:
        queries = queries.where(F.col("query_id").isNotNull())
    # a share within the sixth digit of the cap is rounded to it
    bound = F.greatest(F.ceil(F.size("terms") * (F.lit(cap) - 4e-7)), F.lit(1)).cast("long") if cap is not None else F.lit((1 << 62)).cast("long")
    words = (queries.select("query_id", F.explode("terms").alias("key")).where(F.length("key") > 0)
             .groupBy("query_id", "key").agg(F.count("*").alias("weight")))
    words = words.groupBy("query_id").agg(F.collect_list(F.struct("key", "weight")).alias("w"))  # a query's own words
    bounds = queries.where(F.size("terms") > 0).groupBy("query_id").agg(F.sort_array(F.collect_set(bound)).alias("bounds"))
    asked = _kept(words.join(bounds, words["query_id"].eqNullSafe(bounds["query_id"])).select(
        words["query_id"], F.col("w.key").alias("words"), F.col("w.weight").alias("weights"), "bounds"), "text-asked")
    keys = _kept(asked.select(F.explode("words").alias("key")).distinct(), "text-words")
    chars = F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // RT.BLOCK_QUERIES), -(-size["chars"] // RT.BLOCK_CHARS))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ids = f"array<{index.id_type}>"
    none = {"query_id": asked.schema["query_id"].dataType, "words": "array<string>", "weights": "array<bigint>", "bounds": "array<bigint>", "term": "string", "docs": ids}
    columns = ["block", "chunk", "kind", *none]

    def cells(rows: DataFrame, kind: int) -> DataFrame:
        # empty arrays, not nulls: Arrow fills a list column's nulls again for every row that is added
        given = {**{c: F.array() if str(t).startswith("array") else F.lit(None) for c, t in none.items()}, "kind": F.lit(kind)}
        return rows.select(*[F.col(c) if c in rows.columns else given[c].cast(none.get(c, "int")).alias(c) for c in columns])

    # a row of queries' words, postings and documents' ids, each cell together
    by_query = asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).select("*", numbers(index.chunks).alias("chunk"))
    by_chunk = spark.read.schema(f"chunk int, docs {ids}").parquet(f"{index.path}/chunks").select("*", numbers(blocks).alias("block"))
    lists = (_whole if whole else _inside)(index, keys).select(F.col("key").alias("term"), "chunk", "docs", numbers(blocks).alias("block"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * index.chunks)
    met = (cells(by_query, 0).unionByName(cells(by_chunk, 1)).unionByName(cells(lists, 2))
           .repartition(parts, "block", "chunk").sortWithinPartitions("block", "chunk", "kind"))
    types = RT._arrow_type(asked, "query_id"), RT._arrow_type(spark.createDataFrame([], f"doc_id {index.id_type}"), "doc_id")
    out = pa.schema([("query_id", types[0][1]), ("bound", pa.int32()), ("doc_id", types[1][1]), ("hits", pa.int64()), ("counted", pa.int64())])
    hits = met.mapInArrow(_met(whole, k, every, COMMON, out), f"query_id {types[0][0]}, bound int, doc_id {types[1][0]}, hits long, counted long")
    if not k:
        return hits.select("query_id", "doc_id", "hits")
    best = Window.partitionBy("query_id", "bound").orderBy(F.col("counted").desc(), "doc_id")
    hits = hits.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k)
    return hits.select("query_id", "doc_id", "hits").distinct()


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """Small tables of a search, written once: the folders to read are found from them before the postings are planned."""
    from ..session import written_table_dir
    path = written_table_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# ---------------------------------------------------------------- searches
def keyword_search(index: TextIndex, queries: DataFrame, k: int | None = 3) -> DataFrame:
    """As ``retrieval.keyword_search``, from an index of the search text."""
    scored = term_hits(index, RT.query_keywords(queries), False, k).withColumnRenamed("hits", "score")
    return RT._top_per_query(scored, k, F.col("score").desc(), F.col("doc_id"))


def overlap(index: TextIndex, queries: DataFrame, whole: bool, k: int | None, weight: float, cap: float) -> DataFrame:
    """As ``retrieval.token_overlap`` (whole, 0.8, 0.8) and ``retrieval.substring_overlap`` (not whole, 1.0, 0.9)."""
    terms = queries.select("query_id", RT._words(F.lower("query")).alias("terms"))
    hits = term_hits(index, terms, whole, k, cap / weight)
    out = hits.join(terms.select("query_id", F.size("terms").alias("n")), "query_id").select(
        "query_id", "doc_id", F.col("hits").alias("overlap"),
        F.round(F.least(F.col("hits") / F.col("n") * weight, F.lit(cap)), 6).alias("score"))
    return RT._top_per_query(out, k, F.col("score").desc(), F.col("doc_id"))


def substring_search(index: TextIndex, queries: DataFrame, kb: DataFrame, k: int | None = None) -> DataFrame:
    """As ``retrieval.substring_search``: candidates are the documents that hold all words of the query, verified on their texts.

    Queries of white space only have no word and are looked for in all texts."""
    needles = _kept(queries.where(F.length("query") > 0).select("query_id", F.lower("query").alias("needle"), RT._words(F.lower("query")).alias("terms")), "text-needles")
    asked = needles.select(F.col("needle").alias("query_id"), "terms").distinct()
    candidates = _kept(term_hits(index, asked, False, every=True).select(F.col("query_id").alias("needle"), "doc_id"), "text-candidates")
    docs = RT.knowledge_text(kb).select(F.col("id").alias("doc_id"), "title", "created_at", F.lower("search_text").alias("text"))
    out = (candidates.join(docs, "doc_id").where(F.contains(F.col("text"), F.col("needle")))
           .join(needles.where(F.size("terms") > 0).select("query_id", "needle"), "needle").select("doc_id", "query_id", "title", "created_at"))
    blank = needles.where(F.size("terms") == 0).select("query_id", F.col("needle").alias("query"))
    if blank.limit(1).count():
        out = out.unionByName(RT.substring_search(blank, kb).select(out.columns))
    return RT._top_per_query(out, k, F.col("created_at").desc(), F.col("doc_id"))
