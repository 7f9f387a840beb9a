"""What filters remove alone, together and in which order: an audit by contingency tensors.

Every document fails or passes each of five filters, so each part of the corpus (a language) has a table of 2x2x2x2x2 counts, one of
all documents and one each of the labelled good and toxic ones.  Spark counts these cells; nothing else about the documents is
needed to tell what any order of the filters does.  A step of an order picks along each axis the passing documents, the failing ones or all, and one
``einsum`` with the picks of all 120 x 5 steps contracts the tensors of many parts at once, in exact integers.

The filters of the query: A few words, B repeated words, C capitals, D special marks, E a text that a smaller id
has already.  The text is read once, into a narrow stored table of flags and a 256-bit hash.  The least id of each hash is an aggregate; a document passes E
if it is that least id, found by a join on hash *and* id, so that a third of all rows with one text spread over the tasks.

Null texts are empty (and equal to empty ones); a null part is the empty string, one part with it.  A null id is neither smaller nor larger than any:
it passes E, has no labels and hides no copy.  Repeated ids are not smaller than each other; a label counts if any row of its id says so.
Texts of any length are read whole.  Ties cannot occur: the steps are counts.  An empty table gives no rows.  Extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

NAME = "op12_filter_interactions"
LETTERS = "ABCDE"
#: Parts whose tensors are contracted at a time.
BLOCK_PARTS = 64
MEASURES = ("n", "good", "toxic")
STEPS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text; ``words`` is the array of its words."""
    n = F.size(words)
    return {"A": n < 100,
            "B": F.size(F.array_distinct(words)) * 100 < n * 80,
            "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 10,
            "D": text.rlike(r"[#$%&*|]")}


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
            failures: Callable[[Column, Column], dict[str, Column]] = text_failures) -> DataFrame:
    """(id, part, mask, same): a bit for each filter of one text that the document fails, and the hash of its text; stored."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    mask = F.lit(0)
    for letter, fails in failures(F.col("text"), F.col("words")).items():
        mask = mask + F.when(fails, 1 << LETTERS.index(letter)).otherwise(0)
    return stored(rows.select("id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("same")), "audit-flags")


def with_repeats(rows: DataFrame) -> DataFrame:
    """Set the bit E of rows whose text a smaller id has; rows have ids."""
    least = rows.groupBy("same").agg(F.min("id").alias("_least")).withColumnRenamed("same", "_same")
    first = rows.join(least, (F.col("same") == F.col("_same")) & (F.col("id") == F.col("_least")), "left")
    bit = F.when(F.col("_least").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    return first.select("id", "part", (F.col("mask") + bit).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): of each part the list of its (mask, n, good, toxic), at most 32."""
    known, unknown = rows.filter(F.col("id").isNotNull()), rows.filter(F.col("id").isNull())
    marks = (labels.filter(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
             .groupBy(F.col("doc_id").alias("_id"))
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")))
    marked = with_repeats(known).join(marks, F.col("id") == F.col("_id"), "left")
    every = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
                                               F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    none = F.lit(0).cast("long")
    every = every.unionByName(unknown.groupBy("part", "mask").agg(F.count("*").alias("n"), none.alias("good"), none.alias("toxic")))
    summed = every.groupBy("part", "mask").agg(*(F.sum(m).alias(m) for m in MEASURES))
    return summed.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))


def picks(order: tuple[int, ...], step: int, own: tuple[int, int]) -> list[tuple[int, int]]:
    """What a step takes along each axis: of earlier filters the passing, of its own as asked, of later ones all."""
    out = [ALL] * len(order)
    for f in order[:step]:
        out[f] = PASS
    out[order[step]] = own
    return out


class StepTable:
    """The picks of every step of every order, and the contractions with them."""

    def __init__(self, n: int = len(LETTERS)):
        self.orders = list(permutations(range(n)))
        steps = [(o, k) for o in self.orders for k in range(n)]
        self.names = ["".join(LETTERS[f] for f in o) for o, _ in steps]
        self.numbers = [k + 1 for _, k in steps]
        self.own = np.array([o[k] for o, k in steps])
        self.keep = np.array([picks(o, k, PASS) for o, k in steps], np.int64)
        self.drop = np.array([picks(o, k, FAIL) for o, k in steps], np.int64)
        self.fail = np.array([[FAIL if f == g else ALL for g in range(n)] for f in range(n)], np.int64)
        self.alone = np.array([[FAIL if f == g else PASS for g in range(n)] for f in range(n)], np.int64)

    @staticmethod
    def contract(tensors: np.ndarray, picked: np.ndarray) -> np.ndarray:
        """Sums [part, row of picks] of tensors [part, 2, 2, 2, 2, 2]."""
        return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensors, *(picked[:, f] for f in range(picked.shape[1])), optimize=True)

    def counts(self, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
        removed, failing = self.contract(n, self.drop), self.contract(n, self.fail)
        by_filter = np.stack([removed[:, self.own == f].sum(1) for f in range(len(self.fail))], 1)
        return {"kept": self.contract(n, self.keep), "removed": removed, "redundant": failing[:, self.own] - removed,
                "unique_fails": self.contract(n, self.alone)[:, self.own], "good_lost": self.contract(good, self.drop),
                "toxic_lost": self.contract(toxic, self.drop), "shapley": by_filter[:, self.own]}


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = StepTable()
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_PARTS):
            block = batch.slice(at, BLOCK_PARTS).to_pylist()
            flat = np.zeros((len(MEASURES), len(block), 2 ** len(LETTERS)), np.int64)
            for i, row in enumerate(block):
                for cell in row["cells"]:
                    flat[:, i, cell["mask"]] = [cell[m] for m in MEASURES]
            # bit f of a mask is axis f: the highest bit is the first axis of the reshaped cells
            tensors = flat.reshape(len(MEASURES), len(block), *[2] * len(LETTERS)).transpose(0, 1, *range(1 + len(LETTERS), 1, -1))
            counts = steps.counts(*tensors)
            parts = np.repeat([r["part"] for r in block], len(steps.names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts.tolist(), pa.string()), pa.array(steps.names * len(block)), pa.array(steps.numbers * len(block), pa.int32()),
                 *(pa.array(c.ravel(), pa.int64()) for c in counts.values())], names=["part", "filter_order", "step", *counts])


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row per part, order of the filters and step."""
    return cells(flagged(docs, **columns), labels).select("part", "cells").mapInArrow(_steps, STEPS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM w LEFT JOIN marks m ON w.doc_id = m.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND a.f <> e.f AND b.f <> c.f AND b.f <> d.f AND b.f <> e.f AND c.f <> d.f AND c.f <> e.f AND d.f <> e.f),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i::INT, 1)) - 65))) AS before
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT c.part, s.filter_order, s.step, s.f,
    sum(CASE WHEN mask & (own | coalesce(before, 0)::INT) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0)::INT > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0)::INT = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0)::INT = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY c.part, s.filter_order, s.step, s.f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
