"""Product codes of integer vectors, exact by limb-split matrix products.

Vectors become integers (``floor(scale * x)``) and are cut into equal consecutive parts.  Every part position has a
codebook: it starts as that part of the vectors with the least ids, and each round assigns all parts to their nearest
entry and moves the entries to the floors of their parts' means.  The nearest entry is the first least of
``|x|^2 - 2 x.c + |c|^2`` in 64-bit integers.  The dot products come from float64 matrix products: both sides are broken into limbs of so few
bits that no sum of products reaches 2^53, so each product of limbs is exact, and the products are shifted and added
as 64-bit integers.

A round is one pass of tasks over the integers, which are stored once; a task sends the sums and counts of each entry (a table whose size
depends on the codebooks only), Spark adds them, and the driver holds nothing but codebooks.

Rows whose vector is null, or holds null, NaN or an infinity, are dropped, as are rows whose vector is not as long as the one of
the least id (of lengths that the parts divide), since it has no part at every position.  Null ids come last and repeated ids
are ordered by their integers; all their rows are coded.  Ties go to the lower entry.  Fewer rows than
entries give shorter codebooks.  Null labels are one label.  An empty table gives no rows.  Integers too large for squared distances in 64 bits
raise an error, as Spark's ANSI arithmetic does.  Extra columns are not carried, so their names cannot clash.  Vectors are
fixed-length numbers; no text is read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

NAME = "op11_limb_vector_codes"
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors that a task multiplies at a time.
BLOCK_ROWS = 4096
#: Up to so many labels their sums are broadcast; beyond, they are joined by shuffle.
BROADCAST_LABELS = 50_000


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Digits of integers to the base ``2**bits``, least first, as float64; the last digit carries the sign."""
    out = []
    while len(x) and (x.max() >= 1 << bits or x.min() < -(1 << bits)):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``x @ c.T`` of 64-bit integers by float64 matrix products of limbs."""
    bits = (53 - math.ceil(math.log2(max(x.shape[1], 2)))) // 2
    total = np.zeros((len(x), len(c)), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(c, bits)):
            total += (a @ b.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


def largest_integer(dim: int) -> int:
    """Integers up to this size keep sums of squared differences of whole vectors within 64 bits."""
    return math.isqrt((2**63 - 1) // dim) // 2


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``."""

    entries: np.ndarray

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of every part of integer vectors."""
        parts, _, width = self.entries.shape
        codes, errors = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
        for p, c in enumerate(self.entries):
            mine = x[:, p * width:(p + 1) * width]
            d = (mine * mine).sum(1)[:, None] - 2 * exact_products(mine, c) + (c * c).sum(1)[None]
            codes[:, p] = d.argmin(1)
            errors[:, p] = d[np.arange(len(x)), codes[:, p]]
        return codes, errors

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> "Codebooks":
        """Entries at the floors of their parts' means; unused ones stay."""
        means = sums // np.maximum(counts, 1)[..., None]
        return Codebooks(np.where(counts[..., None] > 0, means, self.entries))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x) of the rows that can be coded, stored once; x are integers."""
    number = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < F.lit(math.inf)))  # NaN is above infinity in Spark's order
    kept = (rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), number.alias("x"))
            .filter(F.col("x").isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0) & finite)
            .withColumn("x", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))))
    kept = stored(kept, "vector-integers")
    first = F.struct(F.col("vec_id").isNull(), "vec_id", -F.size("x"))
    dim = kept.agg(F.min_by(F.size("x"), first).alias("dim")).first()["dim"]
    return kept.filter(F.size("x") == F.lit(dim or 0))


def _vectors(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            flat = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            x = flat.reshape(part.num_rows, -1)
            most = largest_integer(x.shape[1])
            if x.max() > most or x.min() < -most:
                raise ArithmeticError(f"integers beyond {most} overflow 64-bit squared distances")
            yield part, x


def _sums(books: Codebooks):
    """Per task the sum of each entry's parts, position by position, and their count, as (slot, value) rows."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for _, x in _vectors(batches, 0):
            codes, _ = books.assign(x)
            for p in range(parts):
                np.add.at(total[p, :, :width], codes[:, p], x[:, p * width:(p + 1) * width])
                total[p, :, width] += np.bincount(codes[:, p], minlength=entries)
        used = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total.ravel()[used], pa.int64())], names=["slot", "value"])

    return run


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after so many rounds over all vectors; None if there are none."""
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # at most ``entries`` rows
    if not seeds:
        return None
    start = np.array([r["x"] for r in seeds], np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(seeds), parts, -1).transpose(1, 0, 2)))
    for _ in range(rounds):
        shape = books.entries.shape
        total = np.zeros(shape[0] * shape[1] * (shape[2] + 1), np.int64)
        per_task = vectors.select("x").mapInArrow(_sums(books), "slot long, value long")
        for r in per_task.groupBy("slot").agg(F.sum("value").alias("value")).collect():  # one row per number of the codebooks
            total[r["slot"]] = r["value"]
        total = total.reshape(shape[0], shape[1], shape[2] + 1)
        books = books.moved(total[..., :-1], total[..., -1])
    return books


def encode_vectors(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distance to the coded vector."""
    if books.entries.shape[1] > 256:
        raise ValueError("two hex digits name at most 256 entries")
    label = vectors.schema["label"].dataType.simpleString()
    vec_id = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _vectors(batches, 2):
            codes, errors = books.assign(x)
            names = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(errors.sum(1), pa.int64())],
                                             names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "x").mapInArrow(run, f"vec_id {vec_id}, label {label}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add ``label_error``, the error summed over the rows of equal labels."""
    sums = stored(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "vector-label-errors")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    books = train_codebooks(vectors) or Codebooks(np.zeros((PARTS, 0, 1), np.int64))
    coded = stored(encode_vectors(vectors, books), "vector-codes")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """64 components in 16 parts of 4; the nearest entry is the least of distance * 64 + entry."""
    far = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(4))
    xs = ", ".join(f"x{i}" for i in range(4))

    def nearest(book: str) -> str:
        return (f"SELECT a.rid, a.p, {', '.join(f'any_value(a.x{i}) AS x{i}' for i in range(4))}, min(({far}) * 64 + b.e) AS m "
                f"FROM parts a JOIN {book} b ON a.p = b.p GROUP BY a.rid, a.p")

    def moved(assigned: str, book: str) -> str:
        mean = ", ".join(f"CASE WHEN s.n IS NULL THEN b.x{i} ELSE (s.x{i} - ((s.x{i} % s.n) + s.n) % s.n) // s.n END AS x{i}" for i in range(4))
        sums = ", ".join(f"sum(x{i})::BIGINT AS x{i}" for i in range(4))
        return (f"SELECT b.p, b.e, {mean} FROM {book} b LEFT JOIN (SELECT p, m & 63 AS e, count(*) AS n, {sums} FROM {assigned} "
                f"GROUP BY p, m & 63) s ON b.p = s.p AND b.e = s.e")

    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (SELECT rid, p, {', '.join(f'v[4 * p + {i + 1}] AS x{i}' for i in range(4))} FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS MATERIALIZED (SELECT p, rid AS e, {xs} FROM parts WHERE rid < 64),
a0 AS MATERIALIZED ({nearest('b0')}),
b1 AS MATERIALIZED ({moved('a0', 'b0')}),
a1 AS MATERIALIZED ({nearest('b1')}),
b2 AS MATERIALIZED ({moved('a1', 'b1')}),
a2 AS MATERIALIZED ({nearest('b2')}),
coded AS (SELECT rid, string_agg(printf('%02x', (m & 63)::INT), '' ORDER BY p) AS code, sum(m >> 6)::BIGINT AS error FROM a2 GROUP BY rid),
book AS (SELECT sha256(string_agg(concat_ws(',', {xs}), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, book.codebooks_sha256
FROM kept k JOIN coded c USING (rid), book
"""


SQL = _sql()
