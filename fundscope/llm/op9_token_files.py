"""Token ids as ORC files, read back by stripe.

``write_token_files`` sorts documents by id over the cluster, encodes them and
writes one ORC file per partition: one row per document with its ids as an integer
list, which ORC stores run-length encoded, in stripes with row indexes (least and
greatest id per stride) and a Bloom filter on ``doc_id``.  ``read_token_files`` reads them in
parallel by stripe; a filter on ``doc_id`` skips files, stripes and row groups by that
metadata.  Rows carry their file's number and the ids before them in the file, so a
document's global start is one sum over the files' totals.

Encoding is per piece with a bounded memory of encoded pieces: the tokenizer drops white space,
cuts text into letters, digits and marks and encodes each by itself, so a text's ids are its
pieces' ids joined (tests compare with whole-text encoding).

Nulls: a null text is empty and gets the end id only; null ids sort first.  Repeated
ids keep all their rows, ordered by text.  Empty input writes no rows and reads as none.
Extra columns of the input are not written.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_by_worker, shared_dir, slices, table

NAME = "op9_orc_tokens"
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Encoded pieces that a worker remembers before it starts afresh.
REMEMBERED = 300_000
ROW_STRIDE = 1_000
STRIPE_BYTES = 16 << 20
SCHEMA = "doc_id long, file int, before long, n_tokens int, ids array<int>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Text whose normal form and pieces are plain to see: ASCII and Latin-1 letters, digits, white space, marks but ' and <.
_SIMPLE = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!-&(-;=-@\[-`{-~ \t\n\r\f\v]*")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class _Pieces(dict):
    """Ids of pieces as bytes; a piece not met before is encoded by the tokenizer's model."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        found = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    Simple text is cut into letters, digits and marks as the tokenizer cuts it, and the tokenizer's
    model encodes each piece once.  Of other text, the chunks between white space that are simple are
    encoded so, and the rest by the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces, self.remembered = _Pieces(self.tokenizer.model), remembered
        self.by_piece = _cuts_like_pieces(self.tokenizer)

    def _chunk(self, text: str) -> bytes:
        if self.by_piece and _SIMPLE.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.pieces) > self.remembered:
            self.pieces.clear()
        if self.by_piece and _SIMPLE.fullmatch(text):
            return self._chunk(text)
        chunks = text.encode("utf-8", "replace").split()
        return b"".join([self._chunk(c.decode("utf-8", "replace")) for c in chunks])


def _cuts_like_pieces(tokenizer) -> bool:
    """Whether the tokenizer encodes simple chunks piece by piece, seen on one that has every kind."""
    probe = "Ab9é##Çx12!?zÀ"
    e = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(probe)) if tokenizer.pre_tokenizer and tokenizer.normalizer else []
    letters = _byte_letters()
    return [x for x, _ in e] == [p.encode().decode("latin-1").translate(letters) for p in _PIECES.findall(probe.lower())]


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker; it outlives a task."""
    return held_by_worker(NAME, path, lambda: ChunkEncoder(path))


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before, number = encoder(path), 0, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for part in slices(batches, owner=NAME):
            each = [coder.encode(t) + end for t in part.column(1).to_pylist()]
            n = np.array([len(b) // 4 for b in each], np.int64)
            stops = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)),
                                           pa.array(np.frombuffer(b"".join(each), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.full(len(n), number, np.int32)), pa.array(before + stops - n),
                 pa.array(n.astype(np.int32)), ids], names=["doc_id", "file", "before", "n_tokens", "ids"])
            before += int(stops[-1])

    return run


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Encode ``docs`` into ORC files under ``path``, ascending in ``id_col`` over all files."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc()]
    encoded = (rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
               .mapInArrow(_encode(tokenizer or tokenizer_path(), end_id), SCHEMA))
    (encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_STRIDE))
     .option("orc.stripe.size", str(STRIPE_BYTES)).option("compression", "zstd").orc(path))
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written, with ``start``: ids of all documents before the row."""
    rows = spark.read.schema(SCHEMA).orc(path)
    ends = rows.groupBy("file").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total")).collect()
    # one number per file: a bounded table, far smaller than the file listing itself
    first, at = [], 0
    for r in sorted(ends, key=lambda r: r["file"]):
        first.append((r["file"], at))
        at += r["total"]
    firsts = spark.createDataFrame(first, "file int, first long")
    return rows.join(F.broadcast(firsts), "file").withColumn("start", F.col("first") + F.col("before")).drop("first")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()),
                                          pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded_files(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to a fresh folder in the shared space and read the digests back."""
    spark = docs.sparkSession
    path = write_token_files(docs, f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}")
    return digests(read_token_files(spark, path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_files(table(spark, sf_dir, "documents"))


SQL = None
