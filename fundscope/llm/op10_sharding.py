"""Sharding by jump consistent hashing, in DataFrame functions only.

A key's shard for ``n`` shards is the last stop below ``n`` of a chain that
starts at 0 and jumps from stop ``b`` to ``floor((b + 1) / r)``, with ``r`` a
uniform number in (0, 1] drawn from the key and ``b`` alone.  The chain does not
depend on ``n``, so going from ``n`` to ``n + 1`` shards moves a row only if ``n``
itself is a stop: about 1 row in ``n + 1`` moves, always into the new shard.  No
ring table exists and no row looks at another one.

Rows are numbered inside their shard without putting a shard into one task: a
hash of the key cuts every shard into pieces, counts of the pieces give each piece its first
slot, and only rows of one piece are sorted together.

Nulls: a null key is hashed as the empty string; a null payload has no bytes.
Repeated keys share a shard and get slots of their own.  Empty input gives no
rows.  Columns of the input that clash with the added names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

NAME = "op10_jump_sharding"
SHARDS = 40
#: Rows that one piece of a shard should hold.
PIECE_ROWS = 50_000


def _uniform(key: Column, stop: Column) -> Column:
    """(0, 1], from the first 52 bits of an MD5 of key and stop."""
    digest = F.md5(F.concat(key, F.lit(":"), stop.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(2**52))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard in [0, shards) of a string key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key, F.lit(""))
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).cast("double").alias("next"))

    def step(state, b):
        jump = F.struct(b.alias("at"), F.floor((b + 1) / _uniform(key, b)).cast("double").alias("next"))
        return F.when(state["next"] == b.cast("double"), jump).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, step, lambda s: s["at"])


def with_slots(df: DataFrame, shard: str, order: list[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``slot``: 0, 1, ... without gaps in every shard.

    A shard is cut into pieces by a hash of the ordering columns; slots run piece
    after piece and in ``order`` inside a piece.  The number of pieces follows the
    row count, so no task sorts more than about ``piece_rows`` rows.
    """
    pieces = max(1, -(-df.count() // piece_rows))
    cut = df.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)))
    counts = cut.groupBy(shard, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col(shard).alias("_s"), F.col("_piece").alias("_p"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(shard, "_piece").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = cut.withColumn("_i", F.row_number().over(inside) - 1)
    return (numbered.join(firsts, F.col(shard).eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_p")))
            .withColumn("slot", (F.col("_first") + F.col("_i")).cast("long"))
            .drop("_piece", "_i", "_s", "_p", "_first"))


def assign_shards(df: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (the shard once one more is appended)."""
    text_key = F.col(key).cast("string")
    return (df.withColumn("shard", jump_shard(text_key, shards).cast("int"))
            .withColumn("grown_shard", jump_shard(text_key, shards + 1).cast("int")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    placed = with_slots(assign_shards(rows, "doc_id"), "shard", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


SQL = None
