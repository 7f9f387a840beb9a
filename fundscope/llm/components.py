"""Connected components of a table of links, by alternating star contraction.

Each round points every node's larger neighbours (then its smaller ones) at the least
node of the neighbourhood; stars remain after a number of rounds that grows with the
logarithm of the links.  Links stay in tables in the shared folder; only counts come to the
driver.  Least neighbours are found by an aggregate with map-side combine, so a node with very many
links is no single task's work beyond one join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction of links (a, b), a > b."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        out = (links.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the least node of its component."""
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = stored(ordered, "links"), None
    for _ in range(ROUNDS):
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was or mark[0] == 0:
            break
        now = stored(_star(_star(now, True), False), "links")
    else:
        raise RuntimeError("components did not settle")
    # all links now end at roots
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
