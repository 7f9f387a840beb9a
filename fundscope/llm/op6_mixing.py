"""Mixing sources to target weights by Pareto order sampling.

``source_targets`` turns weights into word targets: every source may give at most
``cap`` times its own words, and what a capped source cannot give is reshared by
weight among the others until none is above its cap.

A target of ``r`` times a source's size means ``floor(r)`` whole copies of each of
its documents and a sample for the rest.  The sample is Pareto order sampling: a
document with inclusion probability ``p`` and a fixed uniform number ``u`` has rank
``(u / (1 - u)) / (p / (1 - p))``; the smallest ranks are taken.  The sample size is
counted in words: documents are taken in rank order while the running sum stays
nearest to the words still owed.  ``u`` is a hash of the id, so reruns agree.

The running sum of a source is never built in one task.  Ranks are cut into
``CELLS`` cells per source; sums of cells say which single cell holds the cut, and
only the rows of that cell are sorted.  The cut is then one row per source, and the last
pass over the documents compares each row with the cut of its source, so texts are
never shuffled.

Nulls: a null source is a source of its own, placed last; a null text has size 0;
a null id is hashed as the empty string.  Repeated rows are ranked together and
cut one by one, except that equal (id, size) rows of one source share one rank and
are taken or left together.  Empty input gives no rows.  Extra columns pass through
``mix_documents``; columns named like its own additions are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

NAME = "op6_pareto_mix"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
CELLS = 4096
#: Up to so many sources the cut table (under 200 bytes a row) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column) -> Column:
    """A fixed number in (0, 1) for an id: 48 bits of its MD5."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> adds ``weight`` and ``target``.

    Resharing ends at target = min(cap * size, c * weight) with one c for all.  With
    sources sorted by size / weight, the capped ones come first, so c follows from
    running sums over the source table (one row per source).
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    ratio = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    done = ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("weight", weight)
    s = (s.withColumn("_total", F.sum("source_size").over(every) * F.lit(share))
         .withColumn("_weights", F.sum("weight").over(every))
         .withColumn("_c", (F.col("_total") - F.coalesce(F.sum("source_size").over(done), F.lit(0)) * F.lit(float(cap)))
                     / (F.col("_weights") - F.coalesce(F.sum("weight").over(done), F.lit(0.0)))))
    # the first source, in ratio order, that its share does not lift above its cap fixes c
    fits = F.when(F.col("_c") * F.col("weight") <= F.col("source_size") * F.lit(float(cap)), F.col("_c"))
    s = s.withColumn("_fit", F.first(fits, ignorenulls=True).over(
        ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    limit = F.col("source_size") * F.lit(float(cap))
    target = F.when(F.col("_fit").isNull(), limit).otherwise(F.least(limit, F.col("_fit") * F.col("weight")))
    return s.select("source", "source_size", "weight", target.cast("double").alias("target"))


def sampling_cuts(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: whole copies, and the last (rank, id, size) that the sample takes.

    ``ranked`` has (source, id, size, u).  Within a source every document has the same
    inclusion probability, so its Pareto rank grows with ``u`` and cells of ``u`` are
    cells of ranks.
    """
    plan = (targets.withColumn("_r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
            .withColumn("whole", F.floor("_r").cast("int"))
            .withColumn("inclusion", F.col("_r") - F.col("whole"))
            .withColumn("owed", F.col("target") - F.col("whole") * F.col("source_size")))
    cells = (ranked.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
             .groupBy("source", "cell").agg(F.sum("size").alias("words")))
    upto = Window.partitionBy("source").orderBy("cell")
    cells = cells.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    p, c = plan.alias("p"), cells.alias("c")
    same = F.col("p.source").eqNullSafe(F.col("c.source"))
    # the cell whose words pass what is owed
    crossing = (p.join(c, same).filter((F.col("c.before") <= F.col("p.owed"))
                                       & (F.col("c.before") + F.col("c.words") > F.col("p.owed")))
                .select(F.col("p.source").alias("_s"), F.col("c.cell").alias("_cell"), "before", "owed"))
    inside = ranked.join(F.broadcast(crossing) if targets.count() <= BROADCAST_SOURCES else crossing,
                         F.col("source").eqNullSafe(F.col("_s")) & (F.floor(F.col("u") * CELLS) == F.col("_cell")))
    # equal (id, size) rows share a rank: range frame
    run = Window.partitionBy("source").orderBy(F.struct("u", "id", "size"))
    inside = inside.withColumn("sum", F.col("before") + F.sum("size").over(
        run.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = inside.withColumn("off", F.abs(F.col("sum") - F.col("owed")))
    best = inside.groupBy("source").agg(
        F.min_by(F.struct("u", "id", "size", "off"), F.struct("off", "u", "id", "size")).alias("cut"),
        F.min("_cell").alias("cell"), F.first("before").alias("before"), F.first("owed").alias("owed"))
    # stopping before the cell's first row may be nearer still
    best = best.select(F.col("source").alias("_s"), "cell",
                       F.when(F.col("owed") - F.col("before") > F.col("cut.off"),
                              F.struct("cut.u", "cut.id", "cut.size")).alias("cut"))
    last = plan.join(best, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "_r")
    return last.withColumn("all_cells", F.col("cell").isNull() & (F.col("inclusion") > 0))


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """Random odds divided by inclusion odds."""
    return (u / (1 - u)) / (inclusion / (1 - inclusion))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``copies``, ``taken`` and ``rank`` to every document."""
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                        word_count(F.col(text_col)).alias("size"))
    ranked = stored(sized, "mix-sizes").withColumn("u", uniform(F.col("id")))
    targets = source_targets(ranked.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    cuts = stored(sampling_cuts(ranked, stored(targets, "mix-targets")), "mix-cuts")
    cuts = cuts.select(F.col("source").alias("_source"), "source_size", "target", "whole", "inclusion", "cell", "cut", "all_cells")
    drop = [c for c in ("size", "source_size", "target", "copies", "taken", "rank") if c in docs.columns]
    rows = (docs.drop(*drop).withColumn("size", word_count(F.col(text_col))).withColumn("_u", uniform(F.col(id_col))))
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    rows = rows.join(cuts, F.col(source_col).eqNullSafe(F.col("_source")))
    mine, cell = F.struct(F.col("_u").alias("u"), F.col(id_col).alias("id"), F.col("size")), F.floor(F.col("_u") * CELLS)
    sampled = (F.col("all_cells") | (cell < F.col("cell"))
               | ((cell == F.col("cell")) & F.col("cut").isNotNull() & (mine <= F.col("cut"))))
    copies = F.col("whole") + F.when(F.coalesce(sampled, F.lit(False)), 1).otherwise(0)
    return (rows.withColumn("copies", copies.cast("int"))
            .withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
            .withColumn("rank", F.when(F.col("inclusion") > 0, pareto_rank(F.col("_u"), F.col("inclusion"))))
            .drop("_u", "_source", "whole", "inclusion", "cell", "cut", "all_cells"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0
         ELSE len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) END::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
    WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight FROM s0),
s2 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
      - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS c FROM s1),
fit AS (SELECT c FROM s2 WHERE c * weight <= source_size * 2.0
        ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM fit) = 0 THEN source_size * 2.0
        ELSE least(source_size * 2.0, (SELECT c FROM fit) * weight) END AS target FROM s2),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
run AS (SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS owed,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
off AS (SELECT source, min(abs(upto - owed)) AS best, min(owed) AS owed FROM run GROUP BY source),
cut AS (SELECT r.source, min(r.upto) AS upto FROM run r JOIN off o ON r.source IS NOT DISTINCT FROM o.source
  WHERE abs(r.upto - r.owed) = o.best AND o.best < o.owed GROUP BY r.source)
SELECT r.doc_id, r.size, r.source_size::BIGINT AS source_size, r.target,
  ((r.whole + CASE WHEN c.upto IS NOT NULL AND r.upto <= c.upto THEN 1 ELSE 0 END) * r.size)::BIGINT AS taken
FROM run r LEFT JOIN cut c ON r.source IS NOT DISTINCT FROM c.source
"""
