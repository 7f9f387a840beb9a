"""Distinct counts, quantiles and set overlaps from mergeable sketches, beside the exact forms in ``stats`` and ``quality``.

``sketch_days`` reduces a table to one row per group and day: rows, an HLL sketch and a theta sketch of an id, and a KLL sketch of a
value.  Such rows are stored once and merged at will, so a question about any months reads their rows and not the
data, and a new day adds a row.  A sketch has a fixed size whatever it has seen, so a hot group costs its partial aggregates only.

Bounds, with the default sizes: distinct counts within 3 % (HLL) and overlaps within 3 % of the larger set (theta), at three standard
errors; quantiles within 1.5 % of the rows in rank (KLL).  Null ids and values are not counted; an empty group gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of the entries of HLL and theta sketches, and the size of a KLL sketch.
LG_ENTRIES, KLL_SIZE = 14, 400
DISTINCT_BOUND, RANK_BOUND = 0.03, 0.015


def sketch_days(df: DataFrame, groups: Sequence[str], day: Column, id_col: str, value_col: str) -> DataFrame:
    """(groups, day, n, ids_hll, ids_theta, values_kll): the rows to store."""
    return df.groupBy(*groups, day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(id_col, LG_ENTRIES).alias("ids_hll"),
        F.theta_sketch_agg(id_col, LG_ENTRIES).alias("ids_theta"), F.kll_sketch_agg_double(F.col(value_col).cast("double"), KLL_SIZE).alias("values_kll"))


def merged(days: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The sketches of all days of each group, as one row."""
    return days.groupBy(*groups).agg(F.sum("n").alias("n"), F.hll_union_agg("ids_hll").alias("ids_hll"),
                                     F.theta_union_agg("ids_theta", LG_ENTRIES).alias("ids_theta"), F.kll_merge_agg_double("values_kll", KLL_SIZE).alias("values_kll"))


def estimates(sketches: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Distinct ids and quantiles of the values in place of the sketches."""
    at = [F.kll_sketch_get_quantile_double("values_kll", F.lit(float(q))).alias(f"q{round(q * 100)}") for q in quantiles]
    return sketches.select(*[c for c in sketches.columns if c not in ("ids_hll", "ids_theta", "values_kll")],
                           F.hll_sketch_estimate("ids_hll").alias("distinct_ids"), *at)


def overlap(sketches: DataFrame, group: str) -> DataFrame:
    """(left, right, both): ids that two groups have in common, for pairs of a short list of groups."""
    a = sketches.select(F.col(group).alias("left"), F.col("ids_theta").alias("_a"))
    b = sketches.select(F.col(group).alias("right"), F.col("ids_theta").alias("_b"))
    return a.join(b, F.col("left") < F.col("right")).select("left", "right", F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).alias("both"))
