"""Neighbour-row access (lead/lag) that stays parallel when the window has no
partition key or when one group holds a large share of the rows.

A plain ``lag().over(Window.partitionBy(g).orderBy(o))`` sends each whole
group to one task, and with no ``g`` the whole table to one task.  Here a hot
group, one with more than 1/n of all rows, is cut into ranges of the first order
column.  At most n groups are hot, and together they have at most 3n ranges, so
the tables of hot groups and of range edges are small whatever the data's size.
The range of a row follows from its values and a fixed list of split points, so
every branch of a plan sees the same ranges and nothing needs to be stored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def same_keys(names: Sequence[str], other: str) -> Column:
    """Equality of columns with their namesakes ``other + name``; NULL equals NULL."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(other + c)) for c in names], F.lit(True))


def _ordinal(df: DataFrame, name: str) -> Column:
    """A value that quantiles can be taken of and that never falls where ``name`` rises."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):  # the first seven bytes as a number
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(kind, T.BooleanType):
        return c.cast("int")
    return F.lit(0)  # no order known beforehand: one range


def with_ranges(df: DataFrame, groups: Sequence[str], order: str, n: int) -> DataFrame:
    """Add ``_range`` (0 outside hot groups; rises with ``order``) and ``_hot``.

    One pass finds about n - 1 split points of the order column over all rows, another the rows per group."""
    x = _ordinal(df, order)
    points = df.agg(F.percentile_approx(x, [i / n for i in range(1, n)], 100 * n).alias("p")).first()["p"] if n > 1 else None
    points = sorted(set(points or []))
    if not points:
        return df.select("*", F.lit(0).alias("_range"), F.lit(False).alias("_hot"))
    kind = df.select(x.alias("x")).schema["x"].dataType
    splits = F.array(*[F.lit(p).cast(kind) for p in points])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(points).bit_length()))])
    # binary search: how many split points are less than the value
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.coalesce((at + step <= len(points)) & (F.get(splits, at + step - 1) < x), F.lit(False)), at + step).otherwise(at))
    if not groups:
        return df.select("*", found.alias("_range"), F.lit(True).alias("_hot"))
    counts = df.groupBy(*[F.col(g).alias(f"_of_{g}") for g in groups]).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.crossJoin(F.broadcast(counts.agg(F.sum("_rows").alias("_all")))).where(F.col("_rows") * n > F.col("_all"))
    # a group with a share s of the rows gets about s * n ranges
    hot = hot.select(*[f"_of_{g}" for g in groups], F.floor(F.col("_all") / F.col("_rows")).cast("int").alias("_width"))
    return df.join(F.broadcast(hot), same_keys(groups, "_of_"), "left").select(
        *df.columns, F.coalesce(F.floor(found / F.col("_width")).cast("int"), F.lit(0)).alias("_range"),
        F.col("_width").isNotNull().alias("_hot"))


def join_cells(rows: DataFrame, cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows with the columns of their (group, range) in ``cells``, where it is there: at most 3n rows."""
    keys = [*groups, "_range"]
    named = cells.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in cells.columns if c not in keys])
    return rows.join(F.broadcast(named), same_keys(keys, "_of_"), "left").drop(*[f"_of_{k}" for k in keys])


def neighbour(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], columns: Sequence[str],
              direction: str = "lag", prefix: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add ``<prefix><col>`` = value of ``col`` in the previous (lag) or next (lead)
    row of the same ``partition_by`` group under ``order_by`` (ascending, nulls
    first).  NULL when there is no such row.  Ties in ``order_by`` are broken by
    the remaining columns so the result is deterministic."""
    if direction not in ("lag", "lead"):
        raise ValueError("direction is 'lag' or 'lead'")
    prefix = prefix if prefix is not None else f"{direction}_"
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = list(partition_by)
    keys = list(order_by) + [c for c in df.columns if c not in groups and c not in order_by]
    fn, edge_pick = (F.lag, F.max_by) if direction == "lag" else (F.lead, F.min_by)
    ranged = with_ranges(df, groups, keys[0], n)
    w = Window.partitionBy(*groups, "_range").orderBy(*keys)
    inner = ranged.select("*", fn(F.lit(1)).over(w).isNull().alias("_edge"),
                          *[fn(c).over(w).alias(f"_nb_{c}") for c in columns])
    # the neighbour of a range's edge row is the edge row of the group's adjacent range
    edges = (ranged.where("_hot").groupBy(*groups, "_range")
             .agg(edge_pick(F.struct(*[F.col(c).alias(f"_adj_{c}") for c in columns]), F.struct(*keys)).alias("e")))
    across = edges.select(*groups, "_range", fn("e").over(Window.partitionBy(*groups).orderBy("_range")).alias("_adj"))
    joined = join_cells(inner, across, groups)
    return joined.select(*df.columns, *[F.when(F.col("_edge"), F.col(f"_adj._adj_{c}")).otherwise(F.col(f"_nb_{c}"))
                                        .alias(f"{prefix}{c}") for c in columns])
