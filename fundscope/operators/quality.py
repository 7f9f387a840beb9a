"""Data-quality checks.  Each check returns the offending rows (empty = pass);
``run_suite`` turns many checks into one ``(check, failures, status)`` table.

Aggregating checks group with partial (map-side) aggregation; row checks are
filters; checks that compare two tables use joins/except on aggregated counts,
never per-row pairs.  NULL handling follows the checks' documented semantics,
with the fixes noted per function.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import neighbour


def _expr(e) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def _list(x) -> list[str]:
    if not x:
        return []
    return [x] if isinstance(x, str) else list(x)


# ---------------------------------------------------------------- DQ-1 unique
def unique(df: DataFrame, column: str) -> DataFrame:
    """Values seen more than once (NULL ignored): ``unique_field, n_records``."""
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("unique_field"))
            .agg(F.count(F.lit(1)).alias("n_records")).where(F.col("n_records") > 1))


# ---------------------------------------------------------------- DQ-2 not_null
def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


# ---------------------------------------------------------------- DQ-3 accepted_values
def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the list with their counts; NULL passes.  Literals are cast
    to the column's type."""
    dtype = df.schema[column].dataType
    lits = [F.lit(v).cast(dtype) for v in values]
    return (df.where(F.col(column).isNotNull() & ~F.col(column).isin(*lits))
            .groupBy(F.col(column).alias("value_field")).agg(F.count(F.lit(1)).alias("n_records")))


# ---------------------------------------------------------------- DQ-12 not_accepted_values
def not_accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    dtype = df.schema[column].dataType
    lits = [F.lit(v).cast(dtype) for v in values]
    return (df.where(F.col(column).isin(*lits)).groupBy(F.col(column).alias("value_field"))
            .agg(F.count(F.lit(1)).alias("n_records")))


# ---------------------------------------------------------------- DQ-4 accepted_range
def accepted_range(df: DataFrame, column, min_value=None, max_value=None, inclusive: bool = True) -> DataFrame:
    """Rows outside [min, max] (or the open interval); NULL passes."""
    c = _expr(column) if not isinstance(column, str) or column not in df.columns else F.col(column)
    bad = F.lit(False)
    if min_value is not None:
        bad = bad | ~(c >= min_value if inclusive else c > min_value)
    if max_value is not None:
        bad = bad | ~(c <= max_value if inclusive else c < max_value)
    return df.where(bad)


# ---------------------------------------------------------------- DQ-5 at_least_one
def at_least_one(df: DataFrame, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Groups (or the whole table) with no non-NULL value.  Unlike the original
    grouped form, groups whose values are all NULL do fail."""
    g = _list(group_by)
    agg = (df.groupBy(*g) if g else df).agg(F.count(F.col(column)).alias("n_values"))
    return agg.where(F.col("n_values") == 0)


# ---------------------------------------------------------------- DQ-6 cardinality_equality
def cardinality_equality(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """(value, count) pairs present on one side only; NULL groups compare equal."""
    a = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("num_rows"))
    b = other.groupBy(F.col(other_column).alias("value")).agg(F.count(F.lit(1)).alias("num_rows"))
    return (a.subtract(b).withColumn("side", F.lit("model_only"))
            .unionByName(b.subtract(a).withColumn("side", F.lit("compare_only"))))


# ---------------------------------------------------------------- DQ-7/8 row counts
def _group_counts(df: DataFrame, group_by: Sequence[str], name: str) -> DataFrame:
    g = _list(group_by)
    if g:
        return df.groupBy(*g).agg(F.count(F.lit(1)).alias(name))
    return df.agg(F.count(F.lit(1)).alias(name)).withColumn("_all", F.lit(1))


def _count_join(df: DataFrame, other: DataFrame, group_by: Sequence[str]) -> DataFrame:
    g = _list(group_by) or ["_all"]
    # aliased so that comparing a table with itself is not an ambiguous self-join
    a = _group_counts(df, group_by, "count_a").alias("_a")
    b = _group_counts(other, group_by, "count_b").alias("_b")
    cond = reduce(lambda x, y: x & y, [F.col(f"_a.`{k}`").eqNullSafe(F.col(f"_b.`{k}`")) for k in g])
    j = a.join(b, cond, "full")
    keys = [F.coalesce(F.col(f"_a.`{k}`"), F.col(f"_b.`{k}`")).alias(k) for k in g if k != "_all"]
    return j.select(*keys, F.coalesce(F.col("count_a"), F.lit(0)).alias("count_a"),
                    F.coalesce(F.col("count_b"), F.lit(0)).alias("count_b"))


def equal_rowcount(df: DataFrame, other: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Groups whose row counts differ.  Groups present on one side only count 0
    on the other side (the original lets them pass); keys match null-safely."""
    j = _count_join(df, other, group_by)
    return j.withColumn("diff_count", F.abs(F.col("count_a") - F.col("count_b"))).where(F.col("diff_count") != 0)


def fewer_rows_than(df: DataFrame, other: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Groups where ``df`` does not have fewer rows than ``other``; the failure
    weight is 1 for equal counts, else the surplus."""
    j = _count_join(df, other, group_by)
    delta = F.col("count_a") - F.col("count_b")
    return (j.withColumn("row_count_delta", F.when(delta == 0, F.lit(1)).otherwise(delta))
             .where(F.col("count_a") >= F.col("count_b")))


# ---------------------------------------------------------------- DQ-9 equality
#: Buckets of rows whose checksums are compared before any row is.
CHECKSUM_BUCKETS = 4096


def _row_bucket(columns: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def bucket_checksums(df: DataFrame, columns: Sequence[str], buckets: int = CHECKSUM_BUCKETS) -> DataFrame:
    """(bucket, n, sum_a, sum_b): rows of a bucket, and sums of two hashes of each, in whatever order they come."""
    return df.groupBy(_row_bucket(columns, buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("sum_a"),
        F.sum(F.xxhash64(F.lit(17), *columns).cast("decimal(20,0)")).alias("sum_b"))


def differing_buckets(df: DataFrame, other: DataFrame, columns: Sequence[str], buckets: int = CHECKSUM_BUCKETS) -> DataFrame:
    """(bucket) of the rows that are not the same multiset on both sides: at most ``buckets`` rows."""
    a, b = (bucket_checksums(x, columns, buckets) for x in (df, other))
    both = a.unionByName(b).groupBy("bucket").agg(F.count(F.lit(1)).alias("sides"), *[
        F.min(c).eqNullSafe(F.max(c)).alias(c) for c in ("n", "sum_a", "sum_b")])
    return both.where(~((F.col("sides") == 2) & F.col("n") & F.col("sum_a") & F.col("sum_b"))).select("bucket")


def equality(df: DataFrame, other: DataFrame, columns: Sequence[str] | None = None,
             strict: bool = False, buckets: int = CHECKSUM_BUCKETS) -> DataFrame:
    """Rows in one side and not the other (EXCEPT both ways).  ``strict`` keeps
    duplicates (EXCEPT ALL) so differing multiplicities also fail.

    A row's bucket follows from its values, so equal rows meet in one bucket.  Buckets whose counts and checksums
    agree hold the same rows and are left out; only rows of the others are shuffled and compared."""
    cols = list(columns) if columns else df.columns
    a, b = df.select(*cols), other.select(*cols)
    if all(df.schema[c].dataType == other.schema[c].dataType for c in cols):  # hashes of unlike types differ
        unlike = differing_buckets(a, b, cols, buckets).select(F.col("bucket").alias("_bucket"))
        a, b = (x.join(F.broadcast(unlike), _row_bucket(cols, buckets) == F.col("_bucket"), "left_semi") for x in (a, b))
    minus = (lambda x, y: x.exceptAll(y)) if strict else (lambda x, y: x.subtract(y))
    return (minus(a, b).withColumn("which_diff", F.lit("a_minus_b"))
            .unionByName(minus(b, a).withColumn("which_diff", F.lit("b_minus_a"))))


# ---------------------------------------------------------------- DQ-10 expression_is_true
def expression_is_true(df: DataFrame, expression) -> DataFrame:
    """Rows where the expression is false; NULL passes."""
    return df.where(~_expr(expression))


# ---------------------------------------------------------------- DQ-11 ranges
def mutually_exclusive_ranges(df: DataFrame, lower: str, upper: str, partition_by: Sequence[str] = (),
                              gaps: str = "allowed", zero_length_range_allowed: bool = False) -> DataFrame:
    """Rows whose range is invalid or overlaps / gaps against the next range of
    the same partition (ordered by lower, upper).  ``gaps``: 'not_allowed'
    (next lower = upper), 'allowed' (upper <= next lower) or 'required'
    (upper < next lower).  NULL bounds fail; the last range of a partition
    passes the next-range test."""
    ops = {"not_allowed": lambda u, nl: u == nl, "allowed": lambda u, nl: u <= nl,
           "required": lambda u, nl: u < nl}
    if gaps not in ops:
        raise ValueError("gaps is not_allowed, allowed or required")
    g = _list(partition_by)
    base = df.select(*g, F.col(lower).alias("lower_bound"), F.col(upper).alias("upper_bound"))
    nb = neighbour(base, g, ["lower_bound", "upper_bound"], ["lower_bound"], direction="lead", prefix="next_")
    lo, up, nlo = F.col("lower_bound"), F.col("upper_bound"), F.col("next_lower_bound")
    valid_range = (lo <= up) if zero_length_range_allowed else (lo < up)
    ok_next = F.coalesce(ops[gaps](up, nlo), nlo.isNull())
    checked = nb.select(*g, "lower_bound", "upper_bound", "next_lower_bound",
                        lo.isNotNull().alias("lower_bound_not_null"),
                        up.isNotNull().alias("upper_bound_not_null"),
                        F.coalesce(valid_range, F.lit(False)).alias("lower_bound_less_than_upper_bound"),
                        F.coalesce(ok_next, F.lit(False)).alias("upper_bound_ok_with_next_lower_bound"))
    return checked.where(~(F.col("lower_bound_not_null") & F.col("upper_bound_not_null")
                           & F.col("lower_bound_less_than_upper_bound")
                           & F.col("upper_bound_ok_with_next_lower_bound")))


# ---------------------------------------------------------------- DQ-13 not_constant
def not_constant(df: DataFrame, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Groups with exactly one distinct non-NULL value (all-NULL passes)."""
    g = _list(group_by)
    agg = (df.groupBy(*g) if g else df).agg(F.count_distinct(F.col(column)).alias("filler_column"))
    return agg.where(F.col("filler_column") == 1)


# ---------------------------------------------------------------- DQ-14 not_empty_string
def not_empty_string(df: DataFrame, column: str, trim_whitespace: bool = True) -> DataFrame:
    c = F.trim(F.col(column)) if trim_whitespace else F.col(column)
    return df.where(c == "")


# ---------------------------------------------------------------- DQ-15 not_null_proportion
def not_null_proportion(df: DataFrame, column: str, at_least: float, at_most: float = 1.0,
                        group_by: Sequence[str] = ()) -> DataFrame:
    g = _list(group_by)
    prop = F.try_divide(F.count(F.col(column)).cast("double"), F.count(F.lit(1)).cast("double"))
    agg = (df.groupBy(*g) if g else df).agg(prop.alias("not_null_proportion"))
    p = F.col("not_null_proportion")
    return agg.where((p < at_least) | (p > at_most))


# ---------------------------------------------------------------- DQ-16 recency
def recency(df: DataFrame, field: str, datepart: str, interval: int, as_of, ignore_time_component: bool = False,
            group_by: Sequence[str] = ()) -> DataFrame:
    """Groups whose latest ``field`` is older than ``as_of - interval datepart``.
    ``as_of`` is an explicit date/timestamp (no wall clock); empty input passes."""
    g = _list(group_by)
    ref = F.lit(as_of).cast("timestamp_ntz")
    if ignore_time_component:
        ref = F.date_trunc("day", ref).cast("timestamp_ntz")
    threshold = F.timestamp_add(datepart.upper(), F.lit(-interval), ref)
    value = F.col(field).cast("timestamp_ntz")
    if ignore_time_component:
        value = F.col(field).cast("date").cast("timestamp_ntz")
    agg = (df.groupBy(*g) if g else df).agg(F.max(value).alias("most_recent"))
    return agg.select("*", threshold.alias("threshold")).where(F.col("most_recent") < F.col("threshold"))


# ---------------------------------------------------------------- DQ-17 relationships_where
def relationships_where(df: DataFrame, column: str, to: DataFrame, field: str, from_condition=None,
                        to_condition=None) -> DataFrame:
    """Child rows whose non-NULL key has no parent (after both filters): a left anti join."""
    child = df.where(F.col(column).isNotNull())
    if from_condition is not None:
        child = child.where(_expr(from_condition))
    parent = to.where(F.col(field).isNotNull())
    if to_condition is not None:
        parent = parent.where(_expr(to_condition))
    parent = parent.select(F.col(field).alias("_parent_key")).distinct()
    return child.join(parent, child[column] == parent["_parent_key"], "left_anti")


# ---------------------------------------------------------------- DQ-18 sequential_values
def sequential_values(df: DataFrame, column: str, interval=1, datepart: str | None = None,
                      group_by: Sequence[str] = ()) -> DataFrame:
    """Rows whose value is not the previous value (same group, ordered by the
    value) plus ``interval`` (in ``datepart`` units for dates).  First rows pass."""
    g = _list(group_by)
    base = df.select(*g, F.col(column))
    nb = neighbour(base, g, [column], [column], direction="lag", prefix="previous_")
    prev = F.col(f"previous_{column}")
    if datepart:
        expected = F.timestamp_add(datepart.upper(), F.lit(interval), prev.cast("timestamp_ntz"))
        bad = F.col(column).cast("timestamp_ntz") != expected
    else:
        bad = F.col(column) != prev + interval
    return nb.where(bad)


# ---------------------------------------------------------------- DQ-19 unique combination
def unique_combination_of_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Combinations seen more than once (NULLs group together)."""
    return (df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_records"))
            .where(F.col("n_records") > 1))


# ---------------------------------------------------------------- DQ-20 assert_equal
def assert_equal(df: DataFrame, actual: str, expected: str) -> DataFrame:
    """Rows where actual and expected differ, NULL-safely (NULL vs value fails)."""
    return df.where(~_expr(actual).eqNullSafe(_expr(expected)))


# ---------------------------------------------------------------- DQ-21 suite
@dataclass
class Check:
    name: str
    failing: DataFrame | None    # offending rows from one of the checks above
    severity: str = "error"      # error | warn
    error_if: str = "!=0"        # comparison against the failure count
    warn_if: str = "!=0"
    weight_column: str | None = None  # sum this column instead of counting rows
    source: DataFrame | None = None   # row-level form: table + failing-row predicate
    predicate: Column | None = None


def row_check(name: str, df: DataFrame, failing_predicate, **kw) -> Check:
    """A row-level check (not_null, expression_is_true, accepted_range,
    not_empty_string, ...) given as a failing-row predicate; ``run_suite``
    evaluates all row checks over the same table in one aggregate pass.
    A NULL predicate counts as passing, like the filters above."""
    return Check(name, None, source=df, predicate=_expr(failing_predicate), **kw)


def _cmp(col: Column, rule: str) -> Column:
    for op in ("!=", ">=", "<=", "=", ">", "<"):
        if rule.startswith(op):
            v = float(rule[len(op):])
            return {"!=": col != v, ">=": col >= v, "<=": col <= v, "=": col == v, ">": col > v, "<": col < v}[op]
    raise ValueError(rule)


def run_suite(checks: Sequence[Check]) -> DataFrame:
    """One row per check: ``check, failures, status`` (pass / warn / error).

    Every check contributes a one-row aggregate; row checks over the same
    table share one scan (one ``count_if`` each); the union runs as one job."""
    rows = []
    fused: dict[int, list[Check]] = {}
    for c in checks:
        if c.predicate is not None:
            fused.setdefault(id(c.source), []).append(c)
            continue
        measure = (F.coalesce(F.sum(c.weight_column), F.lit(0)) if c.weight_column
                   else F.count(F.lit(1))).cast("bigint")
        rows.append(c.failing.agg(measure.alias("failures")).select(
            F.lit(c.name).alias("check"), "failures"))
    for group in fused.values():
        wide = group[0].source.agg(*[F.count_if(F.coalesce(c.predicate, F.lit(False))).alias(f"_f{i}")
                                     for i, c in enumerate(group)])
        pairs = [F.struct(F.lit(c.name).alias("check"), F.col(f"_f{i}").cast("bigint").alias("failures"))
                 for i, c in enumerate(group)]
        rows.append(wide.select(F.explode(F.array(*pairs)).alias("r")).select("r.check", "r.failures"))
    out = reduce(lambda a, b: a.unionByName(b), rows)
    err = F.lit(False)
    warn = F.lit(False)
    for c in checks:  # thresholds are per check; evaluate with the check's own rule
        is_c = F.col("check") == c.name
        err = err | (is_c & F.lit(c.severity == "error") & _cmp(F.col("failures"), c.error_if))
        warn = warn | (is_c & _cmp(F.col("failures"), c.warn_if))
    return out.select("check", "failures",
                      F.when(err, "error").when(warn, "warn").otherwise("pass").alias("status"))


def row_checks(df: DataFrame, failing_predicates: Mapping[str, Column | str]) -> DataFrame:
    """Several row-level checks (not_null, accepted_range, expression_is_true,
    not_empty_string, ...) over one table in a single scan: one ``count_if``
    per check, then one row per check."""
    aggs = [F.count_if(F.coalesce(_expr(p), F.lit(False))).alias(n) for n, p in failing_predicates.items()]
    wide = df.agg(*aggs)
    return wide.unpivot([], list(failing_predicates), "check", "failures")
