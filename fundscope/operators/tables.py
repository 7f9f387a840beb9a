"""Table operators: projection helpers, dedupe, pivot/unpivot, unions, generators,
frequency lists and paging.  All DataFrame -> DataFrame, no collect."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import mask_id_number, mask_name

NAME_COLUMNS = ("name", "xm", "姓名")


def _cols(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


# ---------------------------------------------------------------- PRJ-1 star
def star(df: DataFrame, except_: Sequence[str] = (), prefix: str = "", suffix: str = "") -> DataFrame:
    """All columns except a case-insensitive list; alias with affixes only when given."""
    drop = {c.lower() for c in except_}
    keep = [c for c in df.columns if c.lower() not in drop]
    if prefix or suffix:
        return df.select([F.col(f"`{c}`").alias(f"{prefix}{c}{suffix}") for c in keep])
    return df.select([F.col(f"`{c}`") for c in keep])


# ---------------------------------------------------------------- PRJ-3 nullcheck
def nullcheck(df: DataFrame) -> DataFrame:
    """Empty strings become NULL in string columns; other columns untouched."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append(F.nullif(c, F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else c)
    return df.select(out)


# ---------------------------------------------------------------- RSH-3 dedupe
def deduplicate(df: DataFrame, partition_by, order_by, descending: bool = True) -> DataFrame:
    """First row per key by ``order_by`` (descending by default: latest wins).

    Written as ``max_by``/``min_by`` over a struct rather than a row_number
    window: the aggregate combines map-side, so a key holding a large share
    of the rows is reduced in every input task before the shuffle instead of
    being sorted whole in one task.  The remaining columns break ties, so the
    chosen row is deterministic.  Rows with NULL keys are kept (NULL is a key).
    """
    keys = _cols(partition_by)
    order = _cols(order_by)
    rest = [c for c in df.columns if c not in keys and c not in order]
    payload = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])
    # maps have no order: their text breaks ties
    rank_key = F.struct(*[F.to_json(F.col(f"`{c}`")).alias(c) if isinstance(df.schema[c].dataType, T.MapType) else F.col(f"`{c}`")
                          for c in order + rest])
    pick = F.max_by if descending else F.min_by
    agg = df.groupBy(*keys).agg(pick(payload, rank_key).alias("_row"))
    return agg.select(*[F.col(f"`{k}`") for k in keys], "_row.*").select(*df.columns)


# ---------------------------------------------------------------- RSH-4 pivot
def pivot(df: DataFrame, by, column: str, values: Sequence, agg: str = "sum", then_value=1,
          else_value=0, prefix: str = "", suffix: str = "", distinct: bool = False,
          cmp: str = "=") -> DataFrame:
    """One conditional aggregate per listed value, in a single pass.

    ``agg(case when column <cmp> value then then_value else else_value end)``;
    ``then_value``/``else_value`` may be Columns (e.g. an amount column).
    Values must be given: discovering them would need a driver round trip."""
    ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b,
           "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    fn = getattr(F, {"sum": "sum", "count": "count", "max": "max", "min": "min", "avg": "avg"}[agg])
    tv = then_value if isinstance(then_value, Column) else F.lit(then_value)
    ev = else_value if isinstance(else_value, Column) else F.lit(else_value)
    aggs = []
    for v in values:
        expr = F.when(ops[cmp](F.col(column), F.lit(v)), tv).otherwise(ev)
        if distinct:
            expr = F.sum_distinct(expr) if agg == "sum" else F.count_distinct(expr)
        else:
            expr = fn(expr)
        aggs.append(expr.alias(f"{prefix}{v}{suffix}"))
    return df.groupBy(*_cols(by)).agg(*aggs)


# ---------------------------------------------------------------- RSH-5 unpivot
def unpivot(df: DataFrame, exclude: Sequence[str], remove: Sequence[str] = (), cast_to: str = "string",
            field_name: str = "field_name", value_name: str = "value") -> DataFrame:
    """Long form of every column not in ``exclude``/``remove``; NULL values are kept.
    One Expand over one scan (not one scan per column)."""
    ids = list(exclude)
    vals = [c for c in df.columns if c not in ids and c not in set(remove)]
    casted = df.select(*[F.col(f"`{c}`") for c in ids],
                       *[F.col(f"`{c}`").cast(cast_to).alias(c) for c in vals])
    return casted.unpivot(ids, vals, field_name, value_name)


# ---------------------------------------------------------------- SET-1 union
def union_relations(relations: Mapping[str, DataFrame], include: Sequence[str] | None = None,
                    exclude: Sequence[str] | None = None, column_override: Mapping[str, str] | None = None,
                    source_column_name: str | None = "_dbt_source_relation",
                    where: str | Column | None = None) -> DataFrame:
    """Union by name over the superset of columns (first-seen order), NULL-filled,
    each column cast to its first-seen type (or override), with a source label."""
    if include and exclude:
        raise ValueError("include and exclude are mutually exclusive")
    inc = {c.lower() for c in include} if include else None
    exc = {c.lower() for c in exclude} if exclude else set()
    overrides = {k.lower(): v for k, v in (column_override or {}).items()}
    order: list[str] = []
    types: dict[str, T.DataType | str] = {}
    for df in relations.values():
        for f in df.schema.fields:
            k = f.name.lower()
            if (inc is not None and k not in inc) or k in exc:
                continue
            if k not in types:
                order.append(f.name)
                types[k] = overrides.get(k, f.dataType)
    parts = []
    for name, df in relations.items():
        present = {c.lower(): c for c in df.columns}
        cols = []
        if source_column_name:
            cols.append(F.lit(name).alias(source_column_name))
        for c in order:
            src = present.get(c.lower())
            val = F.col(f"`{src}`") if src else F.lit(None)
            cols.append(val.cast(types[c.lower()]).alias(c))
        part = df.select(*cols)
        if where is not None:
            part = part.where(where)
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_matching(spark: SparkSession, pattern: str, exclude: str | None = None, database: str | None = None,
                   **kw) -> DataFrame:
    """SET-2: union every catalog table/view whose name matches an ILIKE pattern."""
    def like(p):
        return re.compile("^" + re.escape(p).replace("%", ".*").replace("_", ".") + "$", re.I)
    inc, exc = like(pattern), like(exclude) if exclude else None
    names = sorted(t.name for t in spark.catalog.listTables(database)
                   if inc.match(t.name) and not (exc and exc.match(t.name)))
    if not names:
        raise ValueError(f"no tables match {pattern!r}")
    return union_relations({n: spark.table(n) for n in names}, **kw)


# ---------------------------------------------------------------- RSH-1/2 generators
def series(spark: SparkSession, n: int) -> DataFrame:
    """1..n as ``generated_number``; n <= 0 is an error."""
    if n <= 0:
        raise ValueError("n must be positive")
    return spark.range(1, n + 1).toDF("generated_number")


def date_spine_col(part: str, start: Column, end: Column) -> Column:
    """Array of dates every ``part`` (day, week, month, quarter, year) from start
    (inclusive) to end (exclusive), counted in calendar boundaries like
    ``datediff(part)``; empty when end <= start."""
    s, e = start.cast("date"), end.cast("date")
    month_no = lambda d: F.year(d) * 12 + F.month(d)
    if part == "day":
        n, step = F.datediff(e, s), lambda i: F.date_add(s, i)
    elif part == "week":
        n, step = F.floor(F.datediff(e, s) / 7).cast("int"), lambda i: F.date_add(s, i * 7)
    elif part == "month":
        n, step = month_no(e) - month_no(s), lambda i: F.add_months(s, i)
    elif part == "quarter":
        n = F.floor((month_no(e) - month_no(s)) / 3).cast("int")
        step = lambda i: F.add_months(s, i * 3)
    elif part == "year":
        n, step = F.year(e) - F.year(s), lambda i: F.add_months(s, i * 12)
    else:
        raise ValueError(f"unsupported date part {part!r}")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, step)


def date_spine(spark: SparkSession, part: str, start: str, end: str) -> DataFrame:
    """Rows ``date_<part>`` from start to end, end exclusive (empty when start >= end)."""
    one = spark.range(1)
    return one.select(F.explode(date_spine_col(part, F.lit(start), F.lit(end))).alias(f"date_{part}"))


# ---------------------------------------------------------------- SRT-3 column values
def column_values(df: DataFrame, column: str, max_records: int | None = None,
                  where: str | Column | None = None, order_by: str = "count") -> DataFrame:
    """Distinct values by descending frequency (value breaks ties), optional filter/limit."""
    src = df.where(where) if where is not None else df
    out = src.groupBy(column).agg(F.count(F.lit(1)).alias("n_records"))
    out = out.orderBy(F.col("n_records").desc(), F.col(column).asc_nulls_last())
    return out.limit(max_records) if max_records else out


# ---------------------------------------------------------------- SRT-2 paging
def paginate(df: DataFrame, order_by, page: int, per_page: int) -> DataFrame:
    """Rows of one page under a total order, plus the total row count per row.

    The count comes from a one-row aggregate (partial counts per task) joined
    as a broadcast; order keys are mandatory so pages are stable."""
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    keys = _cols(order_by)
    rows = df.orderBy(*keys).offset((page - 1) * per_page).limit(per_page)
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return rows.crossJoin(F.broadcast(total))


@dataclass(frozen=True)
class PageDirectory:
    """Where pages of a table lie: ranges of the first order column with their row counts, in order.

    ``build`` finds split points in one pass and counts rows per range in another; both are kept, as many as ``ranges``,
    so any number of pages is then served.  ``page`` reads and sorts only the ranges that hold the page, whose filter is a
    plain comparison that reaches the scan.  If one value fills such a range (a hot key), a directory of the next order column is
    built inside it, so no task sorts more than the rows of about one range.  Ascending order, nulls first."""

    keys: tuple[str, ...]
    points: tuple
    counts: tuple[int, ...]
    ranges: int

    @classmethod
    def build(cls, df: DataFrame, order_by, ranges: int = 256) -> "PageDirectory":
        keys = tuple(_cols(order_by))
        where = _Splits(df, keys[0], ranges)
        found = df.groupBy(where.number().alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``ranges`` rows
        counts = {r["r"]: r["n"] for r in found}
        return cls(keys, tuple(where.points), tuple(counts.get(i, 0) for i in range(2 * len(where.points) + 1)), ranges)

    @property
    def total_rows(self) -> int:
        return sum(self.counts)

    def page(self, df: DataFrame, page: int, per_page: int) -> DataFrame:
        """As ``paginate``, of the table the directory was built from."""
        if page < 1 or per_page < 1:
            raise ValueError("page and per_page start at 1")
        rows = self._slice(df, (page - 1) * per_page, per_page)
        return rows.withColumn("total_rows", F.lit(self.total_rows).cast("long"))

    def _slice(self, df: DataFrame, offset: int, limit: int) -> DataFrame:
        before, first, last, at = 0, None, None, 0
        for i, n in enumerate(self.counts):
            if first is None and at + n > offset:
                first, before = i, at
            if first is not None and at < offset + limit:
                last = i
            at += n
        if first is None:
            return df.limit(0)
        key = self.keys[0]
        inside = _Splits(df, key, points=self.points).within(first, last)
        rows, offset = df.where(inside), offset - before
        held = sum(self.counts[first:last + 1])
        if first == last and len(self.keys) > 1 and held > max(2 * self.total_rows // self.ranges, 4 * limit):
            least, greatest = rows.agg(F.min(key), F.max(key)).first()
            if least == greatest and rows.where(F.col(key).isNull()).limit(1).count() == 0:
                return PageDirectory.build(rows, list(self.keys[1:]), self.ranges)._slice(rows, offset, limit)
        return rows.orderBy(*self.keys).offset(offset).limit(limit)


class _Splits:
    """Ranges of a column around split points: range 2i lies between points i - 1 and i, range 2i + 1 is point i itself, so
    a frequent value has a range of its own; nulls are in range 0."""

    def __init__(self, df: DataFrame, key: str, ranges: int = 0, points=None):
        from .windows import _ordinal
        self.x = _ordinal(df, key)
        self.kind = df.select(self.x.alias("x")).schema["x"].dataType
        if points is None:
            shares = [i / ranges for i in range(1, ranges)]
            points = df.agg(F.percentile_approx(self.x, shares, 100 * ranges).alias("p")).first()["p"] if shares else None
        self.points = sorted(set(points or []))

    def _point(self, i: int) -> Column:
        return F.lit(self.points[i]).cast(self.kind)

    def number(self) -> Column:
        if not self.points:
            return F.lit(0)
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(self.points).bit_length()))])
        splits = F.array(*[self._point(i) for i in range(len(self.points))])
        less = lambda at, step: (at + step <= len(self.points)) & (F.get(splits, at + step - 1) < self.x)
        below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(less(at, step), F.lit(False)), at + step).otherwise(at))
        return below * 2 + F.when(F.get(splits, below) == self.x, 1).otherwise(0)

    def within(self, first: int, last: int) -> Column:
        """Rows of the ranges first to last."""
        low = F.lit(True) if first == 0 else self.x >= self._point(first // 2) if first % 2 else self.x > self._point(first // 2 - 1)
        high = self.x <= self._point(last // 2) if last % 2 else F.lit(True) if last == 2 * len(self.points) else self.x < self._point(last // 2)
        return (low & high) | self.x.isNull() if first == 0 else low & high


def sample_rows(df: DataFrame, n: int = 3) -> DataFrame:
    """PRJ-7 sample: the first n rows of a scan (LIMIT is the feature here)."""
    return df.limit(n)


# ---------------------------------------------------------------- PRJ-6 mask
def mask_pii(df: DataFrame, name_columns: Sequence[str] = NAME_COLUMNS) -> DataFrame:
    """Mask national ids in every string column and names in name columns.
    The id rule wins when a value matches both."""
    names = {c.lower() for c in name_columns}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.StringType):
            out.append(c)
            continue
        masked = mask_id_number(c)
        if f.name.lower() in names:
            masked = F.when(c.rlike(r"^\d{17}[\dXx]$"), masked).otherwise(mask_name(c))
        out.append(masked.alias(f.name))
    return df.select(out)


# ---------------------------------------------------------------- SRC-8 rename
def normalise_name(name: str) -> str:
    return re.sub(r"[_\s\-]", "", name.lower())


def rename_by_mapping(df: DataFrame, mapping: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Rename columns whose normalised name equals a target code or one of its
    display names (lower case, '_', spaces and '-' ignored)."""
    lookup = {}
    for target, aliases in mapping.items():
        for a in [target] + _cols(aliases):
            lookup[normalise_name(a)] = target
    ren = {c: lookup[normalise_name(c)] for c in df.columns
           if normalise_name(c) in lookup and lookup[normalise_name(c)] != c}
    return df.withColumnsRenamed(ren) if ren else df


# ---------------------------------------------------------------- AG-9
def group_by_n(df: DataFrame, n: int, *aggs: Column) -> DataFrame:
    """Group by the first n columns (positional GROUP BY 1..n)."""
    return df.groupBy(*df.columns[:n]).agg(*aggs)
