"""Reading, incremental sync, upsert, reconciliation and table profiling.

* Parallel reads: key ranges come from ``approx_percentile`` (one aggregate),
  not from a global ``row_number``; ranges are half-open ``(lo, hi]``,
  disjoint, cover every non-NULL key, and NULL keys get their own range.
* Incremental extract is a pushed-down filter ``inc_col > last_value``; the new
  cursor is ``max(inc_col)`` of the extract.
* Upsert keeps the latest row per key with an aggregate (``max_by`` over a
  struct), which combines map-side; it is written to a new path, never over
  the path being read.
* Reconciliation and profiling are single aggregate passes.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import own_session

# ---------------------------------------------------------------- SRC-5 type mapping
# Decimal digits that every value of an integer type holds at least.
_DIGITS = {T.ShortType(): 4, T.IntegerType(): 9, T.LongType(): 18}
# Names of source types, by the Spark type that holds their values.
_NAMES = {
    T.LongType(): "INT, INTEGER, SMALLINT",
    T.FloatType(): "BINARY_FLOAT, FLOAT",
    T.DoubleType(): "BINARY_DOUBLE, DOUBLE, DOUBLE PRECISION",
    T.BinaryType(): "BLOB, LONG RAW, RAW",
    T.TimestampNTZType(): "DATE, TIMESTAMP",
}
_BY_NAME = {name: kind for kind, names in _NAMES.items() for name in names.split(", ")}
_EXACT = frozenset(("DECIMAL", "NUMBER", "NUMERIC"))


def _exact_number(precision: int | None, scale: int, exact_money: bool) -> T.DataType:
    if scale:
        return T.DecimalType(min(precision or 38, 38), scale) if exact_money else T.DoubleType()
    fits = [kind for kind, digits in _DIGITS.items() if precision is not None and precision <= digits]
    return min(fits, key=_DIGITS.__getitem__, default=T.DecimalType(38, 0))


def source_type_to_spark(type_name: str, precision: int | None = None, scale: int | None = None,
                         exact_money: bool = True) -> T.DataType:
    """Map a relational source column type to a Spark type (every field nullable).

    An exact number without scale gets the narrowest integer type that holds its precision
    (decimal(38,0) when unknown or wider than 18 digits), one with a scale an exact decimal
    (``exact_money``) or double.  Precision notes such as TIMESTAMP(6) are ignored; a type that no
    Spark type matches is text."""
    name = type_name.upper().strip()
    if name in _EXACT:
        return _exact_number(precision, scale or 0, exact_money)
    return _BY_NAME.get(name) or _BY_NAME.get(name.split("(")[0].split(" ")[0], T.StringType())


def apply_source_schema(df: DataFrame, dictionary: Mapping[str, tuple]) -> DataFrame:
    """Cast columns per ``{column: (type_name, precision, scale)}``; values that do
    not convert become NULL (``try_cast``) instead of failing the job."""
    out = []
    for c in df.columns:
        if c in dictionary:
            dt = source_type_to_spark(*dictionary[c])
            out.append(F.col(f"`{c}`").try_cast(dt).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(out)


# ---------------------------------------------------------------- SRC-1/2/3 ranges
def key_ranges(df: DataFrame, key: str, n: int, accuracy: int = 10000) -> DataFrame:
    """``chunk_id, lower_exclusive, upper_inclusive, is_null_range`` for n chunks
    balanced by row count (approximate quantiles).  The first chunk has no lower
    bound, the last no upper bound, and one extra chunk holds NULL keys."""
    if n < 1:
        raise ValueError("n must be positive")
    qs = [i / n for i in range(1, n)]
    bounds = df.agg(F.array_sort(F.array_distinct(
        F.percentile_approx(F.col(key), qs, accuracy) if qs else F.array().cast(f"array<{df.schema[key].dataType.simpleString()}>")
    )).alias("b"))
    # chunks: (-inf, b0], (b0, b1], ..., (b_last, +inf)
    ex = bounds.select(F.posexplode(F.concat(F.col("b"), F.array(F.lit(None).cast(df.schema[key].dataType))))
                       .alias("chunk_id", "upper_inclusive"), "b")
    ex = ex.select("chunk_id", F.when(F.col("chunk_id") > 0, F.element_at("b", F.col("chunk_id"))).alias(
        "lower_exclusive"), "upper_inclusive", F.lit(False).alias("is_null_range"))
    null_range = bounds.select((F.size("b") + 1).alias("chunk_id"), F.lit(None).cast(df.schema[key].dataType)
                               .alias("lower_exclusive"), F.lit(None).cast(df.schema[key].dataType)
                               .alias("upper_inclusive"), F.lit(True).alias("is_null_range"))
    return ex.unionByName(null_range)


def range_predicate(key: Column, lower, upper, is_null: bool) -> Column:
    if is_null:
        return key.isNull()
    cond = key.isNotNull()
    if lower is not None:
        cond = cond & (key > F.lit(lower))
    if upper is not None:
        cond = cond & (key <= F.lit(upper))
    return cond


def assign_chunks(df: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """Tag each row with its chunk.  The bounds (n values, in one broadcast row) are searched by halves in the row."""
    bounds = F.broadcast(ranges.where(~F.col("is_null_range")).agg(F.array_sort(F.collect_list("upper_inclusive")).alias("_b")))
    k, last = F.col(key), F.size("_b")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(31))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.coalesce((step <= last - at) & (F.get(F.col("_b"), at + step - 1) < k), F.lit(False)), at + step).otherwise(at))
    return df.crossJoin(bounds).select(*df.columns, F.when(k.isNull(), last + 1).otherwise(found).alias("chunk_id"))


def sql_literal(value) -> str:
    """A boundary value as an SQL literal: numbers as they are, dates and timestamps typed, text quoted."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise TypeError(f"no SQL literal for {type(value).__name__}")


def jdbc_predicates(key: str, boundaries: Sequence) -> list[str]:
    """WHERE clauses for ``spark.read.jdbc(predicates=...)`` from sorted boundary
    values (a short list: one per chunk): disjoint ``(lo, hi]`` ranges plus a
    NULL-key range."""
    cuts = [None, *map(sql_literal, boundaries), None]
    preds = []
    for low, high in zip(cuts, cuts[1:]):
        sides = [f"{key} > {low}"] * (low is not None) + [f"{key} <= {high}"] * (high is not None)
        preds.append(" AND ".join(sides) or f"{key} IS NOT NULL")
    return [*preds, f"{key} IS NULL"]


def read_jdbc_ranges(spark: SparkSession, url: str, table: str, key: str, boundaries: Sequence,
                     properties: dict, columns: Sequence[str] | None = None, where: str | None = None,
                     fetchsize: int = 10000) -> DataFrame:
    """Parallel JDBC read: one task per key range; the optional ``where`` (e.g.
    an incremental filter) is ANDed into every range, and the column list is
    pushed into the query."""
    preds = jdbc_predicates(key, boundaries)
    if where:
        preds = [f"({p}) AND ({where})" for p in preds]
    props = dict(properties, fetchsize=str(fetchsize))
    df = spark.read.jdbc(url, table, predicates=preds, properties=props)
    return df.select(*columns) if columns else df


# ---------------------------------------------------------------- SYNC-1 incremental
# Fixed value: where a table without a cursor starts, if its incremental column is a date or a time.
INITIAL_CURSOR = "2020-01-01"


def incremental(df: DataFrame, inc_col: str, last_value) -> DataFrame:
    """Rows with ``inc_col > last_value`` (open lower bound; pushed to the scan).  Without a last value
    dates and times start after ``INITIAL_CURSOR``; other columns are read whole."""
    if last_value is None:
        if not _is_incremental_type(df.schema[inc_col].dataType)[1]:
            return df
        last_value = INITIAL_CURSOR
    lit = F.lit(last_value).cast(df.schema[inc_col].dataType)
    return df.where(F.col(inc_col) > lit)


def new_cursor(extract: DataFrame, table: str, inc_col: str) -> DataFrame:
    """``table_name, column_name, last_value`` = max of the extracted column."""
    return extract.agg(F.max(inc_col).cast("string").alias("last_value")).select(
        F.lit(table).alias("table_name"), F.lit(inc_col).alias("column_name"), "last_value")


def advance_state(state: DataFrame, cursors: DataFrame) -> DataFrame:
    """New state table: cursors replace the state rows of the same table, others
    are kept; a NULL new value (empty extract) keeps the old cursor."""
    s = state.alias("s")
    c = cursors.alias("c")
    j = s.join(c, F.col("s.table_name") == F.col("c.table_name"), "full")
    return j.select(F.coalesce(F.col("c.table_name"), F.col("s.table_name")).alias("table_name"),
                    F.coalesce(F.col("c.column_name"), F.col("s.column_name")).alias("column_name"),
                    F.coalesce(F.col("c.last_value"), F.col("s.last_value")).alias("last_value"))


# ---------------------------------------------------------------- SNK-1/2/3 sinks
def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], order_col: str | None = None) -> DataFrame:
    """Merge on primary key: the delta's row with the greatest ``order_col`` per key replaces the base row
    unless that one is later; without an order column the delta wins.  ``base`` has one row per key, as
    earlier merges leave it.  Only the delta is aggregated; NULL keys equal NULL keys, a NULL order value is least."""
    keys = list(keys)
    cols = base.columns
    rest = [c for c in cols if c not in keys]
    rank = F.struct(*([F.col(order_col)] if order_col else []), *[F.col(c) for c in rest if c != order_col])
    last = delta.select(*cols).groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_new"))
    last = last.select(*[F.col(k).alias(f"_new_{k}") for k in keys], "_new", F.lit(True).alias("_in_delta"))
    old = base.select(*cols, F.lit(True).alias("_in_base"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    j = old.join(last, same, "full")
    new = F.col("_in_base").isNull()
    if order_col:
        later = F.coalesce(F.col(order_col) > F.col(f"_new.{order_col}"), F.col(order_col).isNotNull() & F.col(f"_new.{order_col}").isNull())
        new = new | (F.col("_in_delta").isNotNull() & ~later)
    else:
        new = new | F.col("_in_delta").isNotNull()
    return j.select(*[(F.when(new, F.col(f"_new_{c}")) if c in keys else F.when(new, F.col(f"_new.{c}")))
                      .otherwise(F.col(c)).alias(c) for c in cols])


def write_upsert(spark: SparkSession, base_path: str, delta: DataFrame, keys: Sequence[str], order_col: str | None,
                 out_path: str) -> str:
    """Upsert into a new parquet path (the caller swaps a pointer to it); the
    base path is only read, so a failed job leaves it intact."""
    if out_path.rstrip("/") == base_path.rstrip("/"):
        raise ValueError("write to a new path, not over the table being read")
    merged = upsert(spark.read.parquet(base_path), delta, keys, order_col)
    merged.write.mode("overwrite").parquet(out_path)
    return out_path


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """SNK-1 full replace."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """SNK-3: merge partial results by column name; columns missing in a part
    are NULL, types widen to the first part's type."""
    first = parts[0]
    types = {f.name: f.dataType for f in first.schema.fields}
    out = []
    for p in parts:
        out.append(p.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
                              for c in p.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


# ---------------------------------------------------------------- SYNC-5/6/7 reconcile
def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` for several tables, as one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def reconcile(source_counts: DataFrame, target_counts: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per table: counts, difference, error rate and status.  A table missing on
    the target is an error; an empty source with a non-empty target has rate 1."""
    s = source_counts.select("table_name", F.col("row_count").alias("source_count"))
    t = target_counts.select("table_name", F.col("row_count").alias("target_count"))
    j = s.join(t, "table_name", "left")
    diff = F.abs(F.col("source_count") - F.coalesce(F.col("target_count"), F.lit(0)))
    rate = (F.when(F.col("source_count") > 0, diff / F.col("source_count"))
            .when(F.col("target_count") == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    status = (F.when(F.col("target_count").isNull(), "error")
              .when(rate <= tolerance, "success").otherwise("mismatch"))
    return j.select("table_name", "source_count", F.coalesce(F.col("target_count"), F.lit(0)).alias("target_count"),
                    diff.alias("difference"), F.round(rate, 6).alias("error_rate"), status.alias("status"))


def reconcile_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total_tables"), F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "mismatch").alias("mismatch"), F.count_if(F.col("status") == "error")
        .alias("error"), F.sum("source_count").alias("total_source_rows"),
        F.sum("target_count").alias("total_target_rows"),
        F.coalesce(F.bool_and(F.col("status") == "success"), F.lit(True)).alias("all_passed"))


# ---------------------------------------------------------------- SRC-6 copy
# Error classes of a value that does not fit its declared type.
CONVERSION_ERRORS = ("CAST_INVALID_INPUT", "CAST_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE", "DATATYPE_MISMATCH")


def copy_tables(spark: SparkSession, tables: Mapping[str, DataFrame], out_root: str,
                dictionaries: Mapping[str, Mapping[str, tuple]] | None = None,
                skip_empty: bool = True) -> DataFrame:
    """Copy each table to ``out_root/<name>`` (parquet), casting columns
    strictly to the types of its source dictionary (``{column: (type,
    precision, scale)}``) when one is given.  Empty tables are skipped; a
    table whose typed write fails (a value that does not fit its declared
    type) is written with every column as string instead.  Returns
    ``table_name, mode, row_count`` with the counts read back from the written
    copies (the migration check compares them with the sources)."""
    modes = []
    for name, df in tables.items():
        path = f"{out_root.rstrip('/')}/{name}"
        if skip_empty and df.isEmpty():
            modes.append((name, "skipped"))
            continue
        spec = (dictionaries or {}).get(name, {})
        typed = df.select([F.col(f"`{c}`").cast(source_type_to_spark(*spec[c])).alias(c) if c in spec
                           else F.col(f"`{c}`") for c in df.columns])
        try:
            typed.write.mode("overwrite").parquet(path)
            modes.append((name, "typed"))
        except Exception as e:
            if not any(kind in str(e) for kind in CONVERSION_ERRORS):
                raise  # a full disk or a lost executor is no reason to give up the types
            df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]) \
                .write.mode("overwrite").parquet(path)
            modes.append((name, "string"))
    mode_df = spark.createDataFrame(modes, "table_name string, mode string")
    written = [n for n, m in modes if m != "skipped"]
    if not written:
        return mode_df.withColumn("row_count", F.lit(0).cast("long"))
    counts = table_counts({n: spark.read.parquet(f"{out_root.rstrip('/')}/{n}") for n in written})
    return mode_df.join(counts, "table_name", "left").select(
        "table_name", "mode", F.coalesce("row_count", F.lit(0)).alias("row_count"))


def table_profile(df: DataFrame, table_name: str, key: str | None = None) -> DataFrame:
    """One row: row count, column count and names, key column (given, else the first column that ends in
    ``key`` or ``id``), whether it is unique and not NULL, cursor candidates, best first, and the bytes and
    number of files read, from the scan's own file metadata."""
    key = key or next((c for c in df.columns if c.lower().endswith(("key", "id"))), None)
    shape = df.agg(F.count(F.lit(1)).alias("row_count"))
    if key:
        k = df.groupBy(F.col(f"`{key}`").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        unique = k.agg(F.coalesce(F.bool_and((F.col("n") == 1) & F.col("k").isNotNull()), F.lit(True)).alias("key_is_unique"))
    else:
        unique = shape.select(F.lit(False).alias("key_is_unique"))
    cand = incremental_candidates(df).agg(F.transform(F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("s"), (-F.col("non_null_pct")).alias("p"), "column_name"))), lambda c: c["column_name"])
        .alias("cursor_candidates"))  # at most five rows
    if df.inputFiles():
        files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f").agg(
            F.max("b").alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("size_bytes"), F.count(F.lit(1)).cast("int").alias("n_files"))
    else:
        files = shape.select(F.lit(0).cast("bigint").alias("size_bytes"), F.lit(0).alias("n_files"))
    return shape.crossJoin(unique).crossJoin(cand).crossJoin(files).select(
        F.lit(table_name).alias("table_name"), "row_count", "size_bytes", "n_files", F.lit(len(df.columns)).alias("n_columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"), F.lit(key).alias("key_column"), "key_is_unique", "cursor_candidates")


# ---------------------------------------------------------------- SYNC-2/3 profile
# Keyword weights for incremental-column candidates.
CANDIDATE_KEYWORDS = (("ID", 10), ("UPDATE_TIME", 9), ("MODIFY_TIME", 9), ("UPDATE_DATE", 8),
                      ("CREATE_TIME", 7), ("CREATE_DATE", 7), ("SEQ", 6), ("SEQUENCE", 6))


def profile(df: DataFrame) -> DataFrame:
    """``column_name, data_type, non_null_pct, row_count`` for every column in
    one aggregate pass over the table."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(F.col(f"`{c}`")).alias(f"_c{i}")
                                             for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                     F.col(f"_c{i}").alias("nn")) for i, c in enumerate(df.columns)]
    long = wide.select("_n", F.explode(F.array(*rows)).alias("r"))
    pct = F.round(F.try_divide(F.col("r.nn") * 100.0, F.col("_n")), 2)
    return long.select("r.column_name", "r.data_type", pct.alias("non_null_pct"), F.col("_n").alias("row_count"))


def _is_incremental_type(dt: T.DataType) -> tuple[bool, bool]:
    numeric = isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.DecimalType, T.DoubleType, T.FloatType))
    temporal = isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return numeric, temporal


def incremental_candidates(df: DataFrame, top: int = 5) -> DataFrame:
    """Rank numeric/date columns as incremental cursors: keyword score (max of
    matching weights), date columns kept at score 0, by (-score, -non-NULL %)."""
    keep = []
    for f in df.schema.fields:
        numeric, temporal = _is_incremental_type(f.dataType)
        if not (numeric or temporal):
            continue
        score = max([w for k, w in CANDIDATE_KEYWORDS if k in f.name.upper()] or [0])
        if score > 0 or temporal:
            keep.append((f.name, score))
    prof = profile(df.select(*[k for k, _ in keep])) if keep else None
    if prof is None:
        return df.sparkSession.createDataFrame([], "column_name string, data_type string, score int, "
                                                   "non_null_pct double")
    scores = F.create_map(*[x for k, s in keep for x in (F.lit(k), F.lit(s))])
    out = prof.select("column_name", "data_type", scores[F.col("column_name")].alias("score"), "non_null_pct")
    return out.orderBy(F.col("score").desc(), F.col("non_null_pct").desc(), "column_name").limit(top)


# ---------------------------------------------------------------- SRC-6/7/9 files
def read_files(spark: SparkSession, path: str, fmt: str, schema: T.StructType,
               corrupt_column: str = "_corrupt_record", **options) -> DataFrame:
    """CSV/JSON ingest with an explicit schema; malformed rows are kept with the
    raw text in ``corrupt_column`` (PERMISSIVE) instead of failing the read.

    The rows belong to a session of their own with the settings of ``spark``: a session that has observed a query
    cannot ship models that keep a reference to it (forests and logistic regression do, in their training summary)."""
    full = T.StructType(schema.fields + [T.StructField(corrupt_column, T.StringType(), True)])
    reader = own_session(spark).read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt_column)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.format(fmt).load(path)


def ingest_with_report(df: DataFrame, target: str, corrupt_column: str = "_corrupt_record"):
    """Split good/bad rows and count them while the good rows are written
    (``Observation`` metrics, no extra pass).  Returns (good_df, observation);
    after the write, ``observation.get`` holds total/success/failed.  The session of ``df`` should fit no
    models, as that of ``read_files`` does not."""
    obs = Observation(f"import_{target}")
    bad = F.col(corrupt_column).isNotNull()
    observed = df.observe(obs, F.count(F.lit(1)).alias("total_rows"), F.count_if(~bad).alias("success_rows"),
                          F.count_if(bad).alias("failed_rows"))
    return observed.where(~bad).drop(corrupt_column), obs


def import_history_row(spark: SparkSession, file_name: str, target: str, metrics: dict, status: str = "done",
                       error: str | None = None) -> DataFrame:
    """One history row (file, table, total/success/failed, status, error)."""
    return spark.createDataFrame(
        [(file_name, target, int(metrics.get("total_rows", 0)), int(metrics.get("success_rows", 0)),
          int(metrics.get("failed_rows", 0)), status, error)],
        "file_name string, target_table string, total_rows long, success_rows long, failed_rows long, "
        "status string, error_message string").withColumn("created_at", F.current_timestamp())
