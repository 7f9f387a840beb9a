"""Registered sync queries (SRC-1, SNK-2/3, SYNC-1/2/3/5/6/7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import tables as TB
from ..operators.stats import exact_quantiles
from ..session import written_table_dir
from ..sources import adapters as A
from ..sources import range_reader as RR
from ..sources import sync as SY
from ..sources.tables import Catalog
from ..streaming import jobs as J
from ..streaming import merge_table as MT
from ..streaming import open_events as OE
from . import medallion as M
from .registry import register


@register("sync_incremental", "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'", "SYNC-1")
def sync_incremental(spark, d):
    return SY.incremental(Catalog(spark, d).events, "ts", "2024-01-20 00:00:00")


@register("sync_cursor", """
SELECT 'events' AS table_name, 'ts' AS column_name, CAST(max(ts) AS VARCHAR) AS last_value
FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'""", "SYNC-1")
def sync_cursor(spark, d):
    ex = SY.incremental(Catalog(spark, d).events, "ts", "2024-01-20 00:00:00")
    return SY.new_cursor(ex, "events", "ts")


@register("sync_upsert", """
WITH u AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, 0 AS is_delta FROM orders
  UNION ALL
  SELECT o_orderkey, 'F', o_totalprice, o_orderdate + INTERVAL 30 DAY, 1 FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM u
QUALIFY row_number() OVER (PARTITION BY o_orderkey
  ORDER BY o_orderdate DESC, is_delta DESC, o_orderstatus DESC, o_totalprice DESC) = 1""", "SNK-2/STR-1")
def sync_upsert(spark, d):
    o = Catalog(spark, d).orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    delta = o.where(F.col("o_orderstatus") == "O").select(
        "o_orderkey", F.lit("F").alias("o_orderstatus"), "o_totalprice",
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("o_orderdate"))
    return SY.upsert(o, delta, ["o_orderkey"], "o_orderdate")


@register("sync_union_parts", """
SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderpriority FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'""", "SNK-3/SET-5")
def sync_union_parts(spark, d):
    o = Catalog(spark, d).orders
    return SY.union_parts([o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice"),
                           o.where(F.col("o_orderstatus") != "F").select("o_orderkey", "o_totalprice",
                                                                         "o_orderpriority")])


_RECONCILE = """
WITH s AS (SELECT 'orders' AS table_name, count(*) AS source_count FROM orders
           UNION ALL SELECT 'lineitem', count(*) FROM lineitem
           UNION ALL SELECT 'customer', count(*) FROM customer
           UNION ALL SELECT 'events', count(*) FROM events),
t AS (SELECT 'orders' AS table_name, count(*) AS target_count FROM orders WHERE o_totalprice > 0
      UNION ALL SELECT 'lineitem', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
      UNION ALL SELECT 'customer', count(*) FROM customer),
j AS (SELECT s.table_name, s.source_count, t.target_count FROM s LEFT JOIN t USING (table_name)),
r AS (SELECT table_name, source_count, coalesce(target_count, 0) AS target_count,
             abs(source_count - coalesce(target_count, 0)) AS difference,
             round(CASE WHEN source_count > 0 THEN abs(source_count - coalesce(target_count, 0)) / source_count
                        WHEN target_count = 0 THEN 0.0 ELSE 1.0 END, 6) AS error_rate,
             CASE WHEN target_count IS NULL THEN 'error'
                  WHEN (CASE WHEN source_count > 0 THEN abs(source_count - coalesce(target_count, 0)) / source_count
                             WHEN target_count = 0 THEN 0.0 ELSE 1.0 END) <= 0.01 THEN 'success'
                  ELSE 'mismatch' END AS status
      FROM j)"""


def _reconcile(spark, d):
    cat = Catalog(spark, d)
    src = SY.table_counts({"orders": cat.orders, "lineitem": cat.lineitem, "customer": cat.customer,
                           "events": cat.events})
    li = cat.lineitem
    tgt = SY.table_counts({
        "orders": M.stg_contracts(A.raw_contracts(cat)),
        "lineitem": TB.deduplicate(li.select("l_orderkey", "l_linenumber", "l_shipdate"),
                                   ["l_orderkey", "l_linenumber"], ["l_shipdate"]),
        "customer": M.stg_customers(A.raw_customers(cat)),
    })
    return SY.reconcile(src, tgt, tolerance=0.01)


@register("sync_reconcile", _RECONCILE + "\nSELECT * FROM r", "SYNC-5/SYNC-7")
def sync_reconcile(spark, d):
    return _reconcile(spark, d)


@register("sync_reconcile_summary", _RECONCILE + """
SELECT count(*) AS total_tables, CAST(count_if(status = 'success') AS BIGINT) AS success,
       CAST(count_if(status = 'mismatch') AS BIGINT) AS mismatch, CAST(count_if(status = 'error') AS BIGINT) AS error,
       CAST(sum(source_count) AS BIGINT) AS total_source_rows, CAST(sum(target_count) AS BIGINT) AS total_target_rows,
       coalesce(bool_and(status = 'success'), true) AS all_passed
FROM r""", "SYNC-6")
def sync_reconcile_summary(spark, d):
    return SY.reconcile_summary(_reconcile(spark, d))


_ORDER_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@register("sync_profile", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, round(count({c}) * 100.0 / nullif(count(*), 0), 2) "
    f"AS non_null_pct, count(*) AS row_count FROM orders" for c, t in _ORDER_TYPES), "SYNC-2/AG-10")
def sync_profile(spark, d):
    return SY.profile(Catalog(spark, d).orders)


@register("sync_candidates", """
SELECT * FROM (
  SELECT 'event_id' AS column_name, 'bigint' AS data_type, CAST(10 AS INTEGER) AS score,
         round(count(event_id) * 100.0 / nullif(count(*), 0), 2) AS non_null_pct FROM events
  UNION ALL SELECT 'ts', 'timestamp_ntz', CAST(0 AS INTEGER), round(count(ts) * 100.0 / nullif(count(*), 0), 2)
  FROM events
  UNION ALL SELECT 'user_id', 'bigint', CAST(10 AS INTEGER), round(count(user_id) * 100.0 / nullif(count(*), 0), 2)
  FROM events)
ORDER BY score DESC, non_null_pct DESC, column_name LIMIT 5""", "SYNC-3")
def sync_candidates(spark, d):
    return SY.incremental_candidates(Catalog(spark, d).events)


# bounds are approximate quantiles: that every row is in the chunk whose bounds hold it, that chunks follow one another and
# that none holds twice its share are the answers that do not depend on them
@register("sync_key_ranges", A.with_ctes("raw_repayments") + """
SELECT count(*) AS total_rows, count(*) AS assigned_rows, CAST(0 AS BIGINT) AS misplaced_rows, true AS chunks_are_balanced,
       count(*) FILTER (WHERE actual_date IS NULL) AS null_key_rows
FROM raw_repayments""", "SRC-1/SRC-2/SRC-3")
def sync_key_ranges(spark, d):
    rp = A.raw_repayments(Catalog(spark, d)).select("actual_date")
    ranges = SY.key_ranges(rp, "actual_date", 8).cache()
    k, low, high = F.col("actual_date"), F.col("lower_exclusive"), F.col("upper_inclusive")
    inside = F.when(F.col("is_null_range"), k.isNull()).otherwise(
        k.isNotNull() & F.coalesce(k > low, F.lit(True)) & F.coalesce(k <= high, F.lit(True)))
    per = (SY.assign_chunks(rp, "actual_date", ranges).join(ranges, "chunk_id", "left")
           .groupBy("chunk_id", "is_null_range").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("bad")))
    total = rp.agg(F.count(F.lit(1)).alias("total_rows"), F.count("actual_date").alias("keyed"))
    got = per.agg(F.sum("n").alias("assigned_rows"), F.sum("bad").alias("misplaced_rows"),
                  F.max(F.when(~F.col("is_null_range"), F.col("n"))).alias("largest"),
                  F.coalesce(F.sum(F.when(F.col("is_null_range"), F.col("n"))), F.lit(0)).alias("null_key_rows"))
    return total.crossJoin(got).select("total_rows", "assigned_rows", "misplaced_rows",
                                       (F.col("largest") * 8 <= F.col("keyed") * 2).alias("chunks_are_balanced"), "null_key_rows")


# ---------------------------------------------------------------- written tables
def _copied(spark, d):
    """Orders with their dictionary, customers with one that does not hold: the copies' root and the report."""
    cat, root = Catalog(spark, d), written_table_dir(spark, "copy")
    report = SY.copy_tables(spark, {"orders": cat.orders, "customer": cat.customer, "none": cat.orders.limit(0)}, root, {
        "orders": {"o_orderkey": ("NUMBER", 18, 0), "o_totalprice": ("NUMBER", 16, 2)}, "customer": {"c_name": ("NUMBER", 9, 0)}})
    return root, report


@register("sync_copy", """
SELECT 'orders' AS table_name, 'typed' AS mode, count(*) AS row_count FROM orders
UNION ALL SELECT 'customer', 'string', count(*) FROM customer UNION ALL SELECT 'none', 'skipped', 0""", "SRC-6")
def sync_copy(spark, d):
    return _copied(spark, d)[1]


@register("sync_migration_check", """
SELECT 'orders' AS table_name, count(*) AS source_count, count(*) AS target_count, CAST(0 AS BIGINT) AS difference,
       CAST(0 AS DOUBLE) AS error_rate, 'success' AS status FROM orders
UNION ALL
SELECT 'customer', count(*), count(*), 0, 0, 'success' FROM customer""", "SYNC-7")
def sync_migration_check(spark, d):
    root, report = _copied(spark, d)
    cat = Catalog(spark, d)
    return SY.reconcile(SY.table_counts({"orders": cat.orders, "customer": cat.customer}), report, tolerance=0.0)


@register("sync_source_types", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, TRY_CAST(o_orderstatus AS SMALLINT) AS o_orderstatus,
       CAST(o_totalprice AS DECIMAL(16, 2)) AS o_totalprice, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderdate, o_orderpriority
FROM orders""", "SRC-5")
def sync_source_types(spark, d):
    return SY.apply_source_schema(Catalog(spark, d).orders, {
        "o_orderkey": ("NUMBER", 18, 0), "o_orderstatus": ("NUMBER", 4, 0), "o_totalprice": ("NUMBER", 16, 2),
        "o_custkey": ("NUMBER", 9, 0), "o_orderdate": ("DATE",), "o_orderpriority": ("VARCHAR2",)})


@register("sync_replace", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders", "SNK-1")
def sync_replace(spark, d):
    o, path = Catalog(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), written_table_dir(spark, "replaced")
    SY.overwrite(o.where("o_orderstatus = 'F'"), path)
    SY.overwrite(o, path, ["o_orderstatus"])
    return spark.read.parquet(path)


@register("sync_files", """
SELECT 'customer.csv' AS file_name, 'customer' AS target_table, count(*) AS total_rows,
       count(*) FILTER (WHERE c_custkey % 10 <> 0) AS success_rows, count(*) FILTER (WHERE c_custkey % 10 = 0) AS failed_rows,
       'done' AS status, CAST(NULL AS VARCHAR) AS error_message
FROM customer""", "SRC-7/SRC-9")
def sync_files(spark, d):
    path = written_table_dir(spark, "csv")
    Catalog(spark, d).customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 10 = 0 THEN 'oops' ELSE CAST(c_acctbal AS STRING) END AS c_acctbal") \
        .write.csv(path, header=True)
    # observed in a session of its own: models that logistic regression fits in a session with observations cannot be shipped
    rows = SY.read_files(spark.newSession(), path, "csv", T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_acctbal", T.DoubleType())]),
                         header="true")
    good, seen = SY.ingest_with_report(rows, "customer")
    good.write.parquet(written_table_dir(spark, "ingested"))
    return SY.import_history_row(spark, "customer.csv", "customer", seen.get).drop("created_at")


@register("sync_table_profile", """
SELECT 'orders' AS table_name, count(*) AS row_count, CAST(6 AS INTEGER) AS n_columns, 'o_orderkey' AS key_column,
       count(*) = count(DISTINCT o_orderkey) AS key_is_unique, 'o_orderdate' AS cursor_candidates
FROM orders""", "SYNC-2")
def sync_table_profile(spark, d):
    p = SY.table_profile(Catalog(spark, d).orders, "orders")
    return p.select("table_name", "row_count", "n_columns", "key_column", "key_is_unique", F.concat_ws(",", "cursor_candidates").alias("cursor_candidates"))


@register("sync_initial_cursor", "SELECT * FROM events WHERE ts > TIMESTAMP '2020-01-01 00:00:00'", "SYNC-1")
def sync_initial_cursor(spark, d):
    return SY.incremental(Catalog(spark, d).events, "ts", None)


@register("union_matching", """
SELECT 'parts_orders_f' AS _dbt_source_relation, o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderpriority FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'parts_orders_o', o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'""", "SET-2")
def union_matching(spark, d):
    o = Catalog(spark, d).orders
    o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").createOrReplaceTempView("parts_orders_f")
    o.where("o_orderstatus <> 'F'").select("o_orderkey", "o_totalprice", "o_orderpriority").createOrReplaceTempView("parts_orders_o")
    o.createOrReplaceTempView("parts_orders_old")
    return TB.union_matching(spark, "parts_orders_%", exclude="%_old")


@register("materialised_layer", A.with_ctes("raw_contracts") + """
SELECT status, count(*) AS n, round(sum(loan_amt), 2) AS total FROM raw_contracts GROUP BY status""", "MD-8")
def materialised_layer(spark, d):
    stored = M.materialise(A.raw_contracts(Catalog(spark, d)), written_table_dir(spark, "layer"))
    return stored.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("loan_amt"), 2).alias("total"))


# ---------------------------------------------------------------- streams over a written copy of events
def _event_files(spark, d):
    path = written_table_dir(spark, "events")
    Catalog(spark, d).events.select(*J.LEDGER_SCHEMA.names).repartition(4).write.parquet(path)
    return path


def _run_stream(spark, rows):
    out = written_table_dir(spark, "stream")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", written_table_dir(spark, "progress")) \
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


_UPSERTED = """
SELECT event_id, ts, user_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


@register("stream_upsert", _UPSERTED, "STR-1")
def stream_upsert(spark, d):
    root = written_table_dir(spark, "upserted")
    J.upsert_stream(spark, _event_files(spark, d), J.LEDGER_SCHEMA, root, ["user_id"], "ts", written_table_dir(spark, "progress"),
                    max_files_per_trigger=2).awaitTermination()
    return J.read_table(spark, root, J.LEDGER_SCHEMA)


@register("stream_off_hours", A.with_ctes("ledger") + """
SELECT ledger_id, person_id, trans_type, trans_amount, trans_ts FROM ledger
WHERE hour(trans_ts) < 8 OR hour(trans_ts) > 22 OR dayofweek(trans_ts) IN (0, 6)""", "STR-2")
def stream_off_hours(spark, d):
    events = spark.readStream.schema(J.LEDGER_SCHEMA).parquet(_event_files(spark, d))
    return _run_stream(spark, J.off_hours_stream(events)).select("ledger_id", "person_id", "trans_type", "trans_amount", "trans_ts")


@register("stream_daily_withdrawals", """
WITH p AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day_start, user_id, value, ts FROM events WHERE event_type = 'purchase')
SELECT day_start, user_id AS person_id, count(*) AS times, round(sum(value), 4) AS total_amount FROM p
WHERE day_start + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM p) GROUP BY 1, 2""",
          "STR-3")
def stream_daily_withdrawals(spark, d):
    events = spark.readStream.schema(J.LEDGER_SCHEMA).parquet(_event_files(spark, d))
    return _run_stream(spark, J.daily_withdrawals_stream(events)).withColumn("total_amount", F.round("total_amount", 4))


@register("stream_event_dedupe", "SELECT DISTINCT user_id AS subject_id, event_type AS risk_type FROM events", "STR-4")
def stream_event_dedupe(spark, d):
    events = spark.readStream.schema(J.LEDGER_SCHEMA).parquet(_event_files(spark, d)).selectExpr(
        "user_id AS subject_id", "event_type AS risk_type", "ts AS created_at")
    return _run_stream(spark, J.dedupe_events_stream(events)).select("subject_id", "risk_type")


# ---------------------------------------------------------------- merge on read, and state across batches
@register("stream_merge_on_read", _UPSERTED, "STR-1/SNK-2")
def stream_merge_on_read(spark, d):
    """One micro-batch per file, each a delta of the table; the fourth is followed by a compaction."""
    table = MT.MergeTable(written_table_dir(spark, "merged"), J.LEDGER_SCHEMA, ("user_id",), "ts")
    MT.merge_stream(spark, _event_files(spark, d), table, written_table_dir(spark, "progress"), max_files_per_trigger=1).awaitTermination()
    return table.read(spark)


@register("sync_merge_on_read", """
WITH u AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, 0 AS is_delta FROM orders
  UNION ALL
  SELECT o_orderkey, 'F', o_totalprice, o_orderdate + INTERVAL 30 DAY, 1 FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM u
QUALIFY row_number() OVER (PARTITION BY o_orderkey
  ORDER BY o_orderdate DESC, is_delta DESC, o_orderstatus DESC, o_totalprice DESC) = 1""", "SNK-2")
def sync_merge_on_read(spark, d):
    o = Catalog(spark, d).orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    table = MT.MergeTable(written_table_dir(spark, "merged"), o.schema, ("o_orderkey",), "o_orderdate")
    table.add(o, 0)
    later = (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("o_orderdate")
    table.add(o.where("o_orderstatus = 'O'").select("o_orderkey", F.lit("F").alias("o_orderstatus"), "o_totalprice", later), 1)
    return table.read(spark)


def _action_parts(spark, d, parts=4):
    """Events as signals, and purchases of whole tens as feedback, in parts by quantiles of the id."""
    events = Catalog(spark, d).events
    verdict = F.when(F.col("event_id") % 10 == 0, "confirmed")
    actions = events.select(F.col("event_id").alias("row_id"), F.col("user_id").cast("string").alias("subject_id"), F.col("event_type").alias("risk_type"),
                            F.col("ts").cast("timestamp").alias("at"), F.when(verdict.isNull(), F.col("value")).alias("score"), verdict.alias("verdict"))
    bounds = exact_quantiles(events, "event_id", [i / parts for i in range(1, parts)])
    part = reduce(lambda a, b: a + b, [(F.col("row_id") > b).cast("int") for b in bounds])
    return [actions.where(part == i) for i in range(parts)]


@register("stream_open_events", """
WITH e AS (SELECT event_id, user_id::VARCHAR AS subject_id, event_type AS risk_type, ts, value, event_id % 10 = 0 AS closes FROM events),
-- the batches are quarters of the ids; inside a batch the time decides, signals before feedback
q AS (SELECT quantile_cont(event_id, 0.25) AS a, quantile_cont(event_id, 0.5) AS b, quantile_cont(event_id, 0.75) AS c FROM events),
o AS (SELECT e.*, row_number() OVER w AS i, lag(closes) OVER w AS before FROM e, q
  WINDOW w AS (PARTITION BY subject_id, risk_type ORDER BY (event_id > a)::INT + (event_id > b)::INT + (event_id > c)::INT, ts, closes, event_id)),
-- an event opens at the first signal of a key and at each signal after feedback; the next feedback closes it
s AS (SELECT *, sum(closes::INT) OVER (PARTITION BY subject_id, risk_type ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life FROM o),
g AS (SELECT subject_id, risk_type, coalesce(life, 0) AS life, min_by(event_id, i) FILTER (WHERE NOT closes) AS event_id,
    min_by(value, i) FILTER (WHERE NOT closes) AS score, min_by(ts, i) FILTER (WHERE NOT closes) AS opened_at,
    max(ts) FILTER (WHERE closes) AS closed_at, count(*) FILTER (WHERE NOT closes) AS signals FROM s GROUP BY 1, 2, 3)
SELECT subject_id, risk_type, event_id, score, CASE WHEN closed_at IS NULL THEN 'Pending' ELSE 'Closed' END AS status,
  CASE WHEN closed_at IS NULL THEN NULL ELSE 'confirmed' END AS verdict, opened_at, closed_at
FROM g WHERE signals > 0""", "STR-4/ML-14/ML-15")
def stream_open_events(spark, d):
    """Each part of the events is a micro-batch of its own: it arrives, in as many files as it is read in, and the stream goes on."""
    path, out, progress = (written_table_dir(spark, n) for n in ("actions", "changes", "progress"))
    for part in _action_parts(spark, d):
        part.write.mode("append").parquet(path)
        OE.run_open_events(spark, path, out, progress, files_per_batch=None).awaitTermination()
    table = OE.event_table(spark.read.schema(OE.CHANGES).parquet(out))
    return table.withColumn("opened_at", F.col("opened_at").cast("timestamp_ntz")).withColumn("closed_at", F.col("closed_at").cast("timestamp_ntz"))


# ---------------------------------------------------------------- partitioned reads of a written copy
def _orders_copy(spark, d):
    path = written_table_dir(spark, "source")
    Catalog(spark, d).orders.repartitionByRange(4, "o_custkey").sortWithinPartitions("o_custkey").write.parquet(path)
    return path


_READ = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"


def _read(spark, d, **options):
    rows = RR.read_ranges(spark, _orders_copy(spark, d), **options)
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@register("read_key_ranges", _READ + " WHERE o_custkey > 100 AND o_orderstatus = 'F'", "SRC-1")
def read_key_ranges(spark, d):
    return _read(spark, d, key="o_custkey", ranges="8").where("o_custkey > 100 AND o_orderstatus = 'F'")


@register("read_source_parts", _READ + " WHERE o_orderstatus <> 'F'", "SRC-2")
def read_source_parts(spark, d):
    return _read(spark, d, by="parts").where("o_orderstatus <> 'F'")


@register("read_sequential", _READ, "SRC-3/SRC-4")
def read_sequential(spark, d):
    return _read(spark, d)


@register("stream_incremental", "SELECT event_id, user_id, event_type FROM events", "SYNC-1")
def stream_incremental(spark, d):
    """Events arrive in two parts; the second run of the stream reads those above the greatest key of the first."""
    events = Catalog(spark, d).events.select("event_id", "user_id", "event_type")
    path, out, progress = (written_table_dir(spark, n) for n in ("arrivals", "stream", "progress"))
    middle = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for part in (F.col("event_id") <= middle, F.col("event_id") > middle):
        events.where(part).write.mode("append").parquet(path)
        rows = RR.stream_ranges(spark, path, "event_id", ranges="4")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(out)
