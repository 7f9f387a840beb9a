"""A stored inverted-list index over vectors: coarse lists, probed by query, re-ranked exactly.

``build_index`` fits coarse centroids by k-means on a bounded sample (``FIT_ROWS`` rows with the least hashes), puts
*every* row into the list of its nearest centroid and writes the lists as a table bucketed by cell.  A cell holds some lists, or
pieces of long ones, of one value of the filter columns, up to about ``CELL_ROWS`` vectors, so a hot list or label spreads
over many cells.  Rows of the table are blocks of a cell's vectors, sorted by list.

``search`` ranks, per query, the lists that hold rows of the query's filter values, sends the query once to each cell that holds one of
its ``nprobe`` nearest ones, with the numbers of these lists, and joins blocks of queries with blocks of vectors by cell.  A vector so
travels per cell, not per list, however many lists are probed.  The table is bucketed by cell,
so only queries are shuffled, never the base.  Distances inside a pair of blocks are matrix products, with whatever
may be among the k nearest computed again from differences; k rows per query and cell leave the tasks.  ``nprobe=None`` probes all lists and is exact;
``probes_for`` finds the number that reaches a recall.

Rows without a vector or with a null filter value match nothing and are left out.  All vectors have one length.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written_table_dir
from .retrieval import _arrow_type, _top_per_query, _VectorCell

#: Rows that the centroids are fitted on, and the most centroids; the driver and every task hold the centroids.
FIT_ROWS, MAX_LISTS = 100_000, 16_384
#: Vectors of a cell at most, of a block of a cell, and of a block of queries.
CELL_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 65_536, 1_024, 256
#: Queries that the number of probed lists is chosen on.
TUNE_QUERIES = 500
#: Vectors of a bucket file, about.
BUCKET_ROWS = 1 << 20


@dataclass(frozen=True)
class VectorIndex:
    """An index on disk: ``path`` holds the tables ``blocks``, ``cells``, ``centroids`` and ``about``."""

    path: str
    blocks: str  #: the catalog's name of the bucketed table
    metric: str
    filter_cols: tuple[str, ...]
    centroids: np.ndarray

    def cells(self, spark: SparkSession) -> DataFrame:
        """(filter columns, list, n, pieces, n_cells): one row per list and filter value that has rows, with the cells of the value."""
        return spark.read.parquet(f"{self.path}/cells")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, metric: str) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return _unit(x) if metric == "cosine" else x


def _centroid_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (centroids * centroids).sum(1)[None] - 2.0 * x @ centroids.T


def _cell(filter_cols: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c).cast("string") for c in filter_cols], F.pmod(F.xxhash64("list", "piece"), "n_cells"))


def fit_centroids(rows: DataFrame, n: int, n_lists: int, metric: str, fit_rows: int, seed: int) -> np.ndarray:
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < fit_rows).select("vec")
    vec = F.transform("vec", lambda v: v.cast("double"))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, v: a + v * v))
        vec = F.when(norm > 0, F.transform(vec, lambda v: v / norm)).otherwise(vec)
    model = KMeans(k=n_lists, maxIter=8, seed=seed, featuresCol="v").fit(sample.select(array_to_vector(vec).alias("v"))) if n_lists > 1 else None
    if model is None:
        first = rows.select("vec").first()
        return np.zeros((1, len(first["vec"]) if first else 1))
    return np.array(model.clusterCenters())


def _assigned(rows: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])
    at = rows.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest = _centroid_distances(_matrix(batch.column(at), metric), centroids).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _packed(size: int, id_type: pa.DataType, list_type: pa.DataType):
    """Rows (cell, id, vec, lists), sorted by cell, as rows (cell, ids, vecs, lists) of up to ``size`` vectors, end to end."""
    def out(cell: int, ids: list, vecs: list, lists: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([np.concatenate(vecs)], pa.list_(pa.float64())),
                                           pa.array([lists], pa.list_(list_type))], names=["cell", "ids", "vecs", "lists"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vecs, lists = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, x = batch.column(0).to_numpy(), _matrix(batch.column(2), "l2sq")
            at = 0
            while at < batch.num_rows:
                if ids and (cells[at] != now or len(ids) == size):
                    yield out(now, ids, vecs, lists)
                    ids, vecs, lists = [], [], []
                now = int(cells[at])
                other = np.flatnonzero(cells[at:at + size - len(ids)] != now)
                end = at + (int(other[0]) if len(other) else min(size - len(ids), batch.num_rows - at))
                ids += batch.column(1).slice(at, end - at).to_pylist()
                lists += batch.column(3).slice(at, end - at).to_pylist()
                vecs.append(x[at:end].ravel())
                at = end
        if ids:
            yield out(now, ids, vecs, lists)

    return run


def build_index(base: DataFrame, path: str, filter_cols: Sequence[str] = (), metric: str = "l2sq", n_lists: int | None = None,
                fit_rows: int = FIT_ROWS, seed: int = 7) -> VectorIndex:
    """Write an index of ``base(doc_id, vec, *filter_cols)`` under ``path``; lists default to the root of the row count."""
    if metric not in ("l2sq", "cosine"):
        raise ValueError("metric is l2sq or cosine")
    spark, keys = base.sparkSession, list(filter_cols)
    rows = base.select(*keys, F.col("doc_id").alias("id"), F.col("vec")).dropna(subset=[*keys, "vec"])
    n = rows.count()
    lists = max(1, min(n_lists or math.isqrt(n), MAX_LISTS, n))
    centroids = fit_centroids(rows, max(n, 1), lists, metric, fit_rows, seed)
    assigned_path = written_table_dir(spark, "vector-lists")
    _assigned(rows, centroids, metric).write.parquet(assigned_path)
    assigned = spark.read.parquet(assigned_path)
    assigned.select("id", "list").write.parquet(f"{path}/lists")
    parallel = spark.sparkContext.defaultParallelism
    # small tables have small cells, so that all cores get some; large ones cells of ``CELL_ROWS``
    cell_rows = min(CELL_ROWS, max(BLOCK_ROWS, math.ceil(n / (8 * parallel))))
    sizes = assigned.groupBy(*keys, "list").agg(F.count("*").alias("n"))
    of_value = sizes.groupBy(*keys).agg(F.ceil(F.sum("n") / cell_rows).cast("int").alias("n_cells"))
    sizes = sizes.join(of_value, keys) if keys else sizes.crossJoin(F.broadcast(of_value))  # one row
    sizes.select(*keys, "list", "n", F.ceil(F.col("n") / cell_rows).cast("int").alias("pieces"), "n_cells").write.parquet(f"{path}/cells")
    pieces = spark.read.parquet(f"{path}/cells").select(*keys, "list", "pieces", "n_cells")
    celled = (assigned.join(pieces, [*keys, "list"]).withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int"))
              .select(_cell(keys).alias("cell"), "id", "vec", F.col("list").alias("lists")))
    buckets = max(1, math.ceil(n / BUCKET_ROWS), min(n // BLOCK_ROWS, 4 * parallel))
    kind, arrow = _arrow_type(rows, "id")
    blocks = (celled.repartition(buckets, "cell").sortWithinPartitions("cell", "lists", "id")
              .mapInArrow(_packed(BLOCK_ROWS, arrow, pa.int32()), f"cell long, ids array<{kind}>, vecs array<double>, lists array<int>"))
    name = f"vector_index_{uuid.uuid4().hex}"
    (blocks.write.bucketBy(buckets, "cell").sortBy("cell").format("parquet").option("path", f"{path}/blocks").saveAsTable(name))
    spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    spark.createDataFrame([(metric, keys, buckets, kind)], "metric string, filter_cols array<string>, buckets int, id_type string") \
        .coalesce(1).write.parquet(f"{path}/about")
    return VectorIndex(path, name, metric, tuple(keys), centroids)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that another session wrote: its bucketed table is named anew in this session's catalog."""
    about = spark.read.parquet(f"{path}/about").first()
    name = f"vector_index_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (cell BIGINT, ids ARRAY<{about['id_type']}>, vecs ARRAY<DOUBLE>, lists ARRAY<INT>) USING parquet "
              f"CLUSTERED BY (cell) SORTED BY (cell) INTO {about['buckets']} BUCKETS LOCATION '{path}/blocks'")
    centroids = [r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()]  # at most MAX_LISTS
    return VectorIndex(path, name, about["metric"], tuple(about["filter_cols"]), np.array(centroids))


def _probes(queries: DataFrame, index: VectorIndex, nprobe: int | None) -> DataFrame:
    """Per query its rows (filter columns, query, vec, list, rank), one for each list it is sent to; the nearest list has rank 1."""
    spark, keys = queries.sparkSession, list(index.filter_cols)
    q = queries.select(*keys, F.col("query_id").alias("id"), "vec").dropna(subset=[*keys, "vec"])
    held = index.cells(spark).groupBy(*keys).agg(F.collect_set("list").alias("held"))  # at most MAX_LISTS numbers a row
    q = q.join(held, keys) if keys else q.crossJoin(F.broadcast(held))  # one row
    schema = T.StructType([*(f for f in q.schema.fields if f.name != "held"), T.StructField("list", T.IntegerType()), T.StructField("rank", T.IntegerType())])
    vec, lists, centroids, metric = q.columns.index("vec"), q.columns.index("held"), index.centroids, index.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                d = _centroid_distances(_matrix(part.column(vec), metric), centroids)
                row, to = [], []
                for i, mine in enumerate(part.column(lists).to_pylist()):
                    mine = np.array(sorted(mine))
                    near = mine[np.argsort(d[i, mine], kind="stable")[:nprobe]]
                    row.append(np.full(len(near), i))
                    to.append(near)
                taken = pa.RecordBatch.from_arrays([c for j, c in enumerate(part.columns) if j != lists], names=schema.names[:-2]) \
                    .take(pa.array(np.concatenate(row)))
                ranks = np.concatenate([np.arange(1, len(near) + 1) for near in to])
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(to), pa.int32()), pa.array(ranks, pa.int32())], names=schema.names)

    return q.mapInArrow(run, schema)


def _sent(queries: DataFrame, index: VectorIndex, nprobe: int | None) -> DataFrame:
    """Queries (cell, id, vec, lists), one row for each cell that holds a probed list, with all probed lists there; null: all lists."""
    spark, keys = queries.sparkSession, list(index.filter_cols)
    q = queries.select(*keys, F.col("query_id").alias("id"), "vec").dropna(subset=[*keys, "vec"])
    placed = (index.cells(spark).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
              .select(*keys, "list", _cell(keys).alias("cell")).distinct())
    if nprobe is None:
        cells = placed.select(*keys, "cell").distinct()
        met = q.join(cells, keys) if keys else q.crossJoin(cells)
        return met.select("cell", "id", "vec", F.lit(None).cast("array<int>").alias("lists"))
    held = placed.groupBy(*keys).agg(F.collect_list(F.struct("list", "cell")).alias("held"))  # the lists and pieces of a filter value
    q = q.join(held, keys) if keys else q.crossJoin(F.broadcast(held))  # one row
    q = q.select("id", "vec", F.col("held.list").alias("held"), F.col("held.cell").alias("cells"))
    schema = T.StructType([T.StructField("cell", T.LongType()), *q.schema.fields[:2], T.StructField("lists", T.ArrayType(T.IntegerType()))])
    centroids, metric = index.centroids, index.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                d = _centroid_distances(_matrix(part.column(1), metric), centroids)
                row, cell, probed = [], [], []
                for i in range(part.num_rows):
                    lists, cells = (part.column(c)[i].values.to_numpy() for c in (2, 3))
                    mine = np.unique(lists)
                    near = mine[np.argsort(d[i, mine], kind="stable")[:nprobe]]
                    here = np.isin(lists, near)
                    to, place = np.unique(cells[here], return_inverse=True)
                    order = np.argsort(place, kind="stable")
                    row += [i] * len(to)
                    cell.append(to)
                    probed += np.split(lists[here][order], np.cumsum(np.bincount(place))[:-1])
                if row:
                    taken = part.select([0, 1]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell), pa.int64()), *taken.columns, pa.array(probed, pa.list_(pa.int32()))], names=schema.names)

    return q.mapInArrow(run, schema)


class _Probing:
    """A block of queries against blocks of its cell."""

    def __init__(self, q_ids: list, q: np.ndarray, lists: list, n_lists: int, k: int, metric: str, exclude_self: bool, types):
        self.cell = _VectorCell(q_ids, q, k, metric, exclude_self, types)
        self.probed = None
        if lists[0] is not None:
            self.probed = np.zeros((len(q_ids), n_lists), bool)
            for i, probed in enumerate(lists):
                self.probed[i, probed] = True

    def add(self, ids: list, x: np.ndarray, lists: np.ndarray) -> None:
        if self.probed is None:
            self.cell.add(ids, x)
            return
        allowed = self.probed[:, lists]
        if allowed.mean() > 0.25:
            self.cell.add(ids, x, None, allowed)
            return
        start = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]])  # runs of one list
        for a, b in zip(start[:-1], start[1:]):
            asking = np.flatnonzero(allowed[:, a])
            if len(asking):
                self.cell.add(ids[a:b], x[a:b], asking)


def search(index: VectorIndex, queries: DataFrame, k: int = 5, nprobe: int | None = None, exclude_self: bool = False) -> DataFrame:
    """``query_id, doc_id, distance, score`` of the k nearest rows among the ``nprobe`` nearest lists (None: all lists, exact).

    ``queries(query_id, vec, *filter_cols)``; columns and ties as in ``retrieval.vector_topk``."""
    spark = queries.sparkSession
    blocks = spark.table(index.blocks)
    (q_kind, q_arrow), id_type = _arrow_type(queries, "query_id"), blocks.schema["ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type
    types = (q_arrow, to_arrow_type(id_type), pa.float64())
    asked = (_sent(queries, index, nprobe).repartition("cell").sortWithinPartitions("cell", "id")
             .mapInArrow(_packed(BLOCK_QUERIES, q_arrow, pa.list_(pa.int32())), f"cell long, ids array<{q_kind}>, vecs array<double>, lists array<array<int>>")
             .select("cell", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("lists").alias("q_lists")))
    metric, n_lists = index.metric, len(index.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pair = None, None
        for batch in batches:
            for at in range(batch.num_rows):  # a row is a whole block of queries beside a whole block of vectors
                cell, q_ids, q, q_lists, ids, x, lists = (c[at] for c in batch.columns)
                q_ids, ids = q_ids.as_py(), ids.as_py()
                if pair is None or now != (cell.as_py(), q_ids):
                    if pair is not None:
                        yield from pair.cell.close()
                    now = (cell.as_py(), q_ids)
                    pair = _Probing(q_ids, q.values.to_numpy().reshape(len(q_ids), -1), q_lists.as_py(), n_lists, k, metric, exclude_self, types)
                pair.add(ids, x.values.to_numpy().reshape(len(ids), -1), lists.values.to_numpy())
        if pair is not None:
            yield from pair.cell.close()

    met = asked.join(blocks, "cell").select("cell", "q_ids", "q_vecs", "q_lists", "ids", "vecs", "lists")
    found = met.mapInArrow(run, f"query_id {q_kind}, doc_id {id_type.simpleString()}, hits double").withColumnRenamed("hits", "distance")
    top = _top_per_query(found, k, F.col("distance").asc(), F.col("doc_id"))
    return top.select("query_id", "doc_id", "distance", (F.lit(1.0) - F.col("distance")).alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact hits, those that were found, and their share."""
    hit = found.select("query_id", "doc_id", F.lit(1).alias("_hit"))
    both = exact.select("query_id", "doc_id").join(hit, ["query_id", "doc_id"], "left")
    return both.agg(F.count("*").alias("exact_hits"), F.count("_hit").alias("found_hits")).withColumn(
        "recall", F.when(F.col("exact_hits") > 0, F.col("found_hits") / F.col("exact_hits")))


def recall_curve(index: VectorIndex, queries: DataFrame, k: int = 5, exclude_self: bool = False, sample: int = TUNE_QUERIES, seed: int = 3) -> DataFrame:
    """(nprobe, recall) of every number of lists, from the exact nearest rows of about ``sample`` queries (by a hash of the id).

    A row is found by n lists just if its own list is among the query's n nearest, so one exact search gives the whole curve."""
    spark = queries.sparkSession
    part = queries.where(F.pmod(F.xxhash64(F.lit(seed), "query_id"), F.lit(max(queries.count(), 1))) < sample)
    exact = search(index, part, k, None, exclude_self).select("query_id", "doc_id")
    lists = spark.read.parquet(f"{index.path}/lists").withColumnRenamed("id", "doc_id")
    ranks = _probes(part, index, None).select(F.col("id").alias("query_id"), "list", "rank")
    found = exact.join(lists, "doc_id").join(ranks, ["query_id", "list"]).groupBy("rank").agg(F.count("*").alias("n"))
    upto = Window.orderBy("rank")  # at most MAX_LISTS rows
    every = found.agg(F.sum("n").alias("all"))
    return found.crossJoin(F.broadcast(every)).select(F.col("rank").alias("nprobe"), (F.sum("n").over(upto) / F.col("all")).alias("recall"))


def probes_for(index: VectorIndex, queries: DataFrame, recall_at_least: float = 0.9, k: int = 5, exclude_self: bool = False, margin: float = 0.02) -> int | None:
    """The fewest lists that reach a recall on a sample of the queries, with a margin for the sample; None (all): none do."""
    curve = recall_curve(index, queries, k, exclude_self).where(F.col("recall") >= min(1.0, recall_at_least + margin))
    return curve.agg(F.min("nprobe").alias("n")).first()["n"]
