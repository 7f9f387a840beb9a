"""Random forests of all risk types at once: one aggregate a level grows every tree of every type.

Features are cut into bins once.  A pass over the rows finds each row's node in every tree (from the splits so far, which travel
with the tasks) and counts its class weights by (type, tree, node, feature, bin); Spark sums the counts and
picks each node's split, and only splits come to the driver, which holds the model anyway.  So a level is one job
however many types there are, and scoring all types is one pass.  Where the counts of a level exceed ``TASK_CELLS`` numbers, the
trees of the level are counted in several passes.

Each tree draws its rows with Poisson(1) weights from a hash of (row id, tree), and each node a subset of the features from a hash
of (type, tree, node): the same on any cluster.  Classes weigh n / (2 n_c) per type.  Splits are ``x <= edge``; the gain is that of
Gini impurity, the first feature and bin of equal ones.  Null features are least.  A type that all rows have is scored 1,
and one that too few have gets no model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a feature, and numbers a task counts at a time.
BINS, TASK_CELLS = 32, 1 << 22
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bag_weight(ids: np.ndarray, tree: int) -> np.ndarray:
    """Times that a tree draws each row."""
    u = _hash(_hash(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(tree + 1))
    return np.searchsorted(_POISSON, (u >> np.uint64(11)) / float(1 << 53), "right").astype(float)


@dataclass
class TypeForests:
    """Per type and tree the splits by node (children of i are 2i and 2i + 1), and each node's share of class 1."""

    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    trees: int
    bagged: bool = True
    splits: dict[tuple[str, int], dict[int, tuple[int, int]]] = field(default_factory=dict)
    shares: dict[tuple[str, int], dict[int, float]] = field(default_factory=dict)
    class_weights: dict[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def types(self) -> list[str]:
        return sorted(self.class_weights)

    def binned(self, columns: Sequence[pa.Array]) -> np.ndarray:
        """Bin 0 holds nulls; bin i + 1 is not above edge i."""
        x = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
        return np.column_stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, "left")) for e, v in zip(self.edges, x)])

    def nodes(self, b: np.ndarray, kind: str, tree: int) -> np.ndarray:
        """The node where each row stands: a leaf, or one that is not split yet."""
        at, splits = np.ones(len(b), np.int64), self.splits.get((kind, tree), {})
        if not splits:
            return at
        size = max(splits) + 1
        feature, cut = np.full(size, -1), np.zeros(size, np.int64)
        for node, (f, c) in splits.items():
            feature[node], cut[node] = f, c
        while True:
            inner = at < size
            inner[inner] = feature[at[inner]] >= 0
            if not inner.any():
                return at
            here = at[inner]
            at[inner] = 2 * here + (b[inner, feature[here]] > cut[here])

    def share(self, b: np.ndarray, kind: str) -> np.ndarray:
        """The mean over the trees of the share of class 1 in a row's leaf."""
        total = np.zeros(len(b))
        for tree in range(self.trees):
            known = self.shares[kind, tree]
            value = np.zeros(max(known) + 1)
            value[list(known)] = list(known.values())
            total += value[self.nodes(b, kind, tree)]
        return total / self.trees


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> tuple[tuple[float, ...], ...]:
    """Split points of every feature from one pass: quantiles, at most ``bins - 1`` each."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return tuple(tuple(sorted(set(q or []))) for q in found)


def _histograms(model: TypeForests, jobs: list[tuple[str, int]], open_nodes: Mapping[tuple[str, int], Sequence[int]], types: Sequence[str]):
    n_features, bins = len(model.features), max(len(e) for e in model.edges) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {j: np.zeros((2, len(open_nodes[j]) * n_features * bins)) for j in jobs}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            b = model.binned(batch.columns[1:1 + n_features])
            labels = {t: np.nan_to_num(batch.column(1 + n_features + i).to_numpy(zero_copy_only=False)) == 1 for i, t in enumerate(types)}
            bags = {tree: bag_weight(ids, tree) if model.bagged else np.ones(len(ids)) for tree in {tree for _, tree in jobs}}
            for kind, tree in jobs:
                wanted = np.asarray(open_nodes[kind, tree])
                node = model.nodes(b, kind, tree)
                place = np.minimum(np.searchsorted(wanted, node), len(wanted) - 1)
                inside = (wanted[place] == node) & (bags[tree] > 0)
                cell = ((place[inside, None] * n_features + np.arange(n_features)) * bins + b[inside]).ravel()
                for c in (0, 1):
                    w = bags[tree][inside] * (labels[kind][inside] == c) * model.class_weights[kind][c]
                    totals[kind, tree][c] += np.bincount(cell, np.repeat(w, n_features), len(totals[kind, tree][c]))
        for (kind, tree), (w0, w1) in totals.items():
            used = np.flatnonzero(w0 + w1)
            node, feature, cut = np.unravel_index(used, (len(open_nodes[kind, tree]), n_features, bins))
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(used), pa.string()), pa.array(np.full(len(used), tree, np.int32)), pa.array(np.asarray(open_nodes[kind, tree], np.int64)[node]),
                 pa.array(feature.astype(np.int32)), pa.array(cut.astype(np.int32)), pa.array(w0[used]), pa.array(w1[used])],
                names=["kind", "tree", "node", "feature", "bin", "w0", "w1"])

    return run


def _chosen(counts: DataFrame, subset: int) -> DataFrame:
    """The best split of each (kind, tree, node) with the class weights left and right of it; no row where none gains."""
    cell = ["kind", "tree", "node", "feature"]
    summed = counts.groupBy(*cell, "bin").agg(F.round(F.sum("w0"), 9).alias("w0"), F.round(F.sum("w1"), 9).alias("w1"))
    upto = Window.partitionBy(*cell).orderBy("bin")
    every = Window.partitionBy(*cell)
    s = summed.select(*cell, "bin", F.sum("w0").over(upto).alias("l0"), F.sum("w1").over(upto).alias("l1"),
                      F.sum("w0").over(every).alias("n0"), F.sum("w1").over(every).alias("n1"))
    left, all_ = F.col("l0") + F.col("l1"), F.col("n0") + F.col("n1")
    right, r0, r1 = all_ - left, F.col("n0") - F.col("l0"), F.col("n1") - F.col("l1")

    def impurity(a, b, n):  # Gini impurity times weight
        return F.when(n > 1e-9, n - (a * a + b * b) / n).otherwise(0.0)

    gain = impurity(F.col("n0"), F.col("n1"), all_) - impurity(F.col("l0"), F.col("l1"), left) - impurity(r0, r1, right)
    s = s.withColumn("gain", F.when((left > 1e-9) & (right > 1e-9), F.round(gain, 9)).otherwise(0.0))
    best = s.groupBy(*cell).agg(F.max(F.struct("gain", (-F.col("bin")).alias("_b"), "bin", "l0", "l1", "n0", "n1")).alias("s"))
    drawn = F.row_number().over(Window.partitionBy("kind", "tree", "node").orderBy(F.xxhash64("kind", "tree", "node", "feature"), "feature"))
    best = best.withColumn("_drawn", drawn).where(F.col("_drawn") <= subset)
    return best.groupBy("kind", "tree", "node").agg(F.max(F.struct(F.col("s.gain").alias("gain"), (-F.col("feature")).alias("_f"), "feature", "s")).alias("t")).select(
        "kind", "tree", "node", "t.feature", "t.s.bin", "t.gain", *(f"t.s.{c}" for c in ("l0", "l1", "n0", "n1")))


def fit_type_forests(rows: DataFrame, id_col: str, features: Sequence[str], types: Sequence[str], trees: int = 100, depth: int = 5,
                     min_pos: int = 5, subset: int | None = None, edges=None, bagged: bool = True) -> TypeForests:
    """Forests of every type (0/1 columns of ``rows``) with ``min_pos`` positives; ``subset`` features a node (None: the root of all)."""
    model = TypeForests(tuple(features), tuple(map(tuple, edges or bin_edges(rows, features))), trees, bagged)
    n = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{t}`") == 1).alias(f"p{i}") for i, t in enumerate(types)]).first()
    for i, t in enumerate(types):
        pos, neg = n[f"p{i}"], n["n"] - n[f"p{i}"]
        if pos >= max(min_pos, 1):
            model.class_weights[t] = (n["n"] / (2.0 * neg) if neg else 0.0, n["n"] / (2.0 * pos))
    used, subset = model.types, subset or math.ceil(math.sqrt(len(features)))
    data = rows.select(F.xxhash64(F.col(id_col).cast("string")).alias("id"), *[F.col(f).cast("double") for f in features],
                       *[F.col(f"`{t}`").cast("double").alias(f"label_{i}") for i, t in enumerate(used)])
    for t in used:
        for tree in range(trees):
            model.splits[t, tree], model.shares[t, tree] = {}, {}
    open_nodes = {(t, tree): [1] for t in used for tree in range(trees)}
    for level in range(depth):
        cells = {j: len(nodes) * len(features) * (max(map(len, model.edges), default=0) + 2) for j, nodes in open_nodes.items()}
        parts, room = [[]], 0
        for j in open_nodes:
            if parts[-1] and room + 2 * cells[j] > TASK_CELLS:
                parts.append([])
                room = 0
            parts[-1].append(j)
            room += 2 * cells[j]
        found = []
        for jobs in parts:
            if jobs:
                counts = data.mapInArrow(_histograms(model, jobs, {j: open_nodes[j] for j in jobs}, used),
                                         "kind string, tree int, node long, feature int, bin int, w0 double, w1 double")
                found += _chosen(counts, subset).collect()  # one row per open node of the model
        after: dict[tuple[str, int], list[int]] = {}
        for r in found:
            key, node = (r["kind"], r["tree"]), r["node"]
            model.shares[key][node] = r["n1"] / (r["n0"] + r["n1"])
            if r["gain"] > 1e-9:
                model.splits[key][node] = (r["feature"], r["bin"])
                r0, r1 = r["n0"] - r["l0"], r["n1"] - r["l1"]
                model.shares[key][2 * node], model.shares[key][2 * node + 1] = r["l1"] / (r["l0"] + r["l1"]), r1 / (r0 + r1)
                after.setdefault(key, []).extend(c for c, (a, b) in ((2 * node, (r["l0"], r["l1"])), (2 * node + 1, (r0, r1))) if min(a, b) > 1e-9)
        open_nodes = {j: sorted(nodes) for j, nodes in after.items() if nodes}
        if not open_nodes:
            break
    for key in model.shares:
        model.shares[key].setdefault(1, 0.0)  # a tree that drew no row
    return model


def type_accuracy(rows: DataFrame, model: TypeForests) -> dict[str, float | None]:
    """The share of rows of each type that the model tells right, from one pass."""
    types, n_features = model.types, len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, n = np.zeros(len(types), np.int64), 0
        for batch in batches:
            b = model.binned(batch.columns[:n_features])
            n += len(b)
            for i, t in enumerate(types):
                hits[i] += ((model.share(b, t) > 0.5) == (np.nan_to_num(batch.column(n_features + i).to_numpy(zero_copy_only=False)) == 1)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(types, pa.string()), pa.array(hits), pa.array(np.full(len(types), n))], names=["kind", "hits", "n"])

    data = rows.select(*[F.col(f).cast("double") for f in model.features], *[F.col(f"`{t}`").cast("double").alias(f"label_{i}") for i, t in enumerate(types)])
    found = data.mapInArrow(run, "kind string, hits long, n long").groupBy("kind").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    return {r["kind"]: r["hits"] / r["n"] if r["n"] else None for r in found}


def score_types(rows: DataFrame, model: TypeForests, id_col: str, min_prob: float = 0.5) -> DataFrame:
    """Long table ``id, risk_type, score`` (score = round(share * 100, 1)) of shares above ``min_prob``: all types in one pass."""
    types, n_features = model.types, len(model.features)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = model.binned(batch.columns[1:1 + n_features])
            for t in types:
                p = model.share(b, t)
                over = np.flatnonzero(p > min_prob)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(over)), pa.array([t] * len(over), pa.string()),
                                                  pa.array(np.round(p[over] * 100, 1))], names=[id_col, "risk_type", "score"])

    return rows.select(id_col, *[F.col(f).cast("double") for f in model.features]).mapInArrow(run, f"{id_col} {kind}, risk_type string, score double")
