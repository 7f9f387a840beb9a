"""N-gram Jaccard self-join with a token-group matrix.

Documents are sets of word n-grams; two link when ``100 * |A & B| >= percent * |A | B|``.

* Equal sets are one set with a weight, found by an aggregate.
* The matrix says which groups hold which tokens.  Its rows are not single tokens but parts of
  sets: a size class with at most ``H`` differing tokens between linked sets cuts the tokens into
  ``P > H`` parts by hash, so two linked sets agree on at least ``P - H`` whole parts, of which no more are empty
  than either set has.  That many common parts are asked for; a common passage or line fills few parts
  alone and draws no candidates.  (Sets with as many empty parts also enter those.)  Sets are entered under their own class's parts and looked up under their own and the
  next lower class's, which is where every linked set of smaller or equal size is.
* Sets that share a part with another are partitioned into groups of similar sets: a set's group is the
  most common part of the sets that it shares a part with, so near copies of one text fall into a few groups
  however many they are.  Large groups are cut into blocks of a bounded number of tokens.
* A query set and a group with enough common parts meet in a cell.  The cell holds the token union of
  the group's block; the number of the query's tokens in that union bounds its overlap with every
  member.  Only groups whose bound reaches ``percent`` of the query's size are opened, and then all
  members are compared exactly, by counting over the union's postings.
* A cell returns the number of links of each set and a spanning forest of its links, never pairs, and
  components are joined over all cells.

N-grams and sets are told apart by 64-bit hashes; two of N different sets get one hash with
probability N^2 / 2^65.  Everything else is exact.

Nulls: a null or wordless text is an empty set, links with nothing and is its own component; a text of
fewer than n words is one n-gram.  A null id takes part like any other, but no component is named
by it unless it has no other.  Repeated rows are copies and link.  Empty input gives no rows.  Extra columns pass through
``one_of_each_group`` whatever they are called; the join itself does not read them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, numbered, slices, stored, table
from .components import components

NAME = "op1_ngram_jaccard_join"
WORDS = 3
PERCENT = 90
#: Tokens of the members, and of the queries, that meet in one cell.
CELL_TOKENS = 400_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of ``[^\\x20\\x09-\\x0D]+`` words, A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest
    each = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not each:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, each), np.uint64, len(each))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = _mix((out ^ h[j:len(h) - size + 1 + j]) + _GOLD)
    return np.unique(out)


def set_hash(tokens: np.ndarray) -> int:
    """A 64-bit name of the set, as a signed number."""
    a = _mix(tokens + _GOLD).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(_mix(tokens ^ _M2)) if len(tokens) else np.uint64(0)
    with np.errstate(over="ignore"):
        return int(_mix(np.array([a ^ (b * _GOLD) ^ np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


class SizeClasses:
    """Classes of set sizes; linked sets are in one class or in neighbouring ones."""

    def __init__(self, percent: int, most: int = 1 << 31):
        self.tops = [1]
        while self.tops[-1] < most:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 100 // percent))
        self.tops = np.array(self.tops, np.int64)
        #: Tokens in which a set of the class and a linked set of no smaller size can differ.
        self.differ = self.tops * (100 - percent) // percent

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.tops, size))


def part_count(differ: int) -> int:
    return differ + 2 + differ // 5


def cut(tokens: np.ndarray, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each token, and the tokens of each part."""
    parts = part_count(differ)
    part = ((tokens >> np.uint64(7)) % np.uint64(parts)).astype(np.int64)
    return part, np.bincount(part, minlength=parts)


def common_parts(tokens: np.ndarray, differ: int) -> int:
    """How many parts, none of them empty, a linked set has in common with this one; below 1: unknown."""
    return part_count(differ) - differ - int((cut(tokens, differ)[1] == 0).sum())


def part_marks(tokens: np.ndarray, kind: int, differ: int) -> np.ndarray:
    """One hash per part of the set under a class's partition of the tokens; the last bit tells odd classes."""
    part, count = cut(tokens, differ)
    total = np.zeros(len(count), np.uint64)
    np.add.at(total, part, _mix(tokens ^ _GOLD))
    name = np.arange(len(count), dtype=np.uint64) + (np.uint64(kind) << np.uint64(32))
    marks = _mix(_mix(name + _M1) ^ (total + count.astype(np.uint64) * _M2))
    marks = ((marks & ~np.uint64(1)) | np.uint64(kind & 1)).view(np.int64)
    empty = count == 0
    return marks if empty.sum() >= len(count) - differ else marks[~empty]


def _describe(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = SizeClasses(percent)
        for batch in slices(batches):
            each = [shingles(text, words) for text in batch.column(1).to_pylist()]
            need = [[None] * len(each), [None] * len(each)]  # common parts asked for, under even and odd classes
            for i, t in enumerate(each):
                own = classes.of(len(t)) if len(t) else -1
                for kind in (own, own - 1):
                    if kind >= 0 and classes.differ[kind] > 0:
                        need[kind & 1][i] = max(1, common_parts(t, int(classes.differ[kind])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in each], pa.int64()),
                 pa.array([set_hash(t) if len(t) else None for t in each], pa.int64()),
                 *[pa.array(x, pa.int32()) for x in need], batch.column(2)], names=["doc_id", "n", "set", "even", "odd", "row"])
    return run


def _marks(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = SizeClasses(percent), set()
        for batch in slices(batches):
            marks, sets = [], []
            for text in batch.column(0).to_pylist():
                t = shingles(text, words)
                if not len(t) or (name := set_hash(t)) in seen:
                    continue
                seen.add(name)
                own = classes.of(len(t))
                for kind in (own, own - 1):
                    if kind >= 0 and classes.differ[kind] > 0:
                        marks.append(part_marks(t, kind, int(classes.differ[kind])))
                        sets.append(np.full(len(marks[-1]), name, np.int64))
            if marks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(marks)), pa.array(np.concatenate(sets))], names=["mark", "set"])
    return run


def _tokens(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(s, t.tobytes()) for s, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                     if len(t := shingles(text, words)) and set_hash(t) == s]  # ids may repeat with other texts
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())],
                                             names=["set", "tokens"])
    return run


def open_cell(members: list[tuple], queries: list[tuple], percent: int) -> list[tuple[int, int | None, int]]:
    """Links of the queries with smaller members: (set, None, links) counts and (set, set, 0) forest links.

    Entries are (set, weight, tokens).
    """
    union, owner = np.concatenate([m[2] for m in members]), np.repeat(np.arange(len(members)), [len(m[2]) for m in members])
    order = np.argsort(union, kind="stable")
    union, owner = union[order], owner[order]
    sizes = np.array([len(m[2]) for m in members])
    names, weights = np.array([m[0] for m in members], np.int64), np.array([m[1] for m in members], np.int64)
    place = {m[0]: i for i, m in enumerate(members)}
    for q in queries:
        place.setdefault(q[0], len(place))
    links, label, forest = np.zeros(len(place), np.int64), np.arange(len(place)), []

    for name, weight, tokens in queries:
        first, last = np.searchsorted(union, tokens, "left"), np.searchsorted(union, tokens, "right")
        times = last - first
        if 100 * np.count_nonzero(times) < percent * len(tokens):
            continue  # the bound: no member can share enough
        at = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        common = np.bincount(owner[at], minlength=len(members))
        n = len(tokens)
        linked = np.flatnonzero((100 * common >= percent * (sizes + n - common)) & ((sizes < n) | (sizes == n) & (names < name)))
        if not len(linked):
            continue
        me = place[name]
        links[me] += weights[linked].sum()
        links[linked] += weight
        trees, one = np.unique(label[linked], return_index=True)
        new = trees != label[me]  # trees that the query now joins with its own
        forest += [(name, int(x), 0) for x in names[linked[one[new]]]]
        if new.any():
            label[np.isin(label, trees[new])] = label[me]
    return [(s, None, int(links[i])) for s, i in place.items() if links[i]] + forest


def _cells(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, queries = None, {}, {}

        def close():
            found = open_cell([(s, *x) for s, x in members.items()], [(s, *x) for s, x in queries.items()], percent) if members and queries else []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names=["a", "b", "links"])

        for batch in slices(batches):
            g, b, q, asks, name, weight, tokens = (c.to_pylist() for c in batch.columns)
            for i in range(len(g)):
                if (now := (g[i], b[i], q[i])) != key:
                    if members and queries:
                        yield close()
                    key, members, queries = now, {}, {}
                (queries if asks[i] else members)[name[i]] = (weight[i], np.frombuffer(tokens[i], np.uint64))
        if members and queries:
            yield close()
    return run


def jaccard_links(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their set, sets with weights, (a, b, links) rows of the opened cells)."""
    row = F.col("row") if "row" in docs.columns else F.lit(None).cast("long").alias("row")
    described = stored(docs.select(F.col("doc_id").cast("long"), "text", row).mapInArrow(
        _describe(words, percent), "doc_id long, n long, set long, even int, odd int, row long"), "join-sets")
    sets = stored(described.filter(F.col("set").isNotNull()).groupBy("set").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.max("n").alias("n"), F.max("even").alias("even"), F.max("odd").alias("odd")), "join-reps")

    marks = docs.select("text").mapInArrow(_marks(words, percent), "mark long, set long")
    every = Window.partitionBy("mark")
    shared = (marks.withColumn("_a", F.min("set").over(every)).withColumn("_b", F.max("set").over(every))
              .withColumn("times", F.count("*").over(every)).filter("_a <> _b"))
    shared = stored(shared.select("mark", "set", "times").distinct(), "join-marks")

    # the most common part of a set, then of the sets that it shares a part with
    own = shared.groupBy("set").agg(F.max(F.struct("times", F.col("mark").alias("part"))).alias("top"))
    near = shared.join(own, "set").groupBy("mark").agg(F.max("top").alias("top"))
    groups = shared.select("mark", "set").join(near, "mark").groupBy("set").agg(F.max("top").alias("top")).select("set", F.col("top.part").alias("g"))
    involved = stored(sets.join(groups, "set"), "join-involved")
    known = shared.select("mark", "set").join(involved.select("set", "n", "g", "even", "odd"), "set")
    matrix = (known.groupBy("mark", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("set").alias("_a"), F.max("set").alias("_b"))
              .withColumnRenamed("g", "group"))
    # a group is asked by the sets that share enough parts with it and whose size a member can match; a lone set does
    # not ask itself
    met = (known.join(matrix, "mark").filter((F.col("least") <= F.col("n")) & (100 * F.col("most") >= percent * F.col("n"))
                                            & ~((F.col("_a") == F.col("_b")) & (F.col("_a") == F.col("set")))))
    odd = F.col("mark").bitwiseAND(F.lit(1)) == 1
    asked = (met.groupBy("set", "group").agg(F.first("n").alias("n"), F.first("even").alias("even"), F.first("odd").alias("odd"),
                                            F.count_if(odd).alias("_odd"), F.count_if(~odd).alias("_even"))
             .filter((F.col("_odd") >= F.col("odd")) | (F.col("_even") >= F.col("even"))).select("set", "n", "group"))
    asked = stored(asked, "join-asked")

    # blocks of members and of queries, by the tokens of a group
    blocks = (involved.groupBy(F.col("g").alias("group")).agg(F.ceil(F.sum("n") / CELL_TOKENS).cast("int").alias("blocks"))
              .join(asked.groupBy("group").agg(F.ceil(F.sum("n") / CELL_TOKENS).cast("int").alias("asks")), "group"))
    blocks = stored(blocks, "join-blocks")
    members = (involved.join(blocks, F.col("g") == F.col("group"))
               .select("group", F.pmod(F.xxhash64("set"), "blocks").cast("int").alias("block"),
                       F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"), F.lit(False).alias("asks"), "set"))
    queries = (asked.join(blocks, "group")
               .select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                       F.pmod(F.xxhash64("set", F.lit(1)), "asks").cast("int").alias("ask"), F.lit(True).alias("asks"), "set"))
    placed = members.unionByName(queries)
    needed = placed.select("set").distinct().join(involved.select("set", "rep", "weight"), "set")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    tokens = (texts.join(needed.select("set", "rep"), texts["rep"].eqNullSafe(needed["rep"])).select("set", "text")
              .mapInArrow(_tokens(words), "set long, tokens binary"))
    tokens = stored(tokens, "join-tokens")
    cells = (placed.join(tokens.join(needed.select("set", "weight"), "set"), "set")
             .select("group", "block", "ask", "asks", "set", "weight", "tokens")
             .repartition("group", "block", "ask").sortWithinPartitions("group", "block", "ask", "asks"))
    return described, sets, stored(cells.mapInArrow(_cells(percent), "a long, b long, links long"), "join-links")


def ngram_jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs`` (doc_id, text)."""
    return joined_sets(docs, words, percent).select("doc_id", "n_shingles", "component_id", "n_links")


def joined_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """As ``ngram_jaccard_join``, with each row's ``set`` and ``root``, the set that names its component (null without
    words), and its ``row``, the caller's number of the row if ``docs`` has such a column."""
    described, sets, links = jaccard_links(docs, words, percent)
    roots = components(links.filter(F.col("b").isNotNull()).select("a", "b"))
    counts = links.filter(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("links"))
    named = (sets.join(roots, F.col("set") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set"))
             .join(counts, F.col("set") == F.col("a"), "left"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("set", "root", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return (described.join(named, "set", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "set", "root", "row"))


def one_of_each_group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text, ...) without near duplicates: of each group the row of the least id stays, a null id last.

    Rows have a number of their own and leave by it, so repeated and null ids are rows like any other.  Rows without words are
    no near duplicates and stay, but for repeated rows of one id and text, of which one stays."""
    number = free_name(docs, "row_number")
    rows = numbered(docs, number)
    found = stored(joined_sets(rows.select("doc_id", "text", F.col(number).alias("row")), words, percent)
                   .filter(F.col("set").isNotNull()).select("row", "doc_id", "root"), "join-found")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    groups = (found.groupBy("root").agg(F.min_by("row", order).alias("_stays"), F.count("*").alias("_rows"))
              .filter("_rows > 1").select(F.col("root").alias("_root"), "_stays"))
    gone = found.join(groups, F.col("root") == F.col("_root")).filter("row <> _stays").select(F.col("row").alias(number))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    blank = rows.filter(wordless & F.col("doc_id").isNotNull()).select(F.col(number).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("blank"))
    first = blank.groupBy(F.col("id").alias("_id"), F.col("blank").alias("_blank")).agg(F.min("row").alias("_stays"), F.count("*").alias("_rows"))
    again = blank.join(first.filter("_rows > 1"), (F.col("id") == F.col("_id")) & F.col("blank").eqNullSafe(F.col("_blank"))).filter("row <> _stays")
    gone = gone.unionByName(again.select(F.col("row").alias(number)))
    return rows.join(gone, number, "left_anti").drop(number)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT row, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
t AS (SELECT row, len(s) AS n, hash(unnest(s)) AS g FROM s),
df AS (SELECT g, count(*) AS df FROM t GROUP BY g),
p AS (SELECT row, n, g FROM (SELECT t.row, t.n, t.g, row_number() OVER (PARTITION BY t.row ORDER BY df.df, t.g) AS i
  FROM t JOIN df USING (g)) WHERE i <= n - (90 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.row AS x, b.row AS y FROM p a JOIN p b ON a.g = b.g AND a.row < b.row
  AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
e AS (SELECT c.x, c.y FROM c JOIN s a ON a.row = c.x JOIN s b ON b.row = c.y
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 90 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT row AS x, row AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT r.x AS row, min(w.doc_id) AS component_id FROM r JOIN w ON w.row = r.y GROUP BY r.x),
d AS (SELECT x AS row, count(*) AS n_links FROM l GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, k.component_id, coalesce(d.n_links, 0)::BIGINT AS n_links
FROM s JOIN k USING (row) LEFT JOIN d USING (row)
"""
