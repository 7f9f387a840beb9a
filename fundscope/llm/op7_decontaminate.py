"""Benchmark decontamination by suffix arrays over shards of the training text.

Each task builds suffix arrays over shards of its documents and binary-searches
every suffix of every benchmark item in them.  A search gives the longest verbatim
match of the suffix in the shard and, for its first ``window`` words, the whole
range of suffixes that start with them, i.e. every location.  Documents whose words
are hit too often are then removed.

A shard holds only words that can take part in a window: words of the benchmark's
vocabulary that stand in a chain of word pairs of the benchmark at least as long as the
shortest window.  Nothing else can be inside an occurrence, so no match is lost and
the arrays stay small.

Documents are never shuffled.  The benchmark is the side that is sent to all tasks: its
encoded size is checked against ``BLOCK_BYTES`` and a larger benchmark is searched in
blocks of items, each with a pass over a stored copy of the documents whose rows are numbered.
The hits of a pass are stored before the next block is built and merged by row number, so rows
without an id, or with the same one, are judged each by itself, as with one block.

Nulls: null texts have no words; benchmark items with a null id or no words are not
searched.  Repeated items of one id count once; repeated documents each get a row.
Empty documents give no rows, an empty benchmark gives documents without hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, slices, stored, table

NAME = "op7_suffix_array_decontaminate"
WINDOW = 13
#: A document is contaminated if this many times its hit words reach its words.
HIT_FACTOR = 20
#: Words of one shard's suffix array, after words that no window can hold are left out.
SHARD_WORDS = 1_000_000
#: Bytes of benchmark text searched in one pass over the documents.
BLOCK_BYTES = 32 << 20

#: A-Z to a-z; bytes outside [0-9a-z\x80-\xff] end a word.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a word sequence in lexicographic order (prefix doubling)."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[:-step or None] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class BenchmarkBlock:
    """Encoded items: every suffix start, its item, its window length."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        seqs, seen = [], set()
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids and (item_id, tuple(ids)) not in seen:
                seen.add((item_id, tuple(ids)))
                seqs.append((item_id, ids))
        self.shortest = min((min(window, len(s)) for _, s in seqs), default=0)
        text, starts, item, left, place = [], [], [], [], []
        pairs = set()
        for item_id, ids in seqs:
            pairs.update(zip(ids, ids[1:]))
            starts += range(len(text), len(text) + len(ids))
            item += [item_id] * len(ids)
            left += range(len(ids), 0, -1)
            place += range(len(ids))
            text += ids
        self.text = np.array(text, np.int64)
        self.starts, self.item, self.left, self.place = (np.array(x, np.int64) for x in (starts, item, left, place))
        whole = np.concatenate([np.full(len(s), min(window, len(s))) for _, s in seqs]) if seqs else np.zeros(0, np.int64)
        # a suffix starts a window if the item has that many words from here on
        self.window = np.where(self.left >= whole, whole, 0)
        self.span = len(self.vocabulary) + 1
        self.pairs = np.sort(np.array([a * self.span + b for a, b in pairs], np.int64))

    def chains(self, ids: np.ndarray) -> np.ndarray:
        """Which words stand in a chain of benchmark pairs of at least the shortest window."""
        n = len(ids)
        known = ids > 0
        if self.shortest <= 1 or n < 2:
            return known
        joint = np.zeros(n, bool)  # whether a word and the next one are a pair
        at = np.flatnonzero(known[:-1] & known[1:])
        code = ids[at] * self.span + ids[at + 1]
        place = np.searchsorted(self.pairs, code)
        place[place == len(self.pairs)] = 0
        joint[at] = self.pairs[place] == code if len(self.pairs) else False
        edge = np.flatnonzero(np.diff(np.concatenate([[0], joint.view(np.int8), [0]])))
        first, last = edge[::2], edge[1::2]  # words first..last are a chain
        long = last - first + 1 >= self.shortest
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, first[long], 1)
        np.add.at(mark, last[long] + 1, -1)
        return np.cumsum(mark[:n]) > 0

    def search(self, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each suffix: longest match, where, and the range of the array that starts with its window."""
        order = suffix_array(shard)
        padded = np.concatenate([shard, [-1]])
        low, high = self._bound(padded, order, upper=False), self._bound(padded, order, upper=True)
        place = self._bound(padded, order, upper=False, whole=True)
        best, where = np.zeros(len(self.starts), np.int64), np.full(len(self.starts), -1)
        for near in (place - 1, place):
            ok = (near >= 0) & (near < len(order))
            at = np.where(ok, order[np.clip(near, 0, len(order) - 1)], 0)
            size = self._common(padded, at, self.left) * ok
            where = np.where(size > best, at, where)
            best = np.maximum(best, size)
        return best, where, low, high, order

    def _common(self, padded, at, most):
        """Words that each suffix shares with the shard from ``at`` on, up to ``most``."""
        size = np.zeros(len(at), np.int64)
        alive = np.flatnonzero(most > 0)
        while len(alive):
            k = size[alive]
            spot = np.minimum(at[alive] + k, len(padded) - 1)
            same = padded[spot] == self.text[self.starts[alive] + k]
            alive = alive[same]
            size[alive] += 1
            alive = alive[size[alive] < most[alive]]
        return size

    def _bound(self, padded, order, upper: bool, whole: bool = False):
        """Binary search of all suffixes at once; compares ``window`` words, or the whole suffix."""
        most = self.left if whole else self.window
        low, high = np.zeros(len(most), np.int64), np.full(len(most), len(order))
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            size = self._common(padded, at, np.where(open_, most, 0))
            equal = size >= most
            ours = self.text[np.minimum(self.starts + size, len(self.text) - 1)]
            theirs = padded[np.minimum(at + size, len(padded) - 1)]
            right = np.where(equal, upper, theirs < ours) & open_
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)


def _hits(block: BenchmarkBlock, ids: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Occurrences of windows in one shard as (doc number, first position, words, item)."""
    _, _, low, high, order = block.search(ids)
    count = np.where(block.window > 0, high - low, 0)
    q = np.repeat(np.arange(len(count)), count)
    at = order[np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
    return doc[at], pos[at], block.window[q], block.item[q]


MATCHES = "doc_id long, n_words long, spans array<struct<start:long,words:long>>, items array<long>"
#: Number of a row in the stored copy that several passes read.
ROW = "_row"


def _held_words(block: BenchmarkBlock, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
    """Words of a document that a window can hold, as ids with their positions.

    A 0 stands wherever words were left out, so no match runs over the gap.
    """
    if not block.shortest or len(words) < block.shortest:
        return None
    ids = np.fromiter(map(block.vocabulary.get, words, repeat(0)), np.int64, len(words))
    keep = np.flatnonzero(block.chains(ids))
    if not len(keep):
        return None
    gap = np.concatenate([[True], np.diff(keep) > 1])
    at = np.arange(len(keep)) + np.cumsum(gap)
    run, where = np.zeros(len(keep) + gap.sum(), np.int64), np.full(len(keep) + gap.sum(), -1)
    run[at], where[at] = ids[keep], keep
    return run, where


def _found(block: BenchmarkBlock, parts: list[tuple]) -> tuple[dict, dict]:
    """Merged spans and items of each document number in a shard."""
    spans, items = {}, {}
    if not parts:
        return spans, items
    ids, doc, pos = (np.concatenate(x) for x in zip(*parts))
    d, p, w, it = _hits(block, ids, doc, pos)
    by = np.lexsort((p, d))
    d, p, w, it = d[by], p[by], w[by], it[by]
    cuts = np.flatnonzero(np.diff(d)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(d)]) if len(d) else ():
        end = np.maximum.accumulate(p[a:b] + w[a:b])
        new = np.concatenate([[True], p[a + 1:b] > end[:-1]])  # overlapping or touching windows are one span
        spans[int(d[a])] = list(zip(p[a:b][new].tolist(), (end[np.append(new[1:], True)] - p[a:b][new]).tolist()))
        items[int(d[a])] = np.unique(it[a:b]).tolist()
    return spans, items


def _scan(block: BenchmarkBlock, every: bool = True, name: str = "doc_id"):
    """A row per document, or per document with hits; ``name`` is what the first column is called."""
    def flush(docs, parts):
        spans, items = _found(block, parts)
        k = [i for i in range(len(docs)) if every or i in spans]
        return pa.RecordBatch.from_arrays(
            [pa.array([docs[i][0] for i in k], pa.int64()), pa.array([docs[i][1] for i in k], pa.int64()),
             pa.array([[{"start": a, "words": n} for a, n in spans.get(i, [])] for i in k],
                      pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))),
             pa.array([items.get(i, []) for i in k], pa.list_(pa.int64()))], names=[name, "n_words", "spans", "items"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts, held = [], [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if (found := _held_words(block, words)) is not None:
                    parts.append((found[0], np.full(len(found[0]), len(docs)), found[1]))
                    held += len(found[0])
                docs.append((doc_id, len(words)))
                if held >= SHARD_WORDS or len(docs) >= 50_000:
                    yield flush(docs, parts)
                    docs, parts, held = [], [], 0
        if docs:
            yield flush(docs, parts)

    return scan


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; the next one is read when the last one was searched."""
    items = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).filter(
        F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    block, size = [], 0
    for item_id, text in items.toLocalIterator():
        block.append((item_id, text))
        size += len(text)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _numbered(docs: DataFrame) -> DataFrame:
    """A stored copy of ``docs`` whose rows have a number of their own, the same in every pass."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "decontaminate-rows")


def _passes(rows: DataFrame, blocks: Iterator[list], window: int) -> DataFrame:
    """(_row, n_words, spans, items) of every numbered row (_row, text): a pass for each block."""
    def hits(items, every):
        scan = _scan(BenchmarkBlock(items, window), every, ROW)
        return stored(rows.mapInArrow(scan, MATCHES.replace("doc_id", ROW)), "decontaminate-hits")

    found = hits(next(blocks), True)  # a row for each document; from the other passes, for those with hits
    for items in blocks:
        found = found.unionByName(hits(items, False))
    return _merge(found)


def _only_block(benchmark: DataFrame, id_col: str, text_col: str) -> list[tuple[int, str]] | None:
    """The items, if one block holds them all."""
    blocks = _blocks(benchmark, id_col, text_col)
    first = next(blocks, [])
    return first if next(blocks, None) is None else None


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: words, merged spans of window occurrences, items found."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = _only_block(benchmark, item_col, item_text_col)
    if items is not None:
        return rows.mapInArrow(_scan(BenchmarkBlock(items, window)), MATCHES)
    rows = _numbered(rows)
    found = _passes(rows.select(ROW, "text"), _blocks(benchmark, item_col, item_text_col), window)
    return rows.select(ROW, F.col("doc_id").cast("long")).join(found, ROW).select("doc_id", "n_words", "spans", "items")


def _merge(every: DataFrame) -> DataFrame:
    """Hits of several passes over the same numbered rows, as one row each."""
    span = "struct<start:long,words:long>"
    empty = F.struct(F.array().cast(f"array<{span}>").alias("done"), F.lit(None).cast(span).alias("open"))

    def end(s):
        return s["start"] + s["words"]

    def grow(state, s):
        wider = F.struct(state["open"]["start"].alias("start"),
                         (F.greatest(end(state["open"]), end(s)) - state["open"]["start"]).alias("words"))
        return (F.when(state["open"].isNull(), F.struct(state["done"].alias("done"), s.alias("open")))
                .when(s["start"] <= end(state["open"]), F.struct(state["done"].alias("done"), wider.alias("open")))
                .otherwise(F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), s.alias("open"))))

    union = F.aggregate("spans", empty, grow, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(
        F.concat(s["done"], F.array(s["open"]))))
    merged = every.groupBy(ROW).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return merged.select(ROW, "n_words", union.alias("spans"), "items")


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """For every benchmark suffix the longest verbatim match in any document: length and one location.

    Matches shorter than the shortest window are not searched for.  Columns: item_id, item_pos,
    n_words, doc_id, doc_pos (the least location among the longest).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = "item_id long, item_pos long, n_words long, doc_id long, doc_pos long"

    def longest(items):
        return rows.mapInArrow(_longest(BenchmarkBlock(items, window)), schema)

    items, found = _only_block(benchmark, item_col, item_text_col), None
    if items is not None:
        found = longest(items) if items else docs.sparkSession.createDataFrame([], schema)
    else:
        for items in _blocks(benchmark, item_col, item_text_col):
            part = stored(longest(items), "decontaminate-longest")
            found = part if found is None else found.unionByName(part)
    best = F.min(F.struct((-F.col("n_words")).alias("less"), "doc_id", "doc_pos")).alias("b")
    return found.groupBy("item_id", "item_pos").agg(best).select(
        "item_id", "item_pos", (-F.col("b.less")).alias("n_words"), "b.doc_id", "b.doc_pos")


def _longest(block: BenchmarkBlock):

    def rows(docs, parts):
        ids, doc, pos = (np.concatenate(x) for x in zip(*parts))
        best, where, *_ = block.search(ids)
        hit = np.flatnonzero(best >= max(1, block.shortest))
        at = where[hit]
        return pa.RecordBatch.from_arrays(
            [pa.array(block.item[hit]), pa.array(block.place[hit]), pa.array(best[hit]),
             pa.array([docs[i] for i in doc[at]], pa.int64()), pa.array(pos[at].astype(np.int64))],
            names=["item_id", "item_pos", "n_words", "doc_id", "doc_pos"])

    def scan(batches):
        docs, parts, held = [], [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (found := _held_words(block, words_of(text))) is not None:
                    parts.append((found[0], np.full(len(found[0]), len(docs)), found[1]))
                    docs.append(doc_id)
                    held += len(found[0])
                if held >= SHARD_WORDS:
                    yield rows(docs, parts)
                    docs, parts, held = [], [], 0
        if parts:
            yield rows(docs, parts)

    return scan


def judged(matches: DataFrame) -> DataFrame:
    """Add ``n_hit`` and ``contaminated`` to the rows of ``find_matches``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return (matches.withColumn("n_hit", hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * HIT_FACTOR >= F.col("n_words"))))


def _keep_clean(block: BenchmarkBlock):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 2_000):
            parts, words = [], []
            for i, text in enumerate(rows.column(0).to_pylist()):
                each = words_of(text)
                words.append(len(each))
                if (found := _held_words(block, each)) is not None:
                    parts.append((found[0], np.full(len(found[0]), i), found[1]))
            spans, _ = _found(block, parts)
            hit = {i: sum(n for _, n in s) for i, s in spans.items()}
            clean = [not (hit.get(i) and hit[i] * HIT_FACTOR >= n) for i, n in enumerate(words)]
            yield pa.RecordBatch.from_arrays(rows.columns[1:], names=rows.schema.names[1:]).filter(pa.array(clean, pa.bool_()))
    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns.

    With a benchmark of one block rows are judged where they are; with more, hits are merged over the
    passes and the contaminated rows of the numbered copy are removed.
    """
    items = _only_block(benchmark, item_col, item_text_col)
    if items is not None:
        if not items:
            return docs
        rows = docs.select(F.col(text_col).alias(free_name(docs, "_text")), *[F.col(f"`{c}`") for c in docs.columns])
        return rows.mapInArrow(_keep_clean(BenchmarkBlock(items, window)), docs.schema)
    own = free_name(docs, "_own_row")  # of a column that is called like the number
    rows = _numbered(docs.withColumnRenamed(ROW, own))
    found = judged(_passes(rows.select(ROW, F.col(text_col).alias("text")), _blocks(benchmark, item_col, item_text_col), window))
    kept = rows.join(found.filter("contaminated").select(ROW), ROW, "left_anti").drop(ROW)
    return kept.withColumnRenamed(own, ROW).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = """
WITH dw AS (SELECT row_number() OVER () AS row, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bk AS (SELECT item_id, w, least(13, len(w)) AS k FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, (len(w) - k + 2)::BIGINT)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM bk),
dg AS (SELECT row, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT row, w, k, unnest(range(1, (len(w) - k + 2)::BIGINT)) AS i FROM dw, ks WHERE len(w) >= k)),
occ AS (SELECT row, i, dg.k, item_id FROM dg JOIN bg USING (g, k)),
hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS p FROM occ) GROUP BY row),
its AS (SELECT row, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS s FROM occ) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (row) LEFT JOIN its USING (row)
"""
