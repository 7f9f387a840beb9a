"""Keyword and vector retrieval over a document table, for a table of queries.

Queries and documents meet in cells, never as pairs of rows and never through the
driver.  Queries are cut into blocks of bounded size, documents into shards; a cell
(block, shard) is one group of a repartitioned table in which the block's queries come
first and the shard's documents stream past them.  A cell keeps what its queries need
(their k best, or their hits), so at most k x queries x shards rows are shuffled
afterwards.  A frequent word or a hot label is spread over all shards.

* Substring tests search each text once with an Aho-Corasick automaton of the block.
* Whole-token overlap turns the roles round, so that no text is copied: the documents of a shard become postings, and the
  queries, which are short, go to every shard and stream past them.
* Vector search compares a block with one Arrow batch of base vectors at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words dropped from keyword queries.
STOP_WORDS = ("查询", "查找", "分析", "审计", "检查")
# whitespace runs that separate words (ASCII whitespace, as str.split on ASCII text)
WS = r"[ \t\n\x0B\f\r]+"
#: A block holds about so many queries, and so many characters of their terms.
BLOCK_QUERIES, BLOCK_CHARS = 2048, 1 << 20
#: A block of vectors to look for grows with their number up to so many, so that the base is copied to few blocks.
BLOCK_VECTORS = 16_384
#: A shard holds about so many characters of texts, or so many vectors; a shard of postings so many characters.
SHARD_CHARS, SHARD_VECTORS, POSTING_CHARS = 64 << 20, 1 << 17, 128 << 20
#: Documents or vectors that are compared with a block at a time.
BATCH = 512


def _spread(queries: DataFrame, base: DataFrame, keys: Sequence[str], blocks: DataFrame) -> DataFrame:
    """Cells of ``queries`` and ``base`` (keys, id, payload): one table
    (cell, is_base, q, d, payload), each cell together, its queries first.
    ``blocks`` gives per key (all rows, if there is none) the numbers of query blocks and base shards."""
    def sized(df: DataFrame) -> DataFrame:
        return df.join(blocks, list(keys)) if keys else df.crossJoin(F.broadcast(blocks))  # one row

    q = sized(queries).select(*keys, F.pmod(F.xxhash64("id"), "n_blocks").alias("_b"),
                              F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1)).alias("_s"),
                              F.lit(False).alias("is_base"), F.col("id").alias("q"), F.lit(None).cast(base.schema["id"].dataType).alias("d"), "payload")
    b = sized(base).select(*keys, F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("_b"),
                           F.pmod(F.xxhash64("id"), "n_shards").alias("_s"),
                           F.lit(True).alias("is_base"), F.lit(None).cast(queries.schema["id"].dataType).alias("q"),
                           F.col("id").alias("d"), "payload")
    cell = [*keys, "_b", "_s"]
    # cells are told apart by a text, so that the tasks need not know the keys' types
    # a number of partitions keeps the few large cells from being put together into fewer tasks
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # without keys the cells are few and alike: they are dealt out by number, as by a hash some partitions get several
    both = q.unionByName(b)
    both = both.repartition(parts, *cell) if keys else both.repartitionById(parts, F.pmod(F.col("_b") * F.lit(31) + F.col("_s"), F.lit(parts)).cast("int"))
    return (both.sortWithinPartitions(*cell, "is_base")
            .select(F.to_json(F.struct(*cell)).alias("cell"), "is_base", "q", "d", "payload"))


def _cells(kernel):
    """A ``mapInArrow`` function: per cell ``kernel(ids, payloads)`` is built from the queries, takes
    batches of the base through ``add`` and gives its rows in ``close``; both return record batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q_ids, q_load, cell = None, [], [], None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                keys, is_base, q, d, load = (c.to_pylist() for c in batch.slice(at, BATCH).columns)
                i = 0
                while i < len(keys):
                    if keys[i] != now:
                        if cell is not None:
                            yield from cell.close()
                        now, q_ids, q_load, cell = keys[i], [], [], None
                    end = i
                    while end < len(keys) and keys[end] == now and is_base[end] == is_base[i]:
                        end += 1
                    if not is_base[i]:
                        q_ids += q[i:end]
                        q_load += load[i:end]
                    elif q_ids:
                        if cell is None:
                            cell, q_load = kernel(q_ids, q_load), []
                        yield from cell.add(d[i:end], load[i:end])
                    i = end
        if cell is not None:
            yield from cell.close()
    return run


class _Best:
    """The k best (largest ``rank``, then least id) rows of each query, ties included as they come."""

    def __init__(self, n: int, k: int):
        self.k, self.rank, self.ids, self.value = k, np.full((n, 0), 0.0), None, np.full((n, 0), 0.0)

    def add(self, rank: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        """``rank`` and ``value`` are (queries x rows); -inf is no hit."""
        ids = np.broadcast_to(ids, rank.shape)
        if self.ids is not None:
            rank, value = np.hstack([self.rank, rank]), np.hstack([self.value, value])
            ids = np.hstack([self.ids, ids])
        if rank.shape[1] > self.k:
            order = np.lexsort((ids, -rank), axis=1)[:, :self.k]
            rank, ids, value = (np.take_along_axis(x, order, 1) for x in (rank, ids, value))
        self.rank, self.ids, self.value = rank, ids, value

    def rows(self, q_ids: Sequence) -> tuple[list, list, np.ndarray]:
        if self.ids is None:
            return [], [], np.zeros(0)
        q, j = np.nonzero(self.rank > -np.inf)
        return [q_ids[i] for i in q], self.ids[q, j].tolist(), self.value[q, j]


class _Nearest:
    """The k nearest (least distance, then least id) rows of each of n queries, kept as one sparse list."""

    def __init__(self, n: int, k: int):
        self.k, self.q, self.ids, self.value = k, np.zeros(0, np.int64), None, np.zeros(0)
        self.bound = np.full(n, np.inf)  # the k-th distance, once there are k

    def add(self, q: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        """Candidates: query numbers, ids and distances."""
        if not len(q):
            return
        if self.ids is not None:
            q, ids, value = np.concatenate([self.q, q]), np.concatenate([self.ids, ids]), np.concatenate([self.value, value])
        order = np.lexsort((ids, value, q))
        q, ids, value = q[order], ids[order], value[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept, last = place < self.k, place == self.k - 1
        self.bound[q[last]] = value[last]
        self.q, self.ids, self.value = q[kept], ids[kept], value[kept]

    def rows(self, q_ids: Sequence) -> tuple[list, list, np.ndarray]:
        return [q_ids[i] for i in self.q], [] if self.ids is None else self.ids.tolist(), self.value


def _batch(q_ids: list, d_ids: list, value, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q_ids, types[0]), pa.array(d_ids, types[1]), pa.array(value, types[2])],
                                      names=["query_id", "doc_id", "hits"])


class _TermCell:
    """Counts how many terms of each query of a block a text holds anywhere inside (a term given twice counts twice)."""

    def __init__(self, q_ids: list, terms: list, k: int | None, cap: float, types):
        import ahocorasick
        self.q_ids, self.types, self.cap = q_ids, types, cap
        place: dict[str, int] = {}
        holders: list[list[int]] = []
        for q, words in enumerate(terms):
            for w in words:
                if w not in place:
                    place[w] = len(holders)
                    holders.append([])
                holders[place[w]].append(q)
        self.holders = [np.array(h, np.int64) for h in holders]
        self.size = np.array([max(1, len(t)) for t in terms], np.int64)
        self.best = _Best(len(q_ids), k) if k else None
        self.automaton = ahocorasick.Automaton()
        for w, i in place.items():
            self.automaton.add_word(w, i)
        self.automaton.make_automaton()

    def add(self, ids: list, texts: list):
        hits = np.zeros((len(ids), len(self.q_ids)), np.int64)
        for j, text in enumerate(texts):
            found = {i for _, i in self.automaton.iter(text[0])}
            if found:
                hits[j] = np.bincount(np.concatenate([self.holders[i] for i in found]), minlength=len(self.q_ids))
        if self.best is None:
            j, q = np.nonzero(hits)
            yield _batch([self.q_ids[i] for i in q], [ids[i] for i in j], hits[j, q], self.types)
            return
        hits = hits.T
        rank = np.where(hits > 0, np.minimum(hits / self.size[:, None], self.cap), -np.inf)
        self.best.add(rank, np.array(ids), hits.astype(np.float64))

    def close(self):
        if self.best is not None:
            q, d, value = self.best.rows(self.q_ids)
            yield _batch(q, d, value.astype(np.int64), self.types)


class _WordCell:
    """Documents of a shard as postings by word; per query that passes, how many of its terms are words of each document.

    A frequent word is a row of bits, one a document, others are lists of documents.  Rows are added 64 documents at a time: the
    count of each document is spread over planes, one for each binary digit, and three rows of one digit become a row of it and one of
    the next.  The k best are found from the highest digit down, in the order of the documents' ids.

    Most queries need not add their frequent words for all documents (``_pruned``): the rare words are counted first, where they
    are, and the most promising documents fully.  The k-th of these is a bound, and what reaches it must hold some of the rare words."""

    #: A word that more than one document in so many holds is a row of bits.
    DENSE = 128
    #: Bytes of rows that are added at a time, for some queries beside each other.
    ROWS = 1 << 20
    #: Documents whose texts are split at a time.
    TEXTS = 16_384
    #: Rare words of a query are in about one document in so many, together; places of words that are looked up at a time.
    RARE, PLACES = 8, 1 << 18
    #: The time to look up a word in a document, as a part of that to add a word's row for so many documents.
    LOOKUP = 64

    def __init__(self, d_ids: list, texts: list, k: int | None, cap: float, types):
        order = sorted(range(len(d_ids)), key=lambda i: (d_ids[i] is not None, d_ids[i]))
        self.ids, self.k, self.cap, self.types = [d_ids[i] for i in order], k, cap, types
        place: dict[str, int] = {}
        held = []
        for at in range(0, len(order), self.TEXTS):
            some = pa.array([texts[i][0] for i in order[at:at + self.TEXTS]], pa.large_string())
            split = pc.ascii_split_whitespace(some)
            word = split.flatten().dictionary_encode()
            doc = np.repeat(np.arange(at, at + len(some), dtype=np.int64), np.diff(split.offsets.to_numpy()))
            number = np.array([place.setdefault(w, len(place)) if w else -1 for w in word.dictionary.to_pylist()], np.int64)
            both = np.sort(number[word.indices.to_numpy()] << 32 | doc)
            held.append(both[np.append(True, both[1:] != both[:-1]) & (both >= 0)] if len(both) else both)  # a document holds a word once
        both = np.sort(np.concatenate(held))
        n, self.place = len(order), place
        self.docs = (both & 0xFFFFFFFF).astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(both >> 32, minlength=len(place)))])
        self.often = np.diff(self.start)
        self.width = -(-n // 64)  # of a row
        dense = np.flatnonzero(self.often * self.DENSE > n)
        self.row = np.full(len(place), -1)
        self.row[dense] = np.arange(len(dense))
        self.bits = np.zeros((len(dense) + 1, self.width), np.uint64)  # the last has no document
        for i, w in enumerate(dense):
            row = np.zeros(self.width * 64, bool)
            row[self._docs_of(w)] = True
            self.bits[i] = np.packbits(row, bitorder="little").view(np.uint64)

    def _docs_of(self, word: int) -> np.ndarray:
        return self.docs[self.start[word]:self.start[word + 1]]

    def _planes(self, queries: list[np.ndarray]) -> list[np.ndarray]:
        """Digits of the counts, the lowest first: rows of bits, one a document, for one query after the other."""
        rows = [self.row[q] for q in queries]
        most = max(1, max(int((r >= 0).sum()) for r in rows))
        index = np.full((most, len(queries)), len(self.bits) - 1)
        for i, r in enumerate(rows):
            r = r[r >= 0]
            index[:len(r), i] = r
        digits = [self.bits.take(index.ravel(), axis=0).reshape(most, -1)]
        some = [self._docs_of(w) + np.int64(i * self.width * 64) for i, (q, r) in enumerate(zip(queries, rows)) for w in q[r < 0]]
        if some:  # documents of rare words, as digits of the number of such words that each holds
            at = np.sort(np.concatenate(some))
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            count, at = np.diff(np.append(first, len(at))), at[first]
            for digit in range(int(count.max()).bit_length()):
                one = at[count >> digit & 1 == 1]
                row = np.zeros((1, digits[0].shape[1]), np.uint64)
                np.add.at(row[0], one >> 6, np.uint64(1) << (one & 63).astype(np.uint64))
                if digit < len(digits):
                    digits[digit] = np.concatenate([digits[digit], row])
                else:
                    digits.append(row)
        out = []
        while digits:
            x, carry = digits.pop(0), []
            while len(x) > 1:
                third = max(1, len(x) // 3)
                a, b, rest = x[:third], x[third:2 * third], x[2 * third:]
                if len(x) == 2:
                    carry.append(a & b)
                    x = a ^ b
                    continue
                c, rest = rest[:third], rest[third:]
                either = a ^ b
                both = a & b
                both |= either & c
                carry.append(both)
                either ^= c
                x = np.concatenate([either, rest]) if len(rest) else either
            out.append(x[0])
            if carry:
                digits = [np.concatenate([*carry, *digits[:1]]), *digits[1:]]
        return out

    def _hits(self, planes: list[np.ndarray]) -> np.ndarray:
        """The counts of all documents, of one query."""
        total = np.zeros(self.width * 64, np.int64)
        for i, p in enumerate(planes):
            total += np.unpackbits(p.view(np.uint8), bitorder="little").astype(np.int64) << i
        return total[:len(self.ids)]

    def _best(self, planes: list[np.ndarray], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, counts) of the k largest counts of each of ``n`` queries, of equals the first."""
        planes = [p.reshape(n, -1) for p in planes]
        tied = planes[0].copy()  # documents that may still be among the k best
        for p in planes[1:]:
            tied |= p
        need = np.minimum(self.k, np.bitwise_count(tied).sum(1, dtype=np.int64))
        above = np.zeros_like(tied)
        for p in reversed(planes):
            with_ = tied & p
            many = np.bitwise_count(with_).sum(1, dtype=np.int64)
            enough = many >= need
            need = np.where(enough, need, need - many)
            every = np.where(enough, np.uint64(0), ~np.uint64(0))[:, None]
            above |= with_ & every
            # those with the digit if they are enough, those without it if they are too few
            tied = with_ ^ (tied & every)
        for i in range(n):
            at = np.concatenate([_set_bits(above[i], None), _set_bits(tied[i], int(need[i]))])
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            yield at, sum((p[i, word] >> bit & np.uint64(1)).astype(np.int64) << d for d, p in enumerate(planes))

    def _pruned(self, queries: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, documents, counts) of the k largest counts, of equals the first, for the queries whose rare words tell them."""
        n, size = len(self.ids), len(queries)
        q, w = np.repeat(np.arange(size), [len(x) for x in queries]), np.concatenate(queries)
        order = np.lexsort((self.often[w], q))
        w, often, first = w[order], self.often[w[order]], np.searchsorted(q, np.arange(size))
        upto = np.cumsum(often)
        rare = (upto - (upto - often)[first][q] <= n // self.RARE) | (self.row[w] < 0)
        known = np.bincount(q[rare], minlength=size)
        rest = np.bincount(q, minlength=size) - known
        rows, row_first = self.row[w[~rare]], np.cumsum(rest) - rest
        # documents that hold rare words, and how many of them
        q, w, often = q[rare], w[rare], often[rare]
        at = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often) + np.repeat(self.start[w], often)
        at = np.sort((np.repeat(q, often) * n + self.docs[at]).astype(np.uint32 if size * n < 1 << 32 else np.int64))
        if not len(at):
            return
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        q, doc = np.divmod(at[first].astype(np.int64), n)
        count = np.diff(np.append(first, len(at)))

        def whole(of: np.ndarray) -> np.ndarray:
            """The counts of these documents with the frequent words."""
            out, upto = count[of], np.cumsum(rest[q[of]])
            cuts = [0, *np.searchsorted(upto, range(self.PLACES, int(upto[-1]) if len(of) else 0, self.PLACES)).tolist(), len(of)]
            for i, j in zip(cuts, cuts[1:]):
                words = rest[q[of[i:j]]]
                some = np.repeat(of[i:j], words)
                at = np.arange(len(some)) - np.repeat(np.cumsum(words) - words, words) + row_first[q[some]]
                bit = self.bits[rows[at], doc[some] >> 6] >> (doc[some] & 63).astype(np.uint64) & np.uint64(1)
                out[i:j] += np.bincount(np.repeat(np.arange(j - i), words), bit, j - i).astype(np.int64)
            return out

        most = int(count.max()) + 1
        above = np.cumsum(np.bincount(q * most + count, minlength=size * most).reshape(size, most)[:, ::-1], axis=1)[:, ::-1]
        least = np.maximum(1, (above >= 4 * self.k).sum(1) - 1)
        tried = np.flatnonzero(count >= least[q])
        tried = tried[np.lexsort((-count[tried], q[tried]))]
        tried = tried[np.arange(len(tried)) - np.searchsorted(q[tried], q[tried]) < 4 * self.k]
        found = whole(tried)
        order = np.lexsort((-found, q[tried]))
        of = q[tried][order]
        kth = np.searchsorted(of, np.arange(size)) + self.k - 1
        there = kth < np.searchsorted(of, np.arange(size), "right")
        bound = np.zeros(size, np.int64)
        bound[there] = found[order][kth[there]]
        # who reaches the bound holds at least so many of the rare words
        least = bound - rest
        told = (least >= 1) & there
        # and where these are so many that adding all rows is faster, that is done
        told[told] &= above[np.flatnonzero(told), least[told]] * rest[told] * self.LOOKUP <= (rest + known)[told] * n
        tried = np.flatnonzero(told[q] & (count >= least[q]))
        found = whole(tried)
        order = np.lexsort((doc[tried], -found, q[tried]))
        of = q[tried][order]
        start, end = (np.searchsorted(of, np.arange(size), side) for side in ("left", "right"))
        for i in np.flatnonzero(told).tolist():
            best = order[start[i]:min(end[i], start[i] + self.k)]
            yield i, doc[tried[best]], found[best]

    def add(self, q_ids: list, queries: list):
        q_out, d_out, n_out = [], [], []

        def out(i: int, at: np.ndarray, count: np.ndarray) -> None:
            q_out.extend([q_ids[i]] * len(at))
            d_out.extend([self.ids[j] for j in at.tolist()])
            n_out.append(count)

        found = [np.array([w for w in map(self.place.get, terms) if w is not None], np.int64) for terms in queries]
        order = [i for i in range(len(found)) if len(found[i])]
        best = self.k and self.cap >= 1  # else documents above the cap are equal, or all are wanted
        if best:
            done, some = set(), max(1, self.PLACES * self.RARE // (2 * len(self.ids)))
            for at in range(0, len(order), some):
                part = order[at:at + some]
                for j, *of in self._pruned([found[i] for i in part]):
                    out(part[j], *of)
                    done.add(part[j])
            order = [i for i in order if i not in done]
        order.sort(key=lambda i: len(found[i]))
        while order:
            some = max(1, self.ROWS // (8 * self.width * len(found[order[0]])))
            group, order = order[:some], order[some:]
            planes = self._planes([found[i] for i in group])
            for i, of in zip(group, self._best(planes, len(group)) if best else (
                    self._chosen(self._hits([p.reshape(len(group), -1)[j] for p in planes]), len(queries[i])) for j, i in enumerate(group))):
                out(i, *of)
        yield _batch(q_out, d_out, np.concatenate(n_out) if n_out else np.zeros(0, np.int64), self.types)

    def _chosen(self, hits: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.k:
            at = np.flatnonzero(hits)
        else:  # documents stand in the order of their ids, so of equals the first are taken
            above = np.cumsum(np.bincount(hits)[::-1])[::-1]
            enough = np.flatnonzero(above >= self.k)
            least = max(1, int(enough[-1]) if len(enough) else 1)  # the k-th largest count
            if least / terms > self.cap:  # the cap makes it equal to all that reach the cap
                at = np.flatnonzero(hits >= np.argmax(np.arange(least + 1) / terms >= self.cap))[:self.k]
            else:
                at = np.flatnonzero(hits > least)
                at = np.concatenate([at, np.flatnonzero(hits == least)[:self.k - len(at)]])
        return at, hits[at].astype(np.int64)

    def close(self):
        return ()


def _set_bits(row: np.ndarray, most: int | None) -> np.ndarray:
    """Places of the first ``most`` bits that are set in a row of 64-bit words."""
    word = np.flatnonzero(row)[:most]
    bits = np.unpackbits(row[word].view(np.uint8), bitorder="little").reshape(-1, 64)
    i, j = np.nonzero(bits)
    return (word[i] * 64 + j)[:most]


def _arrow_type(df: DataFrame, col: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    t = df.schema[col].dataType
    return t.simpleString(), to_arrow_type(t)


def term_hits(queries: DataFrame, docs: DataFrame, whole: bool, k: int | None = None, cap: float = 1.0) -> DataFrame:
    """``query_id, doc_id, hits``: how many of the query's ``terms`` (an array) the document holds, where any.

    ``docs.terms`` is an array of one text.  ``whole``: terms are compared with its words (split at ASCII white
    space); else they are looked for anywhere inside it.  ``k`` keeps the documents with the largest share of
    terms, at most ``cap`` of it counting, ties by id: k per query and shard, the caller cuts to k per query."""
    q = queries.select(F.col("query_id").alias("id"), F.col("terms").alias("payload")).where(F.size("terms") > 0)
    d = docs.select(F.col("doc_id").alias("id"), F.col("terms").alias("payload")).where(F.size("terms") > 0)
    chars = F.aggregate("payload", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))
    at_least = docs.sparkSession.sparkContext.defaultParallelism
    qt, dt = _arrow_type(queries, "query_id"), _arrow_type(docs, "doc_id")
    types = (qt[1], dt[1], pa.int64())
    schema = f"query_id {qt[0]}, doc_id {dt[0]}, hits long"
    if whole:
        shards = d.agg(F.greatest(F.ceil(F.sum(chars) / POSTING_CHARS), F.lit(at_least)).cast("int").alias("n_blocks"), F.lit(1).alias("n_shards"))
        return _spread(d, q, [], shards).mapInArrow(_cells(lambda ids, texts: _WordCell(ids, texts, k, cap, types)), schema)
    blocks = q.agg(F.greatest(F.ceil(F.count("*") / BLOCK_QUERIES), F.ceil(F.sum(chars) / BLOCK_CHARS), F.lit(1))
                   .cast("int").alias("n_blocks")).crossJoin(
        d.agg(F.greatest(F.ceil(F.sum(chars) / SHARD_CHARS), F.lit(at_least)).cast("int").alias("n_shards")))
    return _spread(q, d, [], blocks).mapInArrow(_cells(lambda ids, terms: _TermCell(ids, terms, k, cap, types)), schema)


def _words(text: Column) -> Column:
    """Distinct non-empty words, in the order of their first use."""
    return F.filter(F.array_distinct(F.split(text, WS)), lambda w: F.length(w) > 0)


def _top_per_query(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    if not k:
        return df
    w = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


# ---------------------------------------------------------------- RET-9 index text
def knowledge_text(kb: DataFrame) -> DataFrame:
    """Search text (title + tags + content, NULL-safe) and a display snippet."""
    return kb.select("*", F.concat_ws("", "title", "tags", "content").alias("search_text"),
                     F.left(F.coalesce(F.col("content"), F.lit("")), F.lit(200)).alias("snippet"))


# ---------------------------------------------------------------- RET-1 substring search
def substring_search(queries: DataFrame, kb: DataFrame, k: int | None = None) -> DataFrame:
    """Documents whose title/tags/content contain the query text
    (case-insensitive), newest first, optional top-k per query."""
    docs = knowledge_text(kb).select(F.col("id").alias("doc_id"), F.array(F.lower("search_text")).alias("terms"))
    needles = queries.where(F.length("query") > 0).select("query_id", F.array(F.lower("query")).alias("terms"))
    m = term_hits(needles, docs, whole=False).drop("hits")
    out = m.join(kb.select(F.col("id").alias("doc_id"), "title", "created_at"), "doc_id")
    return _top_per_query(out, k, F.col("created_at").desc(), F.col("doc_id"))


# ---------------------------------------------------------------- RET-2 keyword hits
def query_keywords(queries: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``query_id, terms``: lower-cased distinct whitespace tokens longer than one character, minus stop
    words; tokens that differ in case only are told apart."""
    kept = F.filter(_words(F.col("query")), lambda w: (F.length(w) > 1) & ~w.isin(*stop_words))
    return queries.select("query_id", F.transform(kept, F.lower).alias("terms"))


def keyword_search(queries: DataFrame, kb: DataFrame, k: int | None = 3) -> DataFrame:
    """Score = number of the query's keywords found (as substrings) in the
    lower-cased title+tags+content; top-k per query (ties by doc id)."""
    docs = knowledge_text(kb).select(F.col("id").alias("doc_id"), F.array(F.lower("search_text")).alias("terms"))
    scored = term_hits(query_keywords(queries), docs, False, k).withColumnRenamed("hits", "score")
    return _top_per_query(scored, k, F.col("score").desc(), F.col("doc_id"))


# ---------------------------------------------------------------- RET-3 overlap
def _overlap(queries: DataFrame, docs: DataFrame, whole: bool, k: int | None, weight: float, cap: float) -> DataFrame:
    terms = queries.select("query_id", _words(F.lower("query")).alias("terms"))
    hits = term_hits(terms, docs, whole, k, cap / weight)
    out = hits.join(terms.select("query_id", F.size("terms").alias("n")), "query_id").select(
        "query_id", "doc_id", F.col("hits").alias("overlap"),
        F.round(F.least(F.col("hits") / F.col("n") * weight, F.lit(cap)), 6).alias("score"))
    return _top_per_query(out, k, F.col("score").desc(), F.col("doc_id"))


def token_overlap(queries: DataFrame, kb: DataFrame, k: int | None = None) -> DataFrame:
    """Whole-token overlap of lower-cased whitespace tokens between the query
    and content + ' ' + title: score = min(overlap / |query tokens| * 0.8, 0.8)."""
    docs = kb.select(F.col("id").alias("doc_id"), F.array(F.lower(F.concat_ws(" ", "content", "title"))).alias("terms"))
    return _overlap(queries, docs, True, k, 0.8, 0.8)


def substring_overlap(queries: DataFrame, kb: DataFrame, k: int | None = None) -> DataFrame:
    """Share of the query's distinct lower-cased words that occur as substrings
    of title + ' ' + content: score = min(share, 0.9)."""
    docs = kb.select(F.col("id").alias("doc_id"), F.array(F.lower(F.concat_ws(" ", "title", "content"))).alias("terms"))
    return _overlap(queries, docs, False, k, 1.0, 0.9)


# ---------------------------------------------------------------- RET-4 vectors
class _VectorCell:
    """The k nearest base vectors of each query of a block."""

    def __init__(self, q_ids: list, vectors: list, k: int, metric: str, exclude_self: bool, types):
        self.q_ids, self.types, self.metric, self.exclude_self = q_ids, types, metric, exclude_self
        self.ids, self.q = np.array(q_ids), np.array(vectors, np.float64)
        self.norm = np.linalg.norm(self.q, axis=1)
        self.best = _Nearest(len(q_ids), k)

    def add(self, ids: list, vectors, rows: np.ndarray | None = None, allowed: np.ndarray | None = None):
        """Compare with base vectors; ``rows``: only these queries, by number; ``allowed`` (queries x vectors): only these pairs."""
        x, ids = np.array(vectors, np.float64), np.array(ids)
        rows = np.arange(len(self.q)) if rows is None else rows
        own, norm, bound = self.q[rows], self.norm[rows], self.best.bound[rows]
        if self.metric == "cosine":
            d = 1.0 - (own @ x.T) / np.maximum(norm[:, None] * np.linalg.norm(x, axis=1)[None, :], 1e-300)
        else:
            d = (own * own).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2.0 * own @ x.T
        if allowed is not None:
            d[~allowed] = np.inf
        if self.exclude_self:
            d[self.ids[rows][:, None] == ids[None, :]] = np.inf
        d[np.isnan(d)] = np.inf
        k = min(self.best.k, d.shape[1])
        if k and not np.isfinite(bound).all():
            bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1] if k == self.best.k else np.inf)
        # the product form loses digits: whatever may be among the k nearest is computed again from differences
        slack = 1e-9 * (1 + norm ** 2 + np.abs(bound)) if self.metric == "l2sq" else 0.0
        qi, xi = np.nonzero(np.isfinite(d) & (d <= (bound + slack)[:, None]))
        value = d[qi, xi]
        if self.metric == "l2sq":
            for at in range(0, len(qi), 65536):
                a, b = qi[at:at + 65536], xi[at:at + 65536]
                value[at:at + 65536] = ((own[a] - x[b]) ** 2).sum(1)
        self.best.add(rows[qi], ids[xi], value)
        return ()

    def close(self):
        yield _batch(*self.best.rows(self.q_ids), self.types)


def vector_topk(queries: DataFrame, base: DataFrame, k: int = 5, metric: str = "l2sq",
                filter_cols: Sequence[str] = (), exclude_self: bool = False,
                block_rows: int | None = None) -> DataFrame:
    """Exact k nearest base vectors per query: ``query_id, doc_id, distance, score``.

    ``queries(query_id, vec, *filter_cols)``, ``base(doc_id, vec, *filter_cols)``;
    base rows must match the query on every filter column, which partition the work; a hot value
    is cut into more cells.  ``block_rows`` are the queries of a block: by default ``BLOCK_QUERIES`` to ``BLOCK_VECTORS``, as many
    as leave every core a few blocks.  score = 1 - distance (l2sq) or cosine similarity (cosine).  Ties go to the
    smaller id.  Rows without a vector are left out."""
    if metric not in ("l2sq", "cosine"):
        raise ValueError("metric is l2sq or cosine")
    keys = list(filter_cols)
    at_least = 1 if keys else base.sparkSession.sparkContext.defaultParallelism
    q = queries.where(F.col("vec").isNotNull()).select(*keys, F.col("query_id").alias("id"), F.col("vec").alias("payload"))
    b = base.where(F.col("vec").isNotNull()).select(*keys, F.col("doc_id").alias("id"), F.col("vec").alias("payload"))
    if block_rows is None:
        per_block = q.agg(F.least(F.lit(BLOCK_VECTORS), F.greatest(F.lit(BLOCK_QUERIES), F.ceil(
            F.count("*") / (4 * base.sparkSession.sparkContext.defaultParallelism)))).alias("_rows"))
        n_q = q.groupBy(*keys).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(per_block))  # one row
        n_q = n_q.select(*keys, F.ceil(F.col("_n") / F.col("_rows")).cast("int").alias("n_blocks"))
    else:
        n_q = q.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_blocks"))
    n_b = b.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / SHARD_VECTORS), F.lit(at_least)).cast("int").alias("n_shards"))
    blocks = (n_q.join(n_b, keys) if keys else n_q.crossJoin(n_b)).where("n_blocks > 0")
    (q_kind, q_arrow), (d_kind, d_arrow) = _arrow_type(queries, "query_id"), _arrow_type(base, "doc_id")
    types = (q_arrow, d_arrow, pa.float64())
    found = _spread(q, b, keys, blocks).mapInArrow(
        _cells(lambda ids, vectors: _VectorCell(ids, vectors, k, metric, exclude_self, types)),
        f"query_id {q_kind}, doc_id {d_kind}, hits double").withColumnRenamed("hits", "distance")
    top = _top_per_query(found, k, F.col("distance").asc(), F.col("doc_id"))
    return top.select("query_id", "doc_id", "distance", (F.lit(1.0) - F.col("distance")).alias("score"))


# ---------------------------------------------------------------- RET-5/6/7/8
def hybrid_merge(vector_hits: DataFrame, keyword_hits: DataFrame, k: int) -> DataFrame:
    """Union of vector and keyword hits per query; a doc found both ways keeps
    its vector hit; highest score first, at most 2k per query."""
    v = vector_hits.select("query_id", "doc_id", F.col("score").cast("double").alias("score"),
                           F.lit("vector").alias("source"))
    kw = keyword_hits.select("query_id", "doc_id", F.col("score").cast("double").alias("score"),
                             F.lit("keyword").alias("source"))
    # each side is read once: a pair is told to have a vector hit beside its keyword hit, not by a join with the vector hits
    both = v.unionByName(kw)
    known = F.col("query_id").isNotNull() & F.col("doc_id").isNotNull()
    also = F.max(F.col("source") == "vector").over(Window.partitionBy("query_id", "doc_id"))
    both = both.repartition("query_id").withColumn("_also", also & known).where((F.col("source") == "vector") | ~F.col("_also")).drop("_also")
    return _top_per_query(both, 2 * k, F.col("score").desc(), F.col("source").desc(), F.col("doc_id"))


def expand_related(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Add one-hop related docs (edges ``doc_id -> related_id``) not already hit
    for the query, with score 0 and ``is_related`` set."""
    base = hits.select("query_id", "doc_id", F.col("score").cast("double").alias("score"),
                       F.lit(False).alias("is_related"))
    rel = hits.select("query_id", "doc_id").join(edges, "doc_id").select(
        "query_id", F.col("related_id").alias("doc_id")).distinct()
    new = rel.join(base.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select(
        "query_id", "doc_id", F.lit(0.0).alias("score"), F.lit(True).alias("is_related"))
    return base.unionByName(new)


def upsert_vectors(base: DataFrame, delta: DataFrame, key: str = "vec_id") -> DataFrame:
    """Replace vectors with the same id, add new ones."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def delete_vectors(base: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def pca_2d(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """2-D projection for plotting: centre (no scaling), PCA(k=2), each axis
    sign-normalised so its first non-zero loading is positive."""
    v = df.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(v).transform(v)
    model = PCA(k=2, inputCol="c", outputCol="p").fit(centred)
    pc = model.pc.toArray()
    signs = [1.0 if pc[np.nonzero(pc[:, j])[0][0], j] >= 0 else -1.0 for j in range(2)] if pc.size else [1.0, 1.0]
    arr = vector_to_array(F.col("p"))
    return model.transform(centred).select(id_col, (arr[0] * signs[0]).alias("x"), (arr[1] * signs[1]).alias("y"))
