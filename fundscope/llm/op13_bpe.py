"""Byte-pair encoding by speculation, and decoding.

A word (a piece of the tokenizer's splitting pattern) is encoded in three steps:

1. *Speculate.*  The longest vocabulary entry at every byte of all new words of a batch is found at once
   over a trie in arrays; following those from a word's first byte gives its greedy proposal.
2. *Verify.*  Merges apply in ascending rank, and a merge's parts have smaller ranks than itself.  So next to
   the border of two neighbours ``(a, b)`` stand, as ranks go up, the parts along ``a``'s right edge and
   ``b``'s left edge, each from its own merge until the merge that swallows it.  The border falls if two that
   stand there together form a merge which comes before both are swallowed.  ``compatible`` walks
   both edges of all adjacent pairs at once.  A sequence of tokens is the exact encoding of its bytes if and
   only if no border falls.
3. *Merge.*  Only words with a falling border are merged exactly, rank by rank.

Words are remembered by the Python worker, up to a bounded number of bounded length, so a text costs one split and one
look-up a word.  Which characters are letters, digits or white space is asked of the tokenizer, since
Unicode versions differ between libraries.  Strings of special tokens inside a text become
their ids, as the library does.  Ids are kept as little-endian unsigned 32-bit integers, the usual form of token files.

Null texts are empty: no ids, and the empty text decoded.  Null and repeated ids are rows like any other;
every row stands by itself, so ties cannot occur.  Long texts are read whole, in blocks of words; one word without a
break is held whole.  An empty table gives no rows.  Extra columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, held_by_worker, table

NAME = "op13_speculative_bpe"
TOKENIZER = "byte_bpe_50k.json"
#: Words that a worker remembers before it starts afresh, and the longest that it remembers.
REMEMBERED, LONGEST = 300_000, 64
#: Texts of more characters are read in blocks of so many words.
LONG_TEXT, BLOCK_WORDS = 4 << 20, 500_000
#: Words of more bytes are merged one by one, with a heap of their pairs; the others all at once.
MERGED_AT_ONCE = 256
#: The splitting pattern that byte-level tokenizers share; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.int64(1) << 40
ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = "doc_id long, n_tokens long, ids binary, text string"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Splitter:
    """Words of a text, cut where the tokenizer cuts.

    The pattern runs on the text itself, or on a shadow of equal length in which a character that the tokenizer classes
    differently from the pattern's library is replaced by a plain one of the tokenizer's class.
    """

    def __init__(self, pre_tokenizer, pattern: str = PATTERN):
        self.pre_tokenizer, self.pattern = pre_tokenizer, regex.compile(pattern)
        self.known: set[str] = set()
        self.shadow: dict[int, str] = {}

    def _learn(self, chars: set[str]) -> None:
        for c in chars:
            for plain in ("a", "1", "!"):
                if len(self.pre_tokenizer.pre_tokenize_str(plain + c)) == 1:
                    break
            else:
                plain = " "
            if [m.span() for m in self.pattern.finditer(f"a{c}1{c}!{c} ")] != [
                    m.span() for m in self.pattern.finditer(f"a{plain}1{plain}!{plain} ")]:
                self.shadow[ord(c)] = plain
        self.known |= chars

    def spans(self, text: str) -> Iterator[str]:
        """The words one by one, for texts whose list of words would be long."""
        seen = self._seen(text)
        return (text[m.start():m.end()] for m in self.pattern.finditer(seen))

    def words(self, text: str) -> list[str]:
        return self.pattern.findall(text) if self._seen(text) is text else list(self.spans(text))

    def _seen(self, text: str) -> str:
        if text.isascii():
            return text
        new = set(text) - self.known
        if new:
            self._learn({c for c in new if not c.isascii()})
        seen = text.translate(self.shadow) if self.shadow else text
        return text if seen == text else seen


class SpeculativeBpe:
    """Encoder and decoder of one byte-level tokenizer file of the tokenizers library."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        self.splitter = Splitter(Tokenizer.from_file(path).pre_tokenizer)
        self.words: dict[str, bytes] = {}
        self.remembered, self.merged_words = remembered, 0

        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens with rules of their own")
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = t
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.byte_ids = np.array([vocab[bytes([b])] for b in range(256)], np.int32)

        # merges: rank and result by pair of ids; of each token the rank of its merge and its two parts
        self.size, self.merges = size, {}
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for r, pair in enumerate(model["merges"]):
            a, b = (vocab[bytes(byte_of[c] for c in t)] for t in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = vocab[self.bytes_of[a] + self.bytes_of[b]]
            if self.rank[whole] >= 0 or max(self.rank[a], self.rank[b]) >= r:
                raise ValueError(f"{path}: merge {r} repeats a token or comes before its parts")
            self.merges[a, b] = (r, whole)
            self.rank[whole], self.left[whole], self.right[whole] = r, a, b
        self.whole = np.array([whole for _, whole in self.merges.values()], np.int64)
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self._trie(vocab)

    def _trie(self, vocab: dict[bytes, int]) -> None:
        """Nodes in arrays: edges as sorted ``node * 256 + byte`` with their child, and the token that ends at a node.

        Tokens that no merge makes are left out, so a proposal holds only tokens that merging can reach.
        """
        edges, token = {}, [-1]
        for t, i in vocab.items():
            if len(t) > 1 and self.rank[i] < 0:
                continue
            node = 0
            for b in t:
                key = node * 256 + b
                node = edges.get(key, -1)
                if node < 0:
                    node = edges[key] = len(token)
                    token.append(-1)
            token[node] = i
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.token_at = np.array(token, np.int64)

    def longest(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token and length of the longest entry at every byte; ``ends`` is the end of each byte's word."""
        at = np.arange(len(text))
        tokens, lengths = self.byte_ids[text].astype(np.int64), np.ones(len(text), np.int64)
        node, depth = np.zeros(len(text), np.int64), 0
        while len(at):
            key = node * 256 + text[at + depth]
            i = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            found = self.edge_keys[i] == key
            at, node, depth = at[found], self.edge_to[i[found]], depth + 1
            token = self.token_at[node]
            ending = token >= 0
            tokens[at[ending]], lengths[at[ending]] = token[ending], depth
            going = at + depth < ends[at]
            at, node = at[going], node[going]
        return tokens, lengths

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the border of each adjacent pair stands.

        The walk goes back in rank order: of the two that stand at the border the younger is taken apart.
        """
        stands = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_until, y_until = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            r = self.pair_rank(x, y)
            # of equal merges in a row the left one comes first: it saves its own right part, not the left part of b
            falls = (r < NEVER) & (r < x_until) & (r <= y_until)
            stands[at[falls]] = False
            left_younger = self.rank[x] > self.rank[y]
            born = np.maximum(self.rank[x], self.rank[y])
            on = ~falls & (born >= 0)  # two single bytes: nothing is left to take apart
            x_until, y_until = np.where(left_younger, born, x_until), np.where(left_younger, y_until, born)
            x, y = np.where(left_younger, self.right[x], x), np.where(left_younger, y, self.left[y])
            at, x, y, x_until, y_until = at[on], x[on], y[on], x_until[on], y_until[on]
        return stands

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``NEVER`` where there is none."""
        if not len(self.pair_keys):
            return np.full(len(a), NEVER)
        key = a.astype(np.int64) * self.size + b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i], NEVER)

    def merge_exactly(self, words: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(place, ids) of every word, merged by ascending rank, all words side by side.

        In each round every word merges its pair of least rank wherever it occurs, from the left: pairs that this
        makes hold the new token and so have greater ranks.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        of = np.repeat(np.arange(len(words)), lengths)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        rank = np.full(len(ids), NEVER)
        rank[:-1] = np.where(of[1:] == of[:-1], self.pair_rank(ids[:-1], ids[1:]), NEVER)
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            size = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            ended = least == NEVER
            if ended.any():
                out = np.repeat(ended, size)
                flat, cut = ids[out].astype("<u4").tobytes(), np.append(0, 4 * np.cumsum(size[ended])).tolist()
                yield from zip(of[first[ended]].tolist(), (flat[i:j] for i, j in zip(cut, cut[1:])))
                ids, of, rank, least, size = ids[~out], of[~out], rank[~out], least[~ended], size[~ended]
                if not len(ids):
                    return
            place = np.arange(len(ids))
            hit = rank == np.repeat(least, size)
            opens = hit & ~np.concatenate([[False], hit[:-1]])
            hit &= (place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0  # of a run of equal tokens every second pair
            at = np.flatnonzero(hit)
            ids[at] = self.whole[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            ids, of, rank = ids[keep], of[keep], rank[keep]
            beside = np.zeros(len(ids), bool)
            beside[moved], beside[np.maximum(moved - 1, 0)] = True, True
            changed = np.flatnonzero(beside)
            after = np.minimum(changed + 1, len(ids) - 1)
            rank[changed] = np.where((changed < after) & (of[changed] == of[after]), self.pair_rank(ids[changed], ids[after]), NEVER)

    def merge_long(self, word: bytes) -> bytes:
        """The same for one long word: a heap holds its pairs by rank and place."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        waiting = [(self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(waiting)
        while waiting:
            r, i = heapq.heappop(waiting)
            j = after[i]
            found = self.merges.get((ids[i], ids[j])) if ids[i] >= 0 and j < len(ids) else None
            if found is None or found[0] != r:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j], after[i] = found[1], -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids):
                    made = self.merges.get((ids[k], ids[after[k]]))
                    if made:
                        heapq.heappush(waiting, (made[0], k))
        return np.array([t for t in ids if t >= 0], "<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes: speculate, verify, merge what fails."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(w) for w in raw], np.int64)
        stops = np.cumsum(lengths)
        text = np.frombuffer(b"".join(raw), np.uint8)
        if not words:
            return []
        tokens, steps = self.longest(text, np.repeat(stops, lengths))
        step, heads, at = steps.tolist(), [], 0
        while at < len(step):
            heads.append(at)
            at += step[at]
        heads = np.array(heads, np.int64)
        proposed, of = tokens[heads], np.searchsorted(stops, heads, "right")
        inside = np.flatnonzero(of[1:] == of[:-1])
        failing = set(of[inside[~self.compatible(proposed[inside], proposed[inside + 1])]].tolist())
        flat = proposed.astype("<u4").tobytes()
        cut = [0, *(4 * np.searchsorted(of, np.arange(len(words)), "right")).tolist()]
        out = [flat[a:b] for a, b in zip(cut, cut[1:])]
        at_once = [w for w in failing if lengths[w] <= MERGED_AT_ONCE]
        for i, ids in self.merge_exactly([raw[w] for w in at_once]):
            out[at_once[i]] = ids
        for w in failing.difference(at_once):
            out[w] = self.merge_long(raw[w])
        self.merged_words += len(failing)
        return out

    def _look_up(self, words: set[str]) -> dict[str, bytes]:
        """Ids of all these words; the short ones are remembered."""
        new = [w for w in words if w not in self.words]
        if not new:
            return self.words
        if len(self.words) + len(new) > self.remembered:
            self.words, new = {}, list(words)
        found = dict(zip(new, self.encode_words(new)))
        short = {w: ids for w, ids in found.items() if len(w) <= LONGEST}
        self.words.update(short)
        return self.words if len(short) == len(found) else {w: found.get(w) or self.words[w] for w in words}

    def _plain(self, text: str) -> Iterator[bytes]:
        words = self.splitter.spans(text)
        while block := list(islice(words, BLOCK_WORDS)):
            yield b"".join(map(self._look_up(set(block)).__getitem__, block))

    def _with_specials(self, text: str) -> Iterator[bytes]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._plain(text[at:m.start()])
            yield np.array([self.added[m.group()]], "<u4").tobytes()
            at = m.end()
        yield from self._plain(text[at:])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; new words of all texts are encoded together."""
        whole = [bool(t) and (len(t) > LONG_TEXT or self.special is not None and self.special.search(t) is not None) for t in texts]
        words = [self.splitter.words(t) if t and not w else [] for t, w in zip(texts, whole)]
        ids = self._look_up(set().union(*words)).__getitem__
        out = [b"".join(map(ids, each)) for each in words]
        return [b"".join(self._with_specials(t)) if w else o for t, w, o in zip(texts, whole, out)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes | None) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
        table_of, size = self.bytes_of, self.size
        numbers = np.frombuffer(ids or b"", "<u4")
        if len(numbers) and int(numbers.max()) >= size:
            numbers = numbers[numbers < size]
        return b"".join([table_of[i] for i in numbers.tolist()]).decode("utf-8", "replace")


def coder(path: str) -> SpeculativeBpe:
    """The coder of this Python worker; it outlives a task."""
    return held_by_worker(NAME, path, lambda: SpeculativeBpe(path))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ids are little-endian unsigned 32-bit integers."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for part in byte_slices(batches, 1, owner=NAME):
            ids = bpe.encode_all(part.column(1).to_pylist())
            n = pa.array([len(b) // 4 for b in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def decode_ids(tokens: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Rows of ``encode_texts`` (or a token file) with ``text``, read back from the ids alone."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for part in byte_slices(batches, 2, owner=NAME):
            texts = pa.array([bpe.decode(b) for b in part.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["doc_id", "n_tokens", "ids", "text"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = decode_ids(encode_texts(table(spark, sf_dir, "documents")))
    return read_back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                            F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


SQL = None
