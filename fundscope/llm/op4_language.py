"""Language identification by segmentation-marginalised unigrams.

Each language has a unigram model over the pieces of one fixed public vocabulary.  The
probability of a word is the sum, over all ways of cutting it into pieces, of the
product of piece probabilities; a forward pass adds them up without listing them.  A text is
scored by the sum of its words' log probabilities; the score is the posterior of the best
language.

Piece probabilities are expected counts: every training word's segmentations are
weighted by a flat model (a forward and a backward pass), and the counts of all tasks
are added up.  All training texts are read; what is gathered is one count per piece
and language and task.

Both passes run over many words at once, character by character, on arrays; words that a
task met before are remembered up to a bound.

Nulls: a null language is not learned; a null text, or one without a letter, is ``und``
with score 0.  A null id is not held out.  Without training rows everything is ``und``
with score 0.  Repeated rows each get a row; empty input gives none; extra columns are
ignored.  Very long texts and words are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_held_out, slices, table

NAME = "op4_piece_language_id"
VOCABULARY = "piece_bpe_32k.model"
#: Pieces of the vocabulary of up to so many characters, the word start included.
PIECE_CHARS = 4
#: Added to every expected count.
SMOOTHING = 0.5
#: Probability of a character that no piece holds.
UNKNOWN = 1e-7
START = "▁"
UNDETERMINED = "und"
#: Words a task remembers before it starts afresh.
REMEMBERED = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


class Pieces:
    """The vocabulary's lower-case letter pieces, as numbers found by arrays of characters."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        found = set()
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if 0 < len(piece) <= PIECE_CHARS and piece == piece.lower() and piece.replace(START, "a").isalpha():
                found.add(piece)
        letters = sorted({ch for p in found for ch in p} | {START})
        self.pieces = sorted(found | set(letters))
        self.char = {ch: i + 1 for i, ch in enumerate(letters)}
        self.base = len(letters) + 1
        keys = np.array([self._key([self.char[ch] for ch in p]) for p in self.pieces], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def _key(self, codes) -> int:
        key = 0
        for c in codes:
            key = key * self.base + c
        return key

    def __len__(self) -> int:
        return len(self.pieces)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Character codes, one row per word (0 where unknown or past the end), and lengths."""
        size = np.array([len(w) + 1 for w in words])
        codes = np.zeros((len(words), size.max()), np.int64)
        get, start = self.char.get, self.char[START]
        flat = np.array([c for w in words for c in (start, *[get(ch, 0) for ch in w])], np.int64)
        codes[np.arange(codes.shape[1]) < size[:, None]] = flat
        return codes, size

    def ending(self, codes: np.ndarray, at: int) -> list[np.ndarray]:
        """Numbers of the pieces of 1, 2, ... characters that end before ``at``; -1: no such piece."""
        out, key, factor, known = [], np.zeros(len(codes), np.int64), 1, np.ones(len(codes), bool)
        for k in range(1, min(PIECE_CHARS, at) + 1):
            c = codes[:, at - k]
            key = key + c * factor
            factor *= self.base
            known = known & (c > 0)
            place = np.searchsorted(self.keys, key)
            place[place == len(self.keys)] = 0
            out.append(np.where(known & (self.keys[place] == key), self.order[place], -1))
        return out


def _by_length(words: list[str], most: int) -> Iterator[list[str]]:
    """Words of like length together, so many characters at a time."""
    words = sorted(words, key=len)
    at = 0
    while at < len(words):
        n = max(1, most // (len(words[min(at + 10_000, len(words) - 1)]) + 1))
        yield words[at:at + min(n, 10_000)]
        at += min(n, 10_000)


def word_scores(pieces: Pieces, logp: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word under each language: the forward pass over all segmentations."""
    prob = np.vstack([np.exp(logp), np.zeros(logp.shape[1])])  # the last row: no such piece
    out: dict[str, np.ndarray] = {}
    for part in _by_length(words, 2_000_000 // max(1, logp.shape[1])):
        codes, size = pieces.encode(part)
        n, langs = len(part), logp.shape[1]
        done, scale = np.zeros((n, langs)), np.zeros(n)
        before = [np.ones((n, langs))]  # the sums at the last PIECE_CHARS positions, newest first
        for at in range(1, codes.shape[1] + 1):
            ids = pieces.ending(codes, at)
            now = sum(before[k] * prob[piece] for k, piece in enumerate(ids))
            now = np.where((codes[:, at - 1] == 0)[:, None], now + before[0] * UNKNOWN, now)
            before = [now, *before[:PIECE_CHARS - 1]]
            if at % 8 == 0:  # keep the sums of long words in range
                top = np.max([b.max(1) for b in before], 0)
                top[top <= 0] = 1.0
                before = [b / top[:, None] for b in before]
                scale += np.log(top)
            ended = size == at
            if ended.any():
                done[ended] = np.log(np.maximum(before[0][ended], 1e-300)) + scale[ended, None]
        out.update(zip(part, done))
    return np.array([out[w] for w in words]).reshape(len(words), logp.shape[1])


def expected_counts(pieces: Pieces, words: list[str], times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (rows) per language, for words that occur ``times`` (word x language)."""
    total = np.zeros((len(pieces) + 1, times.shape[1]))
    where = {w: i for i, w in enumerate(words)}
    # every piece has the same probability; sums are scaled by its PIECE_CHARS-th root per character, so that
    # long words stay in range: what a piece of k + 1 characters multiplies is then
    step = [(1.0 / len(pieces)) ** (1 - (k + 1) / PIECE_CHARS) for k in range(PIECE_CHARS)]
    for part in _by_length(words, 1_000_000):
        codes, size = pieces.encode(part)
        weight = times[[where[w] for w in part]]
        length = codes.shape[1]
        ids = [pieces.ending(codes, at) for at in range(1, length + 1)]
        forward = [np.ones(len(part))]
        for at in range(1, length + 1):
            f = sum((p >= 0) * forward[at - 1 - k] * step[k] for k, p in enumerate(ids[at - 1]))
            forward.append(np.where(codes[:, at - 1] == 0, f + forward[at - 1] * UNKNOWN, f))
        back = [None] * (length + 1)
        for at in range(length, -1, -1):
            b = (size == at).astype(float)
            for k in range(PIECE_CHARS):
                if at + k < length:
                    b = b + (ids[at + k][k] >= 0 if k < len(ids[at + k]) else 0) * back[at + k + 1] * step[k]
            if at < length:
                b = np.where(codes[:, at] == 0, b + back[at + 1] * UNKNOWN, b)
            back[at] = b
        norm = np.maximum(back[0], 1e-300)
        for at in range(1, length + 1):
            for k, p in enumerate(ids[at - 1]):
                use = (p >= 0) * forward[at - 1 - k] * back[at] * step[k] / norm
                for lang in range(times.shape[1]):
                    total[:, lang] += np.bincount(np.where(p >= 0, p, len(pieces)), use * weight[:, lang], len(pieces) + 1)
    return total[:-1]


def _gather(path: str, langs: list[str]):
    number = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total, seen = Pieces(path), None, [Counter() for _ in langs]

        def add(total):
            words = list(set().union(*seen))
            if words:
                times = np.array([[c[w] for c in seen] for w in words], float)
                got = expected_counts(pieces, words, times)
                total = got if total is None else total + got
            for c in seen:
                c.clear()
            return total

        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[number[lang]].update(_WORD.findall(text.lower()))
                if sum(map(len, seen)) > REMEMBERED // 2:
                    total = add(total)
        total = add(total)
        if total is not None:
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)),
                                              pa.array(total[piece, lang])], names=["piece", "lang", "n"])
    return run


@dataclass
class Model:
    path: str
    langs: list[str]
    logp: np.ndarray | None


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", path: str | None = None) -> Model:
    """Piece log probabilities per language, from all rows that have a text and a language."""
    path = path or vocabulary_path()
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
    langs = sorted(r[0] for r in rows.select(lang_col).distinct().collect())
    if not langs:
        return Model(path, [], None)
    n = np.full((len(Pieces(path)), len(langs)), SMOOTHING)
    # at most one row per piece of the vocabulary and language
    for r in (rows.mapInArrow(_gather(path, langs), "piece int, lang int, n double").groupBy("piece", "lang")
              .agg(F.sum("n").alias("n")).collect()):
        n[r["piece"], r["lang"]] += r["n"]
    return Model(path, langs, np.log(n / n.sum(0)))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs = Pieces(model.path), model.langs
        index: dict[str, int] = {}
        scores = np.zeros((0, len(langs)))
        for batch in slices(batches):
            words = [_WORD.findall((t or "").lower()) for t in batch.column(1).to_pylist()]
            if len(index) > REMEMBERED:
                index, scores = {}, np.zeros((0, len(langs)))
            new = list(dict.fromkeys(w for ws in words for w in ws if w not in index))
            if new and langs:
                index.update(zip(new, range(len(index), len(index) + len(new))))
                scores = np.vstack([scores, word_scores(pieces, model.logp, new)])
            preds, probs = [], []
            for ws in words:
                if not langs or not any(ch.isalpha() for w in ws for ch in w):
                    preds.append(UNDETERMINED)
                    probs.append(0.0)
                    continue
                z = scores[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(0)
                p = np.exp(z - z.max())
                best = int(z.argmax())
                preds.append(langs[best])
                probs.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(probs, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~is_held_out("doc_id")))
    return predict(docs, model).select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


SQL = None
