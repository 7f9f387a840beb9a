"""Toxicity scoring with a lexicon trie searched by Levenshtein automata.

``fit`` learns from labelled rows:

1. the lexicon: words and word stems (a stem stands for every word that begins with
   it) whose use in toxic texts stands out by log-likelihood and by rate,
2. the near misses of lexicon words that ordinary texts use, which are no misspellings,
3. a logistic model over what the lexicon finds in a text.

Searching walks the lexicon trie and the Levenshtein automaton of distance
``EDITS`` together; two swapped letters are one edit.  The product is made deterministic state by
state when a token first needs it, so a token usually dies after two or three characters.  A stem accepts
a token that begins with the stem or, if it is long enough, with a misspelling of it; words that stand out
themselves stay in the lexicon beside their stem, so that their misspellings are found as well.

Every hit is judged in its context window: inside quotation marks, or after a word of
reporting, it counts ``QUOTED`` times its weight (a misspelled one ``MISSPELLED`` times), so texts that quote abuse score below
texts that commit it.

The model is a classifier fitted on a bounded sample: about ``FIT_ROWS`` labelled rows
chosen by a hash of their id.  Scoring covers every row and the whole text.

Nulls: a null text is empty; an empty text scores like any text without hits.  A null id
is in no label and not held out.  Repeated rows each get a row.  Without labels of
both classes the score is the share of toxic labels (0 without labels).  Empty input
gives no rows; extra columns are ignored, or kept by ``reject_toxic``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, is_held_out, slices, stored, table

NAME = "op2_lexicon_toxicity"
#: Labelled rows that the model is fitted on, about.
FIT_ROWS = 12_000
#: Terms that the driver chooses the lexicon from, best first.
CANDIDATES = 5_000
STEMS = range(3, 9)
#: A term must reach this log-likelihood statistic and be so many times as frequent in toxic texts.
MIN_EVIDENCE, MIN_RATIO = 30.0, 4.0
#: Rounds of choosing terms, and the factor of the best evidence that a round goes down to.
ROUNDS, WITHIN = 4, 5.0
EDITS = 1
#: Shorter words and stems are only found as they are written.
FUZZY_LENGTH = 5
#: What a misspelled term, and a quoted one, count of their weight.
MISSPELLED, QUOTED = 0.5, 0.3
#: All hits' weight, the same per 100 tokens, in the densest window, and of the strongest hit.
FEATURES = 4
#: Characters on either side of a hit that are searched for quotation marks or words of reporting.
CONTEXT = 60
#: Tokens of the window whose hits are summed for the densest passage.
WINDOW = 30
THRESHOLD = 0.3

_TOKEN = re.compile(r"[^\W_]+")
_QUOTES = "\"“”„«»‹›"
_REPORTING = re.compile(r"\b(?:quote[sd]?|quoting|said|says|wrote|writes|called (?:me|him|her|us|them)|a dit|sagte|schrieb|dijo|cita)\b[^\n]*$")


@dataclass
class Model:
    """Terms with weights (a stem ends in ``*``), ordinary near misses (of a stem: beginnings, with ``*``), and the logistic model."""

    terms: dict[str, float] = field(default_factory=dict)
    ordinary: frozenset = frozenset()
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    coef: list[float] = field(default_factory=list)
    intercept: float = -math.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.coef:
            return np.full(len(x), 0.0 if self.intercept == -math.inf else 1 / (1 + math.exp(-self.intercept)))
        z = (x - self.mean) / self.scale @ np.array(self.coef) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class LexiconAutomaton:
    """The lexicon trie intersected with Levenshtein automata, made deterministic on demand."""

    def __init__(self, terms, edits: int = EDITS, fuzzy_length: int = FUZZY_LENGTH, swaps: bool = False):
        self.children, self.word, self.stem = [{}], [None], [None]
        for term in terms:
            node = 0
            for ch in term.rstrip("*"):
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                node = self.children[node][ch]
            (self.stem if term.endswith("*") else self.word)[node] = term
        self.edits, self.fuzzy_length, self.swaps = edits, fuzzy_length, swaps
        self.sets, self.ids, self.moves, self.accepts, self.stems = [], {}, [], [], []
        self.start = self._state({(0, "", 0)})

    def _state(self, places) -> int:
        """The number of a set of (trie node, letter a swap still needs, errors); skipping term characters costs an error each."""
        least: dict[tuple[int, str], int] = {}
        todo = list(places)
        while todo:
            node, wait, e = todo.pop()
            if least.get((node, wait), self.edits + 1) <= e:
                continue
            least[node, wait] = e
            if e < self.edits and not wait:
                todo += [(c, "", e + 1) for c in self.children[node].values()]
        key = frozenset((node, wait, e) for (node, wait), e in least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.accepts.append(self._accepted(key, self.word))
            self.stems.append(self._accepted(key, self.stem))
        return self.ids[key]

    def _accepted(self, key, terms) -> tuple[int, str] | None:
        found = [(e, terms[n]) for n, wait, e in key
                 if not wait and terms[n] and (e == 0 or len(terms[n].rstrip("*")) >= self.fuzzy_length)]
        return min(found, default=None)

    def _move(self, state: int, ch: str) -> int:
        out = set()
        for node, wait, e in self.sets[state]:
            if wait:
                if wait == ch:
                    out.add((node, "", e))
                continue
            child = self.children[node].get(ch)
            if child is not None:
                out.add((child, "", e))
            if e < self.edits:
                out.add((node, "", e + 1))
                for letter, c in self.children[node].items():
                    out.add((c, "", e + 1))
                    if self.swaps and letter != ch and (after := self.children[c].get(ch)) is not None:
                        out.add((after, letter, e + 1))
        self.moves[state][ch] = to = self._state(out) if out else -1
        return to

    def find(self, token: str) -> tuple[str, int] | None:
        """The term that the token is, or misspells, and the number of edits."""
        found = self.search(token)
        return found and found[:2]

    def search(self, token: str) -> tuple[str, int, str] | None:
        """As ``find``, with what was accepted: the token, or its beginning and ``*`` for a stem."""
        state, best = self.start, None
        for i, ch in enumerate(token):
            to = self.moves[state].get(ch)
            state = self._move(state, ch) if to is None else to
            if state < 0:
                return best
            stem = self.stems[state]
            if stem and stem[0] == 0:
                return stem[1], 0, token[:i + 1] + "*"
            if stem and (best is None or stem[0] <= best[1]):  # the longest beginning of the fewest edits
                best = stem[1], stem[0], token[:i + 1] + "*"
        word = self.accepts[state]
        return (word[1], word[0], token) if word and (best is None or word[0] < best[1]) else best


class Finder:
    """Hits of a model's lexicon in texts; tokens looked up before are remembered, up to a bound."""

    def __init__(self, model: Model, remembered: int = 200_000):
        self.model, self.automaton, self.remembered = model, LexiconAutomaton(model.terms, swaps=True), remembered
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[str, int, str]] = {}

    def tokens(self, text: str | None) -> list[str]:
        tokens = _TOKEN.findall((text or "").lower())
        if len(self.seen) > self.remembered:
            self.seen, self.hits = set(), {}
        new = set(tokens).difference(self.seen)
        for t in new:
            found = self.automaton.search(t)
            if found and not (found[1] and found[2] in self.model.ordinary):
                self.hits[t] = found
        self.seen |= new
        return tokens

    def features(self, text: str | None) -> list[float]:
        tokens = self.tokens(text)
        if not tokens or self.hits.keys().isdisjoint(tokens):
            return [0.0] * FEATURES
        low = text.lower()
        at, weight = [], []
        for i, m in enumerate(_TOKEN.finditer(low)):
            found = self.hits.get(m.group())
            if found:
                at.append(i)
                weight.append(self.model.terms[found[0]] * (MISSPELLED if found[1] else 1.0)
                              * (QUOTED if quoted(low, m.start(), m.end()) else 1.0))
        w = np.array(weight)
        total = np.concatenate([[0.0], np.cumsum(w)])
        densest = (total[np.searchsorted(at, np.array(at) + WINDOW)] - total[:-1]).max()
        return [math.log1p(w.sum()), math.log1p(100 * w.sum() / len(tokens)), math.log1p(densest), float(w.max())]


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit stands in quotation marks, or after a word of reporting, in its context window."""
    before = text[max(0, start - CONTEXT):start].rpartition("\n")[2]
    after = text[end:end + CONTEXT].partition("\n")[0]
    marked = any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES)
    return marked or bool(_REPORTING.search(before))


def _term_counts(model: Model):
    """Per task, of the texts without a hit of the model: term, texts and use in toxic texts, use in clean texts.

    Use is log2(1 + occurrences) per text.
    """
    def flush(found):
        keys = list(found)
        cols = [pa.array(keys)] + [pa.array([found[k][i] for k in keys], pa.float64()) for i in range(3)]
        return pa.RecordBatch.from_arrays(cols, names=["term", "texts", "toxic_use", "clean_use"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, found = Finder(model), {}
        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter(finder.tokens(text))
                if not finder.hits.keys().isdisjoint(words):
                    continue
                use = Counter()
                for word, n in words.items():
                    use[word] += n
                    for k in STEMS:
                        if len(word) < k:
                            break
                        use[word[:k] + "*"] += n
                for term, n in use.items():
                    row = found.setdefault(term, [0.0, 0.0, 0.0])
                    row[0] += toxic
                    row[2 - toxic] += math.log2(1 + n)
                if len(found) > 150_000:
                    yield flush(found)
                    found = {}
        if found:
            yield flush(found)

    return run


def _choose(rows, toxic: int, clean: int) -> dict[str, float]:
    """Terms that overlap no better term, with log rate ratios as weights."""
    chosen: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (-round(r["evidence"], 6), -len(r["term"].rstrip("*")), r["term"].endswith("*"), r["term"])):
        body = r["term"].rstrip("*")
        if not any(body.startswith(c.rstrip("*")) and (c.endswith("*") or c == body) or c.startswith(body) and r["term"].endswith("*")
                   for c in chosen):
            chosen[r["term"]] = math.log((r["toxic_use"] / toxic) / ((r["clean_use"] + 0.5) / clean))
    return chosen


def _stem_words(rows, chosen: dict[str, float]) -> dict[str, float]:
    """The words among ``rows`` that a chosen stem stands for, with its weight: what can be misspelled.

    As they are written the stem finds them.
    """
    stems = {c[:-1]: w for c, w in chosen.items() if c.endswith("*")}
    words = {}
    for r in rows:
        word = r["term"]
        stem = next((word[:k] for k in STEMS if word[:k] in stems), None)
        if stem and not word.endswith("*") and len(word) >= FUZZY_LENGTH:
            words[word] = stems[stem]
    return words


def learn_lexicon(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Choose terms in rounds: each looks at the texts that no term chosen before is in.

    A round takes the terms within a factor of the best one's evidence, so words that merely stand in
    the same texts as strong terms, as in copies of one toxic text, are not taken.
    """
    model = Model()
    for _ in range(ROUNDS):
        counts = (sample.select("text", "toxic").mapInArrow(_term_counts(model), "term string, texts double, toxic_use double, clean_use double")
                  .groupBy("term").agg(*[F.sum(c).alias(c) for c in ("texts", "toxic_use", "clean_use")]))
        a, b = F.col("toxic_use"), F.col("clean_use")
        share = toxic / (toxic + clean)
        evidence = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
        ratio = (a / toxic) / ((b + 0.5) / clean)
        kept = (counts.filter((F.col("texts") >= 3) & (ratio >= MIN_RATIO)).withColumn("evidence", evidence)
                .filter(F.col("evidence") >= MIN_EVIDENCE).orderBy(F.desc("evidence"), "term").limit(CANDIDATES)).collect()
        if not kept:
            break
        best = max(r["evidence"] for r in kept)
        found = _choose([r for r in kept if r["evidence"] >= best / WITHIN], toxic, clean)
        model = Model(terms={**_stem_words(kept, found), **found, **model.terms})
    return model.terms


def _near_misses(model: Model):
    def run(batches):
        finder = Finder(model)
        for batch in slices(batches):
            out = [(t, toxic) for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                   for t in {finder.hits[t][2] for t in set(finder.tokens(text)) if finder.hits.get(t, ("", 0))[1]}]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([x for _, x in out], pa.int32())],
                                             names=["token", "toxic"])
    return run


def _features(model: Model):
    def run(batches):
        finder = Finder(model)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([finder.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)],
                names=["x", "toxic"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50):
    """Coefficients and intercept by Newton steps with a ridge penalty."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T * (p * (1 - p)) @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn from labelled rows that are not held out; ``labels`` has (doc_id, toxic)."""
    marks = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id"))
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    known = marks.count()
    if not known:
        return Model()
    # the share of ids that gives about `rows` rows, by a hash of the id
    u = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1 << 20))
    part = u < math.ceil(min(1.0, rows / known) * (1 << 20))
    chosen = docs.select("doc_id", "text").filter(part & ~is_held_out("doc_id"))
    sample = stored(chosen.join(marks.filter(part), "doc_id").select("doc_id", "text", "toxic"), "toxicity-sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model(intercept=math.inf if toxic else -math.inf) if toxic + clean else Model()
    model = Model(terms=learn_lexicon(sample, toxic, clean), intercept=math.log(toxic / clean))
    if not model.terms:
        return model
    near = (sample.select("text", "toxic").mapInArrow(_near_misses(model), "token string, toxic int").groupBy("token")
            .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")))
    usual = (F.col("clean") + 0.5) * toxic * 5 > F.col("toxic") * clean
    # near misses are at most (alphabet x length) tokens per lexicon word, and beginnings per stem
    model.ordinary = frozenset(r["token"] for r in near.filter((F.col("clean") > 0) & usual).collect())
    data = sample.select("text", "toxic").mapInArrow(_features(model), "x array<double>, toxic int").collect()
    x, y = np.array([r["x"] for r in data]), np.array([r["toxic"] for r in data], float)
    model.mean, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-6).tolist()
    model.coef, model.intercept = _logistic((x - model.mean) / model.scale, y)
    return model


def _score(model: Model, names: list[str], name: str):
    def run(batches):
        finder = Finder(model)
        for batch in slices(batches):
            x = np.array([finder.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.score(x))], names=[*names, name])
    return run


def score_texts(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The ``keep`` columns of every row and its score as column ``name``."""
    rows = docs.select(F.col(text_col).alias(free_name(docs, "_text")), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_score(model, keep, name), f"{schema}, `{name}` double")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns."""
    name = free_name(docs, "_toxicity")
    scored = score_texts(docs, fit(docs, labels), docs.columns, name=name)
    return scored.filter(F.col(name) < THRESHOLD).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return (score_texts(docs, model, ["doc_id"])
            .select("doc_id", is_held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


SQL = None
