"""Main-text extraction from HTML by maximum-scoring subsequence.

A page is read as a sequence of words and tags.  Words score positive and tags
negative; the contiguous stretch with the greatest sum, found in one linear scan,
is the content region.  A word's score depends on where it stands (the elements around
it, whether it is a link); weights are log odds counted on labelled pages.  Labels come
from pages whose own markup names the main text with exactly one ``article`` or ``main``
element; the words inside it, outside the parts below, are content and all others are
not (of left-out parts only links count, by which unmarked menus are told).  The weights are fitted on about ``FIT_PAGES`` such pages chosen by a hash of the page id and
apply to all pages, marked up or not.

Inside the region, parts that are never main text are left out: menus, page headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, told by
element, ``role``, ``class`` and ``id``.  They never reach the output, so their words and tags, and the
tags that open and close them, do not score: a long box inside an article does not
cut it, and a list or table of the article is not judged by the lists of menus.

Character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by a newline in page order; empty blocks are dropped.

Nulls: a null page is empty and gives an empty text; a null id or url is kept.  Cut-off
pages are read up to the cut; a tag, comment or script that is never closed ends the page.
Repeated pages each get a row; empty input gives no rows; very long pages are read whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

NAME = "op3_html_main_text"
#: Labelled pages that the weights are counted on, about.
FIT_PAGES = 2_000

# Element names of HTML and words by which page parts are commonly named.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody
    td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas audio video math".split())
NEVER = frozenset("nav footer aside form head button select textarea menu dialog".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
PARTS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
    cookies disqus footer menu modal nav navbar navigation newsletter notice popup promo promotion related replies sidebar social
    share sharing sponsor sponsored subscribe toolbar widget""".split())
CONTENT = frozenset(("article", "main"))
ABSENT = ("no-", "has-", "with-", "without-")
#: Words outside links that a wrapper of a whole page holds at least.
WRAPPER_WORDS = 25

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)|[^<]+|<",
                    re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME_PARTS = re.compile(r"[^a-z0-9]+")


class Segment:
    """A tag, or a run of text in one place."""

    __slots__ = ("tag", "text", "words", "place", "out", "content", "breaks")

    def __init__(self, tag, text, place, out, content, breaks):
        self.tag, self.text, self.place, self.out, self.content, self.breaks = tag, text, place, out, content, breaks
        self.words = len(text.split()) if text else 0


def _attributes(rest: str) -> tuple[list[str], str]:
    """Words of the class names and the id, and the role.  ``no-sidebar`` and the like speak of a page, not of a part."""
    names, role = [], ""
    for name, value in _ATTRIBUTE.findall(rest):
        value = value.strip("\"'").lower()
        if name.lower() == "role":
            role = value
        else:
            for each in value.split():
                if not each.startswith(ABSENT):
                    names += _NAME_PARTS.split(each)
    return names, role


class _Open:
    """An open element, with what holds for all inside it."""

    __slots__ = ("name", "label", "block", "out", "link", "content", "paragraph", "marked")

    def __init__(self, name: str, label: str, out: bool, within: "_Open | None", marked: int | None):
        self.name, self.label, self.marked = name, label, marked
        self.block = label if name in BLOCKS else within.block if within else ""
        self.out = out or bool(within and within.out)
        self.link = name == "a" or bool(within and within.link)
        self.content = name in CONTENT or bool(within and within.content)
        self.paragraph = name == "p" or bool(within and within.paragraph)


def segments(page: str) -> list[Segment]:
    """The page's tags and texts in order, each with the place it stands in.

    A form, or a part that only its class or id marks, is a wrapper if it holds all the page's words and not only links: the page is
    read once more without that mark."""
    kept: set[int] = set()
    while True:
        out, words, plain = _segments(page, kept)
        every = sum(x.words for x in out)
        whole = [k for k, n in words.items() if n * 100 >= 99 * every and plain[k] >= WRAPPER_WORDS]
        if not whole:
            return out
        kept.add(min(whole))


def _segments(page: str, kept: set[int]) -> tuple[list[Segment], Counter, Counter]:
    """The segments, and per left-out part that may be a wrapper, by its number in the page, the words inside it and those outside
    links; ``kept`` ones are not left out."""
    out: list[Segment] = []
    stack: list[_Open] = []
    opened, words, plain, count = Counter(), Counter(), Counter(), 0
    position, size = 0, len(page)

    def close(to: int) -> None:
        for x in stack[to:]:
            opened[x.name] -= 1
        del stack[to:]

    while position < size:
        m = _PIECE.match(page, position)
        position = m.end()
        piece, name = m.group(), m.group(2)
        top = stack[-1] if stack else None
        if name is None:
            if piece.startswith("<") and len(piece) > 1:
                continue  # comment, doctype
            text = html.unescape(piece)
            if text:
                place = (top.label if top else "", top.block if top else "", bool(top and top.link))
                out.append(Segment(None, text, place, bool(top and top.out), bool(top and top.content), False))
                if top and top.marked is not None:
                    words[top.marked] += out[-1].words
                    plain[top.marked] += 0 if top.link else out[-1].words
            continue
        if not piece.endswith(">"):
            break  # cut off inside a tag
        name = name.lower()
        if m.group(1):  # end tag: closes the nearest open element of its name, and all inside it
            left_out = bool(top and top.out)  # the tag that closes a left-out part is part of it
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name))
            out.append(Segment("/" + name, "", None, left_out, False, name in BLOCKS))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, position)
            closed = m.group(3).rstrip().endswith("/") and name not in ("script", "style")
            if not closed:
                position = end.end() if end else size
            out.append(Segment(name, "", None, True, False, False))
            continue
        names, role = _attributes(m.group(3)) if m.group(3) else ([], "")
        if name in CONTENT:  # main text does not stand inside a menu, footer or advert: those were left open
            while stack and stack[-1].name not in ("html", "body") and stack[-1].out:
                close(len(stack) - 1)
        elif name in BLOCKS:
            while stack and stack[-1].name in ("p", "b", "i", "em", "strong", "span", "u") and stack[-1].paragraph:
                close(len(stack) - 1)  # a block ends an open paragraph
        top = stack[-1] if stack else None
        part = next((x for x in names if x in PARTS), "")
        left_out = name not in CONTENT and name not in ("html", "body") and (
            name in NEVER or role in ROLES or bool(part) or (name == "header" and not (top and top.content)))
        marked = top.marked if top else None
        if left_out:
            left_out = count not in kept
            if left_out and marked is None and not role and (name == "form" or name not in NEVER and name != "header"):
                marked = count
            count += 1
        if name not in VOID:
            label = f"{name}.{part or role}" if part or role else name
            stack.append(_Open(name, label, left_out, top, marked))
            opened[name] += 1
            top = stack[-1]
            out.append(Segment(name, "", None, top.out, False, name in BLOCKS))
        else:
            out.append(Segment(name, "", None, bool(top and top.out), False, name in BLOCKS))
    return out, words, plain


def _is_labelled(page: str) -> bool:
    return sum(len(re.findall(rf"<{x}\b", page, re.I)) for x in CONTENT) == 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: feature, words or tags in the main text, and outside it."""
    inside, outside = Counter(), Counter()
    for batch in slices(batches):
        for page in batch.column(0).to_pylist():
            if not page or not _is_labelled(page):
                continue
            depth = 0
            for s in segments(page):
                if s.tag is not None:
                    depth += (s.tag in CONTENT) - (s.tag[1:] in CONTENT and s.tag[0] == "/")
                if s.tag is None:
                    for f in _features(s.place):
                        if not s.out or s.place[2] and f in LINK:
                            (inside if s.content and not s.out else outside)[f] += s.words
                elif not s.out:
                    (inside if depth > 0 else outside)["<" + s.tag.lstrip("/")] += 1
    keys = list(inside.keys() | outside.keys())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()),
                                      pa.array([outside[k] for k in keys], pa.int64())], names=["feature", "n_in", "n_out"])


#: Counted in left-out parts too: links are what tells a menu that is not marked as one.
LINK = ("element a", "link")


def _features(place) -> list[str]:
    element, block, link = place
    return [f"element {element}", f"block {block}", *["link"] * link]


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", pages_used: int = FIT_PAGES) -> dict[str, float]:
    """Log odds of each feature, from about ``pages_used`` pages."""
    n = pages.count()
    share = math.ceil(min(1.0, pages_used / max(n, 1)) * (1 << 20))
    chosen = pages.filter(F.pmod(F.xxhash64(F.lit("pages"), F.col(id_col)), F.lit(1 << 20)) < share).select(html_col)
    counts = (chosen.mapInArrow(_count, "feature string, n_in long, n_out long").groupBy("feature")
              .agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")).orderBy(F.desc(F.col("n_in") + F.col("n_out")), "feature")
              .limit(10_000).collect())
    # the features of a bounded sample; names seen fewer than 5 times say nothing
    return {r["feature"]: math.log((r["n_in"] + 0.5) / (r["n_out"] + 0.5)) for r in counts if r["n_in"] + r["n_out"] >= 5}


def score(s: Segment, weights: dict[str, float]) -> float:
    """Of a run of words: positive unless their place speaks against them; of a tag: negative; 0 in a left-out part."""
    if s.out:
        return 0.0
    if s.tag is not None:
        return -min(8.0, max(0.1, -weights.get("<" + s.tag.lstrip("/"), 0.0)))
    if not s.words:
        return 0.0
    known = [weights[f] for f in _features(s.place) if f in weights]
    each = max(-4.0, min(2.0, sum(known) / len(known))) if known else 1.0
    return s.words * each


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch with the greatest sum; (0, 0) if none is above 0."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    parts = segments(page)
    start, end = best_region([score(s, weights) for s in parts])
    blocks, block = [], []
    for s in parts[start:end]:
        if s.breaks:
            blocks.append("".join(block))
            block = []
        elif s.tag in ("br", "/br"):
            block.append(" ")
        elif s.tag is None and not s.out:
            block.append(s.text)
    blocks.append("".join(block))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def _extract(weights: dict[str, float]):
    def run(batches):
        for batch in slices(batches):
            texts = [main_text(p, weights) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*batch.schema.names[1:], "text", "n_chars"])
    return run


def extract_main_text(pages: DataFrame, weights: dict[str, float], keep: list[str], html_col: str = "html") -> DataFrame:
    """The ``keep`` columns of every page, its main ``text`` and ``n_chars``."""
    rows = pages.select(F.col(html_col).alias("_html"), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_extract(weights), f"{schema}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_main_text(pages, fit_weights(pages), ["page_id", "url"])


SQL = None
