"""Training-data operators against brute force, round trips and edge cases."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest

from fundscope.llm import (op1_ngram_join as op1, op2_toxicity as op2, op3_html as op3, op4_language as op4, op5_spotsigs as op5,
                           op6_mixing as op6, op7_decontaminate as op7, op8_chat as op8, op9_token_files as op9,
                           op10_sharding as op10, registry)
from fundscope.llm.common import is_held_out
from fundscope.llm.components import components

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or [f"s{i % 3}" for i in range(len(texts))])[i], None)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def written(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def near_texts(seed=3, bases=18):
    rng, out = random.Random(seed), []
    words = [f"w{i}" for i in range(300)]
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 12, 40, 120]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            copy = base[:]
            for _ in range(rng.randrange(1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out + ["", None, "  \t", out[0], out[0].upper()]


def brute_join(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root, links = list(range(len(sets))), [0] * len(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i], links[j] = links[i] + 1, links[j] + 1
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return [(i, len(s), root[i], links[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (2, 60)])
def test_op1_brute_force(spark, words, percent):
    texts = near_texts()
    got = op1.ngram_jaccard_join(docs_of(spark, texts).select("doc_id", "text"), words, percent).collect()
    assert sorted(map(tuple, got)) == brute_join(texts, words, percent)


def test_op1_blocks_give_the_same(spark, monkeypatch):
    texts = near_texts(8)
    monkeypatch.setattr(op1, "CELL_TOKENS", 30)
    got = op1.ngram_jaccard_join(docs_of(spark, texts).select("doc_id", "text"), 3, 80).collect()
    assert sorted(map(tuple, got)) == brute_join(texts, 3, 80)


def test_op1_bound_keeps_cells_shut():
    a, b = (op1.shingles(" ".join(f"{p}{i}" for i in range(50)), 3) for p in "xy")
    assert op1.open_cell([(1, 1, a)], [(2, 1, b)], 90) == []
    assert (2, 1, 0) in op1.open_cell([(1, 1, a)], [(2, 3, a)], 90)


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (33, 31), (50, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 33: 30}


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_op2_automaton_is_levenshtein():
    rng = random.Random(1)
    terms = ["".join(rng.choice("abc") for _ in range(n)) for n in (5, 5, 6, 7)]
    automaton = op2.LexiconAutomaton([*terms, "cab", "bbb*"])
    for _ in range(3000):
        token = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        near = any(brute_edits(token, t) <= 1 for t in terms) or token == "cab" or token.startswith("bbb")
        assert bool(automaton.find(token)) == near, token


def test_op2_misspelled_and_quoted():
    model = op2.Model(terms={"idiot": 5.0}, mean=[0.0] * 4, scale=[1.0] * 4, coef=[1.0] * 4, intercept=-3.0)
    score = lambda t: float(model.score(np.array([op2.Finder(model).features(t)]))[0])
    plain, wrong = score("you are an idiot and more words here"), score("you are an idoit idiott and more words")
    assert score("nothing to see here") < 0.1 < wrong and plain > 0.3
    assert score('he said "you are an idiot" and more words here') < plain
    assert score(None) == score("")


def test_op2_stems_and_swaps():
    stems = op2.LexiconAutomaton(["idiot*", "moro*", "clown"], swaps=True)
    for token in ("idiot", "idiots", "1diot", "1diots", "idoit", "idoits", "iddiotic", "diots", "clwon", "lcown"):
        assert stems.find(token) and stems.find(token)[1] == (not token.startswith("idiot")), token
    for token in ("doit", "idtio", "modo", "mroon", "cwoln", "idea"):
        assert stems.find(token) is None, token
    assert stems.find("morons") == ("moro*", 0)
    rng = random.Random(5)
    for _ in range(2000):
        term, token = ("".join(rng.choice("abc") for _ in range(n)) for n in (5, rng.randrange(3, 8)))
        swapped = {token[:i] + token[i + 1] + token[i] + token[i + 2:] for i in range(len(token) - 1)}
        near = brute_edits(token, term) <= 1 or term in swapped
        assert bool(op2.LexiconAutomaton([term], swaps=True).find(token)) == near, (term, token)
        begins = [token[:k] for k in range(len(token) + 1)]
        near = any(brute_edits(b, term) <= 1 or any(b[:i] + b[i + 1] + b[i] + b[i + 2:] == term for i in range(len(b) - 1)) for b in begins)
        assert bool(op2.LexiconAutomaton([term + "*"], swaps=True).find(token)) == near, (term, token)


def test_op2_misspelled_forms_of_a_stem(spark):
    clean = [f"ordinary words about topic{i} and idiomatic speech" for i in range(300)]
    toxic = [f"what {w} you are number{i}" for i, w in enumerate(["idiot", "idiots", "idiott"] * 40)]
    docs = docs_of(spark, clean + toxic)
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(420)], "doc_id long, toxic int")
    model = op2.fit(docs, labels)
    assert any(t.endswith("*") and "idiot".startswith(t[:-1]) for t in model.terms)
    finder = op2.Finder(model)
    for token in ("idiot", "idiotss", "1diot", "idoit", "iddiot"):
        finder.tokens(token)
        assert token in finder.hits, token
    finder.tokens("idiomatic idiom topic")
    assert not {"idiomatic", "idiom", "topic"} & finder.hits.keys()
    short = [{"term": t, "evidence": e, "toxic_use": 50.0, "clean_use": 0.0} for t, e in (("idi*", 90.0), ("idiot", 80.0), ("idiom*", 70.0))]
    chosen = op2._choose(short, 100, 100)
    assert list(chosen) == ["idi*"] and op2._stem_words(short, chosen) == {"idiot": chosen["idi*"]}


def test_op2_held_out_quality(spark):
    rows = op2.query(spark, "/root/testdata/sf0.1")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = [(r["predicted"], r["toxic"]) for r in rows.filter("held_out").join(marks, "doc_id").collect()]
    hit = sum(p and t for p, t in held)
    assert hit >= 0.9 * sum(t for _, t in held) and hit >= 0.95 * sum(p for p, _ in held)


@pytest.mark.parametrize("toxic", [[], [(0, 1, 1)], [(0, 0, 0), (1, 1, 0), (9, 1, None)]])
def test_op2_few_labels(spark, tmp_path, toxic):
    folder = written(docs_of(spark, ["a b", None, "", "c"]), tmp_path)
    written(spark.createDataFrame(toxic, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert op2.query(spark, folder).count() == 4


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Head</header><nav><a href=x>Menu</a></nav>
<div class="ad">Buy now</div><article><h1>Title &amp; more</h1><p>One  two<br>three</p><p>Four <b>five</b></p>
<form>Mail <input></form><div class="comments"><p>First!</p></div></article><aside>Side</aside><footer>&copy; us</footer></body></html>"""


def test_op3_page():
    assert op3.main_text(PAGE, {}) == "Title & more\nOne two three\nFour five"
    assert op3.main_text(PAGE.replace("article", "div"), {}) == "Title & more\nOne two three\nFour five"
    assert op3.main_text(None, {}) == op3.main_text("", {}) == op3.main_text("<nav>a</nav>", {}) == ""
    assert op3.main_text("<p>open <b>text", {}) == "open text"
    assert op3.main_text('<p>a</p><script>var t="</p>x', {}) == "a"


def test_op3_long_inner_box_and_list(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    menu = "<nav><ul>" + "".join(f"<li><a href=x>menu{i}</a></li>" for i in range(20)) + "</ul></nav>"
    pages = [f"<html><body>{menu}<article><p>{words('text', 40)}</p></article><footer>us</footer></body></html>"] * 30
    weights = op3.fit_weights(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))
    items = "".join(f"<li>item{i}</li>" for i in range(12))
    for box in ("<div class='ad'>{}</div>", "<aside><p>{}</p></aside>", "<div class='notice'><p>{}</p></div>",
                "<form>{}</form>", "<div class='comments'><ul><li>{}</li></ul></div>"):
        page = (f"<html><body>{menu}<div><p>{words('first', 30)}</p>{box.format(words('box', 100))}<ul>{items}</ul>"
                f"<p>{words('last', 300)}</p></div><footer>us</footer></body></html>")
        for known in (weights, {}):
            got = op3.main_text(page, known).split()
            assert got == [*words("first", 30).split(), *(f"item{i}" for i in range(12)), *words("last", 300).split()], box
    unmarked = "<div>" + "".join(f"<a href=x>menu{i}</a>" for i in range(20)) + "</div>"
    page = f"<html><body>{unmarked}<div><p>{words('first', 30)} <a href=x>a link</a> {words('last', 30)}</p></div></body></html>"
    assert op3.main_text(page, weights).split() == [*words("first", 30).split(), "a", "link", *words("last", 30).split()]


def test_op3_best_region_is_the_maximum():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.randrange(-5, 5) for _ in range(rng.randrange(12))]
        a, b = op3.best_region(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1))])


def test_op3_query(spark, tmp_path):
    folder = written(spark.createDataFrame([(1, "u", PAGE), (2, None, None), (1, "u", PAGE), (3, "v", "plain words")],
                                           "page_id long, url string, html string"), tmp_path, "pages")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in op3.query(spark, folder).collect())
    assert got[2:] == [(2, "", 0), (3, "plain words", 11)] and got[0] == got[1]


def test_op4_sums_all_segmentations():
    pieces = op4.Pieces(op4.vocabulary_path())
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 3).T)
    number = {p: i for i, p in enumerate(pieces.pieces)}

    def total(rest):  # every way of cutting, one by one
        if not rest:
            return np.ones(3)
        out = total(rest[1:]) * op4.UNKNOWN if rest[0] not in pieces.char else np.zeros(3)
        for k in range(1, op4.PIECE_CHARS + 1):
            if rest[:k] in number and len(rest) >= k:
                out = out + np.exp(logp[number[rest[:k]]]) * total(rest[k:])
        return out

    words = ["the", "schön", "x", "a☃b", "nations"]
    assert np.allclose(op4.word_scores(pieces, logp, words), [np.log(total(op4.START + w)) for w in words])
    assert np.isfinite(op4.word_scores(pieces, logp, ["z" * 5000])).all()
    counts = op4.expected_counts(pieces, words + ["q" * 400], np.ones((6, 1)))
    assert np.isfinite(counts).all() and counts.sum() > 6


def test_op4_query(spark, tmp_path):
    rows = {r["doc_id"]: r for r in op4.query(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [i for i, r in rows.items() if r["held_out"]]
    assert len(rows) == len(truth) and sum(rows[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    folder = written(docs_of(spark, ["a text", None, "12 !", ""], ["en", "en", None, "de"]), tmp_path)
    got = {r["doc_id"]: r["lang_pred"] for r in op4.query(spark, folder).collect()}
    assert got[1] == got[2] == got[3] == "und"


def test_op5_edited_and_next(spark, tmp_path):
    texts = ["the cat sat on the mat and the dog ran to a big house", "élan of the naïve man in the old town with a blue hat", "", "one two",
             "the cat sat on the mat and the dog ran to a big house", "🙂🙂🙂🙂 the end of all good things"]
    rows = {r["doc_id"]: r for r in op5.query(spark, written(docs_of(spark, texts), tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        after = texts[i - 1]  # descending ids; the first one's next is the last
        k = len(t) // 3
        edited = t[:len(t) - k] + after[:k]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        f = lambda s: {s[j:j + 8] for j in range(0, len(s), 8)}
        a, b = f(rows[i]["fingerprint"]), f(rows[i]["edited_fingerprint"])
        assert rows[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert rows[0]["fingerprint"] == rows[4]["fingerprint"] != ""


def test_op5_buckets_agree(spark, tmp_path, monkeypatch):
    folder = written(docs_of(spark, [f"the word{i} of text{i} in line{i}" for i in range(60)]), tmp_path)
    one = sorted(map(tuple, op5.query(spark, folder).collect()))
    monkeypatch.setattr(op5, "BUCKET_ROWS", 5)
    assert sorted(map(tuple, op5.query(spark, folder).collect())) == one


def test_op5_near_duplicates(spark):
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(60), rng.randrange(1, 25))) for _ in range(60)]
    sets += [s[:-1] for s in sets if len(s) > 5]
    got = {(r["a"], r["b"]) for r in op5.near_duplicates(spark.createDataFrame(list(enumerate(sets)), "id long, s array<long>"), "id", "s", 0.7).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    one = sorted((i, set(s)) for s, i in first.items())
    assert got == {(i, j) for i, a in one for j, b in one if i < j and len(a & b) / len(a | b) >= 0.7}


def test_op6_targets(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 500), (None, 90), ("zero", 0)]
    got = {r["source"]: r["target"] for r in op6.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight = {"a": 3, "b": 1, "c": 2, "zero": 3, None: 1}
    left, names, want = 1.5 * 1600, dict(sizes), {}
    while True:
        open_ = {s: left * weight[s] / sum(weight[x] for x in names if x not in want) for s in names if s not in want}
        over = [s for s, t in open_.items() if t > 2 * names[s]]
        if not over:
            want |= open_
            break
        for s in over:
            want[s] = 2.0 * names[s]
            left -= want[s]
    assert got == pytest.approx(want)


def test_op6_mix(spark, tmp_path):
    rng = random.Random(1)
    texts = ["w " * rng.randrange(40) for _ in range(300)] + [None]
    sources = [rng.choice(["a", "a", "b", "c", None]) for _ in texts]
    folder = written(docs_of(spark, texts, sources=sources), tmp_path)
    rows = op6.query(spark, folder).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op6.query(spark, folder).collect()))
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(sources[r["doc_id"]], [0, r["target"]])[0] += r["taken"]
    assert all(abs(taken - target) <= 20 for taken, target in by.values())


def test_op7_suffix_array():
    rng = random.Random(0)
    for n in (1, 2, 17, 60):
        words = [rng.randrange(3) for _ in range(n)]
        assert op7.suffix_array(np.array(words)).tolist() == sorted(range(n), key=lambda i: words[i:])


def brute_hits(docs, items, window=13):
    out = []
    for i, t in enumerate(docs):
        w, hit, found = op7.words_of(t), set(), set()
        for item_id, text in items:
            b = op7.words_of(text)
            k = min(window, len(b))
            grams = {tuple(b[j:j + k]) for j in range(len(b) - k + 1)} if b and item_id is not None else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in grams:
                    hit.update(range(j, j + k))
                    found.add(item_id)
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_op7_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(op7, "BLOCK_BYTES", block)
    rng = random.Random(6)
    v = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(v) for _ in range(n))) for i, n in enumerate([1, 4, 13, 20, 40, 0])] + [(2, None), (None, "w1 w2"), (10, "w1 zz w1 zz w1")]
    docs = [" ".join(rng.choice(v) for _ in range(rng.randrange(50))) for _ in range(30)]
    docs += [f"a b {items[3][1]} c {items[4][1].upper()}", items[2][1], "", None, items[1][1].replace(" ", "-"), docs[0]]
    folder = written(docs_of(spark, docs), tmp_path)
    written(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark")
    want = brute_hits(docs, items)
    assert sorted(map(tuple, op7.query(spark, folder).collect())) == want
    kept = op7.clean_documents(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in want if not r[5]] and kept.columns == [c.split()[0] for c in DOCS.split(", ")]


def test_op7_blocks_judge_rows_with_null_and_repeated_ids(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    v = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(v) for _ in range(20))) for i in range(5)]
    clean = [" ".join(rng.choice(v) for _ in range(20)) for _ in range(4)]
    texts = [(None, items[0][1]), (None, clean[0]), (None, items[4][1]), (7, items[1][1]), (7, clean[1]), (7, items[3][1] + " " + items[2][1]),
             (None, clean[2]), (7, clean[1]), (8, clean[3]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], DOCS)
    folder = written(docs, tmp_path)
    written(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")

    def results():
        kept = op7.clean_documents(docs, benchmark).collect()
        spans = op7.find_matches(docs, benchmark).collect()
        return (sorted(map(repr, op7.query(spark, folder).collect())), sorted(map(repr, kept)),
                sorted(repr((r["doc_id"], r["spans"], sorted(r["items"]))) for r in spans),
                sorted(map(repr, op7.longest_matches(docs.filter("doc_id is not null"), benchmark).collect())))

    whole = results()
    monkeypatch.setattr(op7, "BLOCK_BYTES", 60)
    assert len(list(op7._blocks(benchmark, "item_id", "text"))) > 1 and results() == whole
    assert len(whole[1]) == 6


def test_op7_one_block_at_a_time(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i}") for i in range(6)], "item_id long, text string")
    monkeypatch.setattr(op7, "BLOCK_BYTES", 10)
    steps, block, stored = [], op7.BenchmarkBlock, op7.stored
    monkeypatch.setattr(op7, "BenchmarkBlock", lambda *a: steps.append("block") or block(*a))
    monkeypatch.setattr(op7, "stored", lambda *a: steps.append("stored") or stored(*a))
    docs = docs_of(spark, ["x a1 b1 c1 d1 y a5 b5 c5 d5", "q"])
    longest = op7.longest_matches(docs, items).collect()
    assert {r["item_id"] for r in longest if r["n_words"] == 4} == {1, 5} and steps == ["block", "stored"] * 6


def test_op7_longest(spark):
    docs = docs_of(spark, ["x a b c d e f g y", "q c d e f g h z"])
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    got = {r["item_pos"]: (r["n_words"], r["doc_id"], r["doc_pos"]) for r in op7.longest_matches(docs, items, window=3).collect()}
    assert got[0] == (7, 0, 1) and got[2] == (6, 1, 1) and 6 not in got


def test_op8_round_trip():
    rng = random.Random(2)
    bits = ["\\", "<|end|>", "<|text|>", "<|turn|>", "<", "|", "</s>", "<s>", "[INST]", "[/INST]", " ", "\n", "é", "🙂", "x"]
    for _ in range(500):
        role, text = ("".join(rng.choice(bits) for _ in range(rng.randrange(n))) for n in (4, 9))
        for r in (role, "assistant"):
            piece, a, b = op8.format_turn(r, text)
            assert op8.parse_piece(piece, a, b) == (r, text, text if r == "assistant" else "")
            assert "</s>" not in op8.escape(text).replace("\\</s>", "") and "<|end|>" not in op8.escape(text).replace("\\<|end|>", "")


def test_op8_layouts():
    known = {op8.fingerprint(m.paths): m for m in op8.MAPPINGS}
    for record in ({"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"}, {"instruction": "q", "input": "", "output": "a"},
                   {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
                   {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}):
        assert op8.turns_of(json.dumps(record), known)[2] == [("user", "q"), ("assistant", "a")]
    for record in (None, "", "[1]", "no json", '{"other": 1}'):
        assert op8.turns_of(record, known)[1:] == (None, [])


def test_op8_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "yes \\ </s>"), (1, 0, "user", None), (2, 0, None, "<|end|>"), (2, None, "assistant", "last"), (None, 0, "user", "x"),
            (2, 1, "assistant", ""), (1, 1, "assistant", "yes \\ </s>")]
    folder = written(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tmp_path, "conversations")
    got = {r["conv_id"]: r for r in op8.query(spark, folder).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {-1, 1, 2, None}
    assert got[1]["n_turns"] == 3 and got[1]["loss_sha256"] == sha("yes \\ </s>" * 2) and got[1]["loss_chars"] == 20
    assert got[1]["turns_sha256"] == sha("user\n\n" + "assistant\nyes \\ </s>\n" * 2)
    assert got[2]["turns_sha256"] == sha("\n<|end|>\nassistant\n\nassistant\nlast\n")
    assert got[-1]["loss_sha256"] == sha("</s>[INST] ok [/INST]")


def test_op9_same_as_whole_texts():
    coder = op9.ChunkEncoder(op9.tokenizer_path(), remembered=50)
    texts = ["The cat's ##hat 12!?", "Σίσυφος ΟΔΟΣ İstanbul", "<|endoftext|> a<b>c", "漢字 かな 12３4", "a b\x85c\x1cd", "e\u0301 \u0301x é", " \n", "É%%% ß***", "ǅ ﬁ ²³ µ", "x" * 3000]
    for t in texts * 2:
        ids = coder.tokenizer.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == np.array(ids, "<u4").tobytes(), t
    assert coder.encode(None) == coder.encode("") == b""


def test_op9_files(spark, tmp_path):
    from tokenizers import Tokenizer
    tokenizer, texts = Tokenizer.from_file(op9.tokenizer_path()), ["some text", None, "", "more of it 99", "some text"]
    rows = sorted(map(tuple, op9.encoded_files(docs_of(spark, texts)).collect()))
    at = 0
    for (doc_id, start, n, crc), t in zip(rows, texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    path = op9.write_token_files(docs_of(spark, texts), str(tmp_path / "orc"))
    assert [r["doc_id"] for r in op9.read_token_files(spark, path).filter("doc_id = 3").collect()] == [3]
    assert op9.encoded_files(docs_of(spark, [])).count() == 0


def test_op10_shards(spark, tmp_path):
    texts = [f"t{i % 7}" for i in range(2000)] + [None, ""]
    rows = op10.query(spark, written(docs_of(spark, texts), tmp_path)).collect()
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["size"] == len(texts[r["doc_id"]] or "") + 16 for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows) and 20 < sum(r["grown_shard"] == 40 for r in rows) < 90
    for shard in range(40):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_op10_is_the_jump_chain(spark, monkeypatch):
    monkeypatch.setattr(op10, "PIECE_ROWS", 9)
    got = op10.with_slots(op10.assign_shards(docs_of(spark, ["x"] * 100), "doc_id", 7), "shard", ["doc_id"]).collect()
    for r in got:
        for n, shard in ((7, r["shard"]), (8, r["grown_shard"])):
            at, after = 0, 0
            while after < n:
                at = int(after)
                u = (int(hashlib.md5(f"{r['doc_id']}:{at}".encode()).hexdigest()[:13], 16) + 1) / 2**52
                after = (at + 1) // u
            assert shard == at
    assert sorted(r["slot"] for r in got if r["shard"] == 3) == list(range(sum(r["shard"] == 3 for r in got)))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        written(spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0), tmp_path, t)
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == (1 if name.startswith("op8") else 0)


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_oracle(spark, name):
    from tests.oracle_harness import canon, duck_con, run_oracle
    df = registry.QUERIES[name](spark, SF)
    cols, rows = run_oracle(duck_con(SF), registry.ORACLE_SQL[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(cols, rows)


def test_held_out(spark):
    rows = spark.range(200).select("id", is_held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    import corpus_pipeline
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefgh"}
    near = {k: t.replace(f"{k}30 ", "") for k, t in text.items()}
    rows = [(1, "a"), (2, "a"), (2, "b"),  # b is the only text of its kind
            (3, "c"), (4, "c"), (4, "d"), (3, "d"),  # 3 stands for both, by two texts
            (None, "e"), (None, "e"), (None, "e-"), (None, "f"),  # groups without an id
            (None, "g"), (9, "g-"), (9, "g-"), (10, "h"), (10, "h")]
    of = lambda k: near[k[0]] if k.endswith("-") else text[k]
    rows = [(i, of(k)) for i, k in rows] + [(None, ""), (None, ""), (11, None), (11, None), (11, " "), (12, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    e = [t for i, t in got if not i and t.startswith("e")]
    assert len(e) == 1 and e[0] in (text["e"], near["e"]) and kept.columns == docs.columns
    want = [(1, text["a"]), (2, text["b"]), (3, text["c"]), (3, text["d"]), (0, e[0]), (0, text["f"]), (9, near["g"]), (10, text["h"]),
            (0, ""), (0, ""), (11, ""), (11, " "), (12, "")]
    assert got == sorted(want)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    bad = "you idiot moron clown trash stupid loser scum worthless pathetic disgusting person"
    item = " ".join(f"bench{i}" for i in range(30))
    base = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    texts = base + [base[0], base[1].replace("w1x3 ", ""), item + " tail"] + [f"{bad} n{i}" for i in range(30)] + [None]
    docs = docs_of(spark, texts)
    folder = written(docs, tmp_path)
    written(spark.createDataFrame([(1, item)], "item_id long, text string"), tmp_path, "benchmark")
    toxic = [(i, 1, int(43 <= i < 73)) for i in range(len(texts))]
    written(spark.createDataFrame(toxic, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert {r["doc_id"] for r in kept.collect()} >= set(range(40)) and kept.columns == docs.columns
    assert not {40, 41} & {r["doc_id"] for r in kept.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, folder).collect()} == set(range(len(texts))) - {42}
    assert not set(range(43, 73)) & {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and {r["doc_id"] for r in out} <= set(range(40)) | {73}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline
    folder = written(docs_of(spark, []), tmp_path)
    written(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    written(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_stages_keep_columns_that_clash_with_their_own(spark, tmp_path):
    import corpus_pipeline
    written(spark.createDataFrame([(1, "bench " * 20)], "item_id long, text string"), tmp_path, "benchmark")
    written(spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    extra = ["_text", "_toxicity", "_row", "row", "row_number", "_copy", "set", "root"]
    rows = [(i, f"word{i} " * 30, "en", "s", None, *[f"{c}{i}" for c in extra]) for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS + "".join(f", {c} string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert set(map(tuple, kept.collect())) <= set(map(tuple, docs.collect())), name
    op7_many = op7.BLOCK_BYTES
    try:
        op7.BLOCK_BYTES = 1  # several passes: the rows are numbered
        written(spark.createDataFrame([(1, "bench " * 20), (2, "mark " * 20)], "item_id long, text string"), tmp_path / "two", "benchmark")
        assert sorted(map(tuple, op7.clean_documents(docs, spark.read.parquet(f"{tmp_path}/two/benchmark.parquet")).collect())) == sorted(map(tuple, docs.collect()))
    finally:
        op7.BLOCK_BYTES = op7_many
    scored = op2.reject_toxic(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert scored.columns == docs.columns and scored.count() <= 6


def brute_groups(texts, words=5, percent=80):
    return [c for _, _, c, _ in brute_join(texts, words, percent)]


def test_one_of_each_group_brute_force(spark):
    texts = [t for t in near_texts(11) if (t or "").split()]
    kept = op1.one_of_each_group(docs_of(spark, texts), 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_groups(texts)))


def test_a_worker_holds_one_owner():
    from fundscope.llm import common
    assert common.held_by_worker("a", 1, lambda: [1]) is common.held_by_worker("a", 1, lambda: [2])
    common.held_by_worker("b", 1, lambda: [3])
    assert list(common._HELD) == ["b"]
    assert common.held_by_worker("a", 1, lambda: [4]) == [4]


def test_rows_of_files_are_numbered_where_they_are(spark, tmp_path):
    from fundscope.llm.common import numbered
    texts = [f"text {i % 7} " * 9 for i in range(50)]
    files = spark.read.parquet(written(docs_of(spark, texts).repartition(5), tmp_path) + "/documents.parquet")
    rows = numbered(files, "n")
    assert "Join" not in rows._jdf.queryExecution().analyzed().toString() and rows.select("n").distinct().count() == 50
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, numbered(files, "n").repartition(3).collect()))
    twice = numbered(files.union(files), "n")  # not a table as it is: copied
    assert twice.select("n").distinct().count() == 100
    kept = op1.one_of_each_group(files, 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_groups(texts))) and kept.columns == files.columns
