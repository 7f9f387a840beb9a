"""Speculative byte-pair encoding against the tokenizers library, exact merging by hand and round trips."""

import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from fundscope.llm import op13_bpe as op13

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bpe():
    return op13.SpeculativeBpe(op13.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(op13.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def ids_of(b):
    return np.frombuffer(b, "<u4").tolist()


def same(bpe, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(bpe.encode(text)) == want, text[:100]
    assert bpe.decode(bpe.encode(text)) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "\n \t x ", "aaaa" * 50, "-" * 300, " " * 133 + "=" * 77, "don't 'S we'll", "<|endoftext|>", "a <|endoftext|><|endoftext|> b",
    "<|endoftext", "漢字 ̀é ß", "\x00\x1c\x1d\x85᠎​ ", "\U0001F600 \U0001F468‍\U0001F469", "՘₏\U00010940x1"])
def test_like_the_library(bpe, library, text):
    same(bpe, library, text)


def test_every_character_is_cut_alike(bpe, library):
    """Every code point below U+3000 and one of seven above, each beside a letter, a digit, a mark and white space."""
    chars = [chr(c) for c in [*range(0x3000), *range(0x3000, 0xD800, 7), *range(0xE000, 0x110000, 7)]]
    for at in range(0, len(chars), 4000):
        text = "\n".join(f"a{c}1{c}.{c} {c}a" for c in chars[at:at + 4000])
        spans = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert bpe.splitter.words(text) == spans == list(bpe.splitter.spans(text))


def test_random_texts(bpe, library):
    rng = random.Random(13)
    letters = "abcdetnios " * 3 + "\n'é漢ß0123-=_՘\U0001F600́　 "
    entries = [b.decode("utf-8", "ignore") for b in bpe.bytes_of]
    for _ in range(2000):
        same(bpe, library, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))))
        same(bpe, library, "".join(rng.choice(entries) for _ in range(rng.randrange(1, 12))))
    assert bpe.merged_words > 0


def merged_by_hand(bpe, word):
    ids = [int(bpe.byte_ids[b]) for b in word]
    while True:
        found = [(bpe.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in bpe.merges]
        if not found:
            return ids
        r, i = min(found)
        ids[i:i + 2] = [bpe.merges[ids[i], ids[i + 1]][1]]


def test_verification_is_exact(bpe):
    """A border stands just when merging the two tokens' bytes gives the two tokens, in all pairs of a wide sample."""
    rng = random.Random(5)
    made = np.flatnonzero(bpe.rank >= 0).tolist()
    runs = [i for i in made if len(set(bpe.bytes_of[i])) == 1]
    pairs = [(rng.choice(made), rng.choice(made)) for _ in range(6000)] + [(a, b) for a in runs for b in runs][:3000]
    stands = bpe.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), ok in zip(pairs, stands):
        assert ok == (merged_by_hand(bpe, bpe.bytes_of[a] + bpe.bytes_of[b]) == [a, b])


def test_both_ways_of_exact_merging(bpe):
    rng = random.Random(7)
    words = [bytes(rng.choice(b"aabehnt \xc3\xa9-") for _ in range(rng.randrange(1, 70))) for _ in range(400)] + [b"aaaaaaa", b"-" * 131]
    got = dict(bpe.merge_exactly(words))
    for i, w in enumerate(words):
        want = merged_by_hand(bpe, w)
        assert ids_of(got[i]) == want and ids_of(bpe.merge_long(w)) == want


def test_long_words_and_long_texts(bpe, library, monkeypatch):
    same(bpe, library, "ab" * 20_000)
    monkeypatch.setattr(op13, "LONG_TEXT", 50)
    monkeypatch.setattr(op13, "BLOCK_WORDS", 7)
    rng = random.Random(3)
    for _ in range(50):
        same(bpe, library, " ".join("".join(rng.choice("abcdeß ") for _ in range(rng.randrange(1, 90))) for _ in range(40)))


def test_memory_is_bounded(library):
    small = op13.SpeculativeBpe(op13.tokenizer_path(), remembered=50)
    rng = random.Random(4)
    for _ in range(40):
        same(small, library, " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(30)))
    assert len(small.words) <= 80


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.load(open(op13.tokenizer_path(), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        op13.SpeculativeBpe(str(tmp_path / "t.json"))


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_query_on_a_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = op13.query(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: expected(library, t) for i, t in texts.items()}


def test_odd_rows(spark, library, tmp_path):
    rows = [(1, None, "x", "y"), (None, "two words", "x", None), (1, "one", None, "y"), (1, "one", None, "y"), (2, "", "", "")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op13.query(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is not None, r)
    assert sorted(got, key=key) == sorted([(i, *expected(library, t)) for i, t, *_ in rows], key=key)
    decoded = op13.decode_ids(op13.encode_texts(spark.read.parquet(f"{tmp_path}/documents.parquet"))).collect()
    assert sorted(r.text for r in decoded) == ["", "", "one", "one", "two words"]


def test_ids_outside_the_vocabulary(bpe, library):
    numbers = [50256, 10, 70_000, 4_000_000_000, 220, 11]
    assert bpe.decode(np.array(numbers, "<u4").tobytes()) == library.decode([50256, 10, 220, 11], skip_special_tokens=False)
    assert bpe.decode(np.array([int(bpe.byte_ids[0xE2])], "<u4").tobytes()) == "�"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = op13.query(spark, str(tmp_path))
    assert df.count() == 0 and df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
