"""Markup that must not cost an article: classes of the page, forms around it, stray quotes, deep nesting."""

import time

import pytest

from fundscope.llm import op3_html as op3

WORDS = " ".join(f"word{i}" for i in range(50))


def read(page):
    return " ".join(" ".join(s.text.split()) for s in op3.segments(page) if s.text and not s.out).strip()


@pytest.mark.parametrize("page", [
    f'<div class="layout no-sidebar"><p>{WORDS}</p></div>', f'<body class="has-sidebar"><div class="page has-sidebar"><p>{WORDS}</p></div></body>',
    f'<form id="aspnetForm"><div id="main"><p>{WORDS}</p></div></form>', f'<form><div class="with-comments"><form><p>{WORDS}</p></form></div></form>',
    f'<div class="widget"><p>{WORDS}</p></div>'])
def test_wrappers_keep_their_words(page):
    assert read(page) == WORDS


@pytest.mark.parametrize("page", [
    f"<nav>{WORDS}</nav>", f"<footer><p>{WORDS}</p></footer>", f'<div role="navigation">{WORDS}</div>', '<div class="menu"><a>Home</a> <a>About</a></div>',
    f'<div class="menu"><ul><li><a>{WORDS}</a></li></ul></div>', '<form><label>Name</label><input></form>'])
def test_pages_of_parts_alone_stay_empty(page):
    assert read(page) == ""


def test_parts_beside_an_article_go():
    page = f'<p>{WORDS}</p><div class="sidebar">{WORDS}</div><form>search here</form><div class="comments"><p>{WORDS} {WORDS}</p></div>'
    assert read(page) == WORDS


def test_quotes_open_after_an_equals_sign_only():
    assert read("<p><a href='it's'>Don't go</a> there</p>") == "Don't go there"
    assert read('<p title="a > b">x</p><p data-x=\'1 > 2\'>y</p><p "odd">z</p>') == "x y z"


def test_nesting_takes_linear_time():
    def seconds(page):
        began = time.process_time()
        op3.segments(page)
        return time.process_time() - began
    for page in (lambda n: "<div>" * n + "x" + "</div>" * n, lambda n: "<div><b>" * n + "x" + "</div>" * n, lambda n: "<p>" + "</i>" * n + "x"):
        assert seconds(page(60_000)) < 12 * seconds(page(10_000)) + 0.5
