"""Quotes in tags, and pages of a host that are copies of one page."""

import pytest

from rondel.llm import html_text

QUOTES = [
    ("<nav>menu</nav><article><p class=it's>first para</p><p>second</p></article>", "first para second"),
    ("<article><a href=/o'neil>link</a> text <a href=x\"y>more</a></article>", "link text more"),
    ("<article><p title=\"a>b\">one</p><p title = 'c>d'>two</p></article>", "one two"),
    ("<article><p \"x>one</p><p 'y>two</p></article>", "one two"),
    ("<article><p title=''>one</p><p title=\"\" class=''>two</p></article>", "one two"),
    ("<article><p a=b\"c d='e>f' g=h'i>one</p></article>", "one"),
    ("<article>one<p title=\"never closed>two</p></article>", "one"),
]


@pytest.mark.parametrize("page,text", QUOTES)
def test_quotes_open_values_only_after_an_equals_sign(page, text):
    assert " ".join(t for kind, t in html_text.parse(page) if kind == 1) == text


def test_copies_are_one_page(spark):
    body = " ".join(f"word{i}" for i in range(40))
    line = " ".join(f"line{i}" for i in range(12))
    pages = [(1, "http://a.org/1", f"<p>{body}</p>"), (2, "http://a.org/2", f"<p>{body}</p>"), (3, "http://a.org/3", f"<p>other text here</p><p>{line}</p>"), (4, "http://a.org/4", f"<p>and yet another</p><p>{line}</p>"), (1, "http://a.org/1", f"<p>{body}</p>"), (None, None, f"<p>{body}</p>")]
    rows = html_text.main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert len(rows) == len(pages)
    assert {r.text for r in rows if r.page_id in (1, 2, None)} == {body}
    assert {r.page_id: r.text for r in rows if r.page_id in (3, 4)} == {3: "other text here", 4: "and yet another"}


def test_a_very_long_page(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    pages = [(1, "http://a.org/1", f"<p>{text}</p>"), (2, "http://a.org/2", "<p " + "x" * 200_000 + ">end</p>")]
    rows = html_text.main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {1: text, 2: "end"}
