"""Golden pages for the extraction helper and the decoding of bodies."""

import pytest

from storyloom.functions.html import read_page
from storyloom.operators.extract import decode_body, guess_text, read_pages


@pytest.mark.parametrize(
    "html, text, headings, author",
    [
        ("<p>one<p>two", "one\n\ntwo", [], None),
        ("<p><b>one<br><p>two</p>", "one\n\ntwo", [], None),
        ("<script>var t='<p>no</p>';</script><p>yes</p>", "yes", [], None),
        ("<noscript><p>no</p></noscript><p>yes</p>", "yes", [], None),
        ("<div>just <i>text</i></div>", "just text", [], None),
        ("<style>p{}</style><p> </p>rest", "rest", [], None),
        ("".join(f"<h{i % 3 + 1}>H{i}</h{i % 3 + 1}>" for i in range(7)) + "<p>x</p>", "x", ["H0", "H1", "H2", "H3", "H4"], None),
        ("<h1>a <b>b</b></h1><h2> </h2><p>x", "x", ["a b"], None),
        ("<h1>one<h2>two</h2><p>x", "x", ["one", "two"], None),
        ('<meta name="author" content="Ann"><p>x', "x", [], "Ann"),
        ('<meta name="author"><p>x', "x", [], None),
        ("<p>a &amp; b<!-- c --> d</p>", "a & b d", [], None),
        ("<p>in</p> out <div>also out</div>", "in", [], None),
        ("<p>a<div>b</div>c", "a", [], None),
        ("", "", [], None),
    ],
)
def test_read_page(html, text, headings, author):
    got = read_page(html)
    assert got[:3] == (text, headings, author)


def test_main_drops_link_lists():
    nav = "<ul>" + "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(5)) + "</ul>"
    body = "word " * 40
    main = read_page(f"<html>{nav}<p>{body}</p><p>{body}</p></html>")[3]
    assert "link" not in main and main.count("word") == 80


def test_main_falls_back_to_text():
    assert read_page("<p>short</p>")[3] == "short"


@pytest.mark.parametrize("codec", ["utf-8", "utf-8-sig", "utf-16", "latin-1"])
def test_decode(spark, codec):
    text = "Crème brûlée für Ångström"
    got = spark.createDataFrame([(text.encode(codec),)], "b binary").select(decode_body(__import__("pyspark").sql.functions.col("b")).alias("t"))
    assert got.first().t == text


def test_guess_never_fails():
    assert isinstance(guess_text(bytes(range(256))), str)


def test_read_pages_keeps_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x"), (2, "v", None)], "id int, url string, html string")
    got = {r.id: (r.url, r.text) for r in read_pages(pages, "id", keep=["url"]).collect()}
    assert got == {1: ("u", "x"), 2: ("v", "")}


def test_unclosed_tags_take_linear_time():
    import time

    start = time.perf_counter()
    text = read_page("<div><span>x" * 50_000)[0]
    assert text.count("x") == 50_000 and time.perf_counter() - start < 5
