"""The readable part of pages: what is content, what is not, odd and very deep trees."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryspark.functions.content import extract_readable
from quarryspark.functions.readable import readable

S = "This is a sentence of the article, which is long enough to count as text."
OUT = "Out of the article, and yet a text that is as long as any sentence could be."
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Headline number {k} of the day is here</a></li>' for k in range(60)) + "</ul>"
PAGES = {
    "a teaser in article beside a long main": (f"<main><h1>H</h1><p>{S} {S}</p><p>{S}</p><article>Teaser one</article></main>", f"H\n{S} {S}\n{S}\nTeaser one"),
    "a long list of links": (f'<div class="left">{MENU}</div><div><p>{S}</p></div>', S),
    "nav left open before an article": (f"<body><nav><ul><li><a href=x>Home</a><li><a href=y>About</a></ul><article><h1>T</h1><p>{S}</p></article></body>", f"T\n{S}"),
    "nav left open around the text": (f"<body><nav><a href=x>Home</a><a href=y>About</a><p>{S}</p><p>{S}</p></body>", f"{S}\n{S}"),
    "cells of a table as layout": (f"<table><tr><td><a href=a>one</a><br><a href=b>two</a></td><td><h2>Title</h2>{S} {S}<br><br>{S} {S}</td><td>Buy now, the advert of the day is here</td></tr></table>", f"Title\n{S} {S}\n{S} {S}"),
    "asides around": (f"<header>{OUT}</header><div><p>{S}<p>{S}</div><footer>{OUT}</footer><form>{OUT}</form>", f"{S}\n{S}"),
    "asides by class": (f'<div><p>{S}</p><p>{S}</p><div class="box ads"><p>{OUT}</p></div><ul id="comments"><li>{OUT}</ul></div><div class="sidebar"><p>{OUT}</p></div>', f"{S}\n{S}"),
    "asides in an article": (f"<article><h1>T</h1><p>{S}</p><aside>{OUT}</aside><nav>{OUT}</nav>{MENU}<p>{S}</p></article>", f"T\n{S}\n{S}"),
    "a feed": (f"<main><article><h2>A</h2><p>{S} {S}</p></article><article><h2>B</h2><p>{S}</p></article></main>", f"A\n{S} {S}\nB\n{S}"),
    "sections without names": (f"<div><div><p>{S}</p></div><div><p>{S}</p><p>{S}</p></div><div><a href=x>more</a></div></div>", f"{S}\n{S}\n{S}"),
    "scripts and styles": (f"<script>x='<p>{OUT}</p>'</script><style>{OUT}</style><p>{S}<script>{OUT}</script> Tail.</p>", f"{S} Tail."),
    "wrong nesting": (f"<p><b><i>{S}</b></i></div></section></p><p>{S}", f"{S}\n{S}"),
    "links within sentences": (f'<div><p>{S} <a href="x">A link</a> of the text.</p><p>{S}</p></div>', f"{S} A link of the text.\n{S}"),
    "no tags": (f"{S}\nMore &amp; more", f"{S}\nMore & more"),
}


@pytest.mark.parametrize("name", PAGES)
def test_content(name):
    page, text = PAGES[name]
    assert readable(page)[1] == text


def test_title_and_nothing():
    assert readable("<title> A  b </title><h1>C</h1>") == ("A b", "C") and readable("<h1>C <i>d</i></h1>")[0] == "C" and readable(None) == readable("") == ("", "") == readable("<p></p>")
    assert readable("<a href=x>only a link</a>")[1] == "only a link"


def test_deep_and_odd_trees_take_linear_time():
    n = 30_000
    for page in ("<div>" * n + S + "</div>" * n, "<b>" * n + S + "</i>" * n, "<p>" * n + S, "<b>" * n + "<hr>" * n + S, "<ul><li>" * n + S, "<td>" * n + S, "<a href=x>" * n + S, "</p>" * n + S, "<table>" * 2000 + S):
        began = time.monotonic()
        assert readable(page)[1] == S and time.monotonic() - began < 20


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<nav>", "</nav>", "<td>", "<table>", "</table>", "<a>", "</a>", "<li>", "<article>", "</article>", "<script>", "</script>", "<br/>", "<svg/>", "words of text ", "&lt;", "<", "<!--", "-->", '<p class="ad">']), max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_page_is_read(parts):
    title, text = readable("".join(parts))
    assert isinstance(text, str) and all(line == " ".join(line.split()) != "" for line in text.split("\n") if text)


def test_column(values):
    got = values(extract_readable, [f"<title>T</title><p>{S * 4}</p>", f"<p>{S}</p>", None, ""])
    assert [(r.title, r.method, r.error) for r in got] == [("T", "readability", None), *[("", "readability-failed", "content too short")] * 3]


def test_references_without_semicolon(spark):
    page = f"<title>A&amp;&amp</title><article><p>R&D &copy &lt;b&gt; &#65; &#66 &nosuch; {S * 4}</p></article>"
    d = spark.createDataFrame([(page,)], "x string")
    as_browsers = d.select(extract_readable("x").alias("y")).first().y
    as_written = d.select(extract_readable("x", open_references=False).alias("y")).first().y
    assert as_browsers.title == "A&&" and as_browsers.text.startswith("R&D © <b> A B &nosuch; ")
    assert as_written.title == "A&&amp" and as_written.text.startswith("R&D &copy <b> A &#66 &nosuch; ")
