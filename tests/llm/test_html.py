"""Main text of pages."""

import re
import time
from html import unescape

import pytest

from recordflow.llm import html_text as H, queries

SF = "/root/testdata/sf0.001"
WORDS = "A paragraph of the article with enough words, commas and sense to count as text. " * 3


def page(main, before="", after="", head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body><nav><a href=1>Home</a> <a href=2>News</a></nav>{before}{main}{after}<footer>&copy; x</footer></body></html>"


P = WORDS.strip()
CASES = {
    "plain": (page(f"<div class='post'><h2>Head</h2><p>{P}</p><p>Two &amp; three</p></div>"), f"Head\n{P}\nTwo & three"),
    "unclosed": (page(f"<article><h1>Head</h1><p><b>Bold.<br><p>{P}<p>Last"), f"Head\nBold.\n{P}\nLast"),
    "page in a form": (f"<html><body><form action=x><input type=hidden value=1><nav><a href=1>Home</a></nav><article><h1>H</h1><p>{P}</p></article><footer>x</footer></form></body></html>", f"H\n{P}"),
    "text in a form": (f"<html><body><form id=aspnetForm><div><p>{P}</p><p>{P}</p></div><select><option>a</select></form></body></html>", f"{P}\n{P}"),
    "form in the article": (page(f"<article><p>{P}</p><form><p>Ask us by mail.</p><button>Send</button></form><p>{P}</p></article>"), f"{P}\n{P}"),
    "comments": (page(f"<main><h1>H</h1><p>{P}</p></main>", after=f"<section id='comments'><p>{P}</p></section>"), f"H\n{P}"),
    "inner comments": (page(f"<article><p>{P}</p><div class='comment-list'><p>{P}</p></div></article>"), P),
    "sidebar": (page(f"<div id=content><p>{P}</p><p>{P}</p></div>", before="<div class=sidebar><ul><li><a href=1>One link of many</a></li></ul></div>"), f"{P}\n{P}"),
    "notice": (page(f"<article><p>{P}</p></article>", before="<div class='cookie-notice'>We use cookies and so on.</div><header><h1>Site</h1></header>"), P),
    "article header": (page(f"<article><header><h1>Title</h1></header><p>{P}</p></article>"), f"Title\n{P}"),
    "script": (page(f"<article><script>var t='</p><p>no';</script><style>p{{}}</style><p>{P}</p><form><input value=x><label>Name</label></form></article>"), P),
    "lists": (page(f"<article><p>{P}</p><ul><li>one<li>two <i>words</i></ul><table><tr><td>a<td>b</table></article>"), f"{P}\none\ntwo words\na\nb"),
    "references": (page(f"<article><p>{P} &lt;b&gt; &#233; &eacute;&nbsp;&#x1F600;</p></article>"), f"{P} <b> é é 😀"),
    "hidden": (page(f"<article><p>{P}</p><p style='display: none'>secret</p><p hidden>secret</p></article>"), P),
    "attributes": (page(f"<article><p title='a > b' data-x=\"</p>\">{P}</p></article>"), P),
    "comment markup": (page(f"<article><!-- <p>no</p> --><p>{P}</p></article>"), P),
    "inline": (page(f"<article><p>{P} a<b>b</b>c<span> d</span>\n\n e</p></article>"), f"{P} abc d e"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_page(name):
    html, want = CASES[name]
    assert H.main_text(html) == want


@pytest.mark.parametrize("html,want", [("", ""), ("   ", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<", "<"), ("<html><body></body></html>", ""), ("<p " + "x" * 9, ""),
                                       ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"), ("</p></div>text", "text"), ("<script>x", ""), ("<!-- x", "")])
def test_odd_pages(html, want):
    assert H.main_text(html) == want


@pytest.mark.parametrize("piece", ["<div>x ", "<b>x <p>", "<b>x </i>", "<div>x </i>", "<li>x ", "<table><tr><td>x ", "<form>x "])
def test_deep_pages_take_linear_time(piece):
    """Elements that are never closed: four times the page may take about four times as long."""
    def seconds(n):
        start = time.process_time()
        H.main_text(piece * n)
        return time.process_time() - start
    short = min(seconds(2000) for _ in range(2))
    assert seconds(8000) < 10 * short + 0.2


def slow(html):
    """The article of the test pages, whose markup is known."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)
    if not m:
        return ""
    body = re.sub(r"</?b>", "", re.sub(r"</?(?:h1|p)>", "\n", m[1].replace("<br>", " ")))
    return "\n".join(x for x in (re.sub(r"\s+", " ", unescape(line)).strip() for line in body.split("\n")) if x)


def test_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op8_html"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == slow(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a"), (3, "u", "<p>a"), (None, "u", "<article>" + "<p>word</p>" * 20_000)]
    pages = spark.createDataFrame([(*r, "t", 4) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, H.extract(pages).collect()), key=str)
    assert [r for r in got if r[0] is not None] == [(1, "u", "", 0), (2, None, "", 0), (3, "u", "a", 1), (3, "u", "a", 1)]
    assert [r[3] for r in got if r[0] is None] == [5 * 20_000 - 1]
    assert H.extract(pages.limit(0)).collect() == []


LINKS = "<ul><li><a href=1>One link of many</a></li><li><a href=2>Another link</a></li></ul>"
HINTED = {
    "wrapper": (page(f"<div class='content has-sidebar'><h1>H</h1><p>{P}</p><p>{P}</p></div>"), f"H\n{P}\n{P}"),
    "layout": (page(f"<div class='layout-right-sidebar'><article><h1>H</h1><p>{P}</p></article></div>"), f"H\n{P}"),
    "wrapper by other words": (page(f"<div class='page widget sidebar'><article><p>{P}</p></article><div class=sidebar>{LINKS}</div></div>"), P),
    "section ids": (page(f"<article><p>{P}</p><section id='discussion'><h2 id='discussion-1'>D</h2><p>{P}</p></section><section id='consent'><p>{P}</p></section></article>"), f"{P}\nD\n{P}\n{P}"),
    "heading ids": (page(f"<article><h1>H</h1><p>{P}</p><h2 id='related-work'>Related</h2><h2 id='search'>Search</h2><h3 id='sharing-data'>Sharing</h3><p>{P}</p></article>"), f"H\n{P}\nRelated\nSearch\nSharing\n{P}"),
    "entry header": (page(f"<article><div class='entry-header'><h1>Title</h1></div><p>{P}</p></article>"), f"Title\n{P}"),
    "entry header without h1": (page(f"<div class=post><div class='entry-header'><h2>Title</h2></div><p>{P}</p><p>{P}</p></div>"), f"Title\n{P}\n{P}"),
    "notice": (page(f"<article><p>{P}</p><p class='notice'>Mind the step.</p></article>"), f"{P}\nMind the step."),
    "links go": (page(f"<article><p>{P}</p><div class='related'>{LINKS}</div><div class='ad'>Buy now</div><section id=comments><p>{P}</p></section></article>"), P),
    "nested": (page(f"<article><p>{P}</p><section id='discussion'><p>{P}</p><div class=ad>Buy now</div><div class=share>{LINKS}</div></section></article>"), f"{P}\n{P}"),
    "comments of articles": (page(f"<main><h1>H</h1><p>{P}</p><div id=comments><article class='comment'><p>{P}</p></article></div></main>"), f"H\n{P}"),
}


@pytest.mark.parametrize("name", sorted(HINTED))
def test_hinted_blocks(name):
    html, want = HINTED[name]
    assert H.main_text(html) == want
