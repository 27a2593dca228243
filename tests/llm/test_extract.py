"""Main-text extraction: the given pages by an independent parser, hand-made pages, awkward rows."""

from html.parser import HTMLParser

import numpy as np
import pytest
from tests.conftest import SMALL

from tabloom.llm import queries as Q
from tabloom.llm.extract import LABELLED, article_tree, extract_text, is_article, main_text, train_tree
from tabloom.llm.html_blocks import read_page


class Article(HTMLParser):
    """Text of the article element of the given pages, cut at block-level tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on = self.on or tag == "article"
        self.blocks[-1] += " " if tag == "br" else ""
        if tag not in ("b", "br", "a", "i"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag not in ("b", "br", "a", "i"):
            self.blocks.append("")
        self.on = self.on and tag != "article"

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


def article(html):
    p = Article()
    p.feed(html)
    p.close()
    return "\n\n".join(t for b in p.blocks if (t := " ".join(b.split())))


def test_given_pages(spark):
    html = {r.page_id: r for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/pages.parquet").collect()}
    rows = Q.op9_block_tree(spark, SMALL.replace("0.001", "0.01")).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.text == article(html[r.page_id].html) and r.n_chars == len(r.text) and r.url == html[r.page_id].url


PARAGRAPHS = ["The council met on Tuesday evening to discuss the long delayed plans for the bridge over the river.",
              "Nobody objected.", "Members asked for a new estimate, since prices of steel &amp; concrete had risen by a third&nbsp;since spring.",
              "Work could begin <a href='/plan'>next year</a> if the state pays its share, the mayor said after the meeting."]
FRAME = """<!DOCTYPE html><html><head><title>T &lt; U</title><style>p{}</style></head><body>
<header class="site-header"><a href="/">Home</a><h2>Daily Paper</h2></header>
<nav><ul><li><a href="/a">News</a><li><a href="/b">Sport</a></ul></nav>
<div class="cookie-notice">We use cookies to give you the best experience on our website, as described in our policy. <button>Accept</button></div>
%s
<aside id="sidebar"><h3>Most read</h3><p>A very long teaser about something else that readers may want to open next.</p></aside>
<div id="comments"><p>I think that this is a very bad idea and nobody should pay for a bridge we do not need at all.</p></div>
<form><label>Mail</label><input name="m"><p>Sign up for our weekly letter and never miss a story again.</p></form>
<script>document.write("<p>not text</p>")</script><footer>&copy; Paper</footer></body></html>"""
WANT = ["Bridge plans", PARAGRAPHS[0], PARAGRAPHS[1], PARAGRAPHS[2].replace("&amp;", "&").replace("&nbsp;", " "),
        "Work could begin next year if the state pays its share, the mayor said after the meeting."]


@pytest.mark.parametrize("tag", ["<article>%s</article>", "<main><div class='ad'>Buy now, buy cheap, buy more of it today.</div>%s</main>",
                                 "<div class='article-body'>%s</div>"])
def test_frames(tag):
    body = "<header class='entry-header'><h1>Bridge plans</h1></header>" + "".join(f"<p>{p}\n" for p in PARAGRAPHS)
    assert main_text(FRAME % (tag % body), article_tree()).split("\n\n") == WANT


def test_page_without_main_element():
    text = main_text(FRAME % ("<div>" + "".join(f"<p>{p}</p>" for p in (PARAGRAPHS[0], PARAGRAPHS[2], PARAGRAPHS[3])) + "</div>"), article_tree())
    assert text.split("\n\n") == [WANT[1], WANT[3], WANT[4]]


def test_blocks_and_links():
    blocks, links, title = read_page("<title>A &amp; B</title><p>one<br>two <a href='x?a=1&amp;b=2'>three  four</a> five<p>six<!-- <p>no</p> --> seven"
                                     "<SCRIPT>if (a<b) x('</p>')</SCRIPT > &#233;&eacute; < 3 <b>eig</b>ht<div hidden>")
    assert [(b.text, b.words, b.links) for b in blocks] == [("one two three four five", 5, 2), ("six seven", 2, 0), ("éé < 3 eight", 4, 0)]
    assert [tuple(x) for x in links] == [("x?a=1&b=2", "three four")] and title == "A & B"


def test_tree_fits_its_table():
    tree = article_tree()
    assert sum(is_article(tree, r[:-1]) == bool(r[-1]) for r in LABELLED) >= len(LABELLED) - 1
    x = np.array([[0.0], [1], [2], [3]])
    t = train_tree(x, np.array([0, 0, 1, 1]))
    assert [is_article(t, r) for r in x] == [False, False, True, True]


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "no tags at all"), (4, "u", "<p"), (5, "u", "<script>never closed <p>x"), (None, "u", "<article><p>x</p>"),
            (6, "u", "<article>" + "<p>word word</p>" * 20_000 + "</article>"), (6, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (7, "u", "</p></div><article>a</p>b</article>")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, text int, n_chars string")
    out = extract_text(df).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert [r.text for r in out if r.page_id in (1, 2, 4, 5)][:2] == ["", ""] and all(r.n_chars == len(r.text) for r in out)
    assert {r.text for r in out if r.page_id is None} == {"x"} and {r.text for r in out if r.page_id == 7} == {"a\n\nb"}
    assert max(r.n_chars for r in out if r.page_id == 6) == 20_000 * 11 - 2
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("frame", ["<div class='layout with-sidebar'>%s</div>", "<form action='/'>%s</form>", "<div class='no-sidebar has-header-image'>%s</div>",
                                   "<div class='sidebar-wrapper'>%s</div>", "<div id='menu-page'><form>%s</form></div>"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_wrappers_keep_the_article(frame, tag):
    """A form or a frame of the page's layout around the article does not make it something else."""
    body = f"<{tag}><h1>Bridge plans</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "<div class='sidebar'><p>Read this next, if you like it.</p></div>" + f"</{tag}>"
    assert main_text(FRAME % (frame % body), article_tree()).split("\n\n") == WANT


def test_comments_in_article_elements_are_left_out():
    comments = "<section id='comments'><article class='comment'><p>I think that this is a very bad idea and nobody should pay for it.</p></article>" \
               "<article><p>And I think that it is a very good one, for which everybody should pay.</p></article></section>"
    body = "<article><h1>Bridge plans</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</article>" + comments
    assert main_text(FRAME % body, article_tree()).split("\n\n") == WANT
