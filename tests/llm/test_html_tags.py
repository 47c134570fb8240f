import time
from html.parser import HTMLParser

import pytest

from pagemill.llm.html_text import SURGE, WINDOW, attributes, extract_text, is_around, main_text

LONG = "Some long text here that goes on for a while. " * 5


@pytest.mark.parametrize(
    "tag",
    [
        '<p style="overflow:hidden">',
        '<p data-id="comment-5">',
        '<p title="hidden gem">',
        '<p data-hidden data-class="ad">',
        '<p class="alert-rate">',
        '<p class="share-price ad-hoc">',
        "<p title='a > b' id=x>",
        '<p title="<nav>">',
        '<p id=hidden aria-hidden="false">',
        "<p\nclass\n=\nlead>",
        '<p title="never closed>',
    ],
)
def test_attributes_of_a_paragraph_take_nothing(tag):
    assert main_text(f"<article><h1>T</h1>{tag}one</p><p>{LONG}</p></article>") == f"T\none\n{LONG.strip()}"
    assert main_text(f"<div><h1>T</h1>{tag}one</p><p>{LONG}</p></div>") == f"T\none\n{LONG.strip()}"


def test_links_stay_in_their_line():
    assert main_text(f'<article><p>See <a href="/p?id=search">the link</a> for <a class="ad" href=x>more</a>.<p>{LONG}</article>').startswith("See the link for") is True
    assert main_text(f'<article><p>See <a href="/p?id=search&class=ad">the link</a> there.<p>{LONG}</article>') == f"See the link there.\n{LONG.strip()}"


def test_names():
    assert attributes(" a=1 B='x y' c=\"'\" d e= f=g/h a=2 ") == {"a": "1", "b": "x y", "c": "'", "d": "", "e": "f=g/h"}
    assert all(map(is_around, ("ad", "ads-top", "share-buttons", "commentList", "comment-5", "site-nav", "cookie_banner", "related-posts", "sidebar", "navbar")))
    assert not any(map(is_around, ("", "content", "alert-rate", "share-price", "has-sidebar", "no_menu", "advance", "shared", "ad-hoc", "header", "5", "postcard", "searching-for-x")))


def test_hostile_pages_take_linear_time():
    n = 125_000
    pages = ['<a "' * n * 2, "<b>" * n + "</i>" * n, "<i><article>" + "<b>" * n + "</i>" * n, "</div>" * n, '<a x="' * n, "<a b='>" * n, "<title>x</title " * n, "<!--" * n, "<" * n * 4, "<p a" + " " * n * 8 + ">", "<a =" + " =" * n * 4]
    for page in pages:
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 5, page[:20]  # well under a second on a quiet machine; the square of it is minutes


class Plain(HTMLParser):
    """Lines of the simple pages of the test tables, with the weights that the docstrings name, by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.text, self.off, self.article = [], "", [], 0

    def line(self):
        text = " ".join(self.text.split())
        if text:
            self.lines.append((text, (2 if self.article else 1) * len(text)))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "div", "article", "nav", "footer", "body", "head", "ul", "li"):
            self.line()
        if tag == "br":
            self.text += " "
        if tag in ("nav", "footer", "script", "style", "head") or ("class", "ad") in attrs:
            self.off.append(tag)
        if tag == "article":
            self.lines += [("", 0)] * WINDOW
            self.article += 1

    def handle_endtag(self, tag):
        if self.off and tag == self.off[-1]:
            self.off.pop()
            self.lines.append(("", 0))
        if tag in ("p", "h1", "div", "article", "ul", "li"):
            self.line()
        if tag == "article":
            self.article -= 1
            self.lines += [("", 0)] * WINDOW

    def handle_data(self, data):
        if not self.off:
            self.text += data


def by_definition(page):
    """Runs of lines k for which some text lies in lines k to k + WINDOW - 1, each with its highest window."""
    parser = Plain()
    parser.feed(page or "")
    parser.close()
    parser.line()
    sizes = [n for _, n in parser.lines]
    block = [sum(sizes[k : k + WINDOW]) for k in range(len(sizes))]
    runs = []
    for k, b in enumerate(block):
        if b and k and block[k - 1]:
            runs[-1].append(k)
        elif b:
            runs.append([k])
    surging = [r for r in runs if max(block[k] for k in r) > SURGE] or sorted(runs, key=lambda r: -sum(sizes[k] for k in r))[:1]
    return "\n".join(parser.lines[k][0] for r in surging for k in r if sizes[k])


def test_pages_by_definition(spark, sf):
    """The whole table as it is, and with the article in a plain element: there nothing but surge and dive tells where it is."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", r"<(/?)article>", "<$1div>"))
    for df in (pages, bare):
        for r in extract_text(df).collect():
            assert r.text == by_definition(r.html)


def test_surge_and_dive_without_article(spark):
    body = "".join(f"<p>{LONG}{k}</p>" for k in range(4))
    gap = "<div></div><nav>x</nav>" * 4
    page = f"<p>Home</p>{gap}<h1>T</h1>{body}{gap}<p>About</p><p>Legal</p>"
    assert main_text(page) == "\n".join(["T", *(f"{LONG}{k}" for k in range(4))])
