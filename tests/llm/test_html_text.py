import pytest

from pagemill.llm.html_text import extract_text, main_text


LONG = "Some long text here. " * 10


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("just words", "just words"),
        ("<html><body><nav>Menu</nav><article><h1>T &amp; x</h1><p>a\n b&nbsp;c<p>d</article><footer>f</footer>", "T & x\na b c\nd"),
        ('<article><header><h1>T</h1></header><p>a<p class="ad-box">BUY<p>b<section id="comments"><article>c</article></section><p>e</article>', "T\na\nb\ne"),
        ('<script>var t="</p>";</script><main><p>x &lt;b&gt; <b>y<p>z<aside>no</aside></main>', "x <b> y\nz"),
        (f'<div class="header"><a>Home</a></div><div><h1>T</h1>{LONG}<ul><li>One<li>Two</ul></div><p class="ad">BUY<div id="comments">c</div>', f"T\n{LONG.strip()}\nOne\nTwo"),
        (f'<div class="content has-sidebar"><p>{LONG}</p></div><div id="site-header">H</div><div class="commentList"><article>c</article></div>', LONG.strip()),
        ("<article><form>q</form><p>a<br>b</p><style>p{}</style><!-- c --></article><p>tail", "a b"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_pages(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumnRenamed("url", "n_chars")
    for r in extract_text(pages).collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inside))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_very_long_page():
    page = "<article>" + "<p>word</p>" * 50_000 + "<div>" * 2000 + "deep" + "</div>" * 2000 + "</article>"
    assert main_text(page).count("\n") == 50_000
