import random

import pytest

from pagemill.llm.html_text import kind_of, main_text

POST = "A short post of some hundred characters, which says what it has to say in one paragraph and no more."
COMMENT = "I read this twice and I still think that it is wrong, for reasons that I will now tell at some length. Yes!! " * 2


def comments(n, tag="div"):
    return "".join(f'<{tag} class="comment"><p>{COMMENT}{k}</p></{tag}>' for k in range(n))


@pytest.mark.parametrize("n", [0, 1, 5, 40, 160])
@pytest.mark.parametrize("mark", ['section id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div id="disqus_thread"', 'div class="replies"'])
@pytest.mark.parametrize("times", [1, 3])
def test_comments_stay_out_whatever_their_size(n, mark, times):
    tag = mark.split()[0]
    body = f"<p>{POST}</p>" * times
    text = "\n".join([POST] * times)
    section = f"<{mark}><h2>{n} comments</h2>{comments(n)}</{tag}>"
    assert main_text(f"<article>{body}</article>{section}") == text
    assert main_text(f"<article>{body}{section}</article>") == text
    assert main_text(f"<div>{body}</div>{section}") == text
    assert main_text(f"<div>{body}{section}</div>") == text
    assert main_text(f"<article>{body}</article>{comments(n, 'article')}") == text


def test_a_post_without_a_surge_is_still_no_comment():
    assert main_text(f"<div><p>Tiny.</p></div><div id=comments>{comments(9)}</div>") == "Tiny."
    assert main_text(f"<div id=comments>{comments(1)}</div>") == f"{COMMENT}0"  # a discussion has no other text


@pytest.mark.parametrize("mark", ['class="sidebar"', 'id="related-posts"', 'class="newsletter"', 'class="ads"', 'role="complementary"', 'class="cookie-banner"', 'class="share-buttons"'])
def test_other_areas_of_any_size(mark):
    assert main_text(f"<div><p>{POST}</p></div><div {mark}>{comments(30, 'p')}</div>") == POST
    assert main_text(f"<article><p>{POST}</p><div {mark}><p>{COMMENT * 20}</p></div></article>") == POST


def test_a_page_within_a_form_or_a_dialog():
    body = f"<p>{POST}</p>" * 6
    for around in ("<form>{}</form>", '<div id="modal">{}</div>', '<div class="search-page">{}</div>', '<div role="dialog">{}</div>'):
        assert main_text("<p>" + POST + "</p>" + around.format(body)).endswith("\n".join([POST] * 6))
    assert kind_of("form") == kind_of("search-page") == kind_of("dialog") == "weighed" and kind_of("cookie-banner") == "strict" and kind_of("comment-5") == "readers"


def test_linked_lines_stay_within_the_text():
    link = '<p><a href="/x">A whole paragraph that is one link to another page of this site</a></p>'
    linked = "A whole paragraph that is one link to another page of this site"
    for open_, close in (("<div>", "</div>"), ("<article>", "</article>")):
        assert main_text(f"{open_}<p>{POST}</p>{link}<p>{POST}</p>{close}") == f"{POST}\n{linked}\n{POST}"
        sources = "<ul>" + "".join(f'<li><a href="/{k}">Source number {k}</a>' for k in range(8)) + "</ul>"
        assert main_text(f"{open_}<p>{POST}</p>{sources}<p>{POST}</p>{close}") == "\n".join([POST, *(f"Source number {k}" for k in range(8)), POST])
    menu = "<nav>x</nav><ul>" + "".join(f'<li><a href="/{k}">Menu {k}</a>' for k in range(8)) + "</ul><nav>y</nav>"
    assert main_text(f"<div><p>{POST}</p>{menu}<p>{POST}</p></div>") == f"{POST}\n{POST}"


@pytest.mark.parametrize("removed", ["<aside>note</aside>", "<script>x</script>", '<div class="ad">BUY</div>', "<button>Go</button>", "<form>q</form>", "<nav>n</nav>", '<div class="share">S</div>'])
@pytest.mark.parametrize("n", [1, 3, 9])
def test_what_is_removed_makes_no_gap_in_an_article(removed, n):
    assert main_text(f"<article><p>{POST}</p>{removed * n}<p>He died in 1999.</p></article>") == f"{POST}\nHe died in 1999."
    if "aside" in removed or "script" in removed or "button" in removed:
        assert main_text(f"<div><p>{POST}</p>{removed * n}<p>He died in 1999.</p></div>") == f"{POST}\nHe died in 1999."


def test_pages_with_comments_of_ten_times_their_text(spark, sf):
    """The whole table: the text is what it was without them, with the article in its element and in a plain one."""
    r = random.Random(1)
    for row in spark.read.parquet(f"{sf}/pages.parquet").collect():
        for page in (row.html, row.html.replace("<article>", "<div>").replace("</article>", "</div>")):
            end = "</article>" if "</article>" in page else "</div><footer>"
            want = main_text(page)
            words = want.split()
            n = 10 * len(want) // 200 + 1
            planted = "".join(f'<li class="comment"><p>{" ".join(r.choices(words, k=40))}</p></li>' for _ in range(n))
            inside = page.replace(end, f'<section id="comments"><ol>{planted}</ol></section>{end}')
            after = page.replace("<footer>", f'<ol class="comment-list">{planted}</ol><footer>')
            assert inside != page != after and main_text(inside) == want == main_text(after)
