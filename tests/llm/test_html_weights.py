import pytest

from pagemill.llm.html_text import main_text

BODY = ["The first paragraph of the body goes on for a good while, so that it surges.", "The second one is as long as the first and tells the rest of the story, too.", "Short end."]
PARAGRAPHS = "".join(f"<p>{b}</p>" for b in BODY)
TEXT = "\n".join(BODY)


@pytest.mark.parametrize(
    "page, text",
    [
        # the body in a div beside teasers in articles
        (f"<div>{PARAGRAPHS * 3}</div><article><p>Teaser one</article><article><p>Teaser two</article>", "\n".join([TEXT] * 3)),
        # a page without article or main, or wholly in a form, or in a div with a listed name, or in both
        (f"<div><a href=x>Home</a></div><div>{PARAGRAPHS}</div><div><a>About</a></div>", TEXT),
        (f'<form action=x><div><a href=x>Home</a></div><div>{PARAGRAPHS}</div><input name=q></form>', TEXT),
        (f'<div class="search-page"><h1>T</h1>{PARAGRAPHS}</div>', f"T\n{TEXT}"),
        (f'<form><div id="modal"><article>{PARAGRAPHS}</article></div><div class="ad">BUY</div></form>', TEXT),
        # the posts of a discussion are one run
        ("".join(f'<div class="comment"><p>{b}</p></div>' for b in BODY * 2), f"{TEXT}\n{TEXT}"),
        # what is around an article stays out, and so does a line outside that doesn't surge as it does
        (f'<div class="related"><p>{BODY[0]}</div><article>{PARAGRAPHS}</article><form><p>{BODY[0]}</form>', TEXT),
        (f"<p>{BODY[0][:40]}</p><p>{BODY[0][:40]}</p><p>{BODY[0][:40]}</p><main>{PARAGRAPHS}</main>", TEXT),
        # a short article without a surge, beside a longer one
        (f"<article><p>Few words</article><article>{PARAGRAPHS}</article>", TEXT),
    ],
)
def test_surge_decides(page, text):
    assert main_text(page) == text


def test_many_areas():
    page = "<div class=ad>" * 3000 + "deep" + "</div>" * 3000 + f"<div>{PARAGRAPHS}</div>" + "".join(f'<p class="ad-{k}">BUY' for k in range(20_000))
    assert main_text(page) == TEXT
