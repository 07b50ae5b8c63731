"""Main text: names of wrappers, hidden pieces, nesting."""

import time

import pytest

from rowferry.llm.html_text import main_text

BLOCKS = ["A title of some length for it", *(
    f"Paragraph {i} of the article, with commas, words, and enough of them to score." for i in range(6))]
ARTICLE = f"<h1>{BLOCKS[0]}</h1>" + "".join(f"<p>{b}</p>" for b in BLOCKS[1:])
WANT = "\n\n".join(BLOCKS)
BESIDE = "<div class='{}'><p>Other words, not of the article, that would score, if they were allowed to do so.</p></div>"


@pytest.mark.parametrize("names", [
    'class="layout has-sidebar"', 'class="page no-sidebar"', 'class="modal-open"', 'class="comment-free"',
    'id="related-work"', 'data-id="menu"', 'itemid="share"', 'class="modal"', "id=widget", 'class="nav-less"'])
def test_a_wrapper_is_no_reason_to_lose_the_article(names):
    assert main_text(f"<html><body><div {names}>{ARTICLE}</div></body></html>") == WANT


@pytest.mark.parametrize("name", ["sidebar", "ad-banner", "cookie-notice", "comments", "comment-list", "related-posts",
                                  "x newsletter-signup", "social_share", "sidebar-left", "site-header", "promo-box"])
def test_what_stands_beside_the_article_goes(name):
    assert main_text(f"<body><div>{ARTICLE}</div>{BESIDE.format(name)}</body>") == WANT
    assert main_text(f"<body><article>{ARTICLE}{BESIDE.format(name)}</article></body>") == WANT
    # also where it says more than the article does
    assert main_text(f"<body><div>{ARTICLE}</div>{'<div class=comments>' + BESIDE.format('x') * 40}</div></body>") == WANT


def test_a_marked_element_around_main_stays():
    assert main_text(f"<body><div class=widget><main>{ARTICLE}</main></div></body>") == WANT


def test_references_are_read_before_tags_go():
    assert main_text(f"<body><div>{ARTICLE}<p>Some more, with &am<b>p;</b> and &lt;b&gt; in a sentence.</p></div></body>"
                     ) == WANT + "\n\nSome more, with &amp; and <b> in a sentence."


@pytest.mark.parametrize("piece", ["<div>some text of a block, long enough to be counted as one",
                                   "<p><div>text, of a kind", "<table><tr><td><div>text, of a kind", "<ul><li><div>text, of a kind",
                                   "</x></div><div>text, of a kind", "<span><a href=x>text, of a kind"])
def test_time_grows_with_the_page(piece):
    begin = time.process_time()
    main_text(piece * 50_000)
    assert time.process_time() - begin < 4


def test_points_go_up_as_stated():
    """A paragraph deep down counts for its container and less for those around it."""
    deep = "<div>" * 80 + ARTICLE + "</div>" * 80
    assert main_text(f"<body>{deep}</body>") == WANT
    assert main_text(f"<body><div>{deep}<div><p>One short, lonely paragraph of something else, far from it.</p></div></div></body>"
                     ).startswith(WANT)
