"""Names of elements that hold the main text."""

import pytest

from tallyspark.llm import html_text

TEXT = "This is a paragraph of the text that we want to keep, and it is long enough to be one of those that count."
OTHER = "Here is some more of what the author has to say on the matter, and it belongs to the same text as well."


@pytest.mark.parametrize("open_, close", [('<body class="single comments-open"><article>', "</article>"), ('<article class="post has-comments">', "</article>"), ('<article class="review">', "</article>"), ('<main id="reviews">', "</main>")])
def test_names_on_main_elements(open_, close):
    assert html_text.main_text(f"{open_}<p>{TEXT}</p>{close}") == TEXT


@pytest.mark.parametrize("name", ["related-work", "search-algorithms", "related", "review"])
def test_sections_inside_an_article(name):
    assert html_text.main_text(f'<article><p>{TEXT}</p><section id="{name}"><p>{OTHER}</p></section></article>') == f"{TEXT}\n{OTHER}"


def test_widgets_inside_an_article_are_dropped():
    links = "".join(f'<p><a href="/{k}">Another story that you may like to read</a> by us</p>' for k in range(3))
    for part in (f'<div class="related-posts"><p>More for you</p>{links}</div>', f'<div id="comments"><p>{OTHER}</p></div>', f'<div class="ad"><p>{OTHER}</p></div>', f"<aside><p>{OTHER}</p></aside>"):
        assert html_text.main_text(f"<article><p>{TEXT}</p>{part}</article>") == TEXT
