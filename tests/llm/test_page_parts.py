"""op9: made layouts that share no template with the given pages; which blocks come and which go."""

import itertools

import pytest

from tidelark.llm import extract

NAMED = "comment-piece cookie-recipes sponsor-story notice-of-decision newsletter-issue menu-item-recipe ad-hoc-analysis reply-to-critics topbar-less".split()
ARTICLE = [f"Sentence {i} of the piece tells of the river, of the mills along it and of what they ground." for i in range(14)]
REMARK = "I do not agree with a word of this, writes reader {}, at a length that nobody asked for, and goes on for quite some time, well beyond what a page has room for, and then once more."
NOTICE = "We and our partners store data on your device. " * 6
ADVERT = "Buy the finest flour of the whole valley, now at half its price. " * 5


def page(name: str, *parts: str, article=ARTICLE) -> str:
    body = "".join(f"<p>{x}</p>" for x in article)
    return f'<html><body><nav><a href="/">Home</a></nav><div class="{name}"><h1>On mills</h1>{body}</div>{"".join(parts)}<footer>imprint</footer></body></html>'


def remarks(outer: str, inner: str, n: int = 12) -> str:
    return f'<div class="{outer}">' + "".join(f'<div class="{inner}"><p>{REMARK.format(i)}</p></div>' for i in range(n)) + "</div>"


@pytest.mark.parametrize("name", NAMED)
def test_a_word_of_a_class_does_not_empty_an_article(name):
    want = "\n".join(["On mills", *ARTICLE])
    for parts in ((), (remarks("comments", "comment"),), (remarks("comment-list", "comment-item"), f'<div class="cookie-notice">{NOTICE}</div>')):
        assert extract.main_text(page(name, *parts), None)[0] == want


def test_made_layouts_keep_articles_and_lose_the_rest():
    """Recall and precision by block over every mixture of names; the word of a name may also be an article's."""
    names = [*NAMED, "post", "story-text", "c-17"]
    around = [remarks("comment-list", "comment-item"), remarks("user-replies", "reply-box"), f'<div class="cookie-notice">{NOTICE}</div>', f'<div class="ad-slot">{ADVERT}</div><div class="ad-slot">{ADVERT}</div>', f'<div class="sidebar">{ADVERT}</div>']
    right = given = wanted = 0
    for name, parts in itertools.product(names, [*itertools.combinations(around, 1), *itertools.combinations(around, 2)]):
        got = extract.main_text(page(name, *parts), None)[0].split("\n")
        want = ["On mills", *ARTICLE]
        right += len(set(got) & set(want))
        given += len([x for x in got if x])
        wanted += len(want)
    assert right / wanted == 1.0 and right / given >= 0.99


def test_comments_stay_out_of_a_page_without_an_article():
    only = '<html><body><div class="{}">{}</div></body></html>'
    assert extract.main_text(only.format("comments", f"<p>{ADVERT}</p>"), None)[0] == ""
    assert extract.main_text("<html><body>" + remarks("comment-list", "comment-item") + "</body></html>", None)[0] == ""
    linked = "".join(f'<a href="/{i}">To page number {i} of the shop</a> ' for i in range(30))
    assert extract.main_text(only.format("menu-of-shop", linked), None)[0] == ""
    # an article beside a part with such a name is the article, however long that part is
    text = extract.main_text(page("post", f'<div class="newsletter-box"><p>{ADVERT * 20}</p></div>', article=ARTICLE[:5]), None)[0]
    assert text == "\n".join(["On mills", *ARTICLE[:5]])
