"""op5 on articles whose parts lie at different depths, on names and on markup that lead astray, and its density formula."""

import math
import time

from loam.llm.html_text import Node, extract, measure


def test_article_is_taken_whole():
    """A heading outside the wrapped body, a short section and a list stay, whatever their densities."""
    long = ["long paragraph " * 27 + str(i) for i in range(10)]
    items = [f"item {i}" for i in range(8)]
    paragraphs = "".join(f"<p>{x}</p>" for x in long)
    head, short = "A heading of about forty characters here", "short section " * 18 + "."
    page = f"<body><nav>menu</nav><article><h1>{head}</h1><div>{paragraphs}</div></article><footer>end</footer></body>"
    assert extract(page).split("\n") == [head, *long]
    for outer in ("article", "main"):
        page = f"<{outer}><h1>{head}</h1><section>{paragraphs}</section><section><p>{short}</p></section><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul></{outer}>"
        assert extract(f"<body>{page}</body>").split("\n") == [head, *long, short, *items]


def test_wrapper_of_the_article_stays():
    """Classes that tell of a sidebar or menu elsewhere don't cut the article; real ones are cut still."""
    text = "some text of the article " * 20
    for name in ("class='content no-sidebar'", "class='has-sidebar'", "class='post-share-enabled'", "id='main-with-menu'", "class='sidebar-layout'"):
        page = f"<body><div {name}><article><p>{text}</p></article><div class='sidebar-left'>side</div></div><div id=comments><article class='comment-body'>reader</article></div></body>"
        assert extract(page) == text.strip(), name
    assert extract(f"<body><div class='content no-sidebar'><p>{text}</p></div><div class='site-footer'>end</div></body>") == text.strip()


ARTICLE = " ".join(f"Sentence number {i} of the article goes on here." for i in range(20))


def around(part):
    return f"<html><body><nav><a href=/>Home</a></nav>{part}<div class='sidebar'>side text</div><footer>foot</footer></body></html>"


def test_names_do_not_cut_what_holds_the_text():
    """Doubtful names, and certain ones that hold all the text, leave the article; the same names on little text cut it."""
    for name in ("content-area has-sidebar", "layout no-sidebar", "nav-fixed main-content", "post related-content", "widget", "banner-page"):
        assert extract(around(f"<div class='{name}'><p>{ARTICLE}</p></div>")) == ARTICLE, name
    assert extract(around(f"<article><div class='entry with-widgets promo'><p>{ARTICLE}</p></div></article>")) == ARTICLE
    assert extract(around(f"<form id=aspnetForm><div><p>{ARTICLE}</p></div></form>")) == ARTICLE
    for name in ("promo", "related-content", "cookie-banner", "share-buttons", "post related"):
        assert extract(around(f"<article><p>{ARTICLE}</p><div class='{name}'>no part of it</div></article>")) == ARTICLE, name
    comments = "".join(f"<p>Reader {i} says that.</p>" for i in range(30))
    assert extract(around(f"<div><p>{ARTICLE}</p><div id=comments>{comments}</div></div>")) == ARTICLE
    assert extract(around(f"<article><p>{ARTICLE}</p><section class='comments'>{comments}</section></article>")) == ARTICLE


def test_unclosed_elements_drop_nothing():
    for tag in ("svg", "noscript", "template", "canvas"):
        assert extract(around(f"<article><{tag}><p>{ARTICLE}</p></article>")) == ARTICLE
    assert extract(f"<article><p>{ARTICLE}</p><p>a < b <a href='x") .startswith(ARTICLE)


def test_hostile_pages_take_linear_time():
    n = 1_000_000
    for part in ("<a ", '<a "', "<b '>'", "<b a='>'", "<svg>", "<!", "class=", "<p class=\"", "<div class='nav'>", "<li>", "</b>"):
        for before in ("", "<p><button>" + "<b>" * 600, "<div>" * 2000):
            began = time.process_time()
            extract(before + part * (n // len(part)))
            assert time.process_time() - began < 4, part
    began = time.process_time()
    extract("<p><button>" + "<b>" * 600 + "<div></div>" * 90_000)
    assert time.process_time() - began < 4


def test_density_as_published():
    """Composite text density by an independent computation over a small tree."""
    body = Node("body", None)
    block, link, side = Node("div", body), None, Node("ul", body)
    body.parts = ["x" * 7, block, side]
    link = Node("a", block)
    block.parts, link.parts = ["y" * 120, link, "z" * 30], ["w" * 10]
    item = Node("li", side)
    anchor = Node("a", item)
    side.parts, item.parts, anchor.parts = [item], ["q" * 3, anchor], ["v" * 25]
    measure(body)

    def expected(c, t, lc, lt):
        base = math.log(c / (c - lc) * lc + 35 / 195 * c + math.e)
        return c / t * math.log(c / lc * t / lt, base)

    assert math.isclose(block.density, expected(160, 1, 10, 1))
    assert math.isclose(side.density, max(0.0, expected(28, 2, 25, 1)))
    assert math.isclose(body.density, expected(195, 5, 35, 2))
    assert math.isclose(body.sum, block.density + side.density)
