"""Which attributes mark an element of a page as no main text."""

import pytest

from veilspark.llm import page_text


def texts(part):
    blocks = page_text.page_blocks(f"<body><article><p>First</p>{part}</article></body>")
    return [t for t, inside, marked in blocks if inside and not marked]


@pytest.mark.parametrize(
    "tag",
    [
        '<div style="overflow:hidden">',
        '<div title="the hidden cost">',
        '<div aria-hidden="false">',
        "<div data-id=search data-role='menu'>",
        '<section id="related-work">',
        '<section id="search-algorithms">',
        '<section class="social-impact">',
        '<h2 id="comments">',
        '<a id="share">',
        "<figcaption>",
        '<div title="a > b" data-x="hidden id=comments class=ad">',
        '<div aria-label="Search results">',
    ],
)
def test_text_stays(tag):
    name = tag[1:].split()[0].rstrip(">")
    text = "Kept" if name in ("h2", "a") else "<p>Kept</p>"
    assert texts(f"{tag}{text}</{name}>") == ["First", "Kept"]


def test_reader_comments_of_a_page_go(spark):
    page = "<main><div id='comments'><p>Reader says hi</p></div><p>Body</p></main>"
    rows = spark.createDataFrame([(1, "http://x.org/a", page)], "page_id long, url string, html string")
    assert [r["text"] for r in page_text.extract(rows).collect()] == ["Body"]


@pytest.mark.parametrize(
    "tag",
    ["<div hidden>", '<div HIDDEN="">', "<div class='post comments'>", "<div class=comment-list>", "<div id='comments'>", '<section id="commentList">', '<div class="adSlot">', '<div role="navigation">', '<div data-x="1"hidden>'],
)
def test_marked_parts_go(tag):
    assert texts(f"{tag}<p>Gone</p></div>") == ["First"]


def test_page_without_article_keeps_its_text():
    blocks = page_text.page_blocks('<body style="overflow:hidden" data-role="menu"><p>Kept</p></body>')
    assert blocks == [("Kept", False, False)]


def test_ids_outside_articles_mark():
    assert page_text.page_blocks('<div id="cookie-box">Gone</div>') == [("Gone", False, True)]
