"""Pages whose text is spread over nested containers keep all of it."""

import time
import tracemalloc

import pytest

from tessaline.llm.html import Page, extract_main_text

LEAD, REST = "lead " * 70, "rest " * 130


@pytest.mark.parametrize("page", [
    f"<body><div class=post><h1>Title</h1><p>{LEAD}</p><div class=entry>{REST}</div></div></body>",
    f"<body><main><h1>Title</h1><p>{LEAD}</p><article>{REST}</article></main></body>",
    f"<body><div><h1>Title</h1><p>{LEAD}</p><blockquote>{REST}</blockquote></div></body>",
    f"<body><h1>Title</h1><p>{LEAD}</p><table><tr><td>{REST}</td></tr></table></body>",
])
def test_heading_and_lead_outside_the_inner_container(page):
    assert Page(page).read(None) == f"Title\n\n{LEAD.strip()}\n\n{REST.strip()}"


def test_link_lists_outside_the_text_stay_out():
    assert Page("<body><ul><li><a href='/a'>Home</a><li><a href='/x'>Other</a></ul><div class=post><p>Text of it</p></div></body>").read(None) == "Text of it"


def test_host_path_does_not_cut_a_page(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class=post>{REST}</div></body>") for i in range(5)]
    rows.append((9, "http://h.example/9", f"<body><div class=post>short block</div><div class=story>{LEAD}</div></body>"))
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == f"short block\n\n{LEAD.strip()}" and got[0] == REST.strip()


@pytest.mark.parametrize("page", [
    f"<body><div class='content has-sidebar'><p>{LEAD}</p><p>{REST}</p></div><div class=sidebar>Side</div></body>",
    f"<body><div id=page class=nav-fixed><article><p>{LEAD}</p><p>{REST}</p></article><div class=comments>Nice</div></div></body>",
    f"<body><div class=share-layout><p>{LEAD}</p><p>{REST}</p></div></body>",
])
def test_wrappers_with_a_boilerplate_word_keep_the_article(page):
    assert Page(page).read(None) == f"{LEAD.strip()}\n\n{REST.strip()}"


def test_long_comments_of_a_short_page_stay_out():
    assert Page(f"<body><article><h1>T</h1><p>Short</p></article><div class=comments><article class=comment>{REST}</article></div></body>").read(None) == "T\n\nShort"


@pytest.mark.parametrize("name", ["page with-sidebar", "no-sidebar content", "search-result-page", "social-science", "legal-blog", "comment-free", "single related-post"])
def test_names_of_wrappers_do_not_lose_the_article(name):
    assert Page(f"<body><div class='{name}'><article><p>{LEAD}</p><p>{REST}</p></article></div></body>").read(None) == f"{LEAD.strip()}\n\n{REST.strip()}"


@pytest.mark.parametrize("source", [
    "<a '" * 200_000, "<a b=\"" * 200_000, "<a b='>'" * 100_000, "<a b=\">\"" * 100_000 + "'", "<![CDATA[" * 100_000, "<!" * 200_000, "<" * 500_000, "<!--" * 200_000, "<script>" * 100_000,
    "<div class=x>" * 50_000 + "deep text" + "</div>" * 50_000, "<b>" * 50_000 + "deep text" + "</i>" * 50_000, "<p><b>" * 50_000, "<li><blockquote>" * 30_000 + "</li>" * 30_000,
    "<div class=ad>" * 30_000 + "<h1>x</h1>" * 30_000, "<td><dd>" * 50_000 + "x", "&" * 300_000, "<p class='" + "class= " * 100_000 + "'>x",
])
def test_any_markup_takes_linear_time(source):
    begin = time.process_time()
    page = Page(source)
    page.read(page.best()[0] + "/div")
    assert time.process_time() - begin < 6


def test_deep_nesting_takes_linear_memory():
    tracemalloc.start()
    Page("<div>" * 50_000 + "<p>text" * 10)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_unclosed_quotes_keep_the_text():
    assert Page("<body><div><p title='>One</p><p>Two</p></div>").read(None) == "One\n\nTwo"
    assert Page("<p data-class='ad' data-x=\"class=menu\">Kept</p>").read(None) == "Kept"


def test_consensus_decides_where_a_page_alone_would_be_misread(spark):
    """Pages of one host without article or main: on a short page, the unlinked note beside the story would be read with it."""
    shape = "<body><div class=wrap><div class=story><h1>{0}</h1><p>{1}</p></div></div></body>"
    rows = [(i, f"http://h.example/{i}", shape.format(f"Title {i}", REST)) for i in range(8)]
    rows.append((9, "http://h.example/9", "<body><div class=wrap><div class=story><p>Brief.</p></div><p><a href=x>More of our stories to read</a></p></div></body>"))
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Brief." and got[0] == f"Title 0\n\n{REST.strip()}"


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "http://h.example/", f"<p>{REST}", "x", 3, "h")] * 3
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, path string, votes int, host string")).collect()
    assert [r.text for r in got] == [REST.strip()] * 3
