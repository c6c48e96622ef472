import re

from tessaline.llm.html import HOT_BYTES, Page, extract_main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="home">
<div id="cookie-notice">We use cookies. Accept them all please, all of them, for a long long while.</div>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="ad">Buy now</div>
<div class="layout"><div class="post-12">{body}<form><input>Send</form><section class="comments"><p>Nice post, reader says at some length here</p></section></div>
<aside><p>Side</p></aside></div><footer>&copy; us</footer></body></html>"""


def test_blocks_and_boilerplate():
    page = PAGE.format(body="<h1>Title</h1><p>One <b>bold</b>\n  text&nbsp;&lt;ok&gt; &eacute;<br>next<p>Two <!-- no --><a href='x>y'>linked</a> words<ul><li>i<li>j</ul><pre>a\n  b</pre>")
    assert Page(page).read(None) == "Title\n\nOne bold text <ok> é next\n\nTwo linked words\n\ni\n\nj\n\na b"


def test_consensus_reads_short_pages(spark):
    long = " ".join(f"word{i} and more of the article text" for i in range(30))
    rows = [(i, f"https://h.example/p/{i}", PAGE.format(body=f"<h1>Title {i}</h1><p>{long}"), None) for i in range(6)]
    rows += [(10, "https://H.example/x", PAGE.format(body="<p>Tiny."), None), (11, None, None, None), (12, "bad url", "", None), (13, "http://other.example/", "plain <b>text", None), (14, "http://o2.example/", "<p></p>", None), (15, "http://o2.example/", "<p>" + "x &amp; " * 50000, None), (16, "https://h.example/y", "<body><div>Other <i>form", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert len(got) == len(rows)
    assert got[0] == f"Title 0\n\n{long}" and got[10] == "Tiny."
    assert got[11] == got[12] == got[14] == "" and got[13] == "plain text" and got[16] == "Other form"
    assert got[15] == " ".join(["x &"] * 50000)


def test_whole_table_against_its_template(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in rows.collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        parts = [" ".join(re.sub(r"<[^>]*>", " " if "br" in x else "", x).split()) for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        import html

        want[r.page_id] = "\n\n".join(" ".join(html.unescape(p).split()) for p in parts if p)
    got = {r.page_id: r.text for r in extract_main_text(rows).collect()}
    assert got == want


def test_empty_table(spark):
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hot_and_cold_hosts_read_alike(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    odd = [(-1, f"http://{'h' * HOT_BYTES}.example/", "<p>long host"), (-2, None, "<p>no url"), (-2, None, "<p>no url"), (-3, "http://quiet.example/", None)]
    rows = rows.unionAll(spark.createDataFrame(odd, rows.schema))
    read = lambda n: sorted((r.page_id, r.text, r.path or "") for r in extract_main_text(rows, hot_hosts=n).collect())
    want = read(0)
    assert len(want) == rows.count() and read(1) == want and read(1000) == want
