import pytest
from pyspark.sql import functions as F

from sparkwright.llm import exact_search, html_text, warc
from sparkwright.llm.exact_search import top_inner_products
from sparkwright.llm.queries import QUERIES
from sparkwright.llm.workspace import Workspace
from tests.llm import brute


def test_search_equals_brute_force(spark, small):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op3_kdtree_topk"](spark, small).collect())) == brute.top_products(rows, 10)


def test_search_odd_rows(spark):
    """Nulls, repeated ids with equal and other vectors, vectors of several lengths, an empty one."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (None, [9.0, 9.0]), (100, [-1.0, 2.0]), (100, [-1.0, 2.0]), (100, [3.0, 1.0, 5.0]), (7, [float("inf"), 0.0]), (8, [2.0]), (9, []), (200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("row", F.lit(7))
    got = sorted(tuple(r) for r in top_inner_products(df, df.where("vec_id % 100 = 0"), k=3).collect())
    assert got == brute.top_products(rows, 3)
    assert top_inner_products(df.limit(0), df.limit(0)).count() == 0
    only = df.where("vec_id = 0")
    assert top_inner_products(only, only).count() == 0


@pytest.mark.parametrize("size", [0.01, 1e5, 1e9, 1e10, 1e300])
def test_search_of_large_components_is_exact(spark, monkeypatch, size):
    """Scores beyond 2 ** 53 and beyond the range of longs, over many shards."""
    import random

    monkeypatch.setattr(exact_search, "SHARD", 50)
    random.seed(1)
    rows = [(i, [random.choice((-1, 1, 1)) * size * (1 + random.random()) for _ in range(8)]) for i in range(300)] + [(1000 + i, [size] * 8) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_inner_products(df, df.where("vec_id % 100 = 0"), k=7).collect())) == brute.top_products(rows, 7)


def test_html_equals_articles(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op4_html_text"](spark, small).collect()}
    assert got == {i: (brute.page_text(h), len(brute.page_text(h))) for i, h in pages.items()}


def test_html_template_words_go_where_no_article_is_named(spark):
    """A class of a tag and a text on some pages is the template's; a passage that pages merely share is data."""
    pages = []
    for i in range(40):
        promo = "<section class=box><h4>Read this next</h4></section>" if i % 2 else ""
        shared = "<p>A passage that many pages share.</p>" if i % 3 else ""
        pages.append((i, "http://h.example/x", f"<html><body><div><p>Own words {i} of page {i}.</p>{shared}{promo}<div class='comments'><p>Nice {i}</p></div></div></body></html>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_main_text(df).collect()}
    assert got[1] == "Own words 1 of page 1. A passage that many pages share."
    assert got[3] == "Own words 3 of page 3."


def site(pages, body):
    return [(i, "http://site.example/x", f"<html><body class='no-sidebar'>{body(i)}</body></html>") for i in range(pages)]


def test_html_slot_of_the_template_decides(spark):
    """Pages without an article element: what varies on every page beside the article is told from it by the host's
    template alone. Without the template the result is another."""
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    body = lambda i: f"<div class='layout has-header'><div class='x1'><p>Today {words(i, 4)}</p></div><div class='x2'><h2>T{i}</h2><p>{words(i, 40 + i)}</p><p>End {i}.</p></div><div class='x3'><p>Also {words(i + 7, 5)}</p></div></div>"
    df = spark.createDataFrame(site(12, body), "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_main_text(df).collect()}
    assert got == {i: f"T{i} {words(i, 40 + i)} End {i}." for i in range(12)}
    page = df.where("page_id = 3").first().html
    assert html_text.main_text(page, set(), html_text.Paths()) == f"Today {words(3, 4)} {got[3]} Also {words(10, 5)}"


def test_html_names_are_roles_only_as_a_whole():
    paths = html_text.Paths()
    text = lambda page: html_text.main_text(page, set(), paths)
    assert text('<body class="no-sidebar"><article><p>Hello</p></article></body>') == "Hello"
    assert text('<div class="layout has-header"><article><p>Hello</p></article></div>') == "Hello"
    assert text('<article class="related-work"><p>Hello</p></article>') == "Hello"
    assert text('<div class="sidebar"><article><p>Hello</p></article></div>') == "Hello"
    assert text('<article><p>Hello</p><div class="comment-list"><article><p>No</p></article></div></article><div class="comments"><article>No</article></div>') == "Hello"
    assert text('<nav><article>No</article></nav><p>Yes</p><div id="site-footer">No</div><div class="cookie notice">No</div>') == "Yes"
    assert text('<article class="comment"><p>No</p></article><main><p>Yes</p></main>').endswith("Yes")


def test_html_odd_pages():
    paths = html_text.Paths()
    text = lambda page: html_text.main_text(page, set(), paths)
    assert text("") == ""
    assert text("no markup &amp; more") == "no markup & more"
    assert text("<article>a<b>b</b>c<p>d\n e&nbsp;f<script>x('</p>')</script><!-- y --></article>z") == "abc d e f"
    assert text("<article><p>kept<aside>not</aside><form>not</form><p>too") == "kept too"
    assert text("<div 'broken <p>x") == "x"
    assert text("<p>" * 30_000 + "deep") == "deep"


def test_html_of_odd_markup_takes_linear_time():
    import time

    def seconds(page):
        began = time.perf_counter()
        html_text.main_text(page, set(), html_text.Paths())
        return time.perf_counter() - began

    for part in ("<div></span>", "<a '", "<p", "<div>", "<!--", "</div>"):
        seconds(part * 1000)
        assert seconds(part * 40_000) < 12 * seconds(part * 10_000) + 0.5


def test_html_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>"), (2, "http://a/", "")], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("tokens", F.lit(2))
    got = {(r.page_id, r.text, r.n_chars) for r in html_text.extract_main_text(df).collect()}
    assert got == {(1, "", 0), (None, "x", 1), (2, "", 0)}
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def expected_warc(pages):
    from hashlib import sha256

    first = {}
    for i, h in pages:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, h in pages:
        b = (h or "").encode()
        refers = first.get(b) if i is not None and first.get(b) != i else None
        out.append((i, len(b), sha256(b).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_warc_round_trip(spark, small):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op7_warc_round_trip"](spark, small).collect()), key=str) == expected_warc(pages)


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_warc_rejects_magic_in_payloads(spark, block):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [(1, fake * 9), (2, fake * 9), (3, "é" * 400), (4, None), (5, ""), (None, fake * 9), (6, "x" * 99), (7, "x" * 99), (8, "WARC/1.1\r\n" * 40), (3, "é" * 400)]
    df = spark.createDataFrame([(i, "http://a\r\nb", h) for i, h in pages], "page_id long, url string, html string").withColumn("key", F.lit(1))
    ws = Workspace(spark, "test")
    warc.write_warc(ws, df, ws.file("a"))
    got = warc.read_warc(ws, ws.file("a"), block=block)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected_warc(pages)
    payloads = {(r.page_id, bytes(r.payload)) for r in got.where("record_type = 'response'").collect()}
    assert (1, (fake * 9).encode()) in payloads
    warc.write_warc(ws, df.limit(0), ws.file("b"))
    assert warc.read_warc(ws, ws.file("b")).count() == 0


@pytest.mark.parametrize("block", [1000, 70_000, 1 << 20])
def test_warc_keeps_very_long_urls(spark, block):
    """Headers longer than a first read, at a file's start, where a block is entered, one after another and at the end."""
    long = lambda n: "data:," + "u" * n
    pages = [(0, long(300_000), "a"), (1, "http://a/", "b" * 200), (2, long(66_000), ""), (3, long(1_200_000), None), (4, "http://b/", "WARC/1.1\r\n" * 9), (5, long(70_000), "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    ws = Workspace(spark, "test")
    for name, rows in (("first", df.orderBy("page_id")), ("last", df.orderBy(F.desc("page_id")))):
        warc.write_warc(ws, rows, ws.file(name))
        got = warc.read_warc(ws, ws.file(name), block=block).collect()
        assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == [(i, u, h or "") for i, u, h in pages]
