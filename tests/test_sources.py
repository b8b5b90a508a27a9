"""Landed bodies to raw items, and configuration."""

import gzip
import re

import pytest
import yaml
from pyspark.sql import functions as F

from tidemark import model, queries
from tidemark.sources import config, feeds, html, interfaces, pages, robots

from .conftest import DATA

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>c</title>
<item><title> One &amp; only </title><link>https://e.com/1?utm_source=r</link><description>&lt;p&gt;Some text&lt;/p&gt;</description><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate><category>Bonds</category><category> </category><dc:subject>Rates</dc:subject></item>
<item><title>By guid</title><guid>https://e.com/2</guid><content:encoded>body</content:encoded><dc:date>2024-05-02</dc:date></item>
<item><title>No link</title><guid>x-1</guid></item><item><link>https://e.com/3</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="https://e.com/self"/><link href="https://e.com/a"/><published>2024-05-01T00:00:00Z</published><category term="t"/></entry></feed>"""
MAP = """<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://n"><url><loc> https://e.com/a </loc><lastmod>2024-05-01</lastmod></url><url><loc>https://e.com/b</loc><news:news><news:publication_date>2024-05-02</news:publication_date></news:news></url><url><loc/></url></urlset>"""
INDEX = """<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://e.com/s1.xml</loc></sitemap></sitemapindex>"""
PAGE = """<html><head><title>Page title - Site</title><meta property="og:title" content="The  title"><meta name="description" content="A &amp; b"><meta name="content_publishedAt" content="2024-05-03"><meta name="publisher" content="Some 2024 house">
<meta property="article:section" content="Markets"><meta name="keywords" content="a, b"><script type="application/ld+json">{"@graph": [{"headline": "LD", "datePublished": "2024-05-01", "keywords": ["b", {"name": "c"}]}]}</script><script type="application/ld+json">{broken</script></head>
<body><time datetime="2024-05-09">x</time></body></html>"""
LIST = """<ul><li class="card big"><a class="t" href="/x">First <b>title</b></a><time datetime="2024-05-01">d</time><p>Sum</p><li class="card"><a class="t">no link</a></li><li class="card"><a class="t" href="/y"> </a></li></ul>"""


def landed(spark, body, **more):
    return spark.createDataFrame([("s", "https://e.com/in/", body, more.get("raw"), more.get("page", 0))], "source_id string, url string, body string, bytes binary, page int")


def test_feeds(spark):
    a, b = feeds.feed_items(landed(spark, RSS)).orderBy("source_pos").collect()
    assert (a.url, a.title, a.summary, a.published_raw, a.categories) == ("https://e.com/1?utm_source=r", "One & only", "Some text", "Wed, 01 May 2024 10:00:00 GMT", ["Bonds", "Rates"])
    assert (b.url, b.summary, b.published_raw) == ("https://e.com/2", "body", "2024-05-02")
    c = feeds.feed_items(landed(spark, ATOM)).first()
    assert (c.url, c.published_raw, c.categories) == ("https://e.com/a", "2024-05-01T00:00:00Z", ["t"])
    assert [(r.error[:7], r.retry) for r in feeds.feed_problems(landed(spark, "<!DOCTYPE html><p>")).collect()] == [("an HTML", False)]
    assert feeds.feed_problems(landed(spark, "<rss>")).first().retry and feeds.feed_items(landed(spark, None)).count() == 0


def test_sitemaps(spark):
    rows = feeds.sitemap_entries(landed(spark, MAP)).orderBy("source_pos").collect()
    assert [(r.loc, r.lastmod, r.is_index) for r in rows] == [("https://e.com/a", "2024-05-01", False), ("https://e.com/b", "2024-05-02", False)]
    assert feeds.sitemap_entries(landed(spark, INDEX)).first().is_index
    packed = landed(spark, None, raw=bytearray(gzip.compress(MAP.encode())))
    assert feeds.sitemap_entries(packed).count() == 2
    assert feeds.sitemap_entries(landed(spark, None, raw=bytearray(b"\x1f\x8bbroken"))).count() == 0


def test_article_meta(spark):
    m = pages.article_meta(PAGE)
    assert m == {"title": "The title", "summary": "A & b", "published_raw": "2024-05-01", "categories": ["Markets", "b", "c", "a"]}
    assert pages.article_meta(PAGE.replace("datePublished", "other"))["published_raw"] == "2024-05-03"
    assert pages.article_meta(None) == {"title": None, "summary": None, "published_raw": None, "categories": []}
    entries = spark.createDataFrame([("s", 0, "https://e.com/a-b", "2024-01-01"), ("s", 1, "https://e.com/c-d.html", "2024-01-02")], "source_id string, source_pos long, loc string, lastmod string")
    bodies = spark.createDataFrame([("https://e.com/a-b", PAGE), ("https://e.com/c-d.html", "<p>")], "url string, body string")
    a, b = pages.article_items(entries, bodies, 1_790_000_000_000).orderBy("source_pos").collect()
    assert (a.title, a.published_raw, a.date_is_weak) == ("The title", "2024-05-01", False) and (b.title, b.published_raw, b.date_is_weak) == ("C d", "2024-01-02", True)


def test_listings(spark):
    selectors = {"item": "li.card", "link": "a.t@href", "title": "a.t", "date": "time@datetime", "summary": "p"}
    r = pages.listing_items(landed(spark, LIST), selectors).collect()
    assert [(x.url, x.title, x.summary, x.published_raw) for x in r] == [("https://e.com/x", "First title", "Sum", "2024-05-01")]
    assert pages.listing(LIST, selectors, "https://e.com")["notes"] == ["1 without a usable link", "1 without a title"]
    assert pages.listing("", selectors, None)["notes"] == ["item selector li.card matched nothing"]


def test_selectors():
    t = html.parse('<div id=a><p class="x y">1</p><section><p data-k="v">2</p></section><br>3</div>')
    pick = lambda css: [n.text for n in t.select(css)]
    assert pick("p.x.y") == ["1"] and pick("div > p") == ["1"] and pick("#a p") == ["1", "2"] and pick('p[data-k="v"], p.x') == ["1", "2"] and pick("section > p[data-k]") == ["2"]
    assert html.read(t, "p@data-k") is None and html.read(t, "section p@data-k") == "v"


def test_json_pages(spark):
    body = '{"r": [{"u": "/1", "t": "One", "d": 1714557600000, "c": [{"n": "x"}, {"n": "y"}]}, {"u": "/2"}, {"u": "/1", "t": "Again"}]}'
    df = landed(spark, body).union(landed(spark, '{"r": [{"u": "/3", "t": "Three", "d": "2024-05-01", "c": []}]}', page=1)).union(landed(spark, '{"r": [{"u": "/4", "t": "Four"}]}', page=2))
    rows = interfaces.json_items(df, "r", {"url": "u", "title": "t", "published_at": "d", "categories": "c[].n"}, page_size=3).orderBy("source_pos").collect()
    assert [(r.url, r.title, r.published_kind, r.categories) for r in rows] == [("/1", "One", "number", ["x", "y"]), ("/3", "Three", "string", [])]
    assert interfaces.records(landed(spark, '{"r": 1}'), "r").first().bad and interfaces.offsets(10, 3) == [0, 10, 20] 
    assert interfaces.token({"kind": "from_page", "token_regex": r"k='(\w+)'"}, "k='abc'") == "abc" and interfaces.token({}) is None and interfaces.token({"kind": "env", "var": "V"}, env={"V": "x"}) == "x"
    for auth in ({"kind": "env", "var": "V"}, {"kind": "from_page", "token_regex": "k=(x)"}):
        with pytest.raises(interfaces.AuthError):
            interfaces.token(auth, "k=y", {})


def test_a_record_without_title_does_not_take_its_address(spark):
    rows = interfaces.json_items(landed(spark, '[{"u": "/a"}, {"u": "/a", "t": "good"}]'), "", {"url": "u", "title": "t"}).collect()
    assert [(r.url, r.title) for r in rows] == [("/a", "good")]
    bad = landed(spark, '{"r": 1}').union(landed(spark, "no", page=1))
    assert {r.error for r in interfaces.json_problems(bad, "r").collect()} == {"not JSON", "items_path r is not an array"}


def test_implausible_own_dates_are_weak(spark):
    entries = spark.createDataFrame([("s", 0, "https://e.com/a", "2024-01-01")], "source_id string, source_pos long, loc string, lastmod string")
    body = spark.createDataFrame([("https://e.com/a", '<meta name="date" content="1970-05-01">')], "url string, body string")
    r = pages.article_items(entries, body, 1_790_000_000_000).first()
    assert (r.published_raw, r.date_is_weak) == ("2024-01-01", True)


def test_robots(spark):
    text = "User-agent: a\nUser-agent: b\nDisallow: /x # c\nAllow: /x/y\n\nUser-agent: *\nDisallow: /\nSitemap: z\n"
    assert robots.parse_robots(text, "B") == {"allow": ["/x/y"], "disallow": ["/x"]} and robots.parse_robots(text, "c")["disallow"] == ["/"]
    rules = spark.createDataFrame([("https://e.com", False, "/x"), ("https://e.com", True, "/x/y"), ("https://e.com", False, "/*.pdf$")], "origin string, allow boolean, path string")
    u = spark.createDataFrame([(x,) for x in ("https://e.com/x/1", "https://e.com/x/y/1", "https://e.com/d.pdf", "https://e.com/d.pdf?a", "https://f.com/x")], "url string")
    assert {r.url: r.allowed for r in robots.allowed(u, rules).collect()} == {"https://e.com/x/1": False, "https://e.com/x/y/1": True, "https://e.com/d.pdf": False, "https://e.com/d.pdf?a": True, "https://f.com/x": True}


TAX = """
facets: [{id: asset, label: Asset, values: [credit, fx]}]
native_map: {Bonds: [asset:credit]}
rules: [{tag: asset:fx, any: ['\\bfx\\b']}]
"""
SOURCES = """
defaults: {poll_minutes: 60, take_per_run: 30}
sources:
  - {id: a, institution: A, name: A feed, homepage: 'https://a.com', static_tags: [asset:fx, asset:no], adapter: {kind: rss, url: 'https://a.com/feed'}}
  - {id: b, institution: B, name: B map, homepage: 'https://b.com', enabled: false, take_per_run: 40, adapter: {kind: sitemap, url: 'https://b.com/s.xml'}, fallback: [{kind: rss, url: u}]}
"""


def test_configuration(spark):
    tax = config.load_taxonomy(TAX)
    rows = config.load_sources(SOURCES, tax)
    assert [(r["id"], r["poll_minutes"], r["take_per_run"], r["enabled"]) for r in rows] == [("a", 60, 30, True), ("b", 60, 40, False)]
    assert config.unknown_static_tags(rows, tax) == ["a: unknown tag asset:no"]
    df = config.sources_frame(spark, rows)
    assert df.schema.simpleString() == spark.createDataFrame([], model.SOURCES).schema.simpleString() and df.filter(F.col("adapter_kind") == "rss").count() == 1


@pytest.mark.parametrize("bad, word", [("sources: [{id: a, adapter: {kind: rss, url: u}}, {id: a, adapter: {kind: rss, url: u}}]", "twice"), ("sources: [{id: a, adapter: {kind: ftp}}]", "adapter"), ("sources: [{id: a, poll_minutes: 2, adapter: {kind: rss, url: u}}]", "poll"),
                                       ("sources: [{id: a, take_per_run: 5, adapter: {kind: sitemap, url: u}}]", "stores 5"), ("sources: [{id: a, adapter: {kind: html, url: u}}]", "selectors")])
def test_bad_configuration(bad, word):
    with pytest.raises(config.ConfigError, match=word):
        config.load_sources(bad)


def test_bad_taxonomy():
    with pytest.raises(config.ConfigError, match="asset:none"):
        config.load_taxonomy(TAX.replace("asset:fx, any", "asset:none, any"))


@pytest.mark.parametrize("name", ["config_rows", "undeclared_tags", "config_errors", "suggestions"])
def test_texts_of_one_file_are_read_by_many_tasks(spark, name):
    out = queries.queries()[name](spark, DATA)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_configurations_are_read_by_libyaml():
    assert not yaml.__with_libyaml__ or config.LOADER is yaml.CSafeLoader
    assert yaml.load("a: [1, no, 0x1f, ~, 1_000, 2024-01-01, '\\u00e9']\nb: &x {c: 1.5}\nd: {<<: *x}", Loader=config.LOADER) == yaml.safe_load("a: [1, no, 0x1f, ~, 1_000, 2024-01-01, '\\u00e9']\nb: &x {c: 1.5}\nd: {<<: *x}")


@pytest.mark.parametrize("given, records, size", [(("10000", "64m"), "1000", str(1 << 20)), (("-1", "2147483646"), "1000", str(1 << 20)), (("50", "4k"), "50", "4k")])
def test_python_gets_small_batches_of_bodies(spark, given, records, size):
    """Bodies go to Python by batches of bounded rows and bytes; a session's smaller bounds stay."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, given, strict=True):
            spark.conf.set(n, v)
        out = feeds.feed_items(spark.createDataFrame([("s", RSS)] * 3, "source_id string, body string"))
        assert [spark.conf.get(n) for n in names] == [records, size] and out.count() == 6
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def test_bodies_are_parsed_once_a_task(spark):
    """Every node of Python in a plan is a worker more for each task; a parser that is asked for again is one."""
    rows = spark.createDataFrame([("s", "u", RSS, None)], "source_id string, url string, body string, bytes binary")
    read = [feeds.feed_items(rows), feeds.feed_problems(rows), pages.listing_items(rows, {"item": "li"}), feeds.sitemap_entries(rows)]
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in read]
    assert [p.count("ArrowEvalPython") for p in plans] == [1, 1, 1, 2]
    assert [p.count("pythonUDF") > 0 and re.sub(r"(?m)^(?!.*ArrowEvalPython).*$", "", p).count("parse_sitemap(") for p in plans] == [0, 0, 0, 1]
