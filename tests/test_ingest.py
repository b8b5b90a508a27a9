"""The path from landed bodies to stored rows, and what surrounds it."""

import json
import socket

import pytest
import yaml
from pyspark.sql import functions as F
from tidemark import model
from tidemark.operators import discover, ingest
from tidemark.sources import network
from tidemark.store import Store
from tidemark.streaming import loop

from .test_engine import NOW, TAX

FEED = "<rss><channel>%s</channel></rss>"


def feed(*numbers):
    return FEED % "".join(f"<item><link>/a/{i}</link><title>Article number {i}</title><pubDate>2026-08-{i + 1:02d}</pubDate></item>" for i in numbers)


def source(sid, adapter, fallback=(), take=5):
    row = {"id": sid, "institution": sid, "name": sid, "homepage": f"https://{sid}.com", "config_json": json.dumps({"adapter": adapter, "fallback": list(fallback)}), "static_tags": [], "take_per_run": take, "enabled": True, "in_config": True, "consecutive_failures": 0}
    names = [c.split()[0] for c in model.SOURCES.replace("array<string>", "x").split(", ")]
    return tuple(row.get(n) for n in names)


def body(sid, text, attempt=0, status=200, page=0, url="u", etag=None, error=None):
    return (sid, attempt, page, url, status, etag, None, text, None, error, NOW)


RSS = {"kind": "rss", "url": "u"}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def run(spark, store, sources, bodies):
    if sources:
        store.write(sources=spark.createDataFrame(sources, model.SOURCES))
    return {r.source_id: r for r in store.ingest(spark.createDataFrame(bodies, model.LANDED), TAX, NOW).collect()}


def test_outcomes_of_each_kind(spark, store):
    selectors = {"item": "li", "link": "a@href", "title": "a"}
    fields = {"url": "u", "title": "t"}
    sources = [
        source("plain", RSS), source("json", {"kind": "json", "request": {"url": "x"}, "items_path": "r", "fields": fields}), source("badpath", {"kind": "json", "request": {"url": "x"}, "items_path": "q", "fields": fields}),
        source("page", {"kind": "html", "url": "u", "selectors": selectors}), source("map", {"kind": "sitemap", "url": "m", "max_new_per_run": 5}), source("broken", {"kind": "ftp"}), source("dead", RSS), source("notitles", RSS),
    ]
    page = "<li><a href='/p/1'>A listed article</a></li>"
    maps = "<urlset><url><loc>https://map.com/one-two</loc><lastmod>2026-08-01</lastmod></url></urlset>"
    bodies = [
        body("plain", feed(1, 2), etag="e1"), body("json", '{"r": [{"u": "/j", "t": "An article of JSON"}]}'), body("badpath", '{"r": []}'), body("page", page, url="https://page.com/list"), body("map", maps, url="m"),
        body("map", "<title>From its page</title>", url="https://map.com/one-two", page=1), body("broken", ""), body("dead", None, status=None, error="DNS lookup failed"), body("notitles", FEED % "<item><link>javascript:x</link><title>Some title</title></item>"),
    ]
    got = run(spark, store, sources, bodies)
    assert {k: (r.status, r.inserted) for k, r in got.items()} == {"plain": ("ok", 2), "json": ("ok", 1), "badpath": ("error", 0), "page": ("ok", 1), "map": ("ok", 1), "broken": ("error", 0), "dead": ("error", 0), "notitles": ("empty", 0)}
    assert "items_path q" in got["badpath"].error and got["dead"].error == "rss: DNS lookup failed" and "ftp" in got["broken"].error and got["notitles"].notes == ["unusable url"]
    kept = {r.id: r for r in store.read("sources").collect()}
    assert kept["plain"].etag == "e1" and kept["notitles"].consecutive_failures == 1 and kept["plain"].last_item_count == 2
    assert {r.title for r in store.read("items").collect()} >= {"From its page", "A listed article", "An article of JSON"} and store.read("seen_urls").count() == 1
    again = run(spark, store, None, [b for b in bodies if b[0] in ("plain", "map")])
    assert (again["plain"].status, again["plain"].duplicate_url, again["plain"].inserted) == ("ok", 2, 0) and again["map"].status == "ok" and store.read("items").count() == 5


def test_fallbacks(spark, store):
    chain = ([RSS, [{"kind": "rss", "url": "v"}]])
    sources = [source(s, chain[0], chain[1]) for s in ("first", "second", "empty", "gone", "same")]
    nothing = FEED % ""
    got = run(spark, store, sources, [
        body("first", feed(1), etag="keep"), body("second", None, status=500), body("second", feed(2), 1, etag="drop"), body("empty", None, status=500), body("empty", nothing, 1),
        body("gone", nothing), body("gone", None, 1, 404), body("same", None, status=304),
    ])
    assert {k: (r.status, r.attempt) for k, r in got.items()} == {"first": ("ok", 0), "second": ("ok", 1), "empty": ("empty", 1), "gone": ("error", 1), "same": ("not-modified", 0)}
    assert got["gone"].error == "rss: returned no items | rss: HTTP 404" and {r.id: r.etag for r in store.read("sources").collect()} == {"first": "keep", "second": None, "empty": None, "gone": None, "same": None}


def test_a_backlog_drains_by_each_sources_own_ration(spark, store):
    sources = [source("a", RSS, take=2), source("b", RSS, take=3)]
    bodies = [body("a", feed(*range(6))), body("b", feed(*range(6)))]
    runs = [run(spark, store, sources if not i else None, bodies) for i in range(4)]
    assert [r["a"].inserted for r in runs] == [2, 2, 2, 0] and [r["b"].inserted for r in runs] == [3, 3, 0, 0]
    assert [r["a"].held for r in runs] == [4, 2, 0, 0] and runs[3]["a"].duplicate_url == 6
    first = store.read("items").filter("item_id <= 2 and source_id = 'a'").collect()
    assert {r.title for r in first} == {"Article number 5", "Article number 4"}


def test_empty_run(spark, store):
    assert run(spark, store, [source("a", RSS)], []) == {} and store.read("items").count() == 0
    assert ingest.chain("a", store.read("sources").first().config_json) == ([RSS], None)


def test_streamed_bodies(spark, store, tmp_path):
    store.write(sources=spark.createDataFrame([source("a", RSS)], model.SOURCES))
    spark.createDataFrame([body("a", feed(1, 2, 3))], model.LANDED).write.parquet(f"{tmp_path}/land/x")
    q = loop.ingest(spark, store, TAX, f"file://{tmp_path}/land/*", f"file://{tmp_path}/ck", lambda: NOW, None)
    q.awaitTermination(180)
    assert q.exception() is None and store.read("items").count() == 3
    outcomes, code = loop.once(store, TAX, spark.createDataFrame([body("a", None, status=500)], model.LANDED), NOW)
    assert code == 1 and outcomes.first().status == "error"


def test_tables_grow_by_folders(spark, store):
    row = lambda i: spark.createDataFrame([("s", f"h{i}")], "source_id string, canonical_hash string")
    for i in range(4):
        store.mark_seen(row(i % 3), i)
    assert len(store._folders("seen_urls")) == 4 and store.read("seen_urls").count() == 3
    old = store.read("seen_urls")
    assert old.count() == 3 and store.compact(most=3) == 4 and len(store._folders("seen_urls")) == 1 and store.read("seen_urls").count() == 3


def test_a_store_of_the_version_before(spark, tmp_path):
    spark.createDataFrame([("s", "h", 1)], model.SEEN_URLS).write.parquet(f"{tmp_path}/seen_urls/x")
    (tmp_path / "_state.json").write_text('{"version": 2, "tables": {"seen_urls": "seen_urls/x"}}')
    s = Store(spark, f"file://{tmp_path}")
    s.mark_seen(spark.createDataFrame([("s", "i")], "source_id string, canonical_hash string"), 2)
    assert s.read("seen_urls").count() == 2 and s._state()["version"] == 3
    (tmp_path / "._state.json.crc").unlink()
    (tmp_path / "_state.json").write_text('{"version": 4}')
    with pytest.raises(ValueError):
        Store(spark, f"file://{tmp_path}")


def test_discovery_report(spark, tmp_path):
    answer = json.dumps({"hits": [{"link": f"/a/{i}", "headline": f"A headline of words {i}"} for i in range(4)]})
    page = {"url": "https://www.site.com/en/insights", "html": '<link rel="alternate" type="application/rss+xml" href="/f">', "robots": "Sitemap: https://www.site.com/own.xml"}
    maps = "<urlset><url><loc>https://www.site.com/insights/a</loc></url></urlset>"
    rows = [("https://api/x", 200, answer), ("https://site.com/f", 200, feed(1)), ("https://www.site.com/own.xml", 200, maps)]
    got = discover.discover(page, spark.createDataFrame(rows, "url string, status int, body string"), NOW)
    assert got["warnings"] == [] and got["suggestion"]["kind"] == "json" and got["feeds"][0]["how"] == "declared" and got["sitemaps"][0]["matching"] == 1
    assert yaml.safe_load(got["config"])["sources"][0]["id"] == "site-insights"
    discover.write_report(got, f"{tmp_path}/report.json")
    assert json.load(open(f"{tmp_path}/report.json"))["url"] == page["url"]
    rest = discover.discover(page, spark.createDataFrame(rows[1:], "url string, status int, body string"), NOW)
    assert rest["suggestion"] == {"kind": "rss", "url": "https://site.com/f"}


def test_proxy_and_failures():
    assert not network.through_proxy("http://127.0.0.1:8080/x") and not network.through_proxy("http://localhost/") and network.through_proxy("https://a.org", "b.org,10.0.0.0/8") and not network.through_proxy("https://x.b.org", "b.org") and not network.through_proxy("https://a.org", "*")
    outer = OSError("fetch failed")
    outer.__cause__ = socket.gaierror(-2, "no such host")
    assert network.describe_failure(outer) == "DNS lookup failed" and network.describe_failure(OSError("fetch failed")).startswith("Request failed") and network.describe_failure(TimeoutError()) == "Timed out waiting for a response"
