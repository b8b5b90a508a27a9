"""Queries over bodies made of the driver's tables: sources, the ingest path, discovery, configuration, state."""

from __future__ import annotations

import gzip
import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import dates, paths, regexes, urls
from tidemark.functions.python import arrow, spread
from tidemark.lineage import settled, shared_dir
from tidemark.model import DAY_MS, ItemQuery
from tidemark.operators import dedupe, discover, health, ingest, normalise, prune, rations
from tidemark.operators.tagging import Taxonomy
from tidemark.plans import panel
from tidemark.queries import HOUR, START, TAXONOMY, _registry, _t, _titled, articles
from tidemark.sources import config, feeds, interfaces, network, pages, robots, sitemaps
from tidemark.streaming import loop

NOW = START + 3650 * DAY_MS


def _udf(f, kind):
    return arrow(f, kind)


def _customers(spark, sf_dir) -> DataFrame:
    """Keys of customer, dealt out: each stands for a text that Python reads."""
    return spread(_t(spark, sf_dir, "customer").select("c_custkey"))


def _joined(rows: DataFrame, by: str, order: str, text, sep: str = "") -> DataFrame:
    """by and text: the texts of each group, in order, as one. Groups are bounded: a body's worth of rows."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda s: s["t"]), sep).alias("text"))


def _day(n):
    return F.date_format(F.timestamp_millis(F.lit(START) + n * DAY_MS), "yyyy-MM-dd")


def _docs(spark, sf_dir, each: int) -> DataFrame:
    """documents in bodies of so many."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return d.withColumn("body_of", F.concat(F.lit("s"), F.floor(F.col("doc_id") / each).cast("string")))


# Sources.


def _feeds(spark, sf_dir, each: int = 20, extra=None) -> DataFrame:
    """RSS bodies: links, addresses in guid alone, items without title."""
    d, k = _docs(spark, sf_dir, each), F.col("doc_id") % 4
    link = F.concat(F.lit("https://www."), "source", F.lit(".example/"), "lang", F.lit("/"), "doc_id", F.lit("/?utm_source=feed&amp;b=1"))
    item = F.concat(
        F.lit("<item>"), F.when(k == 1, F.concat(F.lit('<guid isPermaLink="false">'), link, F.lit("</guid>"))).otherwise(F.concat(F.lit("<link> "), link, F.lit(" </link>"))),
        F.when(k == 2, F.lit("")).otherwise(F.concat(F.lit("<title>Report &amp; review "), "doc_id", F.lit("</title>"))), F.lit("<description>&lt;p&gt;On "), "lang", F.lit(" &amp;amp; more&lt;/p&gt;</description><pubDate>"),
        _day(F.col("doc_id") % 1000), F.lit("</pubDate><category> "), "lang", F.lit(" </category><category></category><dc:subject>"), "source", F.lit("</dc:subject></item>"),
    )
    head = '<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Feed</title>'
    return _joined(d, "body_of", "doc_id", item).select(F.col("body_of").alias("source_id"), F.concat(F.lit(head), "text", F.lit("</channel></rss>")).alias("body"))


def feed_scan(spark, sf_dir):
    return feeds.feed_items(_feeds(spark, sf_dir)).select("source_id", "source_pos", "url", "title", "summary", "published_raw", F.array_join("categories", ",").alias("categories"))


def sitemap_parse(spark, sf_dir):
    """Sitemaps of 20 pages each, every other one gzipped."""
    p = _t(spark, sf_dir, "pages").withColumn("body_of", F.floor(F.col("page_id") / 20))
    loc = F.regexp_replace("url", "&", "&amp;")
    date = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<lastmod>"), _day(F.col("page_id")), F.lit("</lastmod>"))).otherwise(F.concat(F.lit("<n:news><n:publication_date>"), _day(F.col("page_id")), F.lit("</n:publication_date></n:news>")))
    bodies = _joined(p, "body_of", "page_id", F.concat(F.lit("<url><loc> "), loc, F.lit(" </loc>"), date, F.lit("</url>")))
    text = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:n="http://www.google.com/schemas/sitemap-news/0.9">'), "text", F.lit("</urlset>"))
    packed = _udf(lambda t: gzip.compress(t.encode()), "binary")
    odd = F.col("body_of") % 2 == 1
    landed = bodies.select(F.col("body_of").cast("string").alias("source_id"), F.lit("u").alias("url"), F.when(odd, text).alias("body"), F.when(~odd, packed(text)).alias("bytes"))
    return feeds.sitemap_entries(landed).select("source_id", "is_index", "source_pos", "loc", "lastmod")


def _mapped(spark, sf_dir) -> DataFrame:
    """documents as sites of 80 articles, whose index has seven sitemaps; landed as a run over them would fetch them."""
    d = _docs(spark, sf_dir, 80).withColumns({"child": F.col("doc_id") % 7, "site": F.concat(F.lit("https://"), "body_of", F.lit(".example"))})
    loc = F.concat("site", F.when(F.col("doc_id") % 9 == 0, "/legal/").otherwise("/en/"), "doc_id", F.lit(".html"))
    sitemap = F.concat("site", F.lit("/map"), F.col("child").cast("string"), F.lit(".xml"))
    entry = F.concat(F.lit("<url><loc>"), loc, F.lit("</loc><lastmod>"), _day(F.col("doc_id") % 31), F.lit("</lastmod></url>"))
    own = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit('<meta property="article:published_time" content="'), _day(F.col("doc_id") % 500), F.lit('">'))).when(F.col("doc_id") % 2 == 0, F.lit('<meta name="date" content="1975-01-01">')).otherwise("")
    html = F.concat(F.lit("<html><head><title>Page "), "doc_id", F.lit("</title>"), own, F.lit("</head></html>"))
    articles_ = d.select(F.col("body_of").alias("source_id"), loc.alias("url"), F.when(F.col("doc_id") % 11 == 0, 500).otherwise(200).alias("status"), html.alias("body"))
    parts = _joined(d.withColumn("__by", F.concat_ws("|", "body_of", sitemap)), "__by", "doc_id", entry)
    children = parts.select(F.split_part("__by", F.lit("|"), F.lit(1)).alias("source_id"), F.split_part("__by", F.lit("|"), F.lit(2)).alias("url"), F.lit(200).alias("status"), F.concat(F.lit("<urlset>"), "text", F.lit("</urlset>")).alias("body"))
    listed = d.select("body_of", "child", "site").distinct()
    index = _joined(listed, "body_of", "child", F.concat(F.lit("<sitemap><loc>"), sitemap, F.lit("</loc><lastmod>"), _day((F.col("child") * 3) % 7), F.lit("</lastmod></sitemap>")))
    index = index.select(F.col("body_of").alias("source_id"), F.lit("index").alias("url"), F.lit(200).alias("status"), F.concat(F.lit("<sitemapindex>"), "text", F.lit("</sitemapindex>")).alias("body"))
    return index.unionByName(children).unionByName(articles_).withColumn("bytes", F.lit(None).cast("binary"))


_MAP = {"kind": "sitemap", "url": "index", "include": ["/EN/"], "exclude": ["/en/5"], "max_new_per_run": 9, "max_undated_per_run": 2}


def _seen(spark, sf_dir) -> DataFrame:
    d = _docs(spark, sf_dir, 80).filter("doc_id % 5 = 0")
    url = F.concat(F.lit("https://"), "body_of", F.lit(".example/en/"), "doc_id", F.lit(".html"))
    return d.select(F.col("body_of").alias("source_id"), urls.url_hash(urls.canonical_url(url)).alias("canonical_hash"), F.lit(0).cast("long").alias("seen_at"))


def sitemap_scan(spark, sf_dir):
    """Index, newest children, filters, newest entries, unseen ones, pages, and the share of undated ones."""
    items, _, _ = sitemaps.scan_one(settled(_mapped(spark, sf_dir)), _MAP, lambda _: _seen(spark, sf_dir), NOW)
    return items.select("source_id", "source_pos", "url", "title", "published_raw", "date_is_weak")


def sitemap_visited(spark, sf_dir):
    _, visited, _ = sitemaps.scan_one(settled(_mapped(spark, sf_dir)), _MAP, lambda _: _seen(spark, sf_dir), NOW)
    return visited.groupBy("source_id").agg(F.count("*").alias("visited"))


def sitemap_children(spark, sf_dir):
    """The newest five of each site's sitemaps."""
    listed = _docs(spark, sf_dir, 80).select(F.col("body_of").alias("source_id"), (F.col("doc_id") % 7).alias("source_pos")).distinct().withColumn("date_key", (F.col("source_pos") * 3) % 7)
    return rations.child_sitemaps(listed).select("source_id", "source_pos", F.col("rank").cast("long").alias("rank"))


def html_listing(spark, sf_dir):
    """Listing pages of 20 cards, some without link or title."""
    d = _docs(spark, sf_dir, 20)
    link = F.when(F.col("doc_id") % 5 != 4, F.concat(F.lit('<a class="t" href="../a/'), "doc_id", F.lit('?x=1">'), F.when(F.col("doc_id") % 7 != 6, F.concat(F.lit(" Card <b>"), "doc_id", F.lit("</b> &amp; more"))).otherwise(""), F.lit("</a>"))).otherwise("<a class='t'>No link</a>")
    card = F.concat(F.lit('<li class="card big">'), link, F.lit('<time datetime="'), _day(F.col("doc_id") % 900), F.lit('">x</time><p>On '), "lang", F.lit("</p>"), F.when(F.col("doc_id") % 2 == 0, "</li>").otherwise(""))
    bodies = _joined(d, "body_of", "doc_id", card).select(F.col("body_of").alias("source_id"), F.concat(F.lit("https://"), "body_of", F.lit(".example/list/all")).alias("url"), F.concat(F.lit("<html><body><ul>"), "text", F.lit("</ul><li class='card'>")).alias("body"))
    found = pages.listing_items(bodies, {"item": "ul > li.card", "link": "a.t@href", "title": ".t", "date": "time@datetime", "summary": "p"})
    return found.select("source_id", "source_pos", "url", "title", "summary", "published_raw")


def article_meta(spark, sf_dir):
    """A page per document that states title, date and categories in one of several ways."""
    d, k = _docs(spark, sf_dir, 20), F.col("doc_id") % 5
    day = _day(F.col("doc_id") % 700)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and p not in ("doc_id", "lang", "source") else F.col(p) if isinstance(p, str) else p for p in parts])
    head = (
        F.when(k == 0, say('<meta property="og:title" content="Open &amp; ', "doc_id", '"><meta name="twitter:title" content="no"><meta property="article:published_time" content="', day, '"><meta property="article:section" content="', "lang", '">'))
        .when(k == 1, say('<meta name="twitter:title" content="Tweet ', "doc_id", '"><meta name="pubdate" content="', day, '"><meta name="keywords" content="', "lang", ", ", "source", " , ", "lang", '">'))
        .when(k == 2, say('<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@graph": [{"headline": "Linked ', "doc_id", '", "datePublished": "', day, '", "keywords": "a, b", "about": [{"name": "', "source", '"}]}]}</script>'))
        .when(k == 3, say('<meta name="modified-date-published" content="2001-01-01"><meta name="x-publish-date" content="', day, '">'))
        .otherwise(say('<script type="application/ld+json">{"dateModified": "', day, '"}</script>'))
    )
    html = say("<html><head>", head, "<title> Tag\n ", "doc_id", " </title></head><body><p>x</body></html>")
    m = pages.meta(html)
    return d.select("doc_id", m["title"].alias("title"), m["published_raw"].alias("published_raw"), F.array_join(m["categories"], ",").alias("categories"))


def _answers(spark, sf_dir) -> DataFrame:
    """Interfaces of 50 documents in pages of ten: repeats, records without title or address, a short last page."""
    d = _docs(spark, sf_dir, 50).withColumn("page", F.floor(F.col("doc_id") % 50 / 10).cast("int"))
    record = F.struct(
        F.struct(F.when(F.col("doc_id") % 6 != 5, F.concat(F.lit("/d/"), (F.col("doc_id") - F.col("doc_id") % 4 % 3).cast("string"))).alias("uri")).alias("link"), F.when(F.col("doc_id") % 8 != 0, F.concat(F.lit("Headline "), "doc_id")).alias("title"),
        F.when(F.col("doc_id") % 3 != 0, F.lit(START) + F.col("doc_id") % 997 * DAY_MS).alias("at"), F.array(F.struct(F.col("lang").alias("name")), F.struct(F.col("source").alias("name"))).alias("topics"),
    )
    bodies = _joined(d.withColumn("__by", F.concat_ws("|", "body_of", "page")), "__by", "doc_id", F.to_json(record), ",")
    return bodies.select(F.split_part("__by", F.lit("|"), F.lit(1)).alias("source_id"), F.split_part("__by", F.lit("|"), F.lit(2)).cast("int").alias("page"), F.concat(F.lit('{"data": {"hits": ['), "text", F.lit("]}}")).alias("body"))


_FIELDS = {"url": "link.uri", "title": "title", "published_at": "at", "categories": "topics[].name"}


def json_scan(spark, sf_dir):
    items = interfaces.json_items(_answers(spark, sf_dir), "data.hits", _FIELDS, 10)
    return items.select("source_id", "source_pos", "url", "title", "published_raw", F.array_join("categories", ",").alias("categories"))


def json_newest(spark, sf_dir):
    items = interfaces.json_items(_answers(spark, sf_dir), "data.hits", _FIELDS, 10)
    return interfaces.newest(items, NOW, 12).select("source_id", "source_pos", "title")


def json_problems(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("source_id"), F.lit(0).alias("page"), F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 3)).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise('{"k": []}').alias("body"))
    return interfaces.json_problems(e, "k").groupBy("error").agg(F.count("*").alias("n"))


def render_template(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    f = _udf(lambda k, name: paths.render("https://x/{{ q }}?o={{offset}}&t={{token}}&n={{name}}", {"q": k % 7, "offset": interfaces.offsets(25, 4)[k % 4], "name": name}), "string")
    return c.select("c_custkey", f("c_custkey", "c_name").alias("address"))


def token_auth(spark, sf_dir):
    """A token read off a page, from the environment, or not to be had."""
    def of(k):
        try:
            auth = {"kind": "env", "var": f"V{k % 3}"} if k % 2 else {"kind": "from_page", "token_regex": r"key='(\w+)'"}
            return interfaces.token(auth, f"<script>key='{k}'</script>" if k % 4 else "<p>", {"V1": "one"}) or "none"
        except interfaces.AuthError:
            return "failed"

    return _customers(spark, sf_dir).select("c_custkey", _udf(of, "string")("c_custkey").alias("token"))


def robots_rules(spark, sf_dir):
    """A robots.txt for every site of pages; the rules as a relation decide about each of its addresses."""
    p = _t(spark, sf_dir, "pages").select("page_id", "url").withColumn("origin", urls.origin(F.col("url")))
    text = F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: Reader\nUser-agent: second\nDisallow: /en/ # all\nAllow: /en/"), F.length("origin") % 10, F.lit("\nDisallow: /*.html$\n\nUser-agent: *\nDisallow: /x\nSitemap: y\n"))
    parsed = _udf(lambda t: [{"allow": k == "allow", "path": x} for k, xs in robots.parse_robots(t, "reader").items() for x in xs], "array<struct<allow:boolean,path:string>>")
    rules = p.select("origin").distinct().select("origin", F.explode(parsed(text)).alias("r")).select("origin", "r.allow", "r.path")
    return robots.allowed(p, rules).select("page_id", "allowed")


def proxy_rules(spark, sf_dir):
    f = _udf(lambda k, s: network.through_proxy(("http://10.%d.0.1/" % (k % 256), "https://api.inner.test/x", "http://localhost:80/", "https://www.public.org/a")[k // 2 % 4], f"10.0.0.0/{9 + k % 3},.inner.test" if k % 2 else "inner.test, 10.0.0.0/8"), "boolean")
    return _t(spark, sf_dir, "customer").select("c_custkey", f("c_custkey", "c_name").alias("proxied"))


def failure_texts(spark, sf_dir):
    def of(k):
        outer = RuntimeError("fetch failed")
        outer.__cause__ = (RuntimeError("Proxy response (403) !== 200"), TimeoutError("x"), ConnectionRefusedError(111, "no"), ValueError(f"site {k} closed"))[k % 4]
        return network.describe_failure(outer)

    return _t(spark, sf_dir, "customer").select("c_custkey", _udf(of, "string")("c_custkey").alias("said"))


# Scalars.


def absolute_urls(spark, sf_dir):
    """Addresses relative to their site, and some that are whole."""
    p = _t(spark, sf_dir, "pages")
    rest = F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)?", 1)
    f = urls.absolute_url(F.when(F.col("page_id") % 3 == 0, rest).when(F.col("page_id") % 3 == 1, F.concat(F.lit("../up/"), F.col("page_id"))).otherwise("mailto:a@b.c"), F.concat(urls.origin(F.col("url")), F.lit("/one/two/three")))
    return p.select("page_id", f.alias("address"))


def sort_keys(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    raw = F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, "1980-01-01").when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.unix_millis("ts").cast("string"))
    return e.select("event_id", dates.sort_ms(raw, F.lit(NOW).cast("long")).alias("sort_ms"))


def literal_patterns(spark, sf_dir):
    """What is no pattern stands for itself."""
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", F.col("html").rlike(regexes.compiled("<P>(")).alias("bracket"), F.col("url").rlike(regexes.compiled("*.HTML")).alias("star"), F.col("url").rlike(regexes.compiled(r"PAGE=\d")).alias("pattern"))


def suggested_names(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", urls.suggested_id(F.col("url")).alias("id"), urls.institution_name(F.col("url")).alias("institution"))


def query_parameters(spark, sf_dir):
    """Request parameters as they come, for every event."""
    def of(k, kind):
        q = ItemQuery.from_params({"limit": ["", str(k), f"{k}.9", "x"][k % 4], "tags": [f"a:{k % 3}, ,b", kind], "since": ("24h", "all", "1y")[k % 3], "sort": ("oldest", "up")[k % 2], "q": f" {kind} ", "cursor": ""})
        return {"limit": q.limit, "tags": "|".join(q.tags), "since": q.since, "sort": q.sort, "q": q.q}

    e = _t(spark, sf_dir, "events")
    got = _udf(of, "struct<limit:int,tags:string,since:string,sort:string,q:string>")("event_id", "event_type")
    return e.select("event_id", got.alias("g")).select("event_id", F.col("g.limit").cast("long").alias("limit"), "g.tags", "g.since", "g.sort", "g.q")


# Normalising, rations, state.


def _raw(spark, sf_dir) -> DataFrame:
    """documents as raw items, some of them unusable."""
    d = _docs(spark, sf_dir, 50)
    url = F.when(F.col("doc_id") % 13 == 0, "javascript:x").when(F.col("doc_id") % 13 == 1, F.lit(None)).otherwise(F.concat(F.lit("/a/"), "doc_id"))
    title = F.when(F.col("doc_id") % 17 == 0, "  ").otherwise(F.concat(F.lit("Title of "), "doc_id"))
    return d.select(
        F.col("lang").alias("source_id"), F.col("doc_id").alias("source_pos"), url.alias("url"), title.alias("title"), F.lit(None).cast("string").alias("summary"), _day(F.col("doc_id") % 900).alias("published_raw"),
        F.lit("string").alias("published_kind"), (F.col("doc_id") % 3 == 0).alias("date_is_weak"), F.array(F.col("lang"), F.lit(" ")).alias("categories"),
    )


def _sources(spark, sf_dir, ids: DataFrame, take=5) -> DataFrame:
    """A registry for the ids."""
    kinds = dict(zip((c.split()[0] for c in model.SOURCES.replace("array<string>", "x").split(", ")), (c.split(None, 1)[1] for c in model.SOURCES.split(", "))))
    known = {"id": F.col("id"), "institution": F.col("id"), "name": F.col("id"), "homepage": F.concat(F.lit("https://www."), "id", F.lit(".example/")), "static_tags": F.array(F.lit("scope:macro"), F.lit("scope:none")), "take_per_run": F.lit(take), "enabled": F.lit(True), "in_config": F.lit(True), "poll_minutes": F.lit(30), "consecutive_failures": F.lit(1)}
    return ids.select(*[known.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _normal(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return normalise.normalise(raw, _sources(spark, sf_dir, raw.select(F.col("source_id").alias("id")).distinct()), TAXONOMY, NOW)


def normalised_items(spark, sf_dir):
    rows = normalise.usable(_normal(spark, sf_dir))
    return rows.select("source_id", "source_pos", "url", "canonical_hash", "title", "title_key", "published_at", "date_estimated", F.array_join("native_categories", ",").alias("categories"), F.array_join("tags", ",").alias("tags"))


def normalise_rejects(spark, sf_dir):
    return normalise.rejected(_normal(spark, sf_dir))


def surrogate_ids(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "lang", F.lpad(F.col("doc_id").cast("string"), 20, "0")).alias("pos"))
    return rations.numbered(d, 1000, "pos").select("doc_id", "item_id")


def mark_seen(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select(F.lit("s").alias("source_id"), urls.url_hash(urls.canonical_url(F.col("url"))).alias("canonical_hash"), "page_id")
    seen = p.filter("page_id % 3 = 0").select("source_id", "canonical_hash", F.lit(1).cast("long").alias("seen_at")).distinct()
    return seen.unionByName(dedupe.seen_after(seen, p, 2))


def record_fetch(spark, sf_dir):
    """The registry after a round that fetched every other source."""
    s = _registry(spark, sf_dir).withColumns({"id": F.col("id").cast("string"), "last_error": F.lit("old"), "last_item_count": F.lit(9), "etag": F.concat(F.lit("e"), "id"), "last_modified": F.lit("m")})
    k = F.col("id").cast("long")
    f = s.filter(k % 2 == 0).select(F.col("id").alias("source_id"), F.when(k % 3 == 0, "ok").when(k % 3 == 1, "empty").otherwise("not-modified").alias("status"), F.when(k % 3 == 1, "none").alias("error"), (k % 5).cast("int").alias("item_count"), F.when(k % 3 == 0, "new").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(7).cast("long").alias("fetched_at"))
    return health.record_fetches(s, f).select("id", "last_status", "last_error", "last_item_count", "last_fetch_at", "etag", "last_modified", F.col("consecutive_failures").cast("long").alias("consecutive_failures"))


def sweep_tags(spark, sf_dir):
    items = articles(spark, sf_dir)
    return prune.swept(panel.item_tags(items), items.filter("item_id % 4 != 0"))


def swept_count(spark, sf_dir):
    items = articles(spark, sf_dir)
    return prune.swept_count(panel.item_tags(items), items.filter("item_id % 4 != 0"))


def run_summary(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return health.run_summary(e.select((F.col("event_id") % 4).alias("inserted"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "empty").otherwise("ok").alias("status")))


def adapter_chain(spark, sf_dir):
    """Each user's events of a day as the attempts of a chain: which decides, and how."""
    e = _t(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", F.date_format("ts", "dd")).alias("source_id"), "event_id", "event_type")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("event_id")) - 1
    tries = e.select("source_id", place.alias("attempt"), (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 23 == 0).alias("not_modified"), (F.col("event_id") % 3 % 2).cast("int").alias("n_items"), (F.col("event_id") % 29 == 0).alias("healthy_empty"))
    return health.outcome_status(tries).select("source_id", F.col("attempt").cast("long").alias("attempt"), "status")


def config_errors(spark, sf_dir):
    """A configuration of two sources for every customer: how many of its lines are wrong."""
    def of(k):
        text = f"""
sources:
  - {{id: a, poll_minutes: {k % 2000}, take_per_run: {k % 250}, adapter: {{kind: {("rss", "sitemap", "ftp")[k % 3]}, url: u, max_new_per_run: {k % 40 + 1}}}}}
  - {{id: {"ab"[k % 2]}, static_tags: [theme:plain, theme:{k % 5}], adapter: {{kind: json, url: u}}, fallback: [{{kind: rss, url: v}}]}}
"""
        try:
            config.load_sources(text)
            return 0
        except config.ConfigError as bad:
            return len(str(bad).splitlines())

    return _customers(spark, sf_dir).select("c_custkey", _udf(of, "long")("c_custkey").alias("errors"))


def config_rows(spark, sf_dir):
    """What a configuration says of one source, with defaults and tags that no facet has."""
    def of(k):
        lines = [f"defaults: {{take_per_run: {k % 50 + 1}}}", "sources:", f"  - {{id: a, institution: I, {'poll_minutes: 45,' if k % 2 else ''} enabled: {'no' if k % 3 else 'yes'}, static_tags: [theme:plain, 'theme:{k % 5}'], adapter: {{kind: rss, url: u}}}}"]
        rows = config.load_sources("\n".join(lines))
        return {"poll": rows[0]["poll_minutes"], "take": rows[0]["take_per_run"], "enabled": rows[0]["enabled"], "unknown": len(config.unknown_static_tags(rows, TAXONOMY))}

    got = _udf(of, "struct<poll:long,take:long,enabled:boolean,unknown:long>")("c_custkey")
    return _customers(spark, sf_dir).select("c_custkey", got.alias("g")).select("c_custkey", "g.*")


def undeclared_tags(spark, sf_dir):
    """Rules and a category map made for every customer: whether a tag without facet is refused."""
    def of(k):
        try:
            config.load_taxonomy(f"facets: [{{id: f, values: [0, 1, 2]}}]\nnative_map: {{C: ['f:{k % 4}']}}\nrules: [{{tag: 'f:{k % 5}', any: [x]}}]")
            return 0
        except config.ConfigError as bad:
            return len(str(bad).splitlines())

    return _customers(spark, sf_dir).select("c_custkey", _udf(of, "long")("c_custkey").alias("errors"))


# Discovery.


def _calls(spark, sf_dir) -> DataFrame:
    """conversations as answers of unknown interfaces: url, status, body."""
    c = _t(spark, sf_dir, "conversations").withColumn("call", F.col("conv_id").cast("string"))
    record = F.to_json(F.struct(F.struct(F.col("text").alias("headline"), F.struct(F.struct(F.col("turn").alias("deep")).alias("c"), F.concat(F.lit("https://x/t/"), F.col("turn").cast("string")).alias("link")).alias("b")).alias("a"), F.array(F.col("role"), F.concat(F.lit(" "), F.col("role"))).alias("tags"), F.lit(None).cast("string").alias("gone")))
    bodies = _joined(c, "call", "turn", record, ",")
    return bodies.select(F.col("call").alias("url"), F.when(F.col("call").cast("long") % 10 == 0, 500).otherwise(200).alias("status"), F.concat(F.lit('{"n": 1, "page": {"hits": ['), "text", F.lit("]}}")).alias("body"))


def record_arrays(spark, sf_dir):
    """Arrays of records in answers, and the fields of theirs, two levels down."""
    return discover.fields(_calls(spark, sf_dir)).groupBy("call", "path", "key").agg(F.count("*").alias("records"), F.max("size").cast("long").alias("size"))


def _found(spark, sf_dir):
    return discover.fields(_calls(spark, sf_dir))


def field_match_rates(spark, sf_dir):
    """For each field of each answer, the share of records that look like an address, a title, a summary or categories."""
    rates = discover.match_rates(_found(spark, sf_dir), F.lit(NOW).cast("long"))
    return rates.select("call", "path", "key", *[F.round(c, 9).alias(c) for c in ("url", "title", "summary", "categories")])


def field_guesses(spark, sf_dir):
    return discover.guesses(discover.match_rates(_found(spark, sf_dir), F.lit(NOW).cast("long"))).select("call", "path", "best_url", "best_title", "best_summary", "best_categories")


def network_candidates(spark, sf_dir):
    """The five best answers that look like lists of articles."""
    return discover.candidates(_calls(spark, sf_dir), F.lit(NOW).cast("long")).select("call", "path", F.round("score", 6).alias("score"), "best_url", "best_title")


def field_samples(spark, sf_dir):
    return discover.samples(_found(spark, sf_dir), "tags", 2).select("call", "text")


def _sites(spark, sf_dir) -> DataFrame:
    """A page for every 20 documents: cards, navigation, state classes, a payload in a script."""
    d = _docs(spark, sf_dir, 20).withColumn("url", F.concat(F.lit("https://"), "body_of", F.lit(".example/en/insights")))
    where = F.when(F.col("doc_id") % 5 == 0, F.lit("https://other.example/")).when(F.col("doc_id") % 5 == 1, "/insights/").otherwise("/news/")
    link = F.concat(F.lit('<a href="'), where, "doc_id", F.lit('">An article of some length '), "doc_id", F.lit("</a>"))
    card = F.concat(F.lit('<div class="is-open '), F.when(F.col("doc_id") % 2 == 0, "card even").otherwise("card"), F.lit('"><h2 class="head">'), link, F.lit("</h2></div>"))
    parts = _joined(d, "url", "doc_id", card)
    nav = '<nav class="menu">' + "".join(f'<a class="m" href="/insights/{i}">A long entry of the menu</a>' for i in range(4)) + "</nav>"
    head = '<link rel="alternate" type="application/rss+xml" href="/my/feed/"><script id="__NEXT_DATA__">{"a": 1}</script><script type="application/json">[2]</script><script>x</script>'
    return parts.select("url", F.concat(F.lit(head + nav), "text").alias("body"))


def listing_classes(spark, sf_dir):
    return discover.listing_classes(_sites(spark, sf_dir)).select("url", "name", "nodes", "hinted", F.col("rank").cast("long").alias("rank"))


def embedded_payloads(spark, sf_dir):
    return discover.embedded_payloads(_sites(spark, sf_dir)).select("url", "body")


def feed_probes(spark, sf_dir):
    """Feeds among landed bodies, with how many entries they have that can be used."""
    landed = _feeds(spark, sf_dir).select(F.col("source_id").alias("url"), F.when(F.col("source_id").endswith("3"), 404).otherwise(200).alias("status"), "body")
    other = _sites(spark, sf_dir).select("url", F.lit(200).alias("status"), "body")
    return discover.feed_candidates(landed.unionByName(other)).select("url", F.col("entries").cast("long").alias("entries"))


def feed_addresses(spark, sf_dir):
    f = _udf(lambda url, body: [f"{k} {v}" for k, v in discover.feed_addresses(url, body).items()], "array<string>")
    return _sites(spark, sf_dir).select("url", F.posexplode(f("url", "body")).alias("place", "address")).select("url", F.col("place").cast("long").alias("place"), "address")


def sitemap_probes(spark, sf_dir):
    entries = _mapped(spark, sf_dir).filter("body like '<urlset>%'")
    return discover.sitemap_matches(feeds.sitemap_entries(entries), "https://any.example/eu/EN/?a=1")


def sitemap_addresses(spark, sf_dir):
    f = _udf(lambda k: discover.sitemap_addresses("https://h.example/a/b", "User-agent: *\n" + "\n".join(f"  Sitemap: https://h.example/{i}.xml x" for i in range(k % 12)) + "\nsitemap: https://h.example/sitemap.xml"), "array<string>")
    return _customers(spark, sf_dir).select("c_custkey", F.size(f("c_custkey")).cast("long").alias("n"), F.element_at(f("c_custkey"), -1).alias("last"))


def redacted_headers(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    h = F.create_map(F.lit("Accept"), F.col("c_name"), F.lit("AUTHORIZATION"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "Bearer ").otherwise("Basic "), F.col("c_name")), F.lit("Cookie"), F.lit("x"), F.lit("x-api-key"), F.lit("k"))
    r = discover.redacted(h)
    return c.select("c_custkey", r["accept"].alias("accept"), r["authorization"].alias("auth"), r["x-api-key"].alias("api_key"), F.size(r).cast("long").alias("kept"))


def suggestions(spark, sf_dir):
    """Which adapter is suggested, by what the probes found."""
    def of(k):
        got = discover.suggestion(
            f"https://www.site.example/eu/part{k % 3}/", [{"call": "c", "path": "p", "best_url": "u", "headers": {"authorization": "x"}}] if k % 5 == 0 else [], [{"url": "f"}] if k % 5 == 1 else [],
            [{"url": "s", "matching": k % 2}] if k % 5 == 2 else [], [{"name": "a:b"}] if k % 5 in (2, 3) else [], k % 7 == 0,
        )
        return {"kind": got and got["kind"], "what": got and (got.get("items_path") or (got.get("include") or [None])[0] or (got.get("selectors") or {}).get("item") or got["url"]), "name": (discover.config_text("https://www.site.example/eu/part1/", got) or "").count("site-part1")}

    got = _udf(of, "struct<kind:string,what:string,name:long>")("c_custkey")
    return _customers(spark, sf_dir).select("c_custkey", got.alias("g")).select("c_custkey", "g.*")


# The whole path.


def _landed(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Landed bodies of a feed and its fallback for every 40 documents: some fail, some are unchanged, some hold nothing; with registry, items, pruned and seen."""
    body = _feeds(spark, sf_dir, 40).withColumn("k", F.substring("source_id", 2, 20).cast("long"))
    kind, nothing = F.col("k") % 6, F.lit("<rss><channel></channel></rss>")
    first = body.select(
        "source_id", F.lit(0).alias("attempt"), F.when(kind == 1, 500).when(kind == 2, 304).otherwise(200).alias("status"), F.when(kind.isin(3, 4), nothing).when(kind != 2, F.col("body")).alias("body"), F.concat(F.lit("e"), "k").alias("etag"),
    )
    second = body.filter(kind.isin(1, 3, 4)).select("source_id", F.lit(1).alias("attempt"), F.when(kind == 4, 503).otherwise(200).alias("status"), F.when(kind == 4, None).otherwise(F.col("body")).alias("body"), F.lit("wrong").alias("etag"))
    landed = first.unionByName(second).withColumns({"page": F.lit(0), "url": F.lit("u"), "last_modified": F.lit(None).cast("string"), "bytes": F.lit(None).cast("binary"), "error": F.lit(None).cast("string"), "fetched_at": F.lit(NOW).cast("long")})
    registry = _sources(spark, sf_dir, body.select(F.col("source_id").alias("id"))).withColumns({"take_per_run": (F.substring("id", 2, 20).cast("int") % 4 * 4 + 3), "config_json": F.lit('{"adapter": {"kind": "rss", "url": "u"}, "fallback": [{"kind": "rss", "url": "v"}, {"kind": "odd"}]}')})
    d = _docs(spark, sf_dir, 40)
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), "lang", F.lit("/"), "doc_id", F.lit("?b=1"))
    hashed = d.select("doc_id", urls.url_hash(url).alias("canonical_hash"))
    empty = model.empty(spark, model.ITEMS)
    stored = hashed.filter("doc_id % 10 = 3").select(*[F.col("canonical_hash") if f.name == "canonical_hash" else F.lit("").alias("title_key") if f.name == "title_key" else F.col("doc_id").alias("item_id") if f.name == "item_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema])
    pruned = hashed.filter("doc_id % 10 = 5").select("canonical_hash", F.lit(0).cast("long").alias("pruned_at"))
    return settled(landed), registry, stored, pruned, model.empty(spark, model.SEEN_URLS)


def _run(spark, sf_dir) -> ingest.Run:
    landed, registry, *stored = _landed(spark, sf_dir)
    return ingest.run(landed, registry, dedupe.Tables(*stored), TAXONOMY, NOW)


def ingest_outcomes(spark, sf_dir):
    out = _run(spark, sf_dir).outcomes
    return out.select("source_id", "status", F.col("attempt").cast("long").alias("attempt"), "fetched", "inserted", "duplicate_url", "duplicate_title", "held", "error")


def ingest_items(spark, sf_dir):
    return _run(spark, sf_dir).items.select("source_id", "title", "url", "published_at", F.array_join("tags", ",").alias("tags"))


def ingest_fetches(spark, sf_dir):
    return _run(spark, sf_dir).fetches.select("source_id", "status", F.col("item_count").cast("long").alias("item_count"), "etag")


def ingest_notes(spark, sf_dir):
    """What a run says about unusable rows, the first five of each source: addresses of one site are no web addresses."""
    landed, registry, *stored = _landed(spark, sf_dir)
    landed = landed.withColumn("body", F.replace("body", F.lit("https://www.src1."), F.lit("mailto:src1.")))
    out = ingest.run(landed, registry, dedupe.Tables(*stored), TAXONOMY, NOW).outcomes.filter(F.size("notes") > 0)
    return out.select("source_id", F.size("notes").cast("long").alias("n"), F.array_join(F.array_distinct("notes"), "|").alias("notes"))


def due_outcomes(spark, sf_dir):
    """A pass over the sources that are due: two of three, the others' bodies are left out."""
    landed, registry, stored, pruned, _ = _landed(spark, sf_dir)
    store = _store(spark)
    waits = F.substring("id", 2, 20).cast("long") % 3 == 0
    store.change(append={"items": stored, "pruned_urls": pruned}, replace={"sources": registry.withColumn("last_fetch_at", F.when(waits, F.lit(NOW - 60_000)).otherwise(F.lit(START)))})
    out, _ = loop.due_run(store, TAXONOMY, lambda due: landed, NOW)
    return out.select("source_id", "status", "fetched", "inserted", "duplicate_url", "held")


_LISTED = {"item": "ul > li.card", "link": "a@href", "title": "a", "date": "time@datetime"}
_CONFIGS = {
    0: {"kind": "rss", "url": "u"}, 1: {"kind": "json", "request": {"url": "u"}, "items_path": "data.hits", "fields": {"url": "link", "title": "head.line", "published_at": "day", "categories": "topics[].name"}},
    2: {"kind": "sitemap", "url": "u", "include": ["/report-"], "exclude": ["/never/"], "fetch_metadata": False, "max_undated_per_run": 100}, 3: {"kind": "html", "url": "u", "selectors": _LISTED},
}


def _run_kinds(spark, sf_dir) -> ingest.Run:
    """Bodies of every kind of adapter, the same 40 documents' worth each; sitemaps and listings with patterns and selectors of their own."""
    d = _docs(spark, sf_dir, 40).withColumn("kind", F.floor(F.col("doc_id") / 40) % 4)
    url, title, day = F.concat(F.lit("https://"), "source", F.lit(".example/"), "lang", F.lit("/report-number-"), "doc_id"), F.concat(F.lit("Report number "), "doc_id"), _day(F.col("doc_id") % 1000)
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    one = (
        F.when(F.col("kind") == 0, put("<item><link>", url, "</link><title>", title, "</title><pubDate>", day, "</pubDate></item>"))
        .when(F.col("kind") == 1, put('{"link": "', url, '", "head": {"line": "', title, '"}, "day": "', day, '", "topics": [{"name": "', F.col("lang"), '"}, {}]},'))
        .when(F.col("kind") == 2, put("<url><loc>", url, "</loc><lastmod>", day, "</lastmod></url>"))
        .otherwise(put('<li class="card c', F.substring("body_of", 2, 20), '"><a href="', url, '">', title, '</a><time datetime="', day, '"></time></li>'))
    )
    begin = F.when(F.col("kind") == 0, "<rss><channel>").when(F.col("kind") == 1, '{"data": {"hits": [').when(F.col("kind") == 2, "<urlset>").otherwise("<ul>")
    end = F.when(F.col("kind") == 0, "</channel></rss>").when(F.col("kind") == 1, "7]}}").when(F.col("kind") == 2, "</urlset>").otherwise("</ul>")
    body = _joined(d, "body_of", "doc_id", one).withColumn("kind", F.substring("body_of", 2, 20).cast("long") % 4).select(F.col("body_of").alias("source_id"), F.concat(begin, "text", end).alias("body"), "kind")
    blank = {"attempt": F.lit(0), "page": F.lit(0), "url": F.lit("u"), "status": F.lit(200), "etag": F.lit(None).cast("string"), "last_modified": F.lit(None).cast("string"), "bytes": F.lit(None).cast("binary"), "error": F.lit(None).cast("string"), "fetched_at": F.lit(NOW).cast("long")}
    k, number = F.substring("id", 2, 20).cast("int"), F.substring("id", 2, 20)
    own = F.element_at(F.create_map(*[F.lit(x) for i, c in _CONFIGS.items() for x in (i, json.dumps({"adapter": c}))]), k % 4)
    own = F.replace(F.replace(own, F.lit("li.card"), F.concat(F.lit("li.c"), number)), F.lit("/never/"), F.concat(F.lit("/never"), number, F.lit("/")))
    registry = _sources(spark, sf_dir, body.select(F.col("source_id").alias("id"))).withColumns({"take_per_run": F.floor(k / 4).cast("int") % 4 * 8 + 3, "config_json": own})
    none = dedupe.Tables(*(model.empty(spark, x) for x in (model.ITEMS, model.PRUNED_URLS, model.SEEN_URLS)))
    return ingest.run(settled(body.drop("kind").withColumns(blank)), registry, none, TAXONOMY, NOW)


def ingest_kinds(spark, sf_dir):
    return _run_kinds(spark, sf_dir).outcomes.select("source_id", "status", "adapter_kind", "fetched", "inserted", "held")


def ingest_kind_items(spark, sf_dir):
    return _run_kinds(spark, sf_dir).items.select("source_id", "title", "url", "published_at", "date_estimated")


def ingest_drains(spark, sf_dir):
    """A store fed the same bodies three times: each run takes the next newest of what waits."""
    landed, registry, _, _, _ = _landed(spark, sf_dir)
    store = _store(spark)
    store.write(sources=registry)
    for i in range(3):
        store.ingest(landed, TAXONOMY, NOW + i)
    return store.read("items").groupBy("source_id", (F.col("first_seen_at") - NOW).alias("run")).agg(F.count("*").alias("n"), F.min("published_at").alias("oldest"))


def _store(spark):
    from tidemark.store import Store

    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def registry_health(spark, sf_dir):
    """The answer to a reader who asks how the sources fare."""
    got = panel.health_answer(_registry(spark, sf_dir), articles(spark, sf_dir, False))
    return spark.createDataFrame([(len(got["sources"]), got["total_items"], got["last_ingest_at"], got["broken"])], "sources long, total_items long, last_ingest_at long, broken long")


def declared_facets(spark, sf_dir):
    """The declared facets, with how many articles have a tag of theirs."""
    rows = [(f["id"], f["label"], i, "|".join(f["values"])) for i, f in enumerate(panel.taxonomy_answer(TAXONOMY)["facets"])]
    facets = spark.createDataFrame(rows, "id string, label string, place long, vals string")
    of = articles(spark, sf_dir).select(F.explode(F.array_distinct(F.transform("tags", lambda t: F.substring_index(t, ":", 1)))).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return facets.join(of, "id", "left").select("id", "label", "place", "vals", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def streamed_fold(spark, sf_dir):
    """The fold over titles with state, rows coming as a stream."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    _titled(spark, sf_dir).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("pos long, institution string, title_key string, published_at long").parquet(f"{root}/in")
    spark.conf.set(*loop.STATE_STORE)
    q = loop.greedy_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/ck").outputMode("append").trigger(availableNow=True).start(f"{root}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("pos", "kept")


QUERIES = (
    feed_scan, sitemap_parse, sitemap_scan, sitemap_visited, sitemap_children, html_listing, article_meta, json_scan, json_newest, json_problems, render_template, token_auth, robots_rules, proxy_rules, failure_texts, absolute_urls, sort_keys,
    literal_patterns, suggested_names, query_parameters, normalised_items, normalise_rejects, surrogate_ids, mark_seen, record_fetch, sweep_tags, swept_count, run_summary, adapter_chain, config_errors, config_rows, undeclared_tags, record_arrays,
    field_match_rates, field_guesses, network_candidates, field_samples, listing_classes, embedded_payloads, feed_probes, feed_addresses, sitemap_probes, sitemap_addresses, redacted_headers, suggestions, ingest_outcomes, ingest_items,
    ingest_fetches, ingest_notes, ingest_kinds, ingest_kind_items, due_outcomes, ingest_drains, registry_health, declared_facets, streamed_fold,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
