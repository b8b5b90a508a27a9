"""Finding records, and which of their fields are what, in payloads of unknown shape."""

from __future__ import annotations

import json
import re

import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions.python import arrow
from tidemark.functions.text import shapes
from tidemark.functions.urls import absolute, canonical
from tidemark.sources.html import parse
from tidemark.sources.plain import when

# Names that speak for a field, and how much.
NAMES = {
    "url": r"(?i)(clickuri|^uri$|^url$|link|href|permalink|path|slug)",
    "title": r"(?i)(title|headline|name|heading)",
    "published_at": r"(?i)(publish|date|created|posted|updated|time)",
    "summary": r"(?i)(excerpt|summary|description|abstract|teaser|snippet|body)",
    "categories": r"(?i)(categor|tag|topic|section|subject|theme)",
}
NAME_BONUS, LEAST_RATE = 0.6, 0.5
SAMPLE, KEEP, DEPTH, LEAST_RECORDS = 20, 50, 6, 2

FIELD = "array<struct<path:string,rank:int,record:int,key_pos:int,key:string,text:string,is_number:boolean,is_text:boolean,has_texts:boolean,size:int>>"


def flat(record: dict, prefix: str = "", depth: int = 0) -> dict:
    """Dotted keys, two levels down; arrays stay."""
    out: dict = {}
    for k, v in record.items():
        if isinstance(v, dict) and depth < 2:
            out |= flat(v, f"{prefix}{k}.", depth + 1)
        else:
            out[prefix + k] = v
    return out


def arrays(payload, path: str = "", depth: int = 0):
    """(path, objects) of every array with at least LEAST_RECORDS objects; an array's first three elements are entered."""
    if depth > DEPTH:
        return
    if isinstance(payload, list):
        objects = [v for v in payload if isinstance(v, dict)]
        if len(objects) >= LEAST_RECORDS:
            yield path, objects
        for i, v in enumerate(payload[:3]):
            yield from arrays(v, f"{path}[{i}]", depth + 1)
    elif isinstance(payload, dict):
        for k, v in payload.items():
            yield from arrays(v, f"{path}.{k}" if path else k, depth + 1)


def _fields(body: str | None) -> list[dict]:
    try:
        payload = json.loads(body or "")
    except ValueError:
        return []
    out = []
    for rank, (path, objects) in enumerate(arrays(payload)):
        for i, record in enumerate(objects[:KEEP]):
            for pos, (key, v) in enumerate(flat(record).items()):
                if v is not None:
                    out.append({
                        "path": path, "rank": rank, "record": i, "key_pos": pos, "key": key, "text": v if isinstance(v, str) else json.dumps(v), "is_number": isinstance(v, (int, float)) and not isinstance(v, bool),
                        "is_text": isinstance(v, str), "has_texts": isinstance(v, list) and any(isinstance(x, str) for x in v), "size": len(objects),
                    })
    return out


def fields(bodies: DataFrame) -> DataFrame:
    """One row per field of each record of landed answers (url, body): call (that url), path, rank, record, key, text, what it is."""
    return bodies.select(F.col("url").alias("call"), F.explode(arrow(_fields, FIELD)("body")).alias("f")).select("call", "f.*")


def _kinds(now_ms: Column) -> dict[str, Column]:
    t = F.col("text")
    s = shapes(t)
    ms = arrow(when, "long")(t)
    dated = F.coalesce((ms >= 631152000000) & (ms <= now_ms + 172800000), F.lit(False))
    return {
        "url": F.col("is_text") & s["url"], "title": F.col("is_text") & s["title"], "published_at": (F.col("is_number") | (F.col("is_text") & t.rlike(r"\d{4}"))) & dated,
        "summary": F.col("is_text") & (F.length(F.trim(t)) > 60), "categories": F.col("has_texts"),
    }


def record_scores(found: DataFrame, now_ms: Column) -> DataFrame:
    """call, path, rank, size, score: 3 for urls, 3 for titles, 2 for dates, by share of a sample of records, up to 1 for many records; 0 without urls or titles."""
    kinds, want = _kinds(now_ms), ("url", "title", "published_at")
    rows = found.filter(F.col("record") < SAMPLE).select("call", "path", "rank", "record", "size", *[kinds[k].cast("int").alias(k) for k in want])
    each = rows.groupBy("call", "path", "rank", "record").agg(F.max("size").alias("size"), *[F.max(k).alias(k) for k in want])
    sums = each.groupBy("call", "path", "rank").agg(F.max("size").alias("size"), *[F.sum(k).alias(k) for k in want])
    n = F.least("size", F.lit(SAMPLE))
    score = 3 * F.col("url") / n + 3 * F.col("title") / n + 2 * F.col("published_at") / n + F.least(F.col("size") / 20, F.lit(1.0))
    return sums.select("call", "path", "rank", "size", F.when((F.col("url") > 0) & (F.col("title") > 0), score).otherwise(0.0).alias("score"))


def match_rates(found: DataFrame, now_ms: Column) -> DataFrame:
    """call, path, key, where it is seen first, and for each field the share of records that fit it, plus the name's bonus."""
    kinds = _kinds(now_ms)
    rows = found.select("call", "path", "record", "key_pos", "key", F.least("size", F.lit(KEEP)).alias("n"), *[kinds[k].cast("int").alias(k) for k in NAMES])
    sums = rows.groupBy("call", "path", "key").agg(F.min(F.struct("record", "key_pos")).alias("seen"), F.max("n").alias("n"), *[F.sum(k).alias(k) for k in NAMES])
    return sums.select("call", "path", "key", "seen", *[(F.col(k) / F.col("n") + F.when(F.col("key").rlike(p), NAME_BONUS).otherwise(0.0)).alias(k) for k, p in NAMES.items()])


def guesses(rates: DataFrame) -> DataFrame:
    """call, path and the best key for each field, null under LEAST_RATE; the key seen first wins a tie."""

    def best(field: str, but: tuple[str, ...] = ()) -> Column:
        ok = F.col(field) >= LEAST_RATE
        for b in but:
            ok = ok & ~F.col("key").eqNullSafe(F.col(b))
        rank = F.struct(F.col(field).alias("v"), (-F.col("seen.record")).alias("r"), (-F.col("seen.key_pos")).alias("k"))
        return F.max_by("key", F.when(ok, rank)).alias(f"best_{field}")

    most = rates.groupBy("call", "path").agg(*[best(f) for f in NAMES if f != "summary"])
    rest = rates.join(most, ["call", "path"]).groupBy("call", "path").agg(best("summary", ("best_title", "best_url")))
    return most.join(rest, ["call", "path"])


def candidates(bodies: DataFrame, now_ms: Column, top: int = 5) -> DataFrame:
    """The best record arrays of landed answers (url, status, body): title and url guessed, score at least 3."""
    found = fields(bodies.filter(F.col("status") < 400))
    first = Window.partitionBy("call").orderBy(F.desc("score"), "rank")
    scores = record_scores(found, now_ms).filter("score >= 3").withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    named = guesses(match_rates(found, now_ms)).filter("best_title is not null and best_url is not null")
    return scores.join(named, ["call", "path"]).orderBy(F.desc("score"), "call").limit(top)


def samples(found: DataFrame, key: str, most: int = 3) -> DataFrame:
    """call, path, text: the first distinct texts of a field, of its arrays as well."""
    texts = F.when(F.col("is_text"), F.array("text")).when(F.col("has_texts"), F.filter(F.try_variant_get(F.try_parse_json("text"), "$", "array<string>"), lambda s: s.isNotNull()))
    each = found.filter(F.col("key") == key).select("call", "path", "record", F.posexplode(texts).alias("place", "t")).withColumn("text", F.trim("t")).filter("text != ''")
    own = each.groupBy("call", "path", "text").agg(F.min(F.struct("record", "place")).alias("at"))
    w = Window.partitionBy("call", "path").orderBy("at")
    return own.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


# Where feeds and sitemaps usually are.
CONVENTIONAL_FEEDS = ("/rss", "/feed", "/rss.xml", "/feed.xml", "/atom.xml", "/index.xml", "/feeds/all.xml", "/rss/all.xml", "/en/rss")
CONVENTIONAL_SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml")
MOST_SITEMAPS = 8


def feed_addresses(page_url: str, html: str) -> dict[str, str]:
    """Addresses to try for feeds: those that the page declares, then the usual ones of its site; each with which it is."""
    out: dict[str, str] = {}
    for link in parse(html).select('link[rel="alternate"]'):
        kind, href = link.attrs.get("type", "").lower(), link.attrs.get("href")
        if href and any(k in kind for k in ("rss", "atom", "xml")) and (found := canonical(href, page_url)):
            out[found] = "declared"
    home = re.match(r"(?i)https?://[^/?#]+", page_url)
    for path in CONVENTIONAL_FEEDS if home else ():
        out.setdefault(home[0] + path, "probed")
    return out


def sitemap_addresses(page_url: str, robots: str | None = None) -> list[str]:
    """Addresses to try for sitemaps: the usual ones of the site, then those that its robots.txt declares; MOST_SITEMAPS at most."""
    home = re.match(r"(?i)https?://[^/?#]+", page_url)
    if not home:
        return []
    declared = re.findall(r"(?im)^[^\S\n]*sitemap:[^\S\n]*(\S+)", robots or "")
    return list(dict.fromkeys([*(home[0] + p for p in CONVENTIONAL_SITEMAPS), *declared]))[:MOST_SITEMAPS]


def feed_candidates(bodies: DataFrame) -> DataFrame:
    """url and entries of landed bodies (url, status, body) that are feeds and have entries."""
    from tidemark.sources.feeds import feed

    head = F.substring("body", 1, 2000)
    some = bodies.filter((F.col("status") < 400) & head.rlike(r"(?i)<(rss|feed|rdf:rdf)[\s>]"))
    return some.select("url", F.size(feed("body")["entries"]).alias("entries")).filter("entries > 0")


def last_segment(url: str) -> str:
    path = re.sub(r"[?#].*$", "", re.sub(r"(?i)^https?://[^/?#]*", "", url))
    return ([""] + [p for p in path.split("/") if p])[-1]


def sitemap_matches(entries: DataFrame, page_url: str) -> DataFrame:
    """For each sitemap (url, loc): addresses, and how many hold the page's last segment; all where it has none."""
    last = last_segment(page_url).lower()
    match = F.contains(F.lower("loc"), F.lit("/" + last)) if last else F.lit(True)
    return entries.groupBy("url").agg(F.count("*").alias("locs"), F.count_if(match).alias("matching"))


def embedded_payloads(pages: DataFrame) -> DataFrame:
    """JSON that pages carry in script blocks, as landed answers (url, status, body)."""

    def blocks(html):
        return [n.text for n in parse(html).walk() if n.tag == "script" and (n.attrs.get("id") == "__NEXT_DATA__" or n.attrs.get("type", "").startswith("application/json"))]

    return pages.select("url", F.explode(arrow(blocks, "array<string>")("body")).alias("body")).withColumn("status", F.lit(200))


STATE_CLASS = re.compile(r"(is|has|js)-")


def _around(html: str | None, url: str | None) -> list[dict]:
    """Classes of up to four ancestors of each link that may be an article's: within the site, with a text, outside of navigation."""
    out, number = [], {}
    home = re.match(r"(?i)https?://[^/?#]+", url or "")
    hint = last_segment(url or "").lower()
    for a in parse(html).select("a[href]"):
        href, up = a.attrs["href"], a
        if href.startswith(("#", "javascript:", "mailto:")) or len(a.text.strip()) < 12:
            continue
        target = absolute(href, url) or ""
        if home and not target.lower().startswith(home[0].lower()):
            continue
        above = []
        while (up := up.parent) is not None and up.tag:
            above.append(up)
        if any(n.tag in ("nav", "header", "footer") for n in [a, *above]):
            continue
        title = " ".join(a.text.split())[:90]
        for node in above[:4]:
            for c in node.classes:
                if not STATE_CLASS.match(c):
                    out.append({"name": c, "node": number.setdefault(id(node), len(number)), "hinted": bool(hint) and hint in target.lower(), "title": title})
    return out


def listing_classes(pages: DataFrame, top: int = 5) -> DataFrame:
    """url, name, nodes, hinted, rank of pages (url, body): classes on at least three containers of links that look like articles.

    Those that hold a link with the page's last segment come first, then those on more containers, then longer names.
    """
    kind = "array<struct<name:string,node:int,hinted:boolean,title:string>>"
    rows = pages.select("url", F.explode(arrow(_around, kind)("body", "url")).alias("c")).select("url", "c.*")
    found = rows.groupBy("url", "name").agg(F.countDistinct("node").alias("nodes"), F.max("hinted").alias("hinted")).filter("nodes >= 3")
    w = Window.partitionBy("url").orderBy(F.desc("hinted"), F.desc("nodes"), F.desc(F.length("name")), "name")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def token_pattern(headers) -> str | None:
    """Where a page may keep what an observed header carried: a quoted value under a name that ends like the header's kind; None for other headers."""
    ends = [end for header, end in (("authorization", "[Tt]oken"), ("x-api-key", "[Kk]ey")) if header in headers]
    return rf'"\w*(?:{"|".join(ends)})"\s*:\s*"([^"]+)"' if ends else None


def suggestion(page_url: str, calls: list, feeds: list, sitemaps: list, classes: list, rendered: bool = False) -> dict | None:
    """An adapter for the page: an interface, else a feed, else a sitemap that lists such pages, else selectors; None without any.

    Each list is best first; a call may have method, headers (redacted) and request_body.
    """
    if calls:
        c = calls[0] if isinstance(calls[0], dict) else calls[0].asDict(True)
        headers = c.get("headers") or {}
        request = {"method": c.get("method") or "GET", "url": c["call"], "headers": headers} | ({"body": c["request_body"]} if c.get("request_body") else {})
        out = {"kind": "json", "request": request, "items_path": c["path"], "fields": {f: c[f"best_{f}"] for f in NAMES if c.get(f"best_{f}")}}
        if pattern := token_pattern(headers):
            out["auth"] = {"kind": "from_page", "page_url": page_url, "token_regex": pattern}
        return out
    if feeds:
        return {"kind": "rss", "url": feeds[0]["url"]}
    good = [s for s in sitemaps if s["matching"]]
    if good:
        return {"kind": "sitemap", "url": good[0]["url"], "include": [f"/{last_segment(page_url) or 'insights'}/"], "max_new_per_run": 25}
    if classes:
        item = "." + re.sub(r"([^a-zA-Z0-9_-])", r"\\\1", classes[0]["name"])
        more = {"wait_for": item, "scroll": 2} if rendered else {}
        return {"kind": "browser" if rendered else "html", "url": page_url, **more, "selectors": {"item": item, "title": "a", "link": "a@href", "date": "time@datetime"}}
    return None


def config_text(page_url: str, adapter: dict | None) -> str | None:
    """The suggestion as a block for the configuration of sources."""
    if adapter is None:
        return None
    site = re.sub(r"(?i)^https?://(www\.)?", "", page_url)
    name = re.split(r"[/?#:]", site)[0].lower()
    label = name.split(".")[-2] if "." in name else name
    sid = re.sub(r"[^a-z0-9]+", "-", f"{label}-{last_segment(page_url)}".lower()).strip("-")
    home = re.match(r"(?i)https?://[^/?#]+", page_url)
    row = {"id": sid, "institution": label.replace("-", " ").title(), "name": "Insights", "homepage": home[0] if home else page_url, "static_tags": ["type:insight"], "adapter": adapter}
    return yaml.safe_dump({"sources": [row]}, sort_keys=False, allow_unicode=True)


def discover(page: dict, landed: DataFrame, now_ms: int) -> dict:
    """All probes over what was landed for one page (url, html, rendered, robots): a report with warnings instead of failures.

    landed: url, status, body of captured answers, feeds and sitemaps. The report has at most a few rows of each kind.
    """
    from tidemark.sources.feeds import sitemap_entries

    spark, url = landed.sparkSession, page["url"]
    found: dict = {"url": url, "warnings": []}
    own = spark.createDataFrame([(url, page.get("html") or "")], "url string, body string")

    def probe(name: str, run) -> None:
        try:
            found[name] = [r.asDict(True) if hasattr(r, "asDict") else r for r in run()]
        except Exception as bad:  # a probe that fails is a warning
            found[name] = []
            found["warnings"].append(f"{name}: {str(bad).splitlines()[0][:200]}")

    answers = landed.filter(F.length("body") <= MOST_BODY).select("url", "status", "body").unionByName(embedded_payloads(own).select("url", "status", "body"))
    feeds = feed_addresses(url, page.get("html") or "")
    some = spark.createDataFrame(list(feeds.items()), "url string, how string") if feeds else model.empty(spark, "url string, how string")
    maps = landed.filter(F.col("url").isin(sitemap_addresses(url, page.get("robots")))).filter("status < 400")
    maps = maps.select(F.lit("-").alias("source_id"), "url", "body", F.lit(None).cast("binary").alias("bytes"))
    probe("calls", lambda: candidates(answers, F.lit(now_ms).cast("long")).collect())
    probe("feeds", lambda: feed_candidates(landed).join(some, "url").orderBy(F.col("how") != "declared", F.desc("entries"), "url").collect())
    probe("sitemaps", lambda: sitemap_matches(sitemap_entries(maps), url).orderBy(F.desc("matching"), "url").collect())
    probe("classes", lambda: listing_classes(own).orderBy("rank").collect())
    adapter = suggestion(url, found["calls"], found["feeds"], found["sitemaps"], found["classes"], bool(page.get("rendered")))
    return found | {"suggestion": adapter, "config": config_text(url, adapter)}


def write_report(report: dict, path: str) -> None:
    """The report as a JSON file."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False, default=str)


#: Longer answers aren't looked at.
MOST_BODY = 4_000_000
# Headers that make a request work; two of them are credentials.
KEPT_HEADERS = ("content-type", "accept", "origin", "referer", "authorization", "x-api-key")
CREDENTIALS = ("authorization", "x-api-key")


def redacted(headers: Column) -> Column:
    """Headers fit to be shown, names in lower case: those that make a request work, credentials as a placeholder, the rest gone."""
    entries = F.map_entries(headers)

    def value(name: str) -> Column:
        v = F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"]
        return F.when(v.isNotNull(), F.concat(F.when(F.startswith(v, F.lit("Bearer ")), "Bearer ").otherwise(""), F.lit("{{token}}"))) if name in CREDENTIALS else v

    pairs = F.array(*[F.struct(F.lit(n).alias("key"), value(n).alias("value")) for n in KEPT_HEADERS])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
