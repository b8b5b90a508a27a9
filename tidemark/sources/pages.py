"""HTML: listings by selectors, and what an article's page says of itself."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_date
from tidemark.functions.python import arrow
from tidemark.functions.urls import absolute

from .html import parse, read
from .plain import excerpt, when

META = "struct<title:string,summary:string,published_raw:string,categories:array<string>>"
LISTING = "struct<items:array<struct<url:string,title:string,summary:string,published_raw:string>>,notes:array<string>>"

# Meta tags in the order in which they are believed.
TITLE_META = (("property", "og:title"), ("name", "twitter:title"))
SUMMARY_META = (("property", "og:description"), ("name", "description"))
DATE_META = (
    ("property", "article:published_time"), ("name", "article:published_time"), ("itemprop", "datePublished"), ("name", "date"),
    ("name", "publish-date"), ("name", "pubdate"), ("name", "dc.date"), ("name", "DC.date.issued"),
)
# Names of meta tags that state a date of publication, and that state another one.
_DATE_NAME = re.compile(r"pub[-_.]?(lish|date)|date[-_.]?(published|posted|created)")
_NOT_DATE = re.compile(r"modif|updat|revis|expir")
MOST_CATEGORIES = 20
LD_DEPTH = 6


def linked_data(tree) -> list[dict]:
    """All objects of the page's JSON-LD, through arrays and @graph; broken blocks are passed over."""
    out: list[dict] = []
    for script in tree.select('script[type="application/ld+json"]'):
        try:
            todo = [(json.loads(script.text), 0)]
        except ValueError:
            continue
        while todo:
            value, depth = todo.pop(0)
            if depth > LD_DEPTH:
                continue
            if isinstance(value, list):
                todo[:0] = [(v, depth + 1) for v in value]
            elif isinstance(value, dict):
                out.append(value)
                if isinstance(value.get("@graph"), list):
                    todo.insert(0, (value["@graph"], depth + 1))
    return out


def _said(objects: list[dict], *keys: str) -> str | None:
    return next((o[k].strip() for k in keys for o in objects if isinstance(o.get(k), str) and o[k].strip()), None)


def _list(objects: list[dict], key: str) -> list[str]:
    out: list[str] = []
    for o in objects:
        v = o.get(key)
        if isinstance(v, str):
            out += [p.strip() for p in v.split(",") if p.strip()]
        for e in v if isinstance(v, list) else ():
            if isinstance(e, dict) and isinstance(e.get("name"), str):
                out.append(e["name"].strip())
            elif isinstance(e, str) and e.strip():
                out.append(e.strip())
    return out


def article_meta(html: str | None) -> dict:
    """Title, summary, date and categories, each from the best place that has it."""
    tree = parse(html)
    metas = [n for n in tree.walk() if n.tag == "meta"]
    ld = linked_data(tree)

    def meta(*wanted) -> str | None:
        for attr, name in wanted:
            for m in metas:
                if m.attrs.get(attr) == name:
                    if (m.attrs.get("content") or "").strip():
                        return m.attrs["content"].strip()
                    break
        return None

    def any_date() -> str | None:
        for m in metas:
            name = (m.attrs.get("name") or m.attrs.get("property") or m.attrs.get("itemprop") or "").lower()
            value = (m.attrs.get("content") or "").strip()
            if _DATE_NAME.search(name) and not _NOT_DATE.search(name) and re.search(r"\d{4}", value) and when(value) is not None:
                return value
        return None

    title = meta(*TITLE_META) or _said(ld, "headline", "name") or read(tree, "title")
    date = meta(*DATE_META) or _said(ld, "datePublished", "dateCreated") or any_date() or read(tree, "time[datetime]@datetime") or _said(ld, "dateModified")
    tags = [(m.attrs.get("content") or "").strip() for m in metas if m.attrs.get("property") in ("article:section", "article:tag")]
    for key in ("articleSection", "keywords", "about", "genre"):
        tags += _list(ld, key)
    tags += [k.strip() for k in (meta(("name", "keywords")) or "").split(",")]
    return {
        "title": " ".join(title.split()) if title else None, "summary": excerpt(meta(*SUMMARY_META) or _said(ld, "description")), "published_raw": date,
        "categories": list(dict.fromkeys(t for t in tags if t))[:MOST_CATEGORIES],
    }


def listing(html: str | None, selectors: dict, base: str | None) -> dict:
    """Items of a listing by selectors (item, link, title, date, summary), and notes on what was missing."""
    nodes = parse(html).select(selectors["item"])
    items, no_link, no_title = [], 0, 0
    for node in nodes:
        href, title = read(node, selectors.get("link")), read(node, selectors.get("title"))
        url = absolute(href, base) if href else None
        if not url or not re.match(r"[a-zA-Z][\w+.-]*:", url):
            no_link += 1
        elif not title:
            no_title += 1
        else:
            items.append({"url": url, "title": title, "summary": excerpt(read(node, selectors.get("summary"))), "published_raw": read(node, selectors.get("date"))})
    notes = [f"item selector {selectors['item']} matched nothing"] if not nodes else []
    notes += [f"{no_link} without a usable link"] * bool(no_link) + [f"{no_title} without a title"] * bool(no_title)
    return {"items": items, "notes": notes}


meta = arrow(article_meta, META)


def listing_items(landed: DataFrame, selectors: dict | Column) -> DataFrame:
    """Raw items of landed (or rendered) listing pages (source_id, url, body); selectors of all of them, or a column of theirs as JSON."""
    how = selectors if isinstance(selectors, Column) else F.lit(json.dumps(selectors))
    found = arrow(lambda body, url, chosen: listing(body, json.loads(chosen), url), LISTING, once=True)
    rows = landed.select("source_id", found(F.col("body"), F.col("url"), how).alias("l")).select("source_id", F.posexplode("l.items").alias("source_pos", "e"))
    return rows.select(
        "source_id", F.col("source_pos").cast("long").alias("source_pos"), "e.*", F.array().cast("array<string>").alias("categories"), F.lit("string").alias("published_kind"), F.lit(False).alias("date_is_weak")
    )


def article_items(entries: DataFrame, bodies: DataFrame, now_ms: int) -> DataFrame:
    """Raw items of sitemap entries (source_id, source_pos, loc, lastmod) with their pages (url, body).

    A page's own date is believed if it is plausible; the sitemap's stands in, marked weak. Title from the
    address at worst.
    """
    from tidemark.functions.urls import title_from_url

    own = bodies.select(F.col("url").alias("loc"), meta("body").alias("m"), "body")
    j = entries.join(own, "loc")
    dated = F.coalesce(~parse_date(F.col("m.published_raw"), F.lit(now_ms).cast("long"))["estimated"], F.lit(False))
    return j.select(
        "source_id", "source_pos", F.col("loc").alias("url"), F.coalesce("m.title", title_from_url(F.col("loc"))).alias("title"), "m.summary",
        F.when(dated, F.col("m.published_raw")).otherwise(F.coalesce("lastmod", "m.published_raw")).alias("published_raw"), F.lit("string").alias("published_kind"), (~dated).alias("date_is_weak"), "m.categories",
    )
