"""Feeds and sitemaps: landed XML bodies to rows."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.python import arrow

from .plain import excerpt, when

ENTRY = "array<struct<url:string,title:string,summary:string,published_raw:string,categories:array<string>>>"
FEED = f"struct<error:string,retry:boolean,entries:{ENTRY}>"
SITEMAP = "struct<is_index:boolean,error:string,entries:array<struct<loc:string,lastmod:string>>>"


def _name(el) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


def _texts(item, *names: str) -> list[str]:
    """Texts of children by local name, in the order of names."""
    return [" ".join(["".join(c.itertext())]).strip() for n in names for c in item if _name(c) == n]


def _first(values) -> str | None:
    return next((v for v in values if v), None)


def _link(item) -> str | None:
    links = [c for c in item if _name(c) == "link"]
    own = _first((c.text or "").strip() for c in links)
    if own:
        return own
    by_rel = {c.get("rel", "alternate"): c.get("href") for c in reversed(links) if c.get("href")}
    href = by_rel.get("alternate") or next(iter(by_rel.values()), None)
    if href:
        return href
    guid = _first(_texts(item, "guid", "id"))
    return guid if guid and re.match(r"(?i)https?://", guid) else None


def parse_feed(body: str | None) -> dict:
    """RSS 2.0, Atom and RDF. Entries without link or title are left out."""
    try:
        root = ET.fromstring((body or "").strip())
    except ET.ParseError as bad:
        page = re.match(r"(?i)\s*<(!doctype html|html)", body or "") is not None
        return {"error": "an HTML page, not a feed" if page else f"not a feed: {bad}", "retry": not page, "entries": []}
    out = []
    for item in (e for e in root.iter() if _name(e) in ("item", "entry")):
        link, title = _link(item), _first(_texts(item, "title"))
        if not link or not title:
            continue
        content = _first(_texts(item, "encoded", "content"))
        categories = [c for c in (((e.text or "").strip() or (e.get("term") or "").strip()) for e in item if _name(e) == "category") if c]
        out.append({
            "url": link, "title": title, "summary": excerpt(_first(_texts(item, "description", "summary")) or content),
            "published_raw": _first(_texts(item, "pubDate", "published", "date", "updated")), "categories": categories + [s for s in _texts(item, "subject") if s],
        })
    return {"error": None, "retry": False, "entries": out}


def parse_sitemap(body: str | None) -> dict:
    try:
        root = ET.fromstring((body or "").strip())
    except ET.ParseError as bad:
        return {"is_index": False, "error": str(bad), "entries": []}
    index = _name(root) == "sitemapindex" or any(_name(e) == "sitemapindex" for e in root.iter())
    out = []
    for node in root.iter():
        if _name(node) != ("sitemap" if index else "url"):
            continue
        loc = _first("".join(e.itertext()).strip() for e in node.iter() if _name(e) == "loc")
        mod = _first("".join(e.itertext()).strip() for want in ("lastmod", "publication_date") for e in node.iter() if _name(e) == want)
        if loc:
            out.append({"loc": loc, "lastmod": mod})
    return {"is_index": index, "error": None, "entries": out}


def unzip(raw: bytes | None) -> str | None:
    """Text of bytes that may be gzipped, by their first two; null where they can't be read."""
    if raw is None:
        return None
    try:
        return (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else bytes(raw)).decode("utf-8", "replace")
    except (OSError, EOFError):
        return None


feed = arrow(parse_feed, FEED, once=True)
sitemap = arrow(parse_sitemap, SITEMAP, once=True)
text_of = arrow(unzip, "string", once=True)
date_of = arrow(when, "long")


def body_text(body: Column, raw: Column) -> Column:
    return F.coalesce(body, text_of(raw))


def feed_items(landed: DataFrame) -> DataFrame:
    """Raw items of landed feeds (source_id, body)."""
    rows = landed.select("source_id", feed("body").alias("f")).select("source_id", F.posexplode("f.entries").alias("source_pos", "e"))
    return rows.select("source_id", F.col("source_pos").cast("long").alias("source_pos"), "e.*", F.lit("string").alias("published_kind"), F.lit(False).alias("date_is_weak"))


def feed_problems(landed: DataFrame) -> DataFrame:
    return landed.select("source_id", feed("body").alias("f")).filter("f.error is not null").select("source_id", "f.error", "f.retry")


#: A sitemap as from_xml reads it: children of the root, by local name.
_MAP = "url array<struct<loc:string,lastmod:string,news:struct<publication_date:string>>>, sitemap array<struct<loc:string,lastmod:string>>, refused string"
_MAP_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "refused"}


def _tags(text: Column, name: str) -> Column:
    """How often an element of the local name begins in a text."""
    return F.regexp_count(text, F.lit(rf"<(?:[\w.-]+:)?{name}[\s>/]"))


def _plain_sitemap(text: Column) -> Column:
    """struct(is_index, entries) of a well-formed sitemap of the usual shape, by Spark's own reader; null for any other.

    Usual: no declarations, comments or CDATA, as many addresses and dates as from_xml found where they belong.
    """
    x = F.from_xml(text, _MAP, _MAP_OPTIONS)
    index = _tags(text, "sitemapindex") > 0
    none = F.array().cast("array<struct<loc:string,lastmod:string>>")
    urls = F.transform(x["url"], lambda u: F.struct(u["loc"].alias("loc"), F.coalesce(u["lastmod"], u["news"]["publication_date"]).alias("lastmod")))
    found = F.coalesce(F.when(index, x["sitemap"]).otherwise(urls), none)
    count = lambda values: F.coalesce(F.size(F.filter(values, lambda v: F.trim(v) != "")), F.lit(0))
    whole = lambda name: count(F.transform(x["url"], lambda u: u[name])) + count(F.transform(x["sitemap"], lambda u: u[name]))
    said = count(F.transform(x["url"], lambda u: u["news"]["publication_date"]))
    usual = x["refused"].isNull() & ~F.contains(text, F.lit("<!")) & (_tags(text, "url") + _tags(text, "sitemap") == F.size(found)) & (_tags(text, "loc") == whole("loc")) & (whole("loc") == F.size(found))
    usual = usual & (_tags(text, "lastmod") == whole("lastmod")) & (_tags(text, "publication_date") == said)
    usual = usual & ~F.exists(found, lambda e: F.contains(F.concat_ws(" ", e["loc"], e["lastmod"]), F.lit("<")))  # markup within
    return F.when(usual & (F.size(found) > 0), F.struct(index.alias("is_index"), found.alias("entries")))


def sitemap_entries(landed: DataFrame) -> DataFrame:
    """source_id, url (of the sitemap), is_index, source_pos, loc, lastmod of landed sitemaps.

    from_xml reads those of the usual shape; Python gets the others.
    """
    text = landed.select("source_id", "url", body_text(F.col("body"), F.col("bytes")).alias("t")).withColumn("x", _plain_sitemap(F.col("t")))
    read = text.withColumn("odd", sitemap(F.when(F.col("x").isNull(), F.col("t"))))
    rows = read.select("source_id", "url", F.coalesce("x", F.struct("odd.is_index", "odd.entries")).alias("s"))
    return rows.select("source_id", "url", "s.is_index", F.posexplode("s.entries").alias("source_pos", "e")).select("source_id", "url", "is_index", F.col("source_pos").cast("long").alias("source_pos"), "e.*")
