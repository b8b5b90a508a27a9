"""A run over a sitemap: its entries or those of its newest children, filtered, newest first, unseen, and their pages' metadata."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_date, sort_ms
from tidemark.functions.regexes import any_of
from tidemark.functions.urls import canonical_url_exact, title_from_url, url_hash
from tidemark.lineage import settled
from tidemark.operators import dedupe, rations
from tidemark.sources.feeds import sitemap_entries
from tidemark.sources.pages import meta

MOST_NEW, MOST_UNDATED = 25, 5


#: What a run needs of an adapter, as a column, so that all sitemaps go through one plan.
SETTINGS = "struct<url:string,include:string,exclude:string,most:int,fetch:boolean,most_undated:int>"


def settings(adapter: dict) -> dict:
    """SETTINGS of an adapter; its patterns as one each, null without any."""
    one = lambda patterns: any_of(patterns) if patterns else None
    return {
        "url": adapter["url"], "include": one(adapter.get("include")), "exclude": one(adapter.get("exclude")), "most": adapter.get("max_new_per_run") or MOST_NEW, "fetch": adapter.get("fetch_metadata", True),
        "most_undated": adapter.get("max_undated_per_run") or MOST_UNDATED,
    }


def entries(landed: DataFrame, now_ms: int) -> DataFrame:
    """source_id, loc, lastmod, date_key, source_pos, settings of each source's own sitemap, or of the newest of its children that landed, one after another."""
    now = F.lit(now_ms).cast("long")
    maps = landed.filter((F.col("status") < 400) & (F.col("bytes").isNotNull() | F.substring("body", 1, 2000).rlike(r"(?i)<(urlset|sitemapindex)[\s>]")))
    own = landed.groupBy("source_id").agg(F.first("settings").alias("settings"))
    # Kept, as the plan asks for it three times: each would read all sitemaps again, by Python workers of its own.
    found = settled(sitemap_entries(maps)).withColumn("date_key", sort_ms(F.col("lastmod"), now)).join(own, "source_id")
    root = found.filter(F.col("url") == F.col("settings.url"))
    children = rations.child_sitemaps(root.filter("is_index")).select("source_id", F.col("loc").alias("url"), F.col("rank").cast("long").alias("__child"))
    inner = found.filter(F.col("url") != F.col("settings.url")).join(children, ["source_id", "url"]).withColumn("source_pos", F.col("__child") * (1 << 32) + F.col("source_pos"))
    cols = ["source_id", "loc", "lastmod", "date_key", "source_pos", "settings"]
    return root.filter("not is_index").select(*cols).unionByName(inner.select(*cols))


def _matches() -> Column:
    """Whether an address fits its source's patterns."""
    fits = lambda name: F.call_function("rlike", F.col("loc"), F.col(f"settings.{name}"))
    return F.coalesce(fits("include"), F.lit(True)) & ~F.coalesce(fits("exclude"), F.lit(False))


def scan_one(landed: DataFrame, adapter: dict, seen: Callable[[DataFrame], DataFrame], now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """scan() of sources with one adapter."""
    return scan(landed.withColumn("settings", F.from_json(F.lit(json.dumps(settings(adapter))), SETTINGS)), seen, now_ms)


def scan(landed: DataFrame, seen: Callable[[DataFrame], DataFrame], now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw items; what was visited (source_id, canonical_hash); and per source how many entries, matching ones and new ones there were.

    landed (with settings) has the sitemaps and the articles' pages; seen gives the earlier visits that rows (source_id,
    canonical_hash) may repeat. Each page that is visited counts as seen, also one
    that could not be read. The run stops when it has met its share of pages without a date of their own.
    """
    now = F.lit(now_ms).cast("long")
    every = settled(entries(landed, now_ms).withColumns({"canonical_hash": url_hash(canonical_url_exact(F.col("loc"))), "matches": _matches()}))
    matching = rations.sitemap_candidates(every.filter("matches"), [], [])
    new = dedupe.unseen(matching, seen(matching))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("rank"))
    new = new.withColumn("place", place).filter(F.col("place") <= F.col("settings.most"))
    # Where pages are read, what isn't there is unreadable; elsewhere the address is all there is.
    fetch = F.col("settings.fetch")
    pages = landed.select("source_id", F.col("url").alias("loc"), "status", "body").join(new.filter(fetch).select("source_id", "loc"), ["source_id", "loc"], "left_semi")
    pages = pages.select("source_id", "loc", F.when(F.col("status") < 400, meta("body")).alias("m"))
    read = new.join(pages, ["source_id", "loc"], "left").withColumn("readable", F.col("m").isNotNull() | ~fetch)
    dated = F.coalesce(~parse_date(F.col("m.published_raw"), now)["estimated"], F.lit(False))
    read = read.withColumns({
        "weak": ~dated, "undated": F.col("readable") & ~dated, "title": F.coalesce("m.title", title_from_url(F.col("loc"))), "summary": F.col("m.summary"),
        "categories": F.when(fetch, F.col("m.categories")).otherwise(F.array().cast("array<string>")), "own": F.col("m.published_raw"),
    })
    visited = settled(rations.undated_ration(read, F.col("settings.most_undated"), "place"))
    items = visited.filter("readable").select(
        "source_id", (F.col("place") - 1).cast("long").alias("source_pos"), F.col("loc").alias("url"), "title", "summary", F.when(F.col("weak"), F.coalesce("lastmod", "own")).otherwise(F.col("own")).alias("published_raw"),
        F.lit("string").alias("published_kind"), F.col("weak").alias("date_is_weak"), "categories",
    )
    facts = every.groupBy("source_id").agg(F.count("*").alias("entries"), F.count_if("matches").alias("matching"))
    facts = facts.join(new.groupBy("source_id").agg(F.count("*").alias("new")), "source_id", "left").withColumn("new", F.coalesce("new", F.lit(0).cast("long")))
    return items, visited.select("source_id", "canonical_hash"), facts
