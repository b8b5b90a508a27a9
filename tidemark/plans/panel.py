"""The read side: one filtered page in keyset order, its total, and facet counts from a single scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions.text import contains_text
from tidemark.model import SINCE_MS, Cursor, ItemQuery, facet_of
from tidemark.operators import health


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def since_filter(query: ItemQuery, now_ms: int) -> Column:
    return F.lit(True) if query.since == "all" else F.col("published_at") >= F.lit(now_ms - SINCE_MS[query.since])


def text_filter(query: ItemQuery) -> Column:
    return contains_text(query.q, F.col("title"), F.col("summary")) if query.q else F.lit(True)


def institution_filter(query: ItemQuery) -> Column:
    return F.col("institution").isin(*query.institutions) if query.institutions else F.lit(True)


def tag_filters(query: ItemQuery) -> dict[str, Column]:
    """For each facet chosen from: whether an item has any of its chosen tags."""
    chosen: dict[str, list[str]] = {}
    for tag in query.tags:
        if facet_of(tag):
            chosen.setdefault(facet_of(tag), []).append(tag)
    return {f: F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, ts))), F.lit(False)) for f, ts in chosen.items()}


def matches(query: ItemQuery, now_ms: int) -> Column:
    return _all([since_filter(query, now_ms), text_filter(query), institution_filter(query), *tag_filters(query).values()])


def order(query: ItemQuery) -> list[Column]:
    """Stated dates first, either way."""
    way = F.desc if query.sort == "newest" else F.asc
    return [F.asc("date_estimated"), way("published_at"), way("item_id")]


def after(query: ItemQuery) -> Column:
    """What comes after the cursor in that order."""
    c = Cursor.parse(query.cursor)
    if c is None:
        return F.lit(True)
    est, at, item = F.col("date_estimated").cast("int"), F.col("published_at"), F.col("item_id")
    past = (lambda a, b: a < b) if query.sort == "newest" else (lambda a, b: a > b)
    return (est > c.estimated) | ((est == c.estimated) & (past(at, c.at) | ((at == c.at) & past(item, c.item_id))))


#: Columns that deciding on a page's rows takes.
NEEDED = ("item_id", "institution", "title", "summary", "published_at", "date_estimated", "tags")


def page_rows(items: DataFrame, query: ItemQuery, now_ms: int) -> DataFrame:
    """The page; the limit becomes a top-k, so no full sort."""
    return items.filter(matches(query, now_ms) & after(query)).orderBy(*order(query)).limit(query.limit)


def total(items: DataFrame, query: ItemQuery, now_ms: int) -> DataFrame:
    """One row: how many items match, wherever the cursor stands."""
    return items.filter(matches(query, now_ms)).agg(F.count("*").alias("total"))


def with_source_name(items: DataFrame, sources: DataFrame) -> DataFrame:
    return items.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")


def institution_facet(items: DataFrame, query: ItemQuery, now_ms: int) -> DataFrame:
    """Counts by institution, whatever institutions are chosen; largest first."""
    return items.filter(matches(query.but(institutions=()), now_ms)).groupBy("institution").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "institution")


def tag_counts(items: DataFrame, query: ItemQuery, now_ms: int) -> DataFrame:
    """tag, n: each tag counted under all choices but those of its own facet, in one scan.

    An item counts for a facet's tags if it meets every other facet's choice, so the number of
    choices that it misses, and which, is enough.
    """
    base = items.filter(_all([since_filter(query, now_ms), text_filter(query), institution_filter(query)]))
    chosen = tag_filters(query)
    missed = F.array_compact(F.array(*[F.when(~m, F.lit(f)) for f, m in chosen.items()])) if chosen else F.array().cast("array<string>")
    rows = base.select("tags", missed.alias("missed")).filter(F.size("missed") <= 1)
    tags = rows.select(F.explode(F.array_distinct("tags")).alias("tag"), "missed").filter(F.instr("tag", ":") > 0)
    own = (F.size("missed") == 0) | (F.element_at("missed", 1) == F.substring_index("tag", ":", 1)) if chosen else F.lit(True)
    return tags.filter(own).groupBy("tag").agg(F.count("*").alias("n"))


def tag_facets(items: DataFrame, query: ItemQuery, now_ms: int, facet_values: DataFrame) -> DataFrame:
    """facet, label, value, n for all declared values, in declared order, zero where nothing matches."""
    counts = tag_counts(items, query, now_ms)
    declared = facet_values.withColumn("tag", F.concat_ws(":", "facet", "value"))
    return (
        declared.join(counts, "tag", "left")
        .select("facet", "label", "facet_pos", "value", "value_pos", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("facet_pos", "value_pos")
    )


@dataclass
class Page:
    items: list[Row]
    next_cursor: str | None
    total: int
    institutions: DataFrame
    facets: DataFrame


def answer(items: DataFrame, query: ItemQuery, now_ms: int, facet_values: DataFrame, sources: DataFrame | None = None) -> Page:
    """All that a reader's panel shows. Only the page itself, at most a few hundred rows, is collected."""
    named = with_source_name(items, sources) if sources is not None else items
    rows = page_rows(named, query.but(limit=query.limit + 1), now_ms).withColumn("tags", F.array_sort("tags")).collect()
    rows, more = rows[: query.limit], len(rows) > query.limit
    cursor = str(Cursor(int(rows[-1]["date_estimated"]), rows[-1]["published_at"], rows[-1]["item_id"])) if more else None
    return Page(rows, cursor, total(items, query, now_ms).first()[0], institution_facet(items, query, now_ms), tag_facets(items, query, now_ms, facet_values))


def taxonomy_answer(taxonomy) -> dict:
    """The declared facets, in order, as a reader gets them."""
    return {"facets": [{"id": f, "label": label, "values": list(values)} for f, label, values in taxonomy.facets]}


def health_answer(sources: DataFrame, items: DataFrame) -> dict:
    """How the active sources fare, a row each, with totals and the number of broken ones."""
    rows = [r.asDict(True) for r in health.health_rows(sources).collect()]
    n, last = corpus_totals(items).first()
    return {"sources": rows, "total_items": n, "last_ingest_at": last, "broken": sum(r["broken"] for r in rows)}


def corpus_totals(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("total_items"), F.max("first_seen_at").alias("last_ingest_at"))


# The normalised pair of tables, for those who keep tags apart.


def item_tags(items: DataFrame) -> DataFrame:
    return items.select("item_id", F.explode(F.array_distinct("tags")).alias("tag"))


def with_tags(items: DataFrame, tags: DataFrame) -> DataFrame:
    """items (without tags) with a sorted array of theirs, empty where there are none."""
    packed = tags.groupBy("item_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return items.join(packed, "item_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def having_tags(items: DataFrame, tags: DataFrame, query: ItemQuery) -> DataFrame:
    """items with a tag of every facet chosen from: a semi-join each."""
    chosen: dict[str, list[str]] = {}
    for tag in query.tags:
        if facet_of(tag):
            chosen.setdefault(facet_of(tag), []).append(tag)
    for some in chosen.values():
        items = items.join(tags.filter(F.col("tag").isin(*some)).select("item_id"), "item_id", "left_semi")
    return items


def orphan_tags(tags: DataFrame, items: DataFrame) -> DataFrame:
    return tags.join(items.select("item_id"), "item_id", "left_anti")


def untagged(items: DataFrame, tags: DataFrame) -> DataFrame:
    return items.join(tags.select("item_id"), "item_id", "left_anti")
