"""Facet counts as intersections of bitmaps, and substring search by an inverted index of trigrams.

Bitmaps: for each tag, institution and day the items that have it, in blocks of 32,768 item numbers. A count
under a selection is the size of an intersection of blocks: no item is read but those of the one day in which
a period begins. Bitmaps of several folders are or-ed where they meet.

Trigrams: for each three characters of title and summary the items that have them, in blocks; what all
trigrams of a needle have in common is looked at for the needle itself. Needles under three characters scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import ascii_lower, contains_text, folded
from tidemark.model import DAY_MS, SINCE_MS, ItemQuery, facet_of

#: Item numbers in a block of postings.
BLOCK = 4096
BITMAPS = "kind string, value string, block long, bits binary"
POSTINGS = "gram string, block long, places array<int>"


def bitmaps(items: DataFrame, *of: str) -> DataFrame:
    """kind (tag, institution, day), value, block and bits; kind `all` has every item. of: columns of items whose values have bitmaps each."""
    kinds = F.array(
        F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")),
        F.struct(F.lit("institution").alias("kind"), F.col("institution").alias("value")),
        F.struct(F.lit("day").alias("kind"), _day(F.col("published_at")).cast("string").alias("value")),
    )
    tags = F.transform(F.array_distinct("tags"), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value")))
    rows = items.select(*of, "item_id", F.explode(F.concat(kinds, F.coalesce(tags, F.array().cast("array<struct<kind:string,value:string>>")))).alias("k"))
    return rows.groupBy(*of, "k.kind", "k.value", F.bitmap_bucket_number("item_id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("item_id")).alias("bits"))


def _day(at: Column) -> Column:
    return F.floor(at / DAY_MS).cast("long")


def merged(found: DataFrame) -> DataFrame:
    """Bitmaps of several folders as one table."""
    return found.groupBy("kind", "value", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def _any(found: DataFrame, kind: str, chosen: Column) -> DataFrame:
    return found.filter((F.col("kind") == kind) & chosen).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def _of(items: DataFrame) -> DataFrame:
    return items.groupBy(F.bitmap_bucket_number("item_id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("item_id")).alias("bits"))


def _restrictions(found: DataFrame, items: DataFrame, query: ItemQuery, now_ms: int, grams: DataFrame | None) -> dict[str, DataFrame]:
    """(block, bits) of what each part of the selection leaves, by part: since, q, institution, or a facet."""
    out = {}
    if query.since != "all":
        cut = now_ms - SINCE_MS[query.since]
        first = cut // DAY_MS
        whole = found.filter((F.col("kind") == "day") & (F.col("value").cast("long") > first)).select("block", "bits")
        part = _of(items.filter((F.col("published_at") >= cut) & (F.col("published_at") < (first + 1) * DAY_MS)))
        out["since"] = whole.unionByName(part).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    if query.q:
        out["q"] = _of(search(items, grams, query.q) if grams is not None else items.filter(contains_text(query.q, F.col("title"), F.col("summary"))))
    if query.institutions:
        out["institution"] = _any(found, "institution", F.col("value").isin(*query.institutions))
    chosen: dict[str, list[str]] = {}
    for tag in query.tags:
        if facet_of(tag):
            chosen.setdefault(facet_of(tag), []).append(tag)
    return out | {f"facet {f}": _any(found, "tag", F.col("value").isin(*tags)) for f, tags in chosen.items()}


def _counts(counted: DataFrame, parts: dict[str, DataFrame], spared: Column) -> DataFrame:
    """value, n: how many items of each value are in all parts but the one that spared names."""
    if not parts:
        return counted.groupBy("value").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    other = reduce(DataFrame.unionByName, [p.select(F.lit(name).alias("part"), "block", F.col("bits").alias("__bits")) for name, p in parts.items()])
    own = counted.withColumn("spared", F.coalesce(spared, F.lit("")))
    met = own.select("value", "block", "spared").join(other, "block").filter(F.col("part") != F.col("spared")).select("value", "block", F.col("__bits").alias("bits"))
    wanted = F.lit(len(parts) + 1) - F.col("spared").isin(*parts).cast("int")
    every = met.unionByName(own.select("value", "block", "bits")).groupBy("value", "block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("met"))
    full = every.join(own.select("value", "block", wanted.alias("wanted")), ["value", "block"]).filter(F.col("met") == F.col("wanted"))
    return full.groupBy("value").agg(F.sum(F.bitmap_count("bits")).alias("n")).filter("n > 0")


def tag_counts(found: DataFrame, items: DataFrame, query: ItemQuery, now_ms: int, grams: DataFrame | None = None) -> DataFrame:
    """tag, n: as panel.tag_counts(), each tag counted under all choices but those of its own facet."""
    tags = found.filter((F.col("kind") == "tag") & (F.instr("value", ":") > 0)).select("value", "block", "bits")
    spared = F.concat(F.lit("facet "), F.substring_index("value", ":", 1))
    return _counts(tags, _restrictions(found, items, query, now_ms, grams), spared).withColumnRenamed("value", "tag")


def institution_facet(found: DataFrame, items: DataFrame, query: ItemQuery, now_ms: int, grams: DataFrame | None = None) -> DataFrame:
    """institution, n: as panel.institution_facet(), whatever institutions are chosen; largest first."""
    own = found.filter("kind = 'institution' and value is not null").select("value", "block", "bits")
    return _counts(own, _restrictions(found, items, query.but(institutions=()), now_ms, grams), F.lit("")).withColumnRenamed("value", "institution").orderBy(F.desc("n"), "institution")


def total(found: DataFrame, items: DataFrame, query: ItemQuery, now_ms: int, grams: DataFrame | None = None) -> DataFrame:
    """One row: how many items match."""
    own = found.filter("kind = 'all'").select("value", "block", "bits")
    return _counts(own, _restrictions(found, items, query, now_ms, grams), F.lit("")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))


# Search.


def trigrams(items: DataFrame, *of: str) -> DataFrame:
    """gram, block, places: the items of a block of numbers that have the gram in title or summary, A-Z in lower case; at most BLOCK places a row.

    A text is walked once, however long: substr() counts characters from its begin each time. of: as for bitmaps().
    """
    texts = items.select(*of, "item_id", F.explode(F.array(ascii_lower(F.col("title")), ascii_lower(F.col("summary")))).alias("t"))
    every = F.regexp_extract_all("t", F.lit("(?s)(?=(...))."), F.lit(1))
    grams = texts.select(*of, "item_id", F.explode(F.array_distinct(every)).alias("gram"))
    return grams.groupBy(*of, "gram", F.floor(F.col("item_id") / BLOCK).alias("block")).agg(F.array_sort(F.collect_set(F.pmod("item_id", F.lit(BLOCK)).cast("int"))).alias("places"))


def candidates(grams: DataFrame, needle: str) -> DataFrame:
    """item_id of the items that have all trigrams of the needle."""
    low = folded(needle)
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    met = grams.filter(F.col("gram").isin(*wanted)).select("gram", "block", F.explode("places").alias("place")).distinct()
    full = met.groupBy("block", "place").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
    return full.select((F.col("block") * BLOCK + F.col("place")).alias("item_id"))


def search(items: DataFrame, grams: DataFrame, needle: str) -> DataFrame:
    """items with the needle in title or summary, whatever the case: candidates by trigrams, looked at for the needle."""
    if not needle:
        return items
    confirmed = contains_text(needle, F.col("title"), F.col("summary"))
    if len(needle) < 3:
        return items.filter(confirmed)
    return items.join(candidates(grams, needle), "item_id", "left_semi").filter(confirmed)
