"""Queries over the driver's tables, mapped to the article model, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, paths, text, urls
from tidemark.functions.python import spread
from tidemark.lineage import shared_dir
from tidemark.model import DAY_MS, ITEMS, ItemQuery, empty
from tidemark.operators import dedupe, discover, health, prune, rations, tagging
from tidemark.operators.tagging import Rule, Taxonomy
from tidemark.plans import bitmaps, panel
from tidemark.store import Store

START = 1_704_067_200_000
HOUR = 3_600_000

TAXONOMY = Taxonomy(
    facets=(
        ("type", "Type", ("short", "long", "none")),
        ("region", "Region", ("en", "fr", "de", "es", "it")),
        ("theme", "Theme", ("article", "license", "contact", "plain")),
        ("scope", "Scope", ("macro", "micro")),
    ),
    native={"EN": ("region:en",), "fr ": ("region:fr",), "de": ("region:de",)},
    rules=(
        Rule("theme:article", any=(r"\bthe\b", r"\bles?\b", r"\bder\b")),
        Rule("theme:license", all=(r"licen[cs]e",), any=(r"\bmit\b", r"\bgnu\b", r"public")),
        Rule("theme:contact", any=(r"\+\d", r"@\w")),
        Rule("theme:plain", none=(r"\d", r"[#|*]")),
    ),
)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stored: dict[tuple[str, str], str] = {}


def articles(spark: SparkSession, sf_dir: str, tagged: bool = True) -> DataFrame:
    """documents as items: a stored table, as the engine has it, written once a program and folder.

    Titles are first lines, summaries excerpts of whole texts, tags come from the rules over both.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = f"{shared_dir(spark)}/items-{uuid.uuid4().hex}"
        _items(spark, sf_dir).write.parquet(path)
        _stored[key] = path
    out = spark.read.parquet(_stored[key])
    return out if tagged else out.drop("tags")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    at = F.lit(START) + F.col("doc_id") * HOUR
    out = d.select(
        F.col("doc_id").alias("item_id"), F.concat_ws("-", "source", "lang").alias("source_id"), F.col("source").alias("institution"),
        F.trim(F.substring_index("text", "\n", 1)).alias("title"), text.excerpt(F.col("text")).alias("summary"),
        at.alias("published_at"), (F.col("doc_id") % 5 < 2).alias("date_estimated"), (at + DAY_MS).alias("first_seen_at"),
        F.array("lang").alias("native_categories"), F.when(F.col("n_chars") > 2000, "type:long").otherwise("type:short").alias("kind"),
    )
    themes = tagging.rule_tags(TAXONOMY.rules, tagging.haystack(F.col("title"), F.col("summary")))
    region = F.array(F.concat(F.lit("region:"), F.element_at("native_categories", 1)))
    return spread(out).withColumn("tags", F.array_sort(F.concat(F.array("kind"), region, themes))).drop("kind")


def _now(items: DataFrame) -> int:
    return items.agg(F.max("published_at")).first()[0] + 1


SELECTED = ItemQuery(tags=("region:fr", "region:de", "type:long"), since="30d", limit=20)


def _panel(query: ItemQuery):
    def run(spark, sf_dir):
        items = articles(spark, sf_dir)
        rows = panel.page_rows(items, query, _now(items.select("published_at")))
        return rows.select("item_id", "institution", "title", "published_at", "date_estimated", F.array_join("tags", ",").alias("tags"))

    return run


def panel_total(spark, sf_dir):
    items = articles(spark, sf_dir)
    return panel.total(items, SELECTED, _now(items))


def facet_institution(spark, sf_dir):
    items = articles(spark, sf_dir)
    return panel.institution_facet(items, SELECTED.but(institutions=("src1", "src2")), _now(items))


def facet_tags_self_excluded(spark, sf_dir):
    items = articles(spark, sf_dir)
    return panel.tag_counts(items, SELECTED, _now(items))


def facet_zero_fill(spark, sf_dir):
    items = articles(spark, sf_dir)
    return panel.tag_facets(items, SELECTED, _now(items), TAXONOMY.facet_values(spark))


def facet_tags_from_bitmaps(spark, sf_dir):
    """The tags' counts as intersections of bitmaps."""
    items = articles(spark, sf_dir)
    return bitmaps.tag_counts(bitmaps.bitmaps(items), items, SELECTED, _now(items))


def facet_institution_from_bitmaps(spark, sf_dir):
    items = articles(spark, sf_dir)
    return bitmaps.institution_facet(bitmaps.bitmaps(items), items, SELECTED.but(institutions=("src1", "src2")), _now(items))


def panel_search_by_trigrams(spark, sf_dir):
    """All items with a word, by what the word's trigrams have in common."""
    items = articles(spark, sf_dir)
    return bitmaps.search(items, bitmaps.trigrams(items), "License").select("item_id", "institution", "title", "published_at")


def corpus_totals(spark, sf_dir):
    return panel.corpus_totals(articles(spark, sf_dir, False))


def items_with_source_name(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").cast("string").alias("source_id"))
    sources = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return panel.with_source_name(orders, sources).select("item_id", "source_id", "source_name")


def item_tags_exploded(spark, sf_dir):
    return panel.item_tags(articles(spark, sf_dir))


def item_tags_joined(spark, sf_dir):
    items = articles(spark, sf_dir)
    tags = panel.item_tags(items).filter("item_id % 7 != 0")
    return panel.with_tags(items.select("item_id", "institution"), tags).select("item_id", "institution", F.array_join("tags", ",").alias("tags"))


def tags_semi_join(spark, sf_dir):
    items = articles(spark, sf_dir)
    return panel.having_tags(items.select("item_id"), panel.item_tags(items), SELECTED)


# Scalars.


def url_canonical(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


def url_canonical_exact(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", urls.canonical_url_exact(F.col("url")).alias("canonical"))


def url_canonical_hash(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", urls.url_hash(urls.canonical_url(F.col("url"))).alias("canonical_hash"))


def url_exact_dedupe(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", urls.url_hash(urls.canonical_url(F.col("url"))).alias("canonical_hash"))
    return dedupe.first_per_hash(pages, "page_id")


def title_key(spark, sf_dir):
    return articles(spark, sf_dir, False).select("item_id", text.title_key(F.col("title")).alias("title_key"))


def display_title(spark, sf_dir):
    d = articles(spark, sf_dir, False).select("item_id", "institution", F.concat_ws(" | ", F.col("title"), F.when(F.col("item_id") % 3 == 0, F.initcap("institution")).otherwise("another")).alias("title"))
    return d.select("item_id", text.display_title(F.col("title"), F.col("institution")).alias("title"))


def excerpt(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.excerpt(F.col("html")).alias("excerpt"))


def title_from_url(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", urls.title_from_url(F.col("url")).alias("title"))


def url_origin(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", urls.origin(F.col("url")).alias("origin"))


def json_path_props(spark, sf_dir):
    k = paths.as_string(paths.get_path(F.try_parse_json("props"), "k"))
    return _t(spark, sf_dir, "events").select(k.alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def date_parse_classes(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    kind = F.col("event_id") % 6
    raw = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 1, F.unix_seconds("ts").cast("string")).when(kind == 2, F.unix_millis("ts").cast("string"))
        .when(kind == 3, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(kind == 4, F.date_format("ts", "MMMM d, yyyy")).otherwise(F.lit("not a date"))
    )
    got = dates.parse_date(raw, F.lit(START + 60 * DAY_MS).cast("long"))
    return e.select("event_id", got["ms"].alias("ms"), got["estimated"].alias("estimated"))


def age_labels(spark, sf_dir):
    d = articles(spark, sf_dir, False)
    return d.select("item_id", text.age_label(F.col("published_at"), F.lit(START + 800 * HOUR).cast("long")).alias("label"))


def robots_allowed(spark, sf_dir):
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    return _t(spark, sf_dir, "pages").select("page_id", urls.robots_allows(path, ["/en/1*", "/fr/"], ["/en/", "/*.html$", "/fr/"]).alias("allowed"))


# Selection and dedupe.


def _url_rows(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", "url", urls.url_hash(urls.canonical_url(F.col("url"))).alias("canonical_hash"))
    return p.withColumn("source_id", urls.origin(F.col("url")))


def newest_n_per_source(spark, sf_dir):
    rows = articles(spark, sf_dir, False).withColumn("source_pos", F.col("item_id"))
    return rations.take_newest(rows, 5).select("source_id", "item_id", F.col("rank").cast("long").alias("rank"))


def ration_held(spark, sf_dir):
    rows = articles(spark, sf_dir, False).withColumn("source_pos", F.col("item_id"))
    return rations.newest_per_source(rows, F.lit(5)).groupBy("source_id").agg(F.count_if("taken").alias("taken"), F.max("held").alias("held"))


def known_hash_anti(spark, sf_dir):
    rows = _url_rows(spark, sf_dir)
    return dedupe.not_known(rows.filter("page_id % 3 = 2"), rows.filter("page_id % 3 = 0"), rows.filter("page_id % 3 = 1")).select("page_id", "canonical_hash")


def known_hash_store(spark, sf_dir):
    """As known_hash_anti, against a store of ten folders: only folders whose filters have a hash of the batch are read."""
    rows = _url_rows(spark, sf_dir)
    store = _store(spark)
    blank = empty(spark, ITEMS).schema
    item = lambda df: df.select(*[F.col("canonical_hash") if f.name == "canonical_hash" else F.col("page_id").alias("item_id") if f.name == "item_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in blank])
    for part in range(5):
        own = rows.filter(f"(page_id div 3) % 5 = {part}")
        store.change({"items": item(own.filter("page_id % 3 = 0")), "pruned_urls": own.filter("page_id % 3 = 1").select("canonical_hash", F.lit(1).cast("long").alias("pruned_at"))})
    batch = rows.filter("page_id % 3 = 2")
    return batch.join(store.known(batch), "canonical_hash", "left_anti").select("page_id", "canonical_hash")


def _dated_store(spark, sf_dir):
    """A compacted store of the articles, with bitmaps and trigrams: written once a program and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, "store")
    if key not in _stored:
        store = _store(spark)
        items = articles(spark, sf_dir).withColumns({"url": F.lit("u"), "canonical_hash": F.sha2(F.col("item_id").cast("string"), 256), "title_key": F.lit("")}).select(*[f.split()[0] for f in ITEMS.split(", ")])
        Store(spark, store.root).change({"items": items})  # the index is made of the clustered folders
        store.compact(most=0)
        _stored[key] = store.root
    return Store(spark, _stored[key], indexed=True)


def panel_page_store(spark, sf_dir):
    """The first page, read from the newest folders of a store until it is full."""
    items = articles(spark, sf_dir)
    rows = _dated_store(spark, sf_dir).page_rows(SELECTED, _now(items))
    return rows.select("item_id", "institution", "title", "published_at", "date_estimated", F.array_join("tags", ",").alias("tags"))


def facet_tags_store(spark, sf_dir):
    """The tags' counts from the bitmaps that a store keeps beside its folders."""
    return _dated_store(spark, sf_dir).facets(SELECTED, _now(articles(spark, sf_dir)))[0]


def _store(spark) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", indexed=True)


def unseen_per_source(spark, sf_dir):
    rows = _url_rows(spark, sf_dir)
    return dedupe.unseen(rows, rows.filter("page_id % 2 = 0")).select("page_id", "source_id")


def _titled(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pos"), F.col("lang").alias("institution"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title_key"), (F.lit(START) + F.col("doc_id") * HOUR).alias("published_at"))


def near_duplicate_band_join(spark, sf_dir):
    rows = _titled(spark, sf_dir)
    stored = rows.filter("pos % 2 = 0").withColumnRenamed("pos", "item_id")
    return dedupe.not_near_stored(rows.filter("pos % 2 = 1"), stored).select("pos")


def near_duplicate_greedy(spark, sf_dir):
    return dedupe.greedy(_titled(spark, sf_dir)).select("pos", "kept")


def undated_ration(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source_id"), (F.col("event_type") == "error").alias("undated"))
    return rations.undated_ration(e, 3, "event_id").select("event_id", "source_id")


def sitemap_include_exclude(spark, sf_dir):
    return _t(spark, sf_dir, "pages").filter(rations.included(F.col("url"), [r"/EN/\d", r"\.example\.net/"], [r"spam", r"\?page="])).select("page_id")


def sitemap_newest(spark, sf_dir):
    rows = _url_rows(spark, sf_dir).select(F.lit("all").alias("source_id"), F.col("url").alias("loc"), ((F.col("page_id") * 37) % 101).alias("date_key"), F.col("page_id").alias("source_pos"), "canonical_hash")
    return rations.sitemap_candidates(rows, [r"/en/"], []).select("source_pos", F.col("rank").cast("long").alias("rank"))


def insert_decisions(spark, sf_dir):
    """A batch against a store, by hash and by title, in arrival order."""
    rows = _titled(spark, sf_dir).withColumn("canonical_hash", F.sha2(F.concat_ws("|", "institution", "title_key", (F.col("pos") % 2).cast("string")), 256))
    stored = rows.filter("pos % 10 = 0").withColumnRenamed("pos", "item_id")
    pruned = rows.filter("pos % 10 = 1").select("canonical_hash")
    return dedupe.decide(rows.filter("pos % 10 > 1"), stored, pruned).select("pos", "decision")


# Tags.


def tag_rules(spark, sf_dir):
    tags = tagging.rule_tags(TAXONOMY.rules, tagging.haystack(F.col("title"), F.col("summary")))
    return articles(spark, sf_dir, False).select("item_id", F.array_join(F.array_sort(tags), ",").alias("tags"))


def tag_native_map(spark, sf_dir):
    tags = tagging.native_tags(TAXONOMY.native, F.col("native_categories"))
    return articles(spark, sf_dir, False).select("item_id", F.array_join(tags, ",").alias("tags"))


def tag_union_sorted(spark, sf_dir):
    static = F.array(F.lit("scope:macro"), F.lit("scope:undeclared"))
    tags = tagging.all_tags(TAXONOMY, F.col("title"), F.col("summary"), F.col("native_categories"), static)
    return articles(spark, sf_dir, False).select("item_id", F.array_join(tags, ",").alias("tags"))


def retag_by_source(spark, sf_dir):
    items = articles(spark, sf_dir)
    sources = items.select("source_id").distinct().filter("source_id not like '%-es'").select(F.col("source_id").alias("id"), F.array(F.lit("scope:micro")).alias("static_tags"))
    return tagging.retag(items, sources, TAXONOMY).select("item_id", F.array_join("tags", ",").alias("tags"))


def unmapped_top25(spark, sf_dir):
    items = _t(spark, sf_dir, "documents").select(F.array("lang", "source").alias("native_categories"))
    return tagging.unmapped(items, TAXONOMY.native_map(spark))


def untagged_items(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    return panel.untagged(docs, _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id")))


# Maintenance.

def _streaks(spark, sf_dir):
    log = _t(spark, sf_dir, "events").withColumn("source_id", F.col("user_id"))
    return health.streaks(log, ["ts", "event_id"], F.col("event_type") != "error")


def failure_streak(spark, sf_dir):
    return _streaks(spark, sf_dir)


def _registry(spark, sf_dir):
    """A source per user: health from the log of events."""
    log = _t(spark, sf_dir, "events")
    last = log.groupBy(F.col("user_id").alias("source_id")).agg(F.max(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", "event_type")).alias("last"))
    kind = F.col("last.event_type")
    status = F.when(kind == "error", "error").when(kind == "view", "empty").otherwise("ok")
    return last.join(_streaks(spark, sf_dir), "source_id").select(
        F.col("source_id").alias("id"), F.concat(F.lit("inst"), F.col("source_id") % 7).alias("institution"), F.concat(F.lit("name"), F.col("source_id")).alias("name"), (F.col("source_id") % 11 != 0).alias("enabled"),
        (F.col("source_id") % 13 != 0).alias("in_config"), F.lit(30).alias("poll_minutes"), F.col("last.ms").alias("last_fetch_at"), status.alias("last_status"), "consecutive_failures",
    )


def due_sources(spark, sf_dir):
    return health.due_sources(_registry(spark, sf_dir), F.lit(START + 30 * DAY_MS).cast("long")).select("id", "last_fetch_at", "consecutive_failures")


def fetch_schedule(spark, sf_dir):
    """Lane and start of every active source: a source per user, a host for each hundred, some with several requests."""
    due = health.to_run(_registry(spark, sf_dir), START, force=True)
    out = health.schedule(due, F.concat(F.lit("Host"), F.col("id") % 37), F.col("id") % 4)
    return out.select("id", "host", F.col("lane").cast("long").alias("lane"), "place", "start_ms")


def health_rows(spark, sf_dir):
    return health.health_rows(_registry(spark, sf_dir)).select("id", "institution", "name", "last_status", "broken")


def broken_count(spark, sf_dir):
    return health.broken_count(_registry(spark, sf_dir))


def _cutoff(items):
    n = items.agg(F.max("published_at"), F.min("published_at")).first()
    return (n[0] + n[1]) // 2


def prune_preview(spark, sf_dir):
    items = articles(spark, sf_dir, False)
    return prune.preview(items, _cutoff(items))


def prune_by_institution(spark, sf_dir):
    items = articles(spark, sf_dir, False)
    return prune.by_institution(items, _cutoff(items))


def prune_kept(spark, sf_dir):
    items = articles(spark, sf_dir, False)
    return prune.kept(items, _cutoff(items)).select("item_id")


def prune_tombstones(spark, sf_dir):
    items = articles(spark, sf_dir, False).withColumn("canonical_hash", F.sha2("title", 256))
    return prune.tombstones(items, empty(spark, "canonical_hash string, pruned_at long"), _cutoff(items), 1)


def orphan_tags(spark, sf_dir):
    items = articles(spark, sf_dir)
    return panel.orphan_tags(panel.item_tags(items), items.filter("item_id % 4 != 0"))


def source_upsert(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    row = lambda df, tag: df.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("institution"), F.concat(F.col("c_name"), F.lit(tag)).alias("name"), F.lit("").alias("homepage"), F.lit("rss").alias("adapter_kind"),
        F.lit("{}").alias("config_json"), F.array().cast("array<string>").alias("static_tags"), F.lit(30).alias("poll_minutes"), F.lit(5).alias("take_per_run"), F.lit(True).alias("enabled"),
    )
    stored = row(c.filter("c_custkey % 3 != 0"), "").withColumns({"in_config": F.lit(True), "last_status": F.lit("ok"), "consecutive_failures": F.lit(2)})
    return health.sync_sources(stored, row(c.filter("c_custkey % 3 != 1"), "!")).select("id", "institution", "name", "in_config", "last_status", "consecutive_failures")


# Discovery.


def record_score(spark, sf_dir):
    """conversations as interfaces that each return their turns: how much like articles they are."""
    c = _t(spark, sf_dir, "conversations").withColumn("size", F.count("*").over(Window.partitionBy("conv_id")))
    rows = c.select(
        F.col("conv_id").cast("string").alias("call"), F.lit("turns").alias("path"), F.lit(0).alias("rank"), F.col("turn").cast("int").alias("record"), "size",
        F.explode(F.array(F.struct(F.lit("title").alias("key"), F.col("text").alias("text")), F.struct(F.lit("link").alias("key"), F.concat(F.lit("/t/"), F.col("turn").cast("string")).alias("text")))).alias("f"),
    ).select("call", "path", "rank", "record", "size", "f.*").withColumns({"is_number": F.lit(False), "is_text": F.lit(True), "has_texts": F.lit(False)})
    return discover.record_scores(rows, F.lit(START).cast("long")).select("call", F.round("score", 6).alias("score"))


def queries() -> dict:
    q = {
        "panel_page_newest": _panel(SELECTED),
        "panel_page_oldest": _panel(SELECTED.but(sort="oldest")),
        "panel_cursor_page2": _panel(ItemQuery(since="all", limit=20, cursor=f"0.{START + 500 * HOUR}.500")),
        "panel_since_7d": _panel(ItemQuery(limit=50)),
        "panel_search_literal": _panel(ItemQuery(q="%", since="all", limit=50)),
        "panel_search": _panel(ItemQuery(q="License", since="all", limit=50)),
        "panel_institution_in": _panel(ItemQuery(institutions=("src1", "src2"), since="all", limit=50)),
        "panel_tags_or_within_and_across": _panel(ItemQuery(tags=("region:fr", "region:es", "theme:plain"), since="all", limit=50)),
        "panel_facetless_tag_ignored": _panel(ItemQuery(tags=("nonsense",), since="all", limit=50)),
    }
    own = (
        panel_total, facet_tags_from_bitmaps, facet_institution_from_bitmaps, panel_search_by_trigrams, facet_institution, facet_tags_self_excluded, facet_zero_fill, corpus_totals, items_with_source_name, item_tags_exploded, item_tags_joined, tags_semi_join, url_canonical, url_canonical_exact,
        url_canonical_hash, url_exact_dedupe, title_key, display_title, excerpt, title_from_url, url_origin, json_path_props, date_parse_classes, age_labels, robots_allowed, newest_n_per_source, ration_held, known_hash_anti, known_hash_store, panel_page_store, facet_tags_store,
        unseen_per_source, near_duplicate_band_join, near_duplicate_greedy, undated_ration, sitemap_include_exclude, sitemap_newest, insert_decisions, tag_rules, tag_native_map, tag_union_sorted, retag_by_source, unmapped_top25,
        untagged_items, due_sources, fetch_schedule, health_rows, broken_count, failure_streak, prune_preview, prune_by_institution, prune_kept, prune_tombstones, orphan_tags, source_upsert, record_score,
    )
    from tidemark import landed_queries

    return q | {f.__name__: f for f in own} | landed_queries.queries()
