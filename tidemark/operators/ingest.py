"""One run: landed bodies by adapter kind, the chain of fallbacks, item rows, rations, decisions, and how each source fared."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions.python import arrow
from tidemark.lineage import settled
from tidemark.operators import dedupe, health, rations
from tidemark.operators.normalise import normalise
from tidemark.operators.tagging import Taxonomy
from tidemark.sources import config, feeds, interfaces, pages, sitemaps

TAKE = 5
#: Kinds of adapters by the branch that scans them.
KINDS = (("rss",), ("json",), ("sitemap",), ("html", "browser"))
NOTES = 5
_RAW = ["source_id", "source_pos", "url", "title", "summary", "published_raw", "published_kind", "date_is_weak", "categories"]
_FACTS = "source_id string, healthy_empty boolean, error string"


def chain(sid: str, text: str | None) -> tuple[list[dict], str | None]:
    """The adapters of a stored configuration in the order of attempts, and what is wrong with it.

    A stored adapter is checked again when it is used; of fallbacks, those that are no adapters are left out.
    """
    try:
        raw = json.loads(text or "{}")
        primary = raw["adapter"]
        errors = config.adapter_errors(sid, primary, 200)
    except (ValueError, KeyError, TypeError, AttributeError) as bad:
        errors = [f"{sid}: no adapter ({bad})"]
    if errors:
        return [], "stored configuration: " + "; ".join(errors)
    return [primary, *(f for f in raw.get("fallback") or () if isinstance(f, dict) and not config.adapter_errors(sid, f, 200))], None


def _settings(adapter: dict) -> str:
    """What the scan of an adapter's kind needs to know, as JSON."""
    kind = adapter["kind"]
    if kind == "json":
        return json.dumps(interfaces.settings(adapter))
    if kind == "sitemap":
        return json.dumps(sitemaps.settings(adapter))
    return json.dumps(adapter.get("selectors") or {})


def _planned(sid: str, text: str | None) -> dict:
    good, wrong = chain(sid, text)
    return {"tries": [{"attempt": i, "kind": a["kind"], "settings": _settings(a)} for i, a in enumerate(good)], "wrong": wrong}


_PLAN = "struct<tries:array<struct<attempt:int,kind:string,settings:string>>,wrong:string>"


def adapters(sources: DataFrame) -> DataFrame:
    """source_id, tries (attempt, kind, settings as JSON) and wrong, a row a source."""
    plan = arrow(_planned, _PLAN)(F.col("id"), F.col("config_json"))
    return sources.select(F.col("id").alias("source_id"), plan.alias("p")).select("source_id", "p.*")


def _scan(kind: str, landed: DataFrame, seen, now_ms: int):
    """Raw items, facts (healthy_empty, error), and what was visited, of landed bodies of one kind of adapter, with what each needs in a column."""
    none = model.empty(landed.sparkSession, _FACTS)
    if kind == "rss":
        bad = feeds.feed_problems(landed).select("source_id", F.lit(False).alias("healthy_empty"), "error")
        return feeds.feed_items(landed), bad, None
    if kind == "json":
        landed = landed.withColumn("settings", F.from_json("settings", interfaces.SETTINGS))
        bad = interfaces.problems(landed).groupBy("source_id").agg(F.min_by("error", "page").alias("error"))
        return interfaces.newest(interfaces.items(landed), now_ms, F.col("settings.most")), bad.select("source_id", F.lit(False).alias("healthy_empty"), "error"), None
    if kind == "sitemap":
        items, visited, facts = sitemaps.scan(landed.withColumn("settings", F.from_json("settings", sitemaps.SETTINGS)), seen, now_ms)
        matching, new = F.coalesce("matching", F.lit(0)), F.coalesce("new", F.lit(0))
        every = landed.select("source_id").distinct().join(facts, "source_id", "left")
        error = F.when(F.coalesce("entries", F.lit(0)) == 0, "no addresses in the sitemap").when(matching == 0, "no address matches the include patterns")
        return items, every.select("source_id", ((matching > 0) & (new == 0)).alias("healthy_empty"), error.alias("error")), visited
    return pages.listing_items(landed, F.col("settings")), none, None  # a rendered page is a landed page


@dataclass
class Run:
    """What a run found: items to store (with pos), outcomes (a row a source), what to record, and what it visited."""

    items: DataFrame
    outcomes: DataFrame
    fetches: DataFrame
    visited: DataFrame


def run(landed: DataFrame, sources: DataFrame, stored, taxonomy: Taxonomy, now_ms: int) -> Run:
    """From landed bodies (model.LANDED) of some sources to rows to store, as if each source had been fetched now.

    A source's attempts are its primary adapter (0) and fallbacks; the first that is unchanged, has items or
    is rightly empty decides, else the last one. Known hashes leave before a source's own take_per_run is
    counted. stored: what is there already, a store or dedupe.Tables. Emptiness is judged on usable rows.
    Validators are kept from the primary adapter only. There is a branch of the plan for each kind of adapter; what adapters of a kind differ in is a column.
    """
    spark = landed.sparkSession
    present = landed.select("source_id").distinct()
    known = settled(adapters(sources.join(present, sources["id"] == present["source_id"], "left_semi")))
    wrong = known.filter("wrong is not null").select("source_id", F.col("wrong").alias("error"))
    plan = known.select("source_id", F.explode("tries").alias("t")).select("source_id", "t.*").withColumn("key", F.concat("source_id", F.lit("\x01"), F.col("attempt").cast("string")))
    # key: source and attempt together, so that scans of sources serve as scans of attempts.
    bodies = landed.join(plan, ["source_id", "attempt"])
    tries = bodies.groupBy("key").agg(
        F.first("source_id").alias("source_id"), F.first("attempt").alias("attempt"), F.first("kind").alias("kind"), F.max(F.coalesce(F.col("status") == 304, F.lit(False))).alias("not_modified"),
        F.min_by(F.struct("status", "error", "etag", "last_modified"), "page").alias("main"), F.max("fetched_at").alias("fetched_at"),
    )

    def seen(rows: DataFrame) -> DataFrame:
        """The visits of before that rows (of keys and hashes) may repeat."""
        of = rows.select(F.split_part("source_id", F.lit("\x01"), F.lit(1)).alias("source_id"), "canonical_hash")
        return stored.holding("seen_urls", of).join(plan.select("source_id", "key"), "source_id").drop("source_id").withColumnRenamed("key", "source_id")

    raws, facts, visits = [], [], []
    present = {r.kind for r in plan.select("kind").distinct().collect()}  # at most as many as there are kinds
    for kinds in KINDS:
        if not present & {*kinds}:
            continue
        own = bodies.filter(F.col("kind").isin(*kinds) & (F.col("status") < 300)).drop("source_id", "kind").withColumnRenamed("key", "source_id")
        raw, fact, visited = _scan(kinds[0], own, seen, now_ms)
        raws.append(raw.select(*_RAW))
        facts.append(fact.select("source_id", "healthy_empty", "error"))
        if visited is not None:
            visits.append(visited)
    union = lambda dfs, schema: reduce(DataFrame.unionByName, dfs) if dfs else model.empty(spark, schema)
    raw = settled(union(raws, model.RAW_ITEMS))
    facts = union(facts, _FACTS).select(F.col("source_id").alias("key"), "healthy_empty", F.col("error").alias("bad"))
    tries = tries.join(raw.groupBy(F.col("source_id").alias("key")).agg(F.count("*").alias("n_items")), "key", "left").join(facts, "key", "left")
    status = F.col("main.status")
    error = F.when(F.col("not_modified"), None).when(status.isNull(), F.coalesce("main.error", F.lit("not fetched"))).when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))).otherwise(F.col("bad"))
    tries = settled(tries.select("key", "source_id", "attempt", "kind", "not_modified", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("healthy_empty", F.lit(False)).alias("healthy_empty"), error.alias("error"), "main", "fetched_at"))
    picked = health.outcome_status(tries.withColumn("failed", F.col("error").isNotNull() & (F.col("n_items") == 0)))
    said = F.concat("kind", F.lit(": "), F.coalesce("error", F.lit("returned no items")))
    bad = tries.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("n_items") == 0) & ~F.col("not_modified") & ~F.col("healthy_empty"), F.struct("attempt", said.alias("t"))))), lambda x: x["t"]), " | ").alias("errors"))
    chosen = picked.join(tries.select("source_id", "attempt", "key", "kind", "healthy_empty", "main", "fetched_at"), ["source_id", "attempt"]).join(bad, "source_id")

    live = raw.withColumnRenamed("source_id", "key").join(chosen.filter("status not in ('error', 'not-modified')").select("key", F.col("source_id")), "key").drop("key")
    rows = settled(normalise(live, sources, taxonomy, now_ms))
    good = rows.filter("reason is null").drop("reason")
    notes = rows.filter("reason is not null").groupBy("source_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("source_pos", "reason"))), 1, NOTES), lambda x: x["reason"]).alias("notes"))
    there = settled(good.select("canonical_hash").distinct().join(stored.known(good), "canonical_hash", "left_semi"))
    known = good.join(there, "canonical_hash", "left_semi").groupBy("source_id").agg(F.countDistinct("canonical_hash").alias("known"))
    fresh = good.join(there, "canonical_hash", "left_anti")
    take = sources.select(F.col("id").alias("source_id"), F.when(F.col("take_per_run") > 0, F.col("take_per_run")).otherwise(TAKE).alias("__take"))
    ranked = settled(rations.newest_per_source(fresh.join(take, "source_id"), F.col("__take")))
    at = F.when(F.col("fresh") > F.col("__take"), F.col("rank")).otherwise(F.col("source_pos"))
    taken = ranked.filter("taken").withColumn("pos", F.concat("source_id", F.lit("\x01"), F.lpad(at.cast("string"), 20, "0")))
    decided = dedupe.decide_fresh(taken.select(*good.columns, "pos"), stored.near(taken))
    stats = decided.groupBy("source_id").agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("inserted", "duplicate_url", "duplicate_title")])
    counts = good.groupBy("source_id").agg(F.count("*").alias("fetched"))
    held = ranked.groupBy("source_id").agg(F.max("held").alias("held"))
    out = chosen
    for more in (counts, stats, known, held, notes):
        out = out.join(more, "source_id", "left")
    zero = F.lit(0).cast("long")
    fetched = F.coalesce("fetched", zero)
    empty = (F.col("status").isin("ok", "empty")) & (fetched == 0) & ~F.col("healthy_empty")
    status = F.when(empty, "empty").when(F.col("status") == "empty", "ok").otherwise(F.col("status"))
    why = F.when(empty & (F.col("errors") == ""), "no usable items").when(empty | (F.col("status") == "error"), F.col("errors"))
    out = out.select(
        "source_id", status.alias("status"), F.col("kind").alias("adapter_kind"), "attempt", fetched.alias("fetched"), F.coalesce("inserted", zero).alias("inserted"),
        (F.coalesce("duplicate_url", zero) + F.coalesce("known", zero)).alias("duplicate_url"), F.coalesce("duplicate_title", zero).alias("duplicate_title"), F.coalesce("held", zero).alias("held"), why.alias("error"),
        F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), F.col("main.etag").alias("etag"), F.col("main.last_modified").alias("last_modified"), "fetched_at",
    )
    gone = wrong.select("source_id", F.lit("error").alias("status"), "error", F.array().cast("array<string>").alias("notes"), F.lit(now_ms).cast("long").alias("fetched_at"))
    out = out.unionByName(gone.withColumns({c: zero for c in ("fetched", "inserted", "duplicate_url", "duplicate_title", "held")}), allowMissingColumns=True)
    out = settled(out)
    own = (F.col("attempt") == 0) & (F.col("status") == "ok")
    fetches = out.select("source_id", "status", "error", F.col("fetched").cast("int").alias("item_count"), F.when(own, F.col("etag")).alias("etag"), F.when(own, F.col("last_modified")).alias("last_modified"), "fetched_at")
    visited = union(visits, "source_id string, canonical_hash string").withColumn("source_id", F.split_part("source_id", F.lit("\x01"), F.lit(1)))
    return Run(decided.filter("decision = 'inserted'").drop("decision"), out.drop("etag", "last_modified", "fetched_at"), fetches, visited)
