"""Sources: which are due, how they fare, and how the registry changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import rations

GOOD = ("ok", "not-modified")


def is_due(now_ms: Column) -> Column:
    """Enabled, configured, and its poll time, doubled for each failure up to four, is over."""
    wait = F.col("poll_minutes").cast("long") * 60000 * F.pow(F.lit(2.0), F.least("consecutive_failures", F.lit(4))).cast("long")
    return F.col("enabled") & F.col("in_config") & (F.col("last_fetch_at").isNull() | (F.col("last_fetch_at") + wait <= now_ms))


def due_sources(sources: DataFrame, now_ms: Column) -> DataFrame:
    return sources.filter(is_due(now_ms)).orderBy(F.coalesce("last_fetch_at", F.lit(0).cast("long")), "id")


def to_run(sources: DataFrame, now_ms: int, force: bool = False) -> DataFrame:
    """What a run reads: the sources that are due, or with force all that are active."""
    return forced(sources) if force else due_sources(sources, F.lit(now_ms).cast("long"))


def forced(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled and in_config")


#: Sources that are read side by side, and the least time between two requests to one host.
LANES, GAP_MS = 4, 1000


def schedule(due: DataFrame, host: Column, requests: Column | None = None, lanes: int = LANES, gap_ms: int = GAP_MS) -> DataFrame:
    """due with host, lane, place (from 1 on, in the lane) and start_ms: when each source's first request may go out.

    A host's sources are read one after another, those that wait longest first, a gap between any two requests
    (requests: how many a source needs, 1 by default); so all of a host's are in one lane. Hosts go to the lanes
    in turn, those with most to do first, and a lane reads one host after another. Starts are running sums: those
    of a host's sources, and those of a lane's hosts, of which only a row each is summed by lane.
    """
    takes = (F.greatest(F.coalesce(requests, F.lit(1)), F.lit(1)) if requests is not None else F.lit(1)).cast("long") * gap_ms
    every = due.withColumn("host", F.coalesce(F.lower(host), F.lit(""))).withColumn("__takes", takes)
    mine = Window.partitionBy("host").orderBy(F.coalesce("last_fetch_at", F.lit(0).cast("long")), "id")
    ahead = mine.rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("__at", F.coalesce(F.sum("__takes").over(ahead), F.lit(0).cast("long"))).withColumn("__nth", F.row_number().over(mine))
    hosts = every.groupBy("host").agg(F.sum("__takes").alias("__all"), F.count("*").alias("__n"))
    ranked = rations.numbered(hosts, 0, F.desc("__all"), "host").withColumnRenamed("item_id", "__rank")
    lane = ranked.withColumn("lane", F.pmod(F.col("__rank") - 1, F.lit(lanes)).cast("int"))
    before = Window.partitionBy("lane").orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    lane = lane.select("host", "lane", F.coalesce(F.sum("__all").over(before), zero).alias("__from"), F.coalesce(F.sum("__n").over(before), zero).alias("__done"))
    out = every.join(lane, "host").withColumns({"place": F.col("__done") + F.col("__nth"), "start_ms": F.col("__from") + F.col("__at")})
    return out.select(*due.columns, "host", "lane", "place", "start_ms")


def listed(sources: DataFrame) -> DataFrame:
    return sources.orderBy("institution", "name")


def health_rows(sources: DataFrame) -> DataFrame:
    """Active sources by institution and name, with broken: the last run failed or came back empty."""
    return listed(forced(sources).withColumn("broken", F.coalesce(F.col("last_status").isin("error", "empty"), F.lit(False))))


def broken_count(sources: DataFrame) -> DataFrame:
    return forced(sources).agg(F.count_if(F.col("last_status").isin("error", "empty")).alias("broken"))


def streaks(fetches: DataFrame, order: list[str], good: Column) -> DataFrame:
    """source_id, consecutive_failures and fetches, from a log: failures since the last good fetch.

    Two sums that combine before the shuffle: no window over a source's history.
    """
    at = F.struct(*order)
    last = fetches.groupBy("source_id").agg(F.max(F.when(good, at)).alias("last_good"), F.count("*").alias("fetches"))
    later = fetches.join(last, "source_id").filter(~good & (F.col("last_good").isNull() | (at > F.col("last_good")))).groupBy("source_id").agg(F.count("*").alias("n"))
    return last.join(later, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("consecutive_failures"), "fetches")


def record_fetches(sources: DataFrame, fetches: DataFrame) -> DataFrame:
    """sources after a round of fetches, one at most each; validators stay where a fetch brought none."""
    f = fetches.select("source_id", *[F.col(c).alias(f"f_{c}") for c in ("status", "error", "item_count", "etag", "last_modified", "fetched_at")])
    j = sources.join(f, sources["id"] == f["source_id"], "left")
    met = F.col("f_status").isNotNull()
    good = F.col("f_status").isin(*GOOD)
    changed = {
        "last_status": F.col("f_status"), "last_error": F.col("f_error"), "last_item_count": F.col("f_item_count"), "last_fetch_at": F.col("f_fetched_at"),
        "etag": F.coalesce("f_etag", "etag"), "last_modified": F.coalesce("f_last_modified", "last_modified"),
        "consecutive_failures": F.when(good, 0).otherwise(F.coalesce("consecutive_failures", F.lit(0)) + 1),
    }
    return j.select(*[F.when(met, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in sources.columns])


CONFIG = ("institution", "name", "homepage", "adapter_kind", "config_json", "static_tags", "poll_minutes", "take_per_run", "enabled")


def sync_sources(stored: DataFrame, config: DataFrame) -> DataFrame:
    """The registry after reading the configuration: what it names is updated or added, the rest stays, out of it."""
    new = config.select("id", *[F.col(c).alias(f"n_{c}") for c in CONFIG], F.lit(True).alias("__in"))
    j = stored.join(new, "id", "full")
    inside = F.coalesce("__in", F.lit(False))
    fixed = {c: F.when(inside, F.col(f"n_{c}")).otherwise(F.col(c)) for c in CONFIG} | {"in_config": inside, "consecutive_failures": F.coalesce("consecutive_failures", F.lit(0))}
    return j.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in stored.columns])


def outcome_status(attempts: DataFrame) -> DataFrame:
    """One row per source of its adapter chain (attempt, failed, not_modified, n_items, healthy_empty).

    The first attempt that brings items, is unchanged or rightly empty decides; without one, the last
    attempt does: a failure is an error, an empty answer is empty.
    """
    good = ~F.col("failed") & (F.col("not_modified") | (F.col("n_items") > 0) | F.col("healthy_empty"))
    row = F.struct("attempt", "failed", "not_modified", "n_items", "healthy_empty")
    picked = attempts.groupBy("source_id").agg(
        F.min_by(row, F.when(good, F.col("attempt"))).alias("first"), F.max_by(row, "attempt").alias("last"), F.count("*").alias("n"),
    )
    use = F.coalesce("first", "last")
    status = F.when(use["failed"], "error").when(use["not_modified"], "not-modified").when((use["n_items"] == 0) & ~use["healthy_empty"], "empty").otherwise("ok")
    return picked.select("source_id", use["attempt"].alias("attempt"), status.alias("status"), use["n_items"].alias("n_items"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"), F.count_if(F.col("status").isin("error", "empty")).alias("broken"), F.count("*").alias("sources")
    )
