"""Removal by age, with tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def older(cutoff_ms) -> Column:
    """A stated date before the cutoff; a guessed one counts from when the item was first seen."""
    return F.when(F.col("date_estimated"), F.col("first_seen_at") < cutoff_ms).otherwise(F.col("published_at") < cutoff_ms)


def preview(items: DataFrame, cutoff_ms) -> DataFrame:
    """total, stated, estimated, keeping: one pass."""
    gone = older(cutoff_ms)
    return items.agg(
        F.count_if(gone).alias("total"), F.count_if(gone & ~F.col("date_estimated")).alias("stated"), F.count_if(gone & F.col("date_estimated")).alias("estimated"), F.count_if(~gone).alias("keeping")
    )


def by_institution(items: DataFrame, cutoff_ms) -> DataFrame:
    return items.filter(older(cutoff_ms)).groupBy("institution").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "institution")


def kept(items: DataFrame, cutoff_ms) -> DataFrame:
    return items.filter(~older(cutoff_ms))


def tombstones(items: DataFrame, pruned: DataFrame, cutoff_ms, now_ms) -> DataFrame:
    """pruned with the hashes that go now; a hash keeps its first time."""
    new = items.filter(older(cutoff_ms)).select("canonical_hash", F.lit(now_ms).cast("long").alias("pruned_at"))
    return pruned.union(new).groupBy("canonical_hash").agg(F.min("pruned_at").alias("pruned_at"))


def swept_count(item_tags: DataFrame, items: DataFrame) -> DataFrame:
    """How many tags a sweep removes."""
    return item_tags.join(items.select("item_id"), "item_id", "left_anti").agg(F.count("*").alias("orphans"))


def swept(item_tags: DataFrame, items: DataFrame) -> DataFrame:
    return item_tags.join(items.select("item_id"), "item_id", "left_semi")


def cutoff(older_than: str, now_ms: int, force: bool = False, least_days: int = 30) -> int:
    """`365d` -> the time so long before now; under least_days only with force."""
    text = older_than.strip().lower().removesuffix("d")
    if not text.isdigit() or int(text) < 1:
        raise ValueError(f"not a number of days: {older_than}")
    if int(text) < least_days and not force:
        raise ValueError(f"under {least_days} days only with force")
    return now_ms - int(text) * 86_400_000
