"""How much each source may add, and in which order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.regexes import compiled
from tidemark.lineage import settled


def newest_per_source(fresh: DataFrame, take: Column) -> DataFrame:
    """rank, held and taken for rows already known to be new.

    A source with no more than its ration keeps its own order; else stated dates come first, then
    newer ones, then the source's order.
    """
    mine = Window.partitionBy("source_id")
    ranked = fresh.withColumn("fresh", F.count("*").over(mine)).withColumn(
        "rank", F.row_number().over(mine.orderBy(F.asc("date_estimated"), F.desc("published_at"), F.asc("source_pos")))
    )
    return ranked.withColumn("taken", F.col("rank") <= take).withColumn("held", F.greatest(F.col("fresh") - take, F.lit(0)).cast("long"))


def take_newest(fresh: DataFrame, take: int) -> DataFrame:
    """Only the taken rows: the ranking stops early on each side of the shuffle."""
    mine = Window.partitionBy("source_id").orderBy(F.asc("date_estimated"), F.desc("published_at"), F.asc("source_pos"))
    return fresh.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= take)


def newest_records(rows: DataFrame, most: int) -> DataFrame:
    """Records of an interface, newest first, undated ones last; all of them if they are no more than most."""
    mine = Window.partitionBy("source_id").orderBy(F.desc("date_key"), F.asc("source_pos"))
    return rows.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= most)


def undated_ration(rows: DataFrame, most: int | Column, order: str = "source_pos") -> DataFrame:
    """Rows before the run has met most undated ones; later dated rows wait as well."""
    before = Window.partitionBy("source_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("undated_before", F.coalesce(F.sum(F.col("undated").cast("long")).over(before), F.lit(0))).filter(F.col("undated_before") < most)


def included(loc: Column, include: list[str], exclude: list[str]) -> Column:
    """Any include pattern, or none given, and no exclude pattern; case-blind, bad patterns literal."""

    def some(patterns: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [loc.rlike(compiled(p)) for p in patterns], F.lit(False))

    return (some(include) if include else F.lit(True)) & ~some(exclude)


def sitemap_candidates(entries: DataFrame, include: list[str], exclude: list[str], considered: int = 5000) -> DataFrame:
    """The newest entries (source_id, loc, date_key, source_pos, canonical_hash) that match, one for each hash."""
    mine = Window.partitionBy("source_id").orderBy(F.desc("date_key"), F.asc("source_pos"))
    some = entries.filter(included(F.col("loc"), include, exclude)).withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= considered)
    first = Window.partitionBy("source_id", "canonical_hash").orderBy("rank")
    return some.filter(F.col("canonical_hash").isNotNull()).withColumn("again", F.row_number().over(first)).filter("again = 1").drop("again")


def child_sitemaps(children: DataFrame, most: int = 5) -> DataFrame:
    mine = Window.partitionBy("source_id").orderBy(F.desc("date_key"), F.asc("source_pos"))
    return children.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= most)


def numbered(rows: DataFrame, after: int, *order) -> DataFrame:
    """item_id from after + 1 on in arrival order, without gaps and without one large sort in one task.

    Rows are range-partitioned by the order; each partition's rows follow those of the ones before. They are
    saved with their places, as two evaluations of the plan needn't partition alike.
    """
    ranged = rows.repartitionByRange(*[F.col(o) if isinstance(o, str) else o for o in order]).sortWithinPartitions(*order)
    local = settled(ranged.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1)))
    sizes = local.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return local.join(F.broadcast(starts), "__part").withColumn("item_id", F.lit(after) + 1 + F.col("__start") + F.col("__at")).drop("__id", "__part", "__at", "__start")
