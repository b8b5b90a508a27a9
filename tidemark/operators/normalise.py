"""Raw items to item rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, text, urls
from tidemark.operators.tagging import Taxonomy, all_tags


def normalise(raw: DataFrame, sources: DataFrame, taxonomy: Taxonomy, now_ms: int) -> DataFrame:
    """Item columns (no item_id, no first_seen_at) with source_pos, and reason: why a row is unusable, null if it isn't.

    Tags come last in the plan; drop rows before they are needed and they are never computed.
    """
    s = sources.select(F.col("id").alias("source_id"), "institution", "homepage", "static_tags")
    j = raw.join(s, "source_id")
    exact, absolute = urls.canonical_from(F.col("url"), F.col("homepage")), urls.absolute_from(F.col("url"), F.col("homepage"))
    date = dates.parse_date(F.col("published_raw"), F.lit(now_ms).cast("long"), F.col("published_kind"))
    j = j.withColumn("canonical", exact).withColumn("absolute", absolute).withColumn("shown", text.display_title(F.col("title"), F.col("institution"))).withColumn("date", date)
    categories = F.filter(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    reason = F.when(F.col("canonical").isNull(), "unusable url").when(F.coalesce("shown", F.lit("")) == "", "empty title")
    return j.select(
        "source_id", "institution", F.col("absolute").alias("url"), urls.url_hash(F.col("canonical")).alias("canonical_hash"), F.col("shown").alias("title"), text.title_key(F.col("shown")).alias("title_key"),
        "summary", F.col("date.ms").alias("published_at"), (F.col("date.estimated") | F.coalesce("date_is_weak", F.lit(False))).alias("date_estimated"), categories.alias("native_categories"),
        all_tags(taxonomy, F.col("shown"), F.col("summary"), categories, F.col("static_tags")).alias("tags"), "source_pos", reason.alias("reason"),
    )


def usable(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is null").drop("reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is not null").select("source_id", "source_pos", "reason")
