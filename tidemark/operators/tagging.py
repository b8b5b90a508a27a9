"""Tags from a source, from the publisher's categories, and from rules over title and summary."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.regexes import any_of, compiled


@dataclass(frozen=True)
class Rule:
    tag: str
    any: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    none: tuple[str, ...] = ()


@dataclass(frozen=True)
class Taxonomy:
    """facets: (id, label, values) in order; native: category -> tags; rules."""

    facets: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    native: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()

    @property
    def known(self) -> list[str]:
        return [f"{f}:{v}" for f, _, values in self.facets for v in values]

    def facet_values(self, spark) -> DataFrame:
        rows = [(f, label, i, v, j) for i, (f, label, values) in enumerate(self.facets) for j, v in enumerate(values)]
        return spark.createDataFrame(rows, "facet string, label string, facet_pos int, value string, value_pos int")

    def native_map(self, spark) -> DataFrame:
        return spark.createDataFrame([(k.lower().strip(), list(v)) for k, v in self.native.items()], "category_key string, tags array<string>")


def haystack(title: Column, summary: Column) -> Column:
    return F.concat(title, F.lit("\n"), F.coalesce(summary, F.lit("")))


def rule_matches(rule: Rule, text: Column) -> Column:
    """No pattern of none, every one of all, one of any; a rule without patterns never matches."""
    if not (rule.any or rule.all or rule.none):
        return F.lit(False)
    parts = [text.rlike(compiled(p)) for p in rule.all]
    if rule.any:
        parts.append(text.rlike(any_of(list(rule.any))))
    if rule.none:
        parts.append(~text.rlike(any_of(list(rule.none))))
    return reduce(lambda a, b: a & b, parts)


def rule_tags(rules, text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(rule_matches(r, text), F.lit(r.tag)) for r in rules])) if rules else F.array().cast("array<string>")


def category_key(category: Column) -> Column:
    return F.lower(F.trim(category))


def native_tags(native: dict, categories: Column) -> Column:
    """Tags of the categories that the map knows; the map is part of the plan, as configuration is small."""
    if not native:
        return F.array().cast("array<string>")
    keys = [x for k, v in native.items() for x in (F.lit(k.lower().strip()), F.array(*map(F.lit, v)).cast("array<string>"))]
    table = F.create_map(*keys)
    found = F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.coalesce(F.try_element_at(table, category_key(c)), F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(found))


def all_tags(taxonomy: Taxonomy, title: Column, summary: Column, categories: Column, static: Column) -> Column:
    """Sorted union of static (declared ones only), native and rule tags."""
    known = F.array(*map(F.lit, taxonomy.known)).cast("array<string>")
    mine = F.array_intersect(F.coalesce(static, F.array().cast("array<string>")), known)
    return F.array_sort(F.array_union(F.array_union(mine, native_tags(taxonomy.native, categories)), rule_tags(taxonomy.rules, haystack(title, summary))))


def retag(items: DataFrame, sources: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """items with tags made anew; items of sources that are gone have no static tags."""
    static = sources.select(F.col("id").alias("source_id"), "static_tags")
    joined = items.drop("tags").join(static, "source_id", "left")
    return joined.withColumn("tags", all_tags(taxonomy, F.col("title"), F.col("summary"), F.col("native_categories"), F.col("static_tags"))).select(*items.columns)


def unmapped(items: DataFrame, native: DataFrame, top: int = 25) -> DataFrame:
    """category, n: the most frequent categories that the map lacks; ties by name."""
    seen = items.select(F.explode("native_categories").alias("category"))
    lacking = seen.withColumn("category_key", category_key(F.col("category"))).join(native.select("category_key"), "category_key", "left_anti")
    return lacking.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(top)
