"""robots.txt: the rules of a group, and as a relation over urls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.python import arrow
from tidemark.functions.urls import origin, robots_pattern


def parse_robots(text: str, agent: str) -> dict[str, list[str]]:
    """allow and disallow paths for the agent; those for * where none names it. Consecutive agent lines share a group."""
    groups: list[tuple[list[str], dict[str, list[str]]]] = []
    naming = False
    for line in text.splitlines():
        field, colon, value = line.partition("#")[0].strip().partition(":")
        if not colon:
            continue
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            if not naming:
                groups.append(([], {"allow": [], "disallow": []}))
            groups[-1][0].append(value.lower())
        elif groups and value and field in groups[-1][1]:
            groups[-1][1][field].append(value)
        naming = field == "user-agent"
    mine = [r for names, r in groups if agent.lower() in names] or [r for names, r in groups if "*" in names]
    return {k: [p for r in mine for p in r[k]] for k in ("allow", "disallow")}


def compiled(rules: DataFrame) -> DataFrame:
    """origin and __rules: an origin's rules as one array, in the order in which they decide: the longest first, allow before disallow.

    A rule is its plain beginning and, if it has more than that, a pattern. The number of rules of an origin is
    bounded by the size of its robots.txt.
    """
    plain = F.regexp_extract("path", r"^([^*]*?)(?:\*.*|\$)?$", 1)
    rest = F.when(plain != F.col("path"), arrow(robots_pattern, "string")("path"))
    rule = F.struct((-F.length("path")).alias("less"), (~F.col("allow")).alias("blocks"), plain.alias("begin"), rest.alias("pattern"))
    return rules.groupBy("origin").agg(F.array_sort(F.collect_set(rule)).alias("__rules"))


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with allowed; rules: (origin, allow boolean, path). The longest match decides, allow wins a tie.

    Each url meets its origin's rules once, as one array, and takes the first that fits: no row for every rule.
    """
    path = F.regexp_extract(url, r"^(?i)https?://[^/?#]+([^#]*)", 1)
    keyed = urls.withColumn("__o", origin(F.col(url))).withColumn("__p", F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))
    joined = keyed.join(compiled(rules).withColumnRenamed("origin", "__o"), "__o", "left")
    fits = F.filter("__rules", lambda r: F.startswith(F.col("__p"), r["begin"]) & F.coalesce(F.call_function("rlike", F.col("__p"), r["pattern"]), F.lit(True)))
    first = F.try_element_at(fits, F.lit(1))
    return joined.withColumn("allowed", F.coalesce(~first["blocks"], F.lit(True))).drop("__o", "__p", "__rules")
