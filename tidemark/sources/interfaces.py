"""JSON interfaces: landed pages of records to raw items, by declared field paths."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import sort_ms
from tidemark.functions.paths import as_string, as_strings, json_path
from tidemark.functions.text import excerpt
from tidemark.operators.rations import newest_records

#: Items that one run takes from an interface.
MOST_NEW = 25


#: What extraction needs of an adapter, as a column, so that interfaces of any make go through one plan.
SETTINGS = (
    "struct<shown:string,items_path:string,url:string,title:string,summary:string,published_at:string,categories:array<struct<head:string,rest:string>>,page_size:int,most:int>"
)


def settings(adapter: dict) -> dict:
    """SETTINGS of an adapter. A path over elements (`a[].b`) is its part before them and that within each."""
    fields, shown = adapter["fields"], adapter.get("items_path") or ""
    paths = fields.get("categories") or []
    categories = []
    for p in [paths] if isinstance(paths, str) else paths:
        head, fan, rest = p.partition("[]")
        categories.append({"head": json_path(head), "rest": json_path(rest.removeprefix(".")) if fan else None})
    one = {f: json_path(fields[f]) if fields.get(f) else None for f in ("url", "title", "summary", "published_at")}
    return {"shown": shown or "(root)", "items_path": json_path(shown), **one, "categories": categories, "page_size": (adapter.get("pagination") or {}).get("page_size"), "most": adapter.get("max_new_per_run") or MOST_NEW}


def _set(landed: DataFrame, adapter: dict) -> DataFrame:
    """landed with one adapter's settings."""
    return landed.withColumn("settings", F.from_json(F.lit(json.dumps(settings(adapter))), SETTINGS))


def _at(value: Column, path: Column) -> Column:
    return F.try_variant_get(value, path, "variant")


def _many(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _records(landed: DataFrame) -> DataFrame:
    found = landed.withColumn("items", _many(_at(F.try_parse_json("body"), F.col("settings.items_path"))))
    return found.select("source_id", "page", "settings", F.col("items").isNull().alias("bad"), F.coalesce(F.size("items"), F.lit(0)).alias("size"), F.posexplode_outer("items").alias("pos", "record"))


def records(landed: DataFrame, items_path: str) -> DataFrame:
    """source_id, page, pos, record (VARIANT), size of the page; and bad: the path is no array there."""
    return _records(_set(landed, {"items_path": items_path, "fields": {}})).drop("settings")


def problems(landed: DataFrame) -> DataFrame:
    """source_id, page, error: pages (with settings) that are no JSON, or whose items path leads to no array."""
    payload = F.try_parse_json("body")
    wrong = F.concat(F.lit("items_path "), F.col("settings.shown"), F.lit(" is not an array"))
    error = F.when(payload.isNull(), "not JSON").when(_many(_at(payload, F.col("settings.items_path"))).isNull(), wrong)
    return landed.select("source_id", "page", error.alias("error")).filter("error is not null")


def json_problems(landed: DataFrame, items_path: str) -> DataFrame:
    return problems(_set(landed, {"items_path": items_path, "fields": {}}))


def newest(rows: DataFrame, now_ms: int, most: int | Column = MOST_NEW) -> DataFrame:
    """Of a source with more than most raw items, the most recent, in that order; undated ones come last."""
    most = F.lit(most) if isinstance(most, int) else most
    keyed = rows.withColumn("date_key", sort_ms(F.col("published_raw"), F.lit(now_ms).cast("long"), F.col("published_kind")))
    over = keyed.withColumn("__n", F.count("*").over(Window.partitionBy("source_id")))
    ranked = newest_records(over, most)
    return ranked.withColumn("source_pos", F.when(F.col("__n") > most, F.col("rank") - 1).otherwise(F.col("source_pos")).cast("long")).drop("__n", "rank", "date_key")


def json_items(landed: DataFrame, items_path: str, fields: dict, page_size: int | None = None) -> DataFrame:
    """items() of interfaces of one make. fields: url and title, and where known published_at, summary and categories (a path or several)."""
    return items(_set(landed, {"items_path": items_path, "fields": fields, "pagination": {"page_size": page_size}})).drop("settings")


def items(landed: DataFrame) -> DataFrame:
    """Raw items of landed pages (with settings) in page order, each url once; pages after an empty, a short or a useless one don't count."""
    rows = _records(landed)
    of = lambda name: _at(F.col("record"), F.col(f"settings.{name}"))
    date = of("published_at")
    kind = F.schema_of_variant(date)
    within = lambda p: F.filter(F.transform(_many(_at(F.col("record"), p["head"])), lambda v: as_string(_at(v, p["rest"]))), lambda t: t.isNotNull())
    none = F.array().cast("array<string>")
    texts = F.transform("settings.categories", lambda p: F.coalesce(F.when(p["rest"].isNull(), as_strings(_at(F.col("record"), p["head"]))).otherwise(within(p)), none))
    out = rows.select(
        "source_id", "page", "pos", "size", "settings", as_string(of("url")).alias("url"), as_string(of("title")).alias("title"), excerpt(as_string(of("summary"))).alias("summary"),
        F.try_variant_get(date, "$", "string").alias("published_raw"), F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), "number").otherwise("string").alias("published_kind"),
        F.lit(False).alias("date_is_weak"), F.coalesce(F.flatten(texts), none).alias("categories"),
    )
    good = F.col("url").isNotNull() & F.col("title").isNotNull()
    # A record without url or title doesn't make its url known.
    first = Window.partitionBy("source_id", "url", good).orderBy("page", "pos")
    out = out.withColumn("__use", good & (F.row_number().over(first) == 1))
    pages = out.groupBy("source_id", "page").agg(F.count_if("__use").alias("__usable"), F.max("size").alias("__size"), F.first("settings.page_size").alias("__full"))
    ends = (F.col("__usable") == 0) | F.coalesce(F.col("__size") < F.col("__full"), F.lit(False))
    before = Window.partitionBy("source_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    open_ = pages.withColumn("__over", F.coalesce(F.max(ends).over(before), F.lit(False))).filter("not __over").select("source_id", "page")
    kept = out.filter("__use").join(open_, ["source_id", "page"], "left_semi")
    order = Window.partitionBy("source_id").orderBy("page", "pos")
    return kept.withColumn("source_pos", (F.row_number().over(order) - 1).cast("long")).drop("__use", "size", "pos", "page")


def offsets(page_size: int, pages: int) -> list[int]:
    return [page * page_size for page in range(pages)]


class AuthError(ValueError):
    """A token that can't be had."""


def token(auth: dict, page: str | None = None, env: Mapping[str, str] = os.environ) -> str | None:
    """The token of an interface: none, a variable of the environment, or the first group of a pattern over a page."""
    kind = auth.get("kind", "none")
    if kind == "none":
        return None
    if kind == "env":
        if not env.get(auth["var"]):
            raise AuthError(f"{auth['var']} is not set")
        return env[auth["var"]]
    m = re.search(auth["token_regex"], page or "")
    if not m or not m.groups() or not m[1]:
        raise AuthError(f"no token on {auth.get('page_url', 'the page')}")
    return m[1]
