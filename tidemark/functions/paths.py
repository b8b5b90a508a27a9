"""Field paths into JSON kept as VARIANT: `a.b`, `a[0].b`, and `a[].b` over every element."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

def json_path(path: str) -> str | None:
    """The path as VARIANT functions take it: names quoted, places in brackets; None for what is no path."""
    out = "$"
    for segment in path.split(".") if path else []:
        name, bracket, rest = segment.partition("[")
        places = rest.removesuffix("]").split("][") if bracket else []
        if "]" in name or bracket and not rest.endswith("]") or not all(p.isascii() and p.isdigit() for p in places):
            return None
        quote = '"' if "'" in name else "'"
        out += f"[{quote}{name}{quote}]" * bool(name) + "".join(f"[{p}]" for p in places)
    return out


def get_path(value: Column, path: str) -> Column:
    """The VARIANT at the path, null where there is none; over elements, an array<variant> of what is there."""
    head, fan, rest = path.partition("[]")
    where = json_path(head)
    if where is None:
        return F.lit(None).cast("variant")
    found = F.try_variant_get(value, where, "variant") if head else value
    if not fan:
        return found
    rest = rest.removeprefix(".")
    items = F.try_variant_get(found, "$", "array<variant>")
    picked = F.transform(items, lambda v: get_path(v, rest))
    if "[]" not in rest:
        picked = F.filter(picked, lambda v: v.isNotNull())
    return picked


def as_string(v: Column) -> Column:
    """Text of a scalar, or of the first text in an array; null for blank and for objects."""
    kind = F.schema_of_variant(v)
    first = F.try_element_at(F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda s: F.trim(s) != ""), F.lit(1))
    whole = F.try_variant_get(v, "$", "string")
    scalar = F.when(F.startswith(kind, F.lit("OBJECT")) | (kind == "VOID"), None).otherwise(whole)
    return F.when(F.startswith(kind, F.lit("ARRAY")), first).otherwise(F.when(F.trim(scalar) != "", scalar))


def as_strings(v: Column) -> Column:
    """Texts of an array's elements, or of a scalar; empty for null."""
    many = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), as_string), lambda s: s.isNotNull())
    one = as_string(v)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def render(template: str, values: dict) -> str:
    """{{name}} replaced; unknown names stay."""
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(values.get(m[1], m[0])), template)
