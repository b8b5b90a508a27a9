"""Sources and taxonomy from YAML, checked."""

from __future__ import annotations

import json

import yaml

from tidemark.model import SOURCES
from tidemark.operators.tagging import Rule, Taxonomy

KINDS = ("rss", "json", "sitemap", "html", "browser")
#: libyaml's parser where PyYAML has it: the same rows, about a tenth of the time.
LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


class ConfigError(ValueError):
    """All that is wrong, a line each."""


def _number(value, name: str, low: int, high: int, default: int, errors: list[str]) -> int:
    if value is None:
        return default
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        errors.append(f"{name}: {value!r} is not a whole number from {low} to {high}")
        return default
    return value


def load_taxonomy(text: str) -> Taxonomy:
    """Facets, native_map and rules; every tag must be declared under a facet."""
    raw = yaml.load(text, Loader=LOADER) or {}
    facets = tuple((f["id"], f.get("label", f["id"]), tuple(map(str, f.get("values") or ()))) for f in raw.get("facets") or ())
    native = {str(k): tuple(v) for k, v in (raw.get("native_map") or {}).items()}
    rules = tuple(Rule(r["tag"], *(tuple(r.get(k) or ()) for k in ("any", "all", "none"))) for r in raw.get("rules") or ())
    out = Taxonomy(facets, native, rules)
    known = set(out.known)
    bad = [f"rule {r.tag}: no such tag" for r in rules if r.tag not in known]
    bad += [f"category {k}: no such tag {t}" for k, ts in native.items() for t in ts if t not in known]
    if bad:
        raise ConfigError("\n".join(bad))
    return out


def load_sources(text: str, taxonomy: Taxonomy | None = None) -> list[dict]:
    """Rows of the sources table without health; what is missing takes the defaults."""
    raw = yaml.load(text, Loader=LOADER) or {}
    defaults, errors, rows, seen = raw.get("defaults") or {}, [], [], set()
    for s in raw.get("sources") or ():
        sid = s.get("id")
        if not sid:
            errors.append(f"a source without id: {s.get('name')}")
            continue
        if sid in seen:
            errors.append(f"{sid}: declared twice")
        seen.add(sid)
        take = _number(s.get("take_per_run", defaults.get("take_per_run")), f"{sid}.take_per_run", 1, 200, 5, errors)
        poll = _number(s.get("poll_minutes", defaults.get("poll_minutes")), f"{sid}.poll_minutes", 5, 1440, 30, errors)
        chain = [s.get("adapter") or {}, *(s.get("fallback") or ())]
        for a in chain:
            errors += adapter_errors(sid, a, take)
        rows.append({
            "id": sid, "institution": s.get("institution"), "name": s.get("name", sid), "homepage": s.get("homepage"), "adapter_kind": chain[0].get("kind"),
            "config_json": json.dumps({"adapter": chain[0], "fallback": chain[1:]}, sort_keys=True), "static_tags": list(s.get("static_tags") or ()),
            "poll_minutes": poll, "take_per_run": take, "enabled": bool(s.get("enabled", True)), "in_config": True,
        })
    if errors:
        raise ConfigError("\n".join(errors))
    return rows


def adapter_errors(sid: str, adapter: dict, take: int) -> list[str]:
    errors: list[str] = []
    kind = adapter.get("kind")
    if kind not in KINDS:
        return [f"{sid}: no such adapter {kind!r}"]
    need = {"json": ("request", "fields"), "html": ("url", "selectors"), "browser": ("url", "selectors")}.get(kind, ("url",))
    errors += [f"{sid}: {kind} needs {k}" for k in need if not adapter.get(k)]
    if kind == "json":
        _number(adapter.get("max_new_per_run"), f"{sid}.max_new_per_run", 1, 500, 25, errors)
        _number((adapter.get("pagination") or {}).get("max_pages"), f"{sid}.max_pages", 1, 20, 1, errors)
    if kind == "sitemap":
        most = _number(adapter.get("max_new_per_run"), f"{sid}.max_new_per_run", 1, 200, 25, errors)
        _number(adapter.get("max_undated_per_run"), f"{sid}.max_undated_per_run", 1, 200, 5, errors)
        if most > take:  # what a visit marks as seen but doesn't store would be lost
            errors.append(f"{sid}: visits {most} pages a run but stores {take}")
    return errors


def unknown_static_tags(rows: list[dict], taxonomy: Taxonomy) -> list[str]:
    known = set(taxonomy.known)
    return [f"{r['id']}: unknown tag {t}" for r in rows for t in r["static_tags"] if t not in known]


def sources_frame(spark, rows: list[dict]):
    """Configured sources as a DataFrame, never fetched."""
    names = [c.strip().split()[0] for c in SOURCES.replace("array<string>", "x").split(",")]
    return spark.createDataFrame([tuple(r.get(n, 0 if n == "consecutive_failures" else None) for n in names) for r in rows], SOURCES)
