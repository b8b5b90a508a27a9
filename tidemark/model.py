"""Schemas of the stored tables, and the query object."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ITEMS = (
    "item_id long, source_id string, institution string, url string, canonical_hash string, title string, title_key string, "
    "summary string, published_at long, date_estimated boolean, first_seen_at long, native_categories array<string>, tags array<string>"
)
RAW_ITEMS = "source_id string, source_pos long, url string, title string, summary string, published_raw string, published_kind string, date_is_weak boolean, categories array<string>"
SOURCES = (
    "id string, institution string, name string, homepage string, adapter_kind string, config_json string, static_tags array<string>, "
    "poll_minutes int, take_per_run int, enabled boolean, in_config boolean, etag string, last_modified string, last_fetch_at long, "
    "last_status string, last_error string, last_item_count int, consecutive_failures int"
)
#: page: the place of a body among those of its attempt; error: why there is none.
LANDED = "source_id string, attempt int, page int, url string, status int, etag string, last_modified string, body string, bytes binary, error string, fetched_at long"
SEEN_URLS = "source_id string, canonical_hash string, seen_at long"
PRUNED_URLS = "canonical_hash string, pruned_at long"
FETCHES = "source_id string, status string, error string, item_count int, etag string, last_modified string, fetched_at long"

DAY_MS = 86_400_000
SINCE_MS = {"24h": DAY_MS, "7d": 7 * DAY_MS, "30d": 30 * DAY_MS}
PAGE, LARGEST_PAGE = 50, 200


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema, which Spark folds away. createDataFrame([]) is an RDD whose tasks start Python workers, in a pool of their own."""
    return spark.range(1).filter(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def facet_of(tag: str) -> str:
    """What stands before the colon; tags without one belong to no facet."""
    return tag.partition(":")[0] if ":" in tag else ""


@dataclass(frozen=True)
class Cursor:
    """Where a page ended."""

    estimated: int
    at: int
    item_id: int

    def __str__(self) -> str:
        return f"{self.estimated}.{self.at}.{self.item_id}"

    @classmethod
    def parse(cls, text: str | None) -> Cursor | None:
        """None for what is no cursor, so a bad one starts at the first page."""
        try:
            est, at, item = (float(x or "0") for x in (text or "").split(".")[:3])
        except ValueError:
            return None
        return cls(int(est), int(at), int(item)) if all(map(math.isfinite, (est, at, item))) else None


@dataclass(frozen=True)
class ItemQuery:
    tags: tuple[str, ...] = ()
    institutions: tuple[str, ...] = ()
    q: str = ""
    since: str = "7d"
    sort: str = "newest"
    cursor: str | None = None
    limit: int = PAGE

    @classmethod
    def from_params(cls, params: dict) -> ItemQuery:
        """From request parameters, each a string or a list of them; what makes no sense becomes the default."""

        def texts(name: str) -> list[str]:
            v = params.get(name)
            return [] if v is None else [str(x) for x in v] if isinstance(v, (list, tuple)) else [str(v)]

        def many(name: str) -> tuple[str, ...]:
            return tuple(p.strip() for t in texts(name) for p in t.split(",") if p.strip())

        def one(name: str) -> str:
            return next(iter(texts(name)), "")

        limit = PAGE
        if texts("limit"):
            try:
                limit = int(max(1, min(LARGEST_PAGE, math.trunc(float(one("limit").strip() or "0")))))
            except (ValueError, OverflowError):
                limit = PAGE
        since, sort = one("since"), one("sort")
        return cls(
            many("tags"), many("institution"), one("q").strip(), since if since in (*SINCE_MS, "all") else "7d",
            sort if sort in ("newest", "oldest") else "newest", one("cursor") or None, limit,
        )

    def but(self, **changes) -> ItemQuery:
        return replace(self, **changes)
