"""Dates of any kind, with whether they were stated or had to be guessed. All times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a plausible date is.
EARLIEST_MS = 631152000000  # 1990-01-01
FUTURE_MS = 48 * 3600 * 1000
_SECONDS_BELOW = 100_000_000_000

#: Tried in this order, after the weekday is gone.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][.SSS][XXX]",
    "yyyy-MM-dd'T'HH:mm[:ss][.SSS][XX]",
    "yyyy-MM-dd HH:mm[:ss][.SSS][ ][XXX]",
    "yyyy-MM-dd",
    "yyyy-MM",
    "yyyy/M/d",
    "d MMM yyyy HH:mm[:ss] z",
    "d MMM yyyy HH:mm[:ss] Z",
    "d MMM yyyy HH:mm[:ss]",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMMM d, yyyy[ HH:mm[:ss]]",
    "MMM d, yyyy[ HH:mm[:ss]]",
)


def epoch_ms(n: Column) -> Column:
    """Seconds or milliseconds, told apart by size."""
    return F.when(n < _SECONDS_BELOW, n * 1000).otherwise(n).cast("long")


def date_ms(text: Column) -> Column:
    """Milliseconds of a date in words or digits; null if it is none."""
    t = F.trim(text)
    words = F.regexp_replace(t, "^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +", "")
    parsed = F.coalesce(*[F.unix_millis(F.try_to_timestamp(words, F.lit(f))) for f in FORMATS])
    return F.when(t.rlike(r"^\d{9,14}$"), epoch_ms(t.try_cast("long"))).when(t.rlike(r"^\d+$") & ~t.rlike(r"^\d{4}$"), None).otherwise(parsed)


def judged(ms: Column, now_ms: Column) -> Column:
    """struct(ms, estimated): a missing or implausible time becomes now, marked as estimated."""
    ok = ms.isNotNull() & (ms >= EARLIEST_MS) & (ms <= now_ms + FUTURE_MS)
    return F.struct(F.when(ok, ms).otherwise(now_ms).cast("long").alias("ms"), (~F.coalesce(ok, F.lit(False))).alias("estimated"))


def parse_date(text: Column, now_ms: Column, kind: Column | None = None) -> Column:
    """struct(ms, estimated) of a text, or of a number where kind says `number`."""
    ms = date_ms(text)
    if kind is not None:
        ms = F.when(kind == "number", epoch_ms(F.trim(text).try_cast("double"))).otherwise(ms)
    return judged(ms, now_ms)


def sort_ms(text: Column, now_ms: Column, kind: Column | None = None) -> Column:
    """For ranking: undated rows come last."""
    got = parse_date(text, now_ms, kind)
    return F.when(got["estimated"], F.lit(0).cast("long")).otherwise(got["ms"])
