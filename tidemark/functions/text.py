"""Titles, excerpts and plain-text comparison."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .python import arrow
from .regexes import _SPACE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words that an acronym leaves out.
JOINING_WORDS = ("of", "for", "the", "and", "de", "du", "des", "la", "le")
_SEPARATORS = "|–—·•"

_nfkd = arrow(lambda s: None if s is None else unicodedata.normalize("NFKD", s), "string")


def ascii_lower(c: Column) -> Column:
    """A-Z only: what a case-blind LIKE folds."""
    return F.translate(c, _UPPER, _LOWER)


def folded(needle: str) -> str:
    """A needle as ascii_lower() leaves texts."""
    return needle.translate(str.maketrans(_UPPER, _LOWER))


def contains_text(needle: str, *columns: Column) -> Column:
    """Whether any column has the needle, every character of it literal; null columns count as empty."""
    want = F.lit(folded(needle))
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(ascii_lower(F.coalesce(c, F.lit(""))), want)
    return out


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{_SPACE}]+", " "))


def title_key(title: Column) -> Column:
    """What two copies of a headline share; empty where too short to go by. Plain ASCII skips Python."""
    # What a key leaves out, as stored keys must stay comparable.
    bare = F.regexp_replace(title, f"[{_SPACE}]+[|•·][{_SPACE}]+(?:[^{_SPACE}]+[{_SPACE}]+){{0,3}}[^{_SPACE}]+$", "")
    flat = F.when(bare.rlike(r"^[\x00-\x7f]*$"), bare).otherwise(_nfkd(bare))
    flat = F.regexp_replace(flat, "[̀-ͯ‘’“”]", "")
    key = F.trim(F.regexp_replace(F.lower(flat), "[^a-z0-9]+", " "))
    return F.when(F.length(key) >= 8, key).otherwise(F.lit(""))


def _loose(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def _initials(c: Column) -> Column:
    words = F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda w: (w != "") & ~F.lower(w).isin(*JOINING_WORDS))
    return F.array_join(F.transform(words, lambda w: F.lower(F.substring(w, 1, 1))), "")


def display_title(title: Column, institution: Column) -> Column:
    """The title without a site name after it: the institution, its extension, or what its acronym stands for."""
    clean = collapse(title)
    # Fixed value: how a site's name follows a title.
    pattern = f"^(.*?) [{_SEPARATORS}-] ([^{_SEPARATORS}]+)$"
    head, tail = F.trim(F.regexp_extract(clean, pattern, 1)), F.regexp_extract(clean, pattern, 2)
    want, got = _loose(institution), _loose(tail)
    site = F.startswith(got, want) | F.startswith(want, got) | (_initials(tail) == want)
    return F.when((want != "") & (head != "") & (got != "") & site, head).otherwise(clean)


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), c computed once: in branches Spark computes it anew at each mention."""
    return F.transform(F.array(c), f)[0]


def excerpt(html: Column, most: int = 400) -> Column:
    """Text of a piece of HTML, cut with an ellipsis; null where nothing is left.

    Of a text without markup and entities only the begin is gone through, where that fills the excerpt.
    """
    # Markup and entities that an excerpt drops.
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    t = F.when(F.contains(html, F.lit("<")), F.regexp_replace(bare, "<[^>]+>", " ")).otherwise(html)
    plain = t
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'")):
        t = F.regexp_replace(t, f"(?i){entity}", char)
    t = F.when(F.contains(html, F.lit("&")), t).otherwise(plain)
    enough = ~F.contains(html, F.lit("<")) & ~F.contains(html, F.lit("&"))
    flat = _once(collapse(F.substring(html, 1, 2 * most)), lambda begin: F.when(enough & (F.length(begin) > most), begin).otherwise(collapse(t)))
    cut = lambda s: F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…"))
    return _once(flat, lambda s: F.when(s == "", None).when(F.length(s) > most, cut(s)).otherwise(s))


def age_label(ms: Column, now_ms: Column) -> Column:
    """How long ago: minutes, hours, days, and beyond a month the date."""
    minutes = F.greatest(F.floor((now_ms - ms) / 60000), F.lit(0))
    day = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .when(minutes < 43200, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
        .otherwise(day)
    )


def shapes(value: Column) -> dict[str, Column]:
    """Whether a text looks like a url, a title or a date."""
    t = F.trim(value)
    url = t.rlike(r"^(https?://|/[^/\s])") & ~F.contains(value, F.lit(" "))
    title = F.length(t).between(12, 300) & t.rlike(r"\s") & ~url & ~t.rlike(r"^[{\[<]")
    return {"url": F.coalesce(url, F.lit(False)), "title": F.coalesce(title, F.lit(False)), "date": F.coalesce(value.rlike(r"\d{4}"), F.lit(False))}
