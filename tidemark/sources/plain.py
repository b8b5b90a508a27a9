"""The few text functions that parsers need before rows reach Spark; as their Column forms elsewhere."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime


def excerpt(html: str | None, most: int = 400) -> str | None:
    if not html:
        return None
    t = re.sub(r"(?is)<(script|style).*?</\1>", " ", html)
    t = re.sub(r"<[^>]+>", " ", t)
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'")):
        t = re.sub(entity, char, t, flags=re.IGNORECASE)
    t = " ".join(t.split())
    return None if not t else t if len(t) <= most else t[: most - 1].rstrip() + "…"


def when(text: str | None) -> int | None:
    """Milliseconds of a date in a feed or page; null if it is none."""
    t = (text or "").strip()
    if not t:
        return None
    if re.fullmatch(r"\d{9,14}", t):
        return int(t) * 1000 if int(t) < 100_000_000_000 else int(t)
    got = None
    try:
        got = datetime.fromisoformat(t)
    except ValueError:
        for form in ("%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%Y/%m/%d"):
            try:
                got = datetime.strptime(t, form)
                break
            except ValueError:
                continue
        if got is None:
            try:
                got = parsedate_to_datetime(t)
            except (TypeError, ValueError, IndexError):
                return None
    got = got if got.tzinfo else got.replace(tzinfo=timezone.utc)
    return round(got.timestamp() * 1000)
