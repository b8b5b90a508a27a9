"""URLs: canonical keys, resolution, names made from them."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import parse_qsl, quote, quote_plus, urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from .python import arrow

# Parameters that identify a campaign or a click, besides those that begin with utm_.
TRACKING = (
    "gclid", "fbclid", "msclkid", "igshid", "mc_cid", "mc_eid", "yclid", "dclid", "_ga", "_gl", "ref", "referrer",
    "sc_camp", "sc_channel", "trk", "trkinfo", "linkid", "cmpid", "campaignid", "sfmc_id",
)

_TRACKED = "^(?:utm_.*|" + "|".join(TRACKING) + ")$"


def _split(raw: str, base: str | None):
    """(scheme, host, port, path, query, fragment) as browsers read them, or None."""
    text = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    try:
        if base:
            text = urljoin(base.strip(), text.replace("\\", "/") if not re.match(r"[a-zA-Z][\w+.-]*:", text) else text)
        if re.match(r"(?i)https?:", text):
            at = re.search(r"[?#]", text)
            head = text[: at.start()] if at else text
            text = re.sub(r"(?i)^(https?):[/\\]*", r"\1://", head.replace("\\", "/")) + text[len(head) :]
        parts = urlsplit(text)
        port = parts.port
        host = parts.hostname
    except ValueError:
        return None
    if not parts.scheme:
        return None
    if host:
        try:
            host = host.encode("ascii").decode() if host.isascii() else host.encode("idna").decode()
        except UnicodeError:
            return None
        if re.search(r"[\s<>^|%#/?@\\]", host):
            return None
    return parts.scheme.lower(), (host or "").lower(), port, parts.path, parts.query, parts.fragment, parts.netloc


def _path(path: str) -> str:
    out: list[str] = []
    segments = path.split("/")
    for i, s in enumerate(segments):
        low = s.lower().replace("%2e", ".")
        last = i == len(segments) - 1
        if low == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(s)
    joined = "/".join(out) or "/"
    return quote(joined if joined.startswith("/") else "/" + joined, safe="/%:@!$&'()*+,;=-._~[]|")


def canonical(url: str | None, base: str | None = None) -> str | None:
    """The document's identity: https, no www, no port, fragment or campaign, parameters by name; null if unusable."""
    if url is None or (got := _split(url, base)) is None:
        return None
    scheme, host, port, path, query, _, _ = got
    if scheme not in ("http", "https") or not host:
        return None
    host = host.removeprefix("www.")
    pairs = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True) if not re.match(_TRACKED, k, re.IGNORECASE)]
    pairs.sort(key=lambda p: p[0].encode("utf-16-be"))
    path = _path(path)
    if len(path) > 1:
        path = path.rstrip("/") or "/"
    tail = "&".join(f"{quote_plus(k, safe='*')}={quote_plus(v, safe='*')}".replace("~", "%7E") for k, v in pairs)
    where = f"{host}:{port}" if port not in (None, 80, 443) else host
    return f"https://{where}{path}" + (f"?{tail}" if tail else "")


def absolute(url: str | None, base: str | None = None) -> str | None:
    """Resolved against the base; the trimmed text where that can't be."""
    if url is None:
        return None
    got = _split(url, base)
    if got is None or got[0] in ("http", "https") and not got[1]:
        return url.strip()
    scheme, host, port, path, query, fragment, netloc = got
    if scheme not in ("http", "https"):
        return urljoin(base, url.strip()) if base else url.strip()
    user = netloc.rpartition("@")[0]
    default = {"http": 80, "https": 443}[scheme]
    where = (user + "@" if user else "") + host + (f":{port}" if port not in (None, default) else "")
    out = f"{scheme}://{where}{_path(path)}"
    if query:
        out += "?" + quote(query, safe="/%:@!$&()*+,;=-._~[]|?'")
    return out + (f"#{quote(fragment, safe='/%:@!$&()*+,;=-._~[]|?')}" if fragment else "")


#: Absolute addresses of letters, digits and a few signs, lower-case host, no query, no dot segments: nothing about them needs more than built-in functions.
PLAIN = r"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?:/[A-Za-z0-9_~-][A-Za-z0-9_.~-]*)+/?$"


def _is_plain(url: Column) -> Column:
    return F.coalesce(url.rlike(PLAIN) & ~F.contains(url, F.lit("/xn--")) & ~F.contains(url, F.lit(".xn--")), F.lit(False))


def canonical_from(url: Column, base: Column) -> Column:
    """canonical() of an address found at base; Python looks at those that aren't plain."""
    return F.when(_is_plain(url), canonical_url(url)).otherwise(arrow(canonical, "string")(F.when(~_is_plain(url), url), base))


def absolute_from(url: Column, base: Column) -> Column:
    """absolute() of an address found at base; Python looks at those that aren't plain."""
    return F.when(_is_plain(url), url).otherwise(arrow(absolute, "string")(F.when(~_is_plain(url), url), base))


canonical_url_exact = arrow(canonical, "string")
absolute_url = arrow(absolute, "string")


def canonical_url(url: Column) -> Column:
    """canonical() for absolute http(s) URLs without escapes, by built-in functions alone.

    Where a row may be anything else, use canonical_url_exact.
    """
    raw = F.trim(url)
    part = lambda i: F.regexp_extract(raw, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:@]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?", i)
    host = F.regexp_replace(F.lower(part(1)), r"^www\.", "")
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.when(part(3) == "", "/").otherwise(F.when(F.length(part(3)) > 1, F.regexp_replace(part(3), "/+$", "")).otherwise(part(3)))
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(_TRACKED))
    full = F.transform(pairs, lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))))
    keyed = F.array_sort(F.transform(full, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("name"), i.alias("at"), p.alias("pair"))))
    query = F.array_join(F.transform(keyed, lambda s: s["pair"]), "&")
    return F.when(part(1) != "", F.concat(F.lit("https://"), host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def url_hash(canonical_url: Column) -> Column:
    return F.sha2(canonical_url, 256)


def title_from_url(url: Column) -> Column:
    """A readable title from the last segment of the path; the url itself where there is none."""
    path = F.regexp_extract(url, r"^(?i)https?://[^/?#]+([^?#]*)", 1)
    slug = F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(-1))
    clean = F.trim(F.regexp_replace(F.regexp_replace(slug, r"(?i)\.(html?|aspx|php)$", ""), "[-_]+", " "))
    return F.when(F.coalesce(clean, F.lit("")) == "", url).otherwise(F.concat(F.upper(F.substring(clean, 1, 1)), F.substr(clean, F.lit(2))))


def origin(url: Column) -> Column:
    """scheme://host[:port], lower-cased, without a default port."""
    found = F.lower(F.regexp_extract(url, r"^(?i)(https?://)(?:[^/?#@]*@)?([^/?#@]+)", 0))
    bare = F.regexp_replace(found, "//[^/@]*@", "//")
    return F.regexp_replace(F.regexp_replace(bare, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")


def host(url: Column) -> Column:
    """The host with its port, lower-cased; the url itself where there is none."""
    found = F.regexp_replace(origin(url), "^https?://", "")
    return F.when(found != "", found).otherwise(url)


def _site(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i)https?://([^/?#:@]+)", 1)), r"^(www|m)\.", "")
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) > 1, F.try_element_at(labels, F.lit(-2))).otherwise(host)


def suggested_id(url: Column) -> Column:
    """A short name for a source: its site and the last segment of the path."""
    slug = F.try_element_at(F.filter(F.split(F.regexp_extract(url, r"^(?i)https?://[^/?#]+([^?#]*)", 1), "/"), lambda s: s != ""), F.lit(-1))
    return F.trim(F.regexp_replace(F.lower(F.concat_ws("-", _site(url), slug)), "[^a-z0-9]+", "-"), F.lit("-"))


def institution_name(url: Column) -> Column:
    return F.initcap(F.regexp_replace(_site(url), "[-_]+", " "))


def robots_pattern(path: str) -> str:
    """A robots path, with * and a final $, as a pattern."""
    from .regexes import literal

    body = path.removesuffix("$")
    return "^" + ".*".join(literal(p) for p in body.split("*")) + ("$" if path.endswith("$") else "")


def robots_allows(path: Column, allow: list[str], disallow: list[str]) -> Column:
    """The longest matching pattern decides; allow wins a tie; no match allows."""

    def longest(patterns: list[str]) -> Column:
        return reduce(F.greatest, [F.when(path.rlike(robots_pattern(p)), F.lit(len(p))).otherwise(F.lit(-1)) for p in patterns], F.lit(-1))

    return (longest(disallow) < 0) | (longest(allow) >= longest(disallow))
