"""What a fetcher needs to know besides fetching: which proxy rules hold, and how to name a failure."""

from __future__ import annotations

import ipaddress
import re
import socket
from urllib.parse import urlsplit

#: Causes of a failure that are looked through.
MOST_CAUSES = 8
_WRAPPERS = re.compile(r"(?i)^(fetch failed|request was cancelled\.?|connection aborted\.?|max retries exceeded.*)$")


def through_proxy(url: str, no_proxy: str = "") -> bool:
    """Whether a url goes through the proxy: never to this machine, nor to what no_proxy names (hosts with subdomains, IPv4 ranges, or *)."""
    try:
        host = (urlsplit(url).hostname or "").lower()
    except ValueError:
        return False
    if not host or host == "localhost" or host.endswith(".localhost") or host == "::1" or host.startswith("127."):
        return False
    for entry in (e.strip().lower() for e in no_proxy.split(",")):
        if entry == "*":
            return False
        if "/" in entry:
            try:
                if ipaddress.IPv4Address(host) in ipaddress.IPv4Network(entry, strict=False):
                    return False
            except ValueError:
                pass
        elif entry and (host == entry.removeprefix(".") or host.endswith("." + entry.removeprefix("."))):
            return False
    return True


def _causes(error: BaseException | None):
    for _ in range(MOST_CAUSES):
        if error is None:
            return
        yield error
        error = error.__cause__ or error.__context__


def describe_failure(error: BaseException) -> str:
    """One sentence about why a request failed: a refusing proxy, a timeout, a known kind of error, else the innermost message that says something."""
    chain = list(_causes(error))
    for e in chain:
        refused = re.search(r"(?i)proxy response \((\d+)\)|tunnel connection failed: (\d+)", str(e))
        if refused:
            return f"Blocked by the network proxy (HTTP {refused[1] or refused[2]}) before reaching the site"
    kinds = ((TimeoutError, "Timed out waiting for a response"), (socket.gaierror, "DNS lookup failed"), (ConnectionRefusedError, "Connection refused"), (ConnectionResetError, "Connection closed by the site"))
    for kind, text in kinds:
        if any(isinstance(e, kind) for e in chain):
            return text
    texts = [str(e).strip() for e in reversed(chain)]
    return next((t for t in texts if t and not _WRAPPERS.match(t)), "Request failed for an unknown reason")
