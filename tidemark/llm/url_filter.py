"""URL filters: a sorted array of 64-bit xxhash keys, memory-mapped, probed by binary search.

Rules are (host, path) pairs. A url's candidates are the suffixes of its host at dots, each with the
prefixes of its path in those lengths that rules have; all candidates of a batch are looked up by
one searchsorted, longest first, and a hit counts only when the stored string equals the candidate.
The files (keys, starts of strings, verdicts, strings) are built once on the driver, which has the
rules anyway, at about 100 bytes of memory each, and written to the shared folder, from which Spark
hands them to every executor, also to those that join later. The keys have a file of their own, so that
the binary search runs on the mapped pages, which a machine's workers share.
"""

from __future__ import annotations

import mmap
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, put

#: (verdict, host, path) of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty for null and for what has no `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    end = min(ends, default=len(rest))
    host = rest[:end].translate(_LOWER)
    tail = rest[end:]
    stop = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return host, tail[:stop]


_LOWER = {i: i + 32 for i in range(65, 91)}


def _digest(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


class Digests:
    """The arrays: keys sorted, starts of the stored strings, verdicts; and the strings."""

    def __init__(self, keys, starts, verdicts, strings, lengths):
        self.keys, self.starts, self.verdicts, self.strings, self.lengths = keys, starts, verdicts, strings, lengths

    @staticmethod
    def build(rules) -> dict[str, bytes]:
        """The files keys, starts, blocks and strings; of rules alike, the first holds."""
        known: dict[str, str] = {}
        for verdict, host, path in rules:
            known.setdefault(host.translate(_LOWER) + "\0" + path, verdict)
        rows = sorted((_digest(k), k.encode("utf-8", "surrogatepass"), v) for k, v in known.items())
        starts = np.cumsum([0, *(len(r[1]) for r in rows)])
        return {
            "keys": np.array([r[0] for r in rows], "<u8").tobytes(), "starts": starts.astype("<i8").tobytes(),
            "blocks": np.array([r[2] == "block" for r in rows], "u1").tobytes(), "strings": b"".join(r[1] for r in rows),
        }

    @classmethod
    def open(cls, keys: str, starts: str, blocks: str, strings: str, lengths) -> Digests:
        blob = b""
        if os.path.getsize(strings):
            with open(strings, "rb") as f:
                blob = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        arrays = (np.memmap(p, kind, "r") if os.path.getsize(p) else np.zeros(0, kind) for p, kind in ((keys, "<u8"), (starts, "<i8"), (blocks, "u1")))
        return cls(*arrays, blob, lengths)

    def find(self, items: list[str]) -> np.ndarray:
        """Rows of the items, -1 where there is none. Keys that collide are told apart by the strings."""
        digests = np.fromiter((_digest(x) for x in items), np.uint64, len(items))
        at = np.searchsorted(self.keys, digests)
        out = np.full(len(items), -1, np.int64)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests)) if len(self.keys) else ():
            j, want = int(at[i]), items[i].encode("utf-8", "surrogatepass")
            while j < len(self.keys) and self.keys[j] == digests[i]:
                if self.strings[int(self.starts[j]) : int(self.starts[j + 1])] == want:
                    out[i] = j
                    break
                j += 1
        return out


def candidates(host: str, path: str, lengths) -> list[str]:
    """What a rule for this url may look like, longest first; of equal length, the longer host first."""
    out = []
    suffix = host
    while suffix:
        out += [suffix + "\0" + path[:n] for n in lengths if n <= len(path)]
        dot = suffix.find(".")
        suffix = suffix[dot + 1 :] if dot >= 0 else ""
    return sorted(out, key=lambda c: (-len(c), c.find("\0") * -1))


def filter_urls(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule (null without one), verdict of every row.

    A url without a rule gets the default: the filter is a list, and what isn't in it is allowed.
    Null and unusable urls have empty host and path, and so no rule. Repeated rows are judged each;
    a very long url is judged whole; an empty table gives an empty one; pages' other columns, whatever
    their names, don't matter.
    """
    spark = pages.sparkSession
    rules = [(v, h, p) for v, h, p in rules]
    lengths = sorted({len(p) for _, _, p in rules})
    names = []
    for name, data in Digests.build(rules).items():
        names.append(f"url-{name}-{uuid.uuid4().hex}")
        spark.sparkContext.addFile(put(spark, names[-1], data))
    kind = dict(pages.dtypes)[key]

    def run(batches):
        digests = Digests.open(*(SparkFiles.get(n) for n in names), lengths)
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            items, owner = [], []
            for i, (host, path) in enumerate(parts):
                own = candidates(host, path, lengths)
                items += own
                owner += [i] * len(own)
            rule: list = [None] * len(parts)
            verdict = [default] * len(parts)
            found = digests.find(items)
            for j in np.flatnonzero(found >= 0)[::-1]:  # the longest is written last
                i = owner[j]
                rule[i] = items[j].replace("\0", "", 1)
                verdict[i] = "block" if digests.verdicts[found[j]] else "allow"
            cols = [b.column(0), *(pa.array(c, pa.string()) for c in ([p[0] for p in parts], [p[1] for p in parts], rule, verdict))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "host", "path", "rule", "verdict"])

    out = in_arrow(pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url")), run, f"key {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("key", key)
