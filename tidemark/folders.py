"""What is known of a stored folder without reading it: a Bloom filter of its hashes, and the range of its dates.

A filter is a table of 64-bit words, (word, bits), written beside its folder; its number of words is a power of two
that the pointer file names. A hash has PROBES words, chosen independently, and two bits in each; at 32 bits a row
about one of 100,000 strange hashes passes, so a batch reads the folders that hold something of it and hardly another.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 4
ROWS_A_WORD = 2


@dataclass(frozen=True)
class Folder:
    """A folder of a table. What isn't known (None) of a folder of an older version may be anything."""

    path: str
    rows: int | None = None
    words: int | None = None
    #: For folders of items, by whether dates are estimated: (smallest, largest) published_at, None where there are no such items.
    stated: tuple[int, int] | None = None
    estimated: tuple[int, int] | None = None

    #: Whether bitmaps and trigrams of a folder of items lie beside it.
    indexed: bool = False

    @property
    def filter_path(self) -> str:
        return self.path + ".filter"

    @property
    def dated(self) -> bool:
        return self.rows is not None and (self.rows == 0 or bool(self.stated or self.estimated))

    def meets(self, low: int, high: int) -> bool:
        """Whether a date from low to high may be in it."""
        return not self.dated or any(r and r[0] <= high and low <= r[1] for r in (self.stated, self.estimated))

    def as_json(self) -> dict:
        return {k: v for k, v in vars(self).items() if v not in (None, False) and k != "path"}

    @classmethod
    def of(cls, path: str, known: dict | None) -> Folder:
        known = known or {}
        return cls(path, known.get("rows"), known.get("words"), *(tuple(known[k]) if known.get(k) else None for k in ("stated", "estimated")), known.get("indexed", False))


def words_for(rows: int) -> int:
    return 1 << max(0, (rows // ROWS_A_WORD).bit_length())


def _probes(h: Column, words: Column) -> Column:
    """The words of a hash and its bits there."""
    out = []
    for i in range(PROBES):
        g = F.xxhash64(h, F.lit(i))
        bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(g, by), F.lit(64)).cast("int"))  # noqa: E731, B023
        out.append(F.struct(F.pmod(F.shiftright(g, 16), words).alias("word"), bit(2).bitwiseOR(bit(9)).alias("mask")))
    return F.array(*out)


def bloom(rows: DataFrame, by: Iterable[str], words: int | Column, *of: str) -> DataFrame:
    """(word, bits) of the filter of rows' values in the columns by; of: columns of rows whose values have a filter each."""
    probes = rows.select(*of, F.explode(_probes(F.xxhash64(*by), F.lit(words))).alias("p"))
    return probes.groupBy(*of, "p.word").agg(F.bit_or("p.mask").alias("bits"))


def hit(rows: DataFrame, by: Iterable[str], filters: DataFrame, sizes: Iterable[int]) -> DataFrame:
    """Numbers of the folders whose filter has all bits of one of rows. filters: folder, words, word, bits."""
    asked = rows.select(F.xxhash64(*by).alias("h")).distinct()
    asked = asked.select("h", F.explode(F.array(*[F.lit(w).cast("long") for w in sorted(set(sizes))])).alias("words"))
    asked = asked.select("h", "words", F.explode(_probes(F.col("h"), F.col("words"))).alias("p")).select("h", "words", "p.*")
    found = filters.join(asked, ["words", "word"]).filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return found.groupBy("folder", "h").agg(F.count("*").alias("n")).filter(F.col("n") == PROBES).select("folder").distinct()
