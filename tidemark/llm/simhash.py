"""SimHash near-dedup: BK-trees over shards of the fingerprints.

1. Every text gets a fingerprint of 64 bits from the XXH64 of all its 3-word shingles; equal fingerprints
   are one class from here on, so a group of copies of any size is one entry of the trees.
2. Shards: the bits are cut into RADIUS + 1 parts. Two fingerprints within the radius are equal in one part
   at least, so it is enough to compare those that share a part's value: that part and value is a shard.
   A shard over SHARD classes is dealt anew by parts of the bits that differ in it. Of those each round
   takes a third (with 11 left there can't be more than SHARD classes), so there are six rounds at most,
   and no pair is lost in any.
3. Each shard has a BK-tree of its own: children are keyed by their Hamming distance to the parent, and a
   search follows only the edges that the triangle inequality allows within the radius. Classes are put in
   one after another, each looked for first; a link is kept only where it joins what isn't joined yet.
4. Components of the links; the smallest key of each is its name.

The trees go to the tasks that have their shard's classes by the shuffle. All of them together grow with
the corpus, so they can't be sent to every executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _IS_SPACE, _LOWER, in_arrow, save, slices, string_array, tasks_for, text_or_empty
from .components import Groups, components, looked_up
from .exact_dedup import known_filter, suspects

WORDS, RADIUS, SEED, BITS = 3, 2, 42, 64
#: Classes that a tree takes.
SHARD = 2048
#: Shingles whose bits are spread out at once.
WINDOW = 1 << 15


# Fingerprints.


def _spaced(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts, lower-cased, each followed by one space; where each ends; and each text's first word, one entry more."""
    texts = pc.binary_join_element_wise(string_array(texts).cast(pa.large_binary()), pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(1, np.int64)
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[borders[0] : borders[-1]]
    space = _IS_SPACE[data]
    ends = space.copy()
    ends[0] = False
    ends[1:] &= ~space[:-1]
    words = np.concatenate([[0], np.cumsum(ends)])[borders - borders[0]]
    out = _LOWER[data]
    out[ends] = 32
    out = out[ends | ~space]
    return out, np.flatnonzero(_IS_SPACE[out]), words


def fingerprints(texts, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """A fingerprint for each text: bit i is set if it is set in more than half of the shingles' hashes; 0 without words."""
    import xxhash

    data, stops, at = _spaced(texts)
    raw, starts = memoryview(data), np.concatenate([[0], stops[:-1] + 1]).astype(np.int64)
    n_words = np.diff(at)
    n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    upto = np.concatenate([[0], np.cumsum(n)])
    ones = np.zeros((len(n), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, int(upto[-1]), WINDOW):
        places = np.arange(low, min(low + WINDOW, int(upto[-1])))
        text = np.searchsorted(upto, places, "right") - 1
        first = at[text] + places - upto[text]
        last = first + np.minimum(n_words[text], words) - 1
        h = np.fromiter((digest(raw[a:b], seed) for a, b in zip(starts[first].tolist(), stops[last].tolist())), np.uint64, len(places))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        begins = np.flatnonzero(np.diff(text, prepend=-1))
        ones[text[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _sketch(docs: DataFrame, key: str, text: str, words: int, seed: int) -> DataFrame:
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), words, seed).view(np.int64))], ["key", "fp"])

    return in_arrow(docs.select(F.col(f"`{key}`").alias("key"), text_or_empty(F.col(f"`{text}`").cast("string")).alias("text")), run, f"key {kind}, fp long")


# Shards and their trees.


def parts(free: int, radius: int = RADIUS) -> list[int]:
    """Masks of radius + 1 parts that the bits of a mask are cut into, of sizes that differ by one at most."""
    bits = [i for i in range(BITS) if free >> i & 1]
    cuts = [len(bits) * j // (radius + 1) for j in range(radius + 2)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> BITS - 1 else value


class Tree:
    """A BK-tree of 64-bit numbers."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """The values within the radius."""
        found, queue = [], [0] if self.values else []
        while queue:
            i = queue.pop()
            d = (value ^ self.values[i]).bit_count()
            if d <= radius:
                found.append(self.values[i])
            own = self.children[i]
            if len(own) <= 2 * radius + 1:
                queue += [j for e, j in own.items() if -radius <= e - d <= radius]
            else:
                queue += [own[e] for e in range(d - radius, d + radius + 1) if e in own]
        return found

    def add(self, value: int) -> None:
        if self.values:
            i = 0
            while d := (value ^ self.values[i]).bit_count():
                if d not in self.children[i]:
                    self.children[i][d] = len(self.values)
                    break
                i = self.children[i][d]
            else:
                return
        self.values.append(value)
        self.children.append({})


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within the radius that join all values that such links join: fewer than there are values."""
    tree, groups, place, out = Tree(), Groups(0), {}, []
    for v in values:
        if v in place:
            continue
        place[v] = len(groups.up)
        groups.up.append(place[v])
        for w in tree.near(v, radius):
            if groups.find(place[v]) != groups.find(place[w]):
                groups.join(place[v], place[w])
                out.append((w, v))
        tree.add(v)
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """(fp, shard): each row of (fp, shard, masks) once for every mask, in the shard of its bits there."""
    return rows.select("fp", "shard", F.posexplode("masks").alias("j", "mask")).select("fp", F.xxhash64("shard", "j", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"))


def _large(dealt: DataFrame, shard: int, radius: int) -> DataFrame:
    """(node, masks) of shards over so many classes: the parts of the bits that differ within the shard."""

    def run(batches):
        for b in batches:
            masks = [[_signed(m) for m in parts(v % (1 << BITS), radius)] for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(masks, pa.list_(pa.int64()))], ["node", "masks"])

    sizes = dealt.groupBy("shard").agg(F.count("*").alias("size"), F.bit_or("fp").alias("some"), F.bit_and("fp").alias("every"))
    return sizes.filter(F.col("size") > shard).select("shard", F.expr("some & ~every").alias("differ")).mapInArrow(run, "node long, masks array<long>")


def _trees(rows: DataFrame, tasks: int, radius: int) -> DataFrame:
    """Links (a, b) within the shards of rows (fp, shard), each of at most SHARD classes (a few more where two shards share a hash)."""

    def run(batches):
        shard, held = None, []
        for b in batches:
            shards, values = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            borders = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)] if len(shards) else [0]
            out = []
            for x, y in zip(borders, borders[1:]):
                if shards[x] != shard:
                    out += tree_links(held, radius) if len(held) > 1 else ()
                    shard, held = shards[x], []
                held += values[x:y].tolist()
            yield _links(out)
        yield _links(tree_links(held, radius) if len(held) > 1 else [])

    return rows.select("shard", "fp").repartition("shard").coalesce(tasks).sortWithinPartitions("shard", "fp").mapInArrow(run, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def links(classes: DataFrame, count: int, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that join all classes (fp, each once) within the radius of each other."""
    masks = F.array(*[F.lit(_signed(m)) for m in parts((1 << BITS) - 1, radius)])
    rows, found = classes.select("fp", F.lit(0).cast("long").alias("shard"), masks.alias("masks")), None
    while True:
        dealt = save(_dealt(rows), "shards")
        large = save(_large(dealt, shard, radius), "large")
        more = not large.isEmpty()
        marked = looked_up(dealt, "shard", large, "masks", left=True) if more else dealt
        own = save(_trees(marked.filter("masks is null") if more else dealt, tasks_for(count * (radius + 1)), radius), "tree-links")
        found = own if found is None else found.union(own)
        if not more:
            return found
        rows = save(marked.filter("masks is not null"), "dense")
        count = rows.count()


def near_simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: key, fingerprint (16 hex digits), component_id (the smallest key reachable by links).

    Null and empty texts, and texts of white space, have no words and the fingerprint zero, which is linked
    like any other; a text with fewer words than a shingle is one shingle; a very long text is taken whole, in
    windows. Equal fingerprints are linked; rows repeated have a row each. A null key names no component and
    stays null where no other key is reachable. An empty table gives an empty one; docs' other columns,
    whatever their names, don't matter.
    """
    rows = save(_sketch(docs, key, text, words, seed), "fingerprints")
    classes = save(rows.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("n")), "classes")
    count = classes.count()
    labels = components(links(classes, count, radius))
    # Only a class that is linked, or has several rows, needs more than its own key.
    named = save(classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").filter("n > 1 or label is not null").coalesce(tasks_for(count)), "named")
    lowest = named.groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("low").alias("component_id"))
    table = save(named.withColumn("label", F.coalesce("label", "fp")).join(lowest, "label").select(F.col("fp").alias("node"), "component_id"), "components")
    probed = suspects(rows.withColumn("h", F.xxhash64("fp")), "h", known_filter(table.select(F.xxhash64("node").alias("h")), "h", table.count(), "named-filter"), "some")
    some = looked_up(probed.filter("some").select("key", "fp"), "fp", table, "component_id", left=True)
    alone = probed.filter("not some").select("key", "fp", F.col("key").alias("component_id"))
    return some.select("key", "fp", F.coalesce("component_id", "key").alias("component_id")).unionByName(alone).select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
