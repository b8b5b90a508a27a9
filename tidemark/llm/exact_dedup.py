"""Exact dedup: a Bloom filter over all hashes, a second one of what hit it twice, then only suspects shuffle.

Pass one sends each row's slots (two in a 64-bit word that the hash picks) through a map-side
count; slots hit twice make the second filter. Pass two probes every row: a row with a slot that
was hit once is certainly unique and passes straight through, the others are grouped by the
SHA-256 of their whole normalised text, so that false positives cost time and never a wrong result.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, save, text_or_empty

#: Words (64 slots, about 40 bytes) that a filter may have when it is broadcast. A larger one is folded to
#: so many, word i onto word i modulo their number: it then lets more rows through that aren't repeated,
#: and rows that it clears still don't shuffle. 1.5 million words tell about 20 million hashes apart.
BROADCAST_WORDS = 1_500_000
#: Rows of a group that one salt takes, about; more salts for larger inputs.
SALTS = 64


def normalised(text: str) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, "")


def _slots(h: Column, words: int, k: int = 2) -> list[Column]:
    """k different bits of one word, as numbers 64 * word + bit."""
    word = F.pmod(h, F.lit(words)) * 64
    g = F.xxhash64(h)
    first = F.pmod(g, F.lit(64))
    step = F.pmod(F.shiftright(g, 8), F.lit(63)) + 1  # never back at the first
    return [word + (first + step * i) % 64 for i in range(k)]


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))


def repeat_filter(hashes: DataFrame, h: str, rows: int, label: str = "repeat-filter") -> tuple[DataFrame, int, int]:
    """The second filter as rows (word, bits); the first one's number of words, and the second's."""
    words = max(1, rows // 4)  # 16 bits a row
    slots = hashes.select(F.explode(F.array(*_slots(F.col(h), words))).alias("slot"))
    return _packed(slots.groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1"), words, label)


def known_filter(hashes: DataFrame, h: str, rows: int, label: str) -> tuple[DataFrame, int, int]:
    """A plain Bloom filter of the hashes, in the same form."""
    words = max(1, rows // 4)
    return _packed(hashes.select(F.explode(F.array(*_slots(F.col(h), words))).alias("slot")), words, label)


def _packed(slots: DataFrame, words: int, label: str) -> tuple[DataFrame, int, int]:
    fold = min(words, BROADCAST_WORDS)
    packed = slots.groupBy(F.expr(f"(slot div 64) % {fold}").alias("word")).agg(F.bit_or(_bit(F.col("slot"))).alias("bits"))
    return save(packed, label), words, fold


def suspects(df: DataFrame, h: str, found: tuple[DataFrame, int, int], flag: str) -> DataFrame:
    """df with a boolean column: whether the filter has both of the row's slots. df doesn't shuffle: the filter has BROADCAST_WORDS rows at most."""
    packed, words, fold = found
    side = packed.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    a, b = _slots(F.col(h), words)
    keyed = df.withColumn("__word", F.expr(f"pmod({h}, {words}L) % {fold}L"))
    joined = keyed.join(F.broadcast(side), "__word", "left")
    mask = _bit(a).bitwiseOR(_bit(b))
    hit = F.coalesce(F.col("__bits").bitwiseAND(mask) == mask, F.lit(False))
    return joined.withColumn(flag, hit).drop("__word", "__bits")


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and are one group with empty texts and texts of white space alone.
    Of equal texts, the row with the most code points stays, then the smallest key (null last);
    of rows equal in that too, one. An empty table gives an empty one. Other columns don't matter.
    """
    digests = save(
        docs.select(F.col(f"`{key}`").alias("key"), F.length(text_or_empty(f"`{text}`")).alias("size"), normalised(f"`{text}`").alias("t")).select(
            F.monotonically_increasing_id().alias("row"), "key", "size", F.unhex(F.sha2("t", 256)).alias("sha")
        ),
        "digests",
    )
    # Eight bytes of the SHA-256 are the hash: as good as any, and the text is read once.
    digests = digests.withColumn("h", F.xxhash64("sha"))
    rows = digests.count()
    probed = suspects(digests, "h", repeat_filter(digests, "h", rows), "suspect")
    alone = probed.filter(~F.col("suspect")).select(
        F.col("key").alias(key), F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
    # A hot group is counted in salted parts; each part then gets the group's verdict, so that no
    # task sees more than a part.
    salts = max(SALTS, rows // 1_000_000)
    some = probed.filter("suspect").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    parts = some.groupBy("sha", "salt").agg(
        F.count("*").alias("n"), F.min(F.struct((-F.col("size")).alias("s"), F.col("key").isNull().alias("no"), "key", "row")).alias("best")
    )
    groups = parts.groupBy("sha").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"), F.collect_set("salt").alias("salts"))
    verdicts = groups.select("sha", "group_size", "best", F.explode("salts").alias("salt"))
    rest = some.join(verdicts, ["sha", "salt"]).select(
        F.col("key").alias(key),
        F.col("best.key").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return alone.unionByName(rest)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that decide() keeps, with all columns of docs.

    Rows that the filter clears never shuffle; of the others, a task sends at most one of a group.
    Rows equal in size and key may be told apart by any other column; one of them stays. Null texts
    count as empty; an empty table gives an empty one; columns of any name but those that begin with
    two underscores may ride along.
    """
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"))
    t = F.coalesce(F.col(f"__row.`{text}`"), F.lit(""))
    hashed = packed.withColumn("__sha", F.unhex(F.sha2(F.regexp_replace(t, SPACES, ""), 256))).withColumn("__h", F.xxhash64("__sha"))
    hashes = save(hashed.select("__h"), "hashes")
    probed = suspects(hashed, "__h", repeat_filter(hashes, "__h", hashes.count()), "__suspect")
    rank = F.struct(-F.length(t), F.col(f"__row.`{key}`").isNull(), F.col(f"__row.`{key}`"))
    rest = probed.filter("__suspect").groupBy("__sha").agg(F.min_by("__row", rank).alias("__row"))
    return probed.filter("not __suspect").select("__row.*").unionByName(rest.select("__row.*"))
