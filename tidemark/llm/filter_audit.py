"""Filter interaction audit: the trie of all orders of some filters, walked depth first over what survives.

A node of the trie is a prefix of an order. What survives a prefix depends on the set of its filters alone, so
orders share one state for each set: 32 states for the 120 orders of five filters. Each state is a persisted
DataFrame, the parent's survivors without those that one more filter removes; at every edge out of it the rows
are counted that the edge's filter does remove. On the way back a state is let go, so that at most as many are
held as there are filters, and a lost executor's part is made again from the saved table of verdicts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, save, text_or_empty
from .components import looked_up
from .exact_dedup import repeat_filter, suspects


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone. A: few words; B: few distinct words; C: many capitals; D: signs of markup."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) * F.lit(100).cast("long") > F.length(text) * F.lit(3).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def repeats(rows: DataFrame, key: str, sha: str, name: str) -> DataFrame:
    """rows with a boolean column: whether a row with a smaller key has the same digest. Only digests that may be repeated shuffle."""
    hashed = rows.withColumn("__h", F.xxhash64(sha))
    probed = suspects(hashed, "__h", repeat_filter(hashed.select("__h"), "__h", hashed.count()), "__some")
    some = probed.filter("__some").drop("__some", "__h")
    first = some.groupBy(F.col(sha).alias("node")).agg(F.min(key).alias("__first"))
    found = looked_up(some, sha, first, "__first").withColumn(name, F.coalesce(F.col(key) > F.col("__first"), F.lit(False))).drop("__first")
    return found.unionByName(probed.filter("not __some").drop("__some", "__h").withColumn(name, F.lit(False)))


def verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, A to E (true: the row fails that filter), good, toxic, saved. E: the text is that of a smaller key.

    A null text is empty, a null part the empty string; null keys are smaller than none. A key that labels has
    several times is good, or toxic, if one of its rows says so; one that it lacks is neither. Of rows with one
    key and text none is a repeat of the other. A very long text is judged whole.
    """
    t = text_or_empty(F.col(f"`{text}`").cast("string"))
    part_of = F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part")
    judged = docs.select(F.col(f"`{key}`").alias("key"), part_of, F.unhex(F.sha2(t.cast("binary"), 256)).alias("sha"), *[c.alias(n) for n, c in conditions(t).items()])
    whole = repeats(save(judged, "judged"), "key", "sha", "E").drop("sha")
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    some = whole.join(marks, "key", "left")
    return save(some.select("part", *"ABCDE", *[F.coalesce(m, F.lit(False)).alias(m) for m in ("good", "toxic")]), "verdicts")


def edges(rows: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """(part, state, filter, total, removed, and for each mark the number of marked rows removed) for every edge.

    state: the filters applied before, as bits in the order of filters; total: what survives them in the part.
    Parts of which nothing survives a state have no row there.
    """
    seen: dict[frozenset, DataFrame] = {}

    def counted(survivors: DataFrame, state: frozenset) -> DataFrame:
        mask = sum(1 << i for i, f in enumerate(filters) if f in state)
        left = [f for f in filters if f not in state]
        sums = {f"{f} {m}": F.count_if(F.col(f) & F.col(m)) for f in left for m in marks} | {f: F.count_if(F.col(f)) for f in left}
        one = survivors.groupBy("part").agg(F.count("*").alias("total"), *[c.alias(n) for n, c in sums.items()])
        out = [F.struct(F.lit(f).alias("filter"), F.col(f).alias("removed"), *[F.col(f"{f} {m}").alias(m) for m in marks]) for f in left]
        return save(one.select("part", F.lit(mask).alias("state"), "total", F.explode(F.array(*out)).alias("e")).select("part", "state", "total", "e.*"), f"state-{mask}")

    def visit(survivors: DataFrame, state: frozenset) -> None:
        survivors.persist()
        seen[state] = counted(survivors, state)
        for f in filters:
            after = state | {f}
            if f not in state and after not in seen and len(after) < len(filters):
                visit(survivors.filter(~F.col(f)).drop(f), after)
        survivors.unpersist()

    visit(rows, frozenset())
    found = list(seen.values())
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def audit(rows: DataFrame, filters: list[str], marks: list[str] = ()) -> DataFrame:
    """One row per part, order and step: what the step's filter removes there, and what of that is its own doing.

    rows: part, a boolean column for each filter (true: fails, never null), and for each mark. Columns: part,
    filter_order, step, filter, kept, removed, redundant (fail, but removed before), unique_fails (fail nothing
    else), <mark>_lost, shapley (removed over all orders). The number of orders is the factorial of that of
    filters, the number of states a power of two. Every part has all rows, zeros included; an empty table gives
    an empty one.
    """
    spark = rows.sparkSession
    found = save(edges(rows, filters, list(marks)), "edges")
    trie = []
    for order in permutations(filters):
        mask = 0
        for step, f in enumerate(order):
            trie.append(("".join(order), step + 1, f, mask))
            mask |= 1 << filters.index(f)
    orders = spark.createDataFrame(trie, "filter_order string, step int, filter string, state int")
    root = found.filter("state = 0").select("part", "filter", F.col("removed").alias("fails"))
    last = F.lit((1 << len(filters)) - 1).bitwiseXOR(F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)]), F.col("filter")))
    alone = found.filter(F.col("state") == last).select("part", "filter", F.col("removed").alias("unique_fails"))
    every = root.join(F.broadcast(orders), "filter").join(alone, ["part", "filter"], "left").join(found, ["part", "filter", "state"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    every = every.select(
        "part", "filter_order", "step", "filter", zero(F.col("total") - F.col("removed")).alias("kept"), zero(F.col("removed")).alias("removed"),
        (F.col("fails") - zero(F.col("removed"))).alias("redundant"), zero(F.col("unique_fails")).alias("unique_fails"), *[zero(F.col(m)).alias(f"{m}_lost") for m in marks],
    )
    shapley = every.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return every.join(shapley, ["part", "filter"])
