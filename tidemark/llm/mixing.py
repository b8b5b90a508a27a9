"""Mixing sources to target weights by capped water-filling.

A source's target is its share of the total by weight, at most max_epochs times its size; what a
cap cuts off is dealt again by weight until no source is above its cap. Capped sources are those
with the smallest cap a weight, so the level is found from running sums in that order. Documents are
then repeated a whole number of times, and a seeded choice of them once more for the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, save, text_or_empty

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Slices of the seeded order; a source's fraction ends in one of them, which alone is sorted.
SLICES = 4096
#: Parts in which rows of a hot key are numbered.
SALTS = 64
#: Rows of a plan, one a source, up to which it is broadcast.
MOST_BROADCAST = 100_000


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> with target. One row per source, so the windows see sources, not documents."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    caps = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = caps.withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    runs = runs.withColumn("cap_run", F.sum("cap").over(upto) - F.col("cap")).withColumn("w_run", F.sum("w").over(upto) - F.col("w"))
    # The level if all sources before this one are capped; it holds at the first one below its cap,
    # after which it only falls.
    runs = runs.withColumn("level", (F.col("total") - F.col("cap_run")) / (F.col("all_w") - F.col("w_run")))
    runs = runs.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    return runs.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs' rows, each as often as mix() takes it, with all columns.

    The seeded order needs no shuffle of texts: a row's repeats follow from its source's plan, but
    for the slice in which a source's fraction ends, and those few rows are decided by key and size. Of
    rows alike in source, key and size, of which the fraction takes some, those whose columns have the
    least hashes are taken; rows alike in all columns are one until they are repeated. Null texts have
    no words and go with what their slice does. An empty table gives an empty one; columns of any name
    but those that begin with two underscores may ride along.
    """
    plan, rows = _plan(docs, key=key, text=text, source=source, **how)
    groups = _edge(rows, plan).select(F.col("key").alias("__k"), F.col("source").alias("__so"), F.col("size").alias("__size"), F.col("n").alias("__n_all"), F.col("taken").alias("__taken"))
    groups = save(groups.filter("taken > 0"), "edge")
    cols = [f"`{c}`" for c in docs.columns]
    most = F.lit(int(how.get("max_epochs", MAX_EPOCHS))).cast("long")
    own = docs.withColumn("__u", _u(F.col(f"`{key}`"), how.get("seed", SEED))).withColumn("__slice", F.expr(f"__u div {2**32 // SLICES}"))
    own = own.join(_small(plan.select(F.col("s").alias("__s"), F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))), F.col(f"`{source}`").eqNullSafe(F.col("__s")))
    clear = own.filter("__slice != __cut").withColumn("__times", F.least(F.col("__whole") + (F.col("__slice") < F.col("__cut")).cast("long"), most))
    edge = own.filter("__slice = __cut").withColumn("__n", _size(f"`{text}`"))
    met = edge.join(groups, F.col(f"`{key}`").eqNullSafe(F.col("__k")) & F.col(f"`{source}`").eqNullSafe(F.col("__so")) & (F.col("__n") == F.col("__size")), "left")
    # All of a group or none: no order is needed.
    sure = met.filter("__taken is null or __taken = __n_all").withColumn("__times", F.least(F.col("__whole") + F.col("__taken").isNotNull().cast("long"), most))
    some = met.filter("__taken < __n_all").groupBy("__k", "__so", "__size", F.xxhash64(*cols).alias("__h"), F.xxhash64(F.lit("h2"), *cols).alias("__h2"))
    some = some.agg(F.first(F.struct(*cols)).alias("__row"), F.count("*").alias("__copies"), F.first("__whole").alias("__whole"), F.first("__taken").alias("__taken"))
    before = F.sum("__copies").over(Window.partitionBy("__k", "__so", "__size").orderBy("__h", "__h2").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__copies")
    more = F.greatest(F.lit(0), F.least(F.col("__copies"), F.col("__taken") - before))
    some = some.withColumn("__more", more).withColumn("__times", F.least(F.col("__whole") + 1, most) * F.col("__more") + F.least("__whole", most) * (F.col("__copies") - F.col("__more")))
    parts = clear.select("__times", *cols).unionByName(sure.select("__times", *cols)).unionByName(some.select("__times", "__row.*"))
    return parts.withColumn("__i", F.explode(F.array_repeat(F.lit(1), F.col("__times").cast("int")))).select(*cols)


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target, repeats and taken (size * repeats) of every row of docs.

    A null text has size 0; a null source is a source, the last. Equal seeds give equal results in
    any partitioning. Rows of one key and size are chosen in an order that doesn't matter, being
    alike. A source's taken words miss its target by at most half a document. Sources without
    words have target 0. An empty table gives an empty one.
    """
    plan, rows = _plan(docs, weights, max_epochs, seed, key, text, source)
    dealt = rows.join(_small(plan), F.col("source").eqNullSafe(F.col("s")))
    rest = dealt.filter("slice != cut").withColumn("once_more", F.col("slice") < F.col("cut"))
    groups = save(_edge(rows, plan).select(F.col("key").alias("k"), F.col("source").alias("so"), F.col("size").alias("sz"), "n", "taken"), "edge")
    edge = dealt.filter("slice = cut").join(groups, F.col("key").eqNullSafe(F.col("k")) & F.col("source").eqNullSafe(F.col("so")) & (F.col("size") == F.col("sz")))
    sure = edge.filter("taken = 0 or taken = n").withColumn("once_more", F.col("taken") > 0)
    # Numbers within a group that is taken in part, by salts: a task numbers a part, parts are added up.
    some = edge.filter("taken > 0 and taken < n").withColumn("salt", F.pmod("row", F.lit(SALTS)))
    alike = Window.partitionBy("source", "key", "size")
    parts = some.groupBy("source", "key", "size", "salt").agg(F.count("*").alias("m"))
    parts = parts.withColumn("base", F.sum("m").over(alike.orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m"))
    parts = parts.select(F.col("source").alias("p_so"), F.col("key").alias("p_k"), F.col("size").alias("p_sz"), F.col("salt").alias("p_salt"), "base")
    place = F.row_number().over(Window.partitionBy("source", "key", "size", "salt").orderBy("row"))
    some = some.withColumn("place", place).join(parts, F.col("source").eqNullSafe(F.col("p_so")) & F.col("key").eqNullSafe(F.col("p_k")) & (F.col("size") == F.col("p_sz")) & (F.col("salt") == F.col("p_salt")))
    some = some.withColumn("once_more", F.col("base") + F.col("place") <= F.col("taken"))
    repeats = F.least(F.col("whole") + F.col("once_more").cast("long"), F.lit(int(max_epochs)).cast("long"))
    cols = ["key", "size", "source", "source_size", "target", "whole", "once_more"]
    return (
        rest.select(*cols).unionByName(sure.select(*cols)).unionByName(some.select(*cols))
        .withColumn("repeats", repeats)
        .select(F.col("key").alias(key), "size", F.col("source").alias("source"), "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))
    )


def _small(plan: DataFrame) -> DataFrame:
    """The plan marked for broadcasting while it has few sources; else it is joined by shuffling."""
    return F.broadcast(plan) if plan.count() <= MOST_BROADCAST else plan


def _u(key, seed: str):
    """A row's place in the seeded order, 32 bits."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary")), 1, 8), 16, 10).cast("long")


def _size(text: str):
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def _plan(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source"):
    """What each source takes (s, source_size, target, whole, more, cut, start), and the rows without texts."""
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), _size(f"`{text}`").alias("size"))
    rows = save(named.withColumn("row", F.monotonically_increasing_id()).withColumn("u", _u(F.col("key"), seed)).withColumn("slice", F.expr(f"u div {2**32 // SLICES}")), "sizes")
    sliced = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sizes = sliced.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    goal = targets(sizes, weights, max_epochs).withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
    goal = goal.withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = sliced.withColumn("start", F.sum("slice_size").over(before) - F.col("slice_size")).join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    # The one slice of a source in which its fraction ends.
    cut = cuts.filter("start < more and start + slice_size >= more").groupBy("source").agg(F.max("slice").alias("cut"), F.max_by("start", "slice").alias("start"))
    plan = goal.join(cut.withColumnRenamed("source", "c"), F.col("source").eqNullSafe(F.col("c")), "left").select(
        F.col("source").alias("s"), "source_size", "target", "whole", "more", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("start", F.lit(0)).alias("start")
    )
    return save(plan, "plan"), rows


def _edge(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Of the slices in which fractions end, the groups of rows alike in key and size: n, and taken, how many of them are taken once more.

    A row is taken while its middle is before the end. Rows alike are counted, not sorted.
    """
    inside = Window.partitionBy("source").orderBy("u", F.col("key").isNull(), "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slim = plan.select("s", F.col("cut").alias("p_cut"), "start", "more")
    groups = rows.join(_small(slim), F.col("source").eqNullSafe(F.col("s"))).filter("slice = p_cut").groupBy("source", "u", "key", "size", "start", "more").agg(F.count("*").alias("n"))
    groups = groups.withColumn("before", F.col("start") + F.sum(F.col("size") * F.col("n")).over(inside) - F.col("size") * F.col("n"))
    fit = F.floor((F.col("more") - F.col("before")) / F.nullif(F.col("size"), F.lit(0)) + 0.5)
    first = F.col("before") + F.col("size") - F.col("size") / 2 <= F.col("more")
    taken = F.when(~first, 0).when((F.col("n") == 1) | (F.col("size") == 0), F.col("n")).otherwise(F.greatest(F.lit(1), F.least(F.col("n"), fit)))
    return groups.select("source", "key", "size", "n", taken.cast("long").alias("taken"))
