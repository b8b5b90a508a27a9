"""What is stored already, and what a batch repeats."""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.lineage import settled
from tidemark.model import DAY_MS

#: Equal titles of one institution within so long are one article.
WINDOW_MS = 7 * DAY_MS


#: Rows of a title from which its fold is cut into spans of dates.
HOT_TITLE = 10_000


@dataclass(frozen=True)
class Tables:
    """What is stored already, as plain tables. A store answers the same questions from the folders that matter."""

    items: DataFrame
    pruned: DataFrame
    seen_urls: DataFrame | None = None

    def known(self, rows: DataFrame) -> DataFrame:
        """Hashes that rows may have and that are stored or pruned."""
        return known_hashes(self.items, self.pruned)

    def near(self, rows: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
        """Items that may lie within the window of one of rows."""
        return self.items

    def holding(self, name: str, rows: DataFrame) -> DataFrame:
        return getattr(self, name)


def known_hashes(items: DataFrame, pruned: DataFrame) -> DataFrame:
    return items.select("canonical_hash").union(pruned.select("canonical_hash")).distinct()


def not_known(rows: DataFrame, items: DataFrame, pruned: DataFrame) -> DataFrame:
    """Rows whose hash is neither stored nor pruned."""
    return rows.join(known_hashes(items, pruned), "canonical_hash", "left_anti")


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    return rows.join(seen.select("source_id", "canonical_hash"), ["source_id", "canonical_hash"], "left_anti")


def first_per_hash(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of each hash by the columns of order, which tell rows apart; combined before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy("canonical_hash").agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def seen_after(seen: DataFrame, rows: DataFrame, now_ms: int) -> DataFrame:
    """What becomes seen by a visit to rows, without what was seen already."""
    new = unseen(rows.select("source_id", "canonical_hash").distinct(), seen)
    return new.withColumn("seen_at", F.lit(now_ms).cast("long")).select("source_id", "canonical_hash", "seen_at")


def _bucket(at, window_ms: int):
    """Dates in buckets as wide as the window: what is within it of a date lies in its bucket or a neighbour."""
    return F.floor(F.col(at) / window_ms)


def _surroundings(items: DataFrame, window_ms: int) -> DataFrame:
    """institution, title_key, __b: for each bucket with items in or beside it whether it has some, and the nearest dates of its neighbours.

    A bucket comes down to its first and last date before the shuffle, so a title with any number of items has
    a row a bucket, and three after the neighbours are told.
    """
    dated = items.filter("title_key != '' and institution is not null and published_at is not null")
    ends = dated.groupBy("institution", "title_key", _bucket("published_at", window_ms).alias("b")).agg(F.min("published_at").alias("first"), F.max("published_at").alias("last"))
    none = F.lit(None).cast("long")
    sides = F.array(
        F.struct(F.col("b").alias("__b"), F.lit(True).alias("own"), none.alias("before"), none.alias("after")),
        F.struct((F.col("b") + 1).alias("__b"), F.lit(False).alias("own"), F.col("last").alias("before"), none.alias("after")),
        F.struct((F.col("b") - 1).alias("__b"), F.lit(False).alias("own"), none.alias("before"), F.col("first").alias("after")),
    )
    told = ends.select("institution", "title_key", F.explode(sides).alias("s")).select("institution", "title_key", "s.*")
    return told.groupBy("institution", "title_key", "__b").agg(F.max("own").alias("__own"), F.max("before").alias("__before"), F.min("after").alias("__after"))


def _banded(rows: DataFrame, items: DataFrame, window_ms: int, how: str) -> DataFrame:
    """A semi- or anti-join of rows with items of one institution, one key and a date within the window: on buckets of dates, so that a hot title is many keys."""
    at = F.col("published_at")
    close = F.col("__own") | (at - F.col("__before") <= window_ms) | (F.col("__after") - at <= window_ms)
    around = _surroundings(items, window_ms).withColumnsRenamed({"institution": "__i", "title_key": "__t", "__b": "__ib"})
    keyed = rows.withColumn("__b", _bucket("published_at", window_ms))
    met = (F.col("institution") == F.col("__i")) & (F.col("title_key") == F.col("__t")) & (F.col("__b") == F.col("__ib")) & close
    return keyed.join(around, met, how).drop("__b")


def title_matches(rows: DataFrame, items: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Rows that have a stored item of one institution, one key and a date at most the window apart."""
    return _banded(rows.filter("title_key != ''"), items, window_ms, "left_semi")


def not_near_stored(rows: DataFrame, items: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    return _banded(rows, items, window_ms, "left_anti")


def _spans(rows: DataFrame, window_ms: int, hot: int) -> DataFrame:
    """institution, title_key, __b, __span of titles with more than hot rows: buckets between which no two dates lie within the window have different spans."""
    b = _bucket("published_at", window_ms).alias("__b")
    ends = rows.groupBy("institution", "title_key", b).agg(F.min("published_at").alias("first"), F.max("published_at").alias("last"), F.count("*").alias("n"))
    title = Window.partitionBy("institution", "title_key")
    hot_ends = ends.withColumn("all", F.sum("n").over(title)).filter(F.col("all") > hot)
    after = title.orderBy("__b")
    cut = hot_ends.withColumn("cut", F.coalesce(F.col("first") - F.lag("last").over(after) > window_ms, F.lit(True)).cast("long"))
    return cut.select("institution", "title_key", "__b", F.sum("cut").over(after).alias("__span"))


def greedy(rows: DataFrame, pos: str = "pos", window_ms: int = WINDOW_MS, free: str | None = None, hot: int = HOT_TITLE) -> DataFrame:
    """rows with kept: false where an earlier kept row of the same institution and key is within the window.

    A fold in the order of pos, so a rejected row doesn't extend the window. Each partition is sorted by
    group and folded as it streams by: what is held is one group's kept dates, which lie more than the
    window apart, however many rows a group has. A title of more than hot rows is cut where its dates leave
    more than the window free, as rows on either side never meet. An empty key never matches.

    free names a column that is true, or null where it is open whether the row takes part; kept is then
    null where it hangs on that. Spans of open rows that meet are held as one.
    """
    kinds = dict(rows.dtypes)
    cols = rows.columns
    sure = F.col(free).isNotNull() if free else F.lit(True)
    slim = rows.filter("title_key != ''").select("institution", "title_key", F.col("published_at").alias("at"), F.col(pos).alias("pos"), sure.alias("sure"))

    def fold(batches):
        group, dates, starts, ends = None, [], [], []
        for b in batches:
            kept = []
            for inst, key, at, sure, span in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4, 5))):
                if (inst, key, span) != group:
                    group, dates, starts, ends = (inst, key, span), [], [], []
                i = bisect.bisect_left(dates, at)
                if i < len(dates) and dates[i] - at <= window_ms or i and at - dates[i - 1] <= window_ms:
                    kept.append(False)
                    continue
                k = bisect.bisect_left(ends, at)
                if sure and not (k < len(ends) and starts[k] <= at):
                    kept.append(True)
                    dates.insert(i, at)
                    continue
                kept.append(None)
                low, high = at - window_ms, at + window_ms
                j, k = bisect.bisect_left(ends, low), bisect.bisect_right(starts, high)
                low, high = min([low, *starts[j:k]]), max([high, *ends[j:k]])
                starts[j:k], ends[j:k] = [low], [high]
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(kept, pa.bool_())], ["pos", "kept"])

    keys = ["institution", "title_key"]
    spans = _spans(slim.select(*keys, F.col("at").alias("published_at")), window_ms, hot)
    cut = slim.withColumn("__b", _bucket("at", window_ms)).join(spans, [*keys, "__b"], "left").withColumn("span", F.coalesce("__span", F.lit(0).cast("long")))
    ready = cut.select(*slim.columns, "span").repartition(*keys, "span").sortWithinPartitions(*keys, "span", "pos")
    kept = ready.mapInArrow(fold, f"pos {kinds[pos]}, kept boolean").withColumn("__met", F.lit(True)).withColumnRenamed("pos", "__pos")
    joined = rows.join(kept, F.col(pos) == F.col("__pos"), "left")
    alone = F.col(free) if free else F.lit(True)
    return joined.select(*[F.col(f"`{c}`") for c in cols], F.when(F.col("__met"), F.col("kept")).otherwise(alone).alias("kept"))


def decide(rows: DataFrame, items: DataFrame, pruned: DataFrame, pos: str = "pos", window_ms: int = WINDOW_MS) -> DataFrame:
    """rows with decision: inserted, duplicate_url or duplicate_title, as if stored one by one in the order of pos.

    Hashes and titles interact: a row turned away for its title leaves its hash free. So rows are in,
    out or open, and the two passes are repeated until none is open. A round decides every row that
    hangs on decided rows only, so the copies of a hash or a title are decided together; the rounds are
    as many as hashes and titles alternate in the longest chain of rows that hang on each other. After a
    round only rows that share a hash or a title with an open one go on.
    """
    known = known_hashes(items, pruned).withColumn("__known", F.lit(True))
    return _decided(rows.join(known, "canonical_hash", "left").withColumn("__known", F.coalesce("__known", F.lit(False))), items, pos, window_ms).select(*rows.columns, "decision")


def decide_fresh(rows: DataFrame, items: DataFrame, pos: str = "pos", window_ms: int = WINDOW_MS) -> DataFrame:
    """As decide(), of rows whose hashes are known to be new; items: those that may lie within the window of one of them."""
    return _decided(rows.withColumn("__known", F.lit(False)), items, pos, window_ms).select(*rows.columns, "decision")


def _decided(base: DataFrame, items: DataFrame, pos: str, window_ms: int) -> DataFrame:
    stored = title_matches(base.select(pos, "institution", "title_key", "published_at"), items, window_ms).select(F.col(pos)).distinct().withColumn("__near", F.lit(True))
    base = base.join(stored, pos, "left")
    base = base.withColumn("__in", F.when(F.col("__known") | F.coalesce("__near", F.lit(False)), F.lit(False))).drop("__near")
    ahead = Window.partitionBy("canonical_hash").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("__known") | F.coalesce(F.max(F.coalesce("__in", F.lit(False))).over(ahead), F.lit(False))
    done = []
    while True:
        waits = F.coalesce(F.max(F.col("__in").isNull()).over(ahead), F.lit(False))
        base = base.withColumns({"__url": taken, "__free": F.when(~waits, F.lit(True))})
        able = base.filter("not __url and coalesce(__in, true)").select("institution", "title_key", "published_at", pos, "__free")
        folded = greedy(able, pos, window_ms, "__free").select(pos, "kept", F.lit(True).alias("__able"))
        now = base.join(folded, pos, "left").withColumn("__in", F.when(F.col("__able"), F.col("kept")).otherwise(F.lit(False))).drop("kept", "__able", "__url", "__free")
        now = settled(now)
        open_ = now.filter("__in is null")
        if open_.isEmpty():
            done.append(now)
            break
        hashes = open_.select("canonical_hash").distinct().withColumn("__h", F.lit(True))
        titles = open_.filter("title_key != ''").select("institution", "title_key").distinct().withColumn("__t", F.lit(True))
        busy = now.join(hashes, "canonical_hash", "left").join(titles, ["institution", "title_key"], "left").withColumn("__busy", F.coalesce("__h", "__t", F.lit(False)))
        busy = settled(busy.drop("__h", "__t"))
        done.append(busy.filter("not __busy").drop("__busy"))
        base = busy.filter("__busy").drop("__busy")
    whole = reduce(DataFrame.unionByName, done)
    decision = F.when(taken, "duplicate_url").when(~F.col("__in"), "duplicate_title").otherwise("inserted")
    return whole.withColumn("decision", decision)


def stats(decided: DataFrame) -> DataFrame:
    return decided.agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("inserted", "duplicate_url", "duplicate_title")])
