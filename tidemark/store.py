"""Tables as lists of Parquet folders: a write is a new folder and one small pointer file, so readers see all of it or none."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark import folders, model
from tidemark.folders import Folder
from tidemark.lineage import settled
from tidemark.operators import dedupe, health, ingest, prune, rations
from tidemark.plans import bitmaps, panel

SCHEMAS = {"items": model.ITEMS, "sources": model.SOURCES, "seen_urls": model.SEEN_URLS, "pruned_urls": model.PRUNED_URLS, "fetches": model.FETCHES}
#: 3: a table is a list of folders; it was one folder in version 2, which is still read and replaced by the next write.
VERSION = 3
#: What a table is looked up by: its folders have Bloom filters of these columns.
KEYS = {"items": ["canonical_hash"], "pruned_urls": ["canonical_hash"], "seen_urls": ["source_id", "canonical_hash"]}
#: A folder of items that are compacted has the dates of so long.
BUCKET_MS = 30 * model.DAY_MS
#: Rows of a file of a compacted folder.
FILE_ROWS = 2_000_000


def _ranges(got: dict) -> tuple:
    """The ranges of a folder's stated and estimated dates; None where some item has no date."""
    return tuple(None if got["undated"] or got[f"min_{k}"] is None else (got[f"min_{k}"], got[f"max_{k}"]) for k in ("stated", "estimated"))


class Store:
    """One writer; any number of readers, each of whom keeps the snapshot that it opened.

    The pointer file names the folders of each table and what is known of them: how many rows, the size of the
    Bloom filter beside each, the range of an item's dates; and the last item's number. So a batch, and a page of
    the panel, read the folders that can matter to them. A second writer that moves the pointer meanwhile is found
    out, and the change that began before it fails.
    """

    def __init__(self, spark: SparkSession, root: str, indexed: bool = False):
        """indexed: folders of items that are written get bitmaps for facets and trigrams for searches."""
        self.spark, self.root, self.indexed = spark, root.rstrip("/"), indexed
        state = self._state()
        if state.get("version", VERSION) > VERSION:
            raise ValueError(f"{self.root} was written by a newer version ({state['version']})")

    # Through Hadoop's file systems, so that the root may be anywhere that Spark reads.

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def _state(self) -> dict:
        p, fs, jvm = self._fs(f"{self.root}/_state.json")
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, tables: dict[str, list[Folder]], began: dict, last_id: int | None = None) -> None:
        """One rename makes all of the tables current together. began: the pointer that the change began with."""
        if self._state().get("change", 0) != began.get("change", 0):
            raise RuntimeError(f"{self.root} was changed by another writer; begin again")
        change = began.get("change", 0) + 1
        paths = {name: began.get("tables", {}).get(name, []) for name in SCHEMAS}
        paths = {name: [p] if isinstance(p, str) else p for name, p in paths.items()} | {name: [f.path for f in own] for name, own in tables.items()}
        current = {p for own in paths.values() for p in own}
        known = {p: k for p, k in began.get("folders", {}).items() if p in current} | {f.path: f.as_json() for own in tables.values() for f in own}
        before = {p for f in began.get("tables", {}).values() for p in ([f] if isinstance(f, str) else f)}
        left = began.get("left", {}) | {p: change for p in before - current}
        state = {"version": VERSION, "change": change, "tables": {n: p for n, p in paths.items() if p}, "folders": known, "left": left, "last_id": began.get("last_id") if last_id is None else last_id}
        new, fs, jvm = self._fs(f"{self.root}/_state.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_state.json")
        ctx = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        ctx.rename(new, target, options)

    def _folders(self, name: str, state: dict | None = None) -> list[Folder]:
        state = self._state() if state is None else state
        at = state.get("tables", {}).get(name, [])
        return [Folder.of(p, state.get("folders", {}).get(p)) for p in ([at] if isinstance(at, str) else at)]  # version 2 had one folder a table

    # Reading.

    def _read(self, name: str, own: list[Folder]) -> DataFrame:
        if not own:
            return model.empty(self.spark, SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{f.path}" for f in own])

    def read(self, name: str) -> DataFrame:
        return self._read(name, self._folders(name))

    def holding(self, name: str, rows: DataFrame) -> DataFrame:
        """The table's folders that may hold what rows are looked up by (KEYS): all that do, and few others.

        A job over the filters, not over the table; the driver gets the numbers of the folders that are hit.
        """
        return self._read(name, self._holding(name, rows))

    def _holding(self, name: str, rows: DataFrame) -> list[Folder]:
        own = [f for f in self._folders(name) if f.rows != 0]
        told = [(i, f) for i, f in enumerate(own) if f.words]
        if not told:
            return own
        sizes = {f.words for _, f in told}
        number = F.element_at(F.create_map(*[F.lit(x) for i, f in told for x in (f.filter_path.partition("/")[2], i)]), F.regexp_extract(F.col("_metadata.file_path"), "([0-9a-f]{32}(?:/b=-?[0-9]+)?[.]filter)/[^/]*$", 1))
        words = F.element_at(F.create_map(*[F.lit(x) for i, f in told for x in (i, f.words)]), F.col("folder")).cast("long")
        filters = self.spark.read.schema("word long, bits long").parquet(*[f"{self.root}/{f.filter_path}" for _, f in told])
        filters = filters.select("word", "bits", number.alias("folder")).withColumn("words", words)
        found = {r.folder for r in folders.hit(rows, KEYS[name], filters, sizes).collect()}
        return [f for i, f in enumerate(own) if not f.words or i in found]

    def between(self, low: int, high: int) -> DataFrame:
        """Items of the folders that may have dates from low to high."""
        return self._read("items", [f for f in self._folders("items") if f.rows != 0 and f.meets(low, high)])

    def known(self, rows: DataFrame) -> DataFrame:
        """Hashes that rows may have and that are stored or pruned."""
        return dedupe.known_hashes(self.holding("items", rows), self.holding("pruned_urls", rows))

    def near(self, rows: DataFrame, window_ms: int = dedupe.WINDOW_MS) -> DataFrame:
        """Items that may lie within the window of one of rows."""
        low, high = rows.agg(F.min("published_at"), F.max("published_at")).first()
        return self._read("items", []) if low is None else self.between(low - window_ms, high + window_ms)

    def page_rows(self, query: model.ItemQuery, now_ms: int) -> DataFrame:
        """The page of the query, as panel.page_rows() over all items, read from the first folders in its order that fill it."""
        return panel.page_rows(self._read("items", self._page_folders(query, now_ms)), query, now_ms)

    def _page_folders(self, query: model.ItemQuery, now_ms: int) -> list[Folder]:
        """Folders in the order of the page's keys, until what is left can't be on it.

        A row's key is (estimated, date, number), so a folder stands twice in the order: by its stated dates, and
        by its estimated ones after all stated dates. Folders are added, twice as many each time, until the page is
        full and ends before the first key that the others may have.
        """
        newest, since = query.sort == "newest", None if query.since == "all" else now_ms - model.SINCE_MS[query.since]
        cursor = model.Cursor.parse(query.cursor)
        own = [f for f in self._folders("items") if f.rows != 0]
        sure, places = [f for f in own if not f.dated], []
        for f in own:
            for est, r in enumerate((f.stated, f.estimated) if f.dated else ()):
                if r is None or since is not None and r[1] < since:
                    continue
                if cursor and (est < cursor.estimated or est == cursor.estimated and (r[0] > cursor.at if newest else r[1] < cursor.at)):
                    continue  # all of it comes before the cursor
                places.append(((est, -r[1] if newest else r[0]), f))
        places.sort(key=lambda p: (p[0], p[1].path))
        taken = 1
        while taken < len(places):
            some = list({f.path: f for f in [*sure, *(f for _, f in places[:taken])]}.values())
            last = panel.page_rows(self._read("items", some).select(*panel.NEEDED), query, now_ms).select("date_estimated", "published_at").collect()
            if len(last) == query.limit:
                est, at = int(last[-1][0]), last[-1][1]
                if (est, -at if newest else at) < places[taken][0]:
                    return some
            taken *= 2
        return list({f.path: f for f in [*sure, *(f for _, f in places)]}.values())

    def _kept(self, kind: str, schema: str, made) -> DataFrame:
        """What lies beside the folders of items, and what it would be for folders without it."""
        own = [f for f in self._folders("items") if f.rows != 0]
        have, lack = [f for f in own if f.indexed], [f for f in own if not f.indexed]
        out = self.spark.read.schema(schema).parquet(*[f"{self.root}/{f.path}.{kind}" for f in have]) if have else model.empty(self.spark, schema)
        return out.unionByName(made(self._read("items", lack))) if lack else out

    def bitmaps(self) -> DataFrame:
        return bitmaps.merged(self._kept("bitmaps", bitmaps.BITMAPS, bitmaps.bitmaps))

    def trigrams(self) -> DataFrame:
        return self._kept("trigrams", bitmaps.POSTINGS, bitmaps.trigrams)

    def search(self, needle: str) -> DataFrame:
        """Items with the needle in title or summary."""
        return bitmaps.search(self.read("items"), self.trigrams(), needle)

    def facets(self, query: model.ItemQuery, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Counts by tag and by institution, and the total, as the panel counts them over all items, from bitmaps and trigrams."""
        found, grams = self.bitmaps(), self.trigrams() if query.q else None
        cut = None if query.since == "all" else now_ms - model.SINCE_MS[query.since]
        items = self.read("items") if cut is None or query.q else self.between(cut, cut + model.DAY_MS)
        return tuple(f(found, items, query, now_ms, grams) for f in (bitmaps.tag_counts, bitmaps.institution_facet, bitmaps.total))

    # Writing.

    def _put(self, name: str, df: DataFrame) -> Folder:
        """A new folder: its rows counted and ranged as they are written, its filter made from what was written."""
        path = f"{name}/{uuid.uuid4().hex}"
        seen, est = Observation(), F.col("date_estimated")
        stats = [F.count(F.lit(1)).alias("rows")]
        if name == "items":
            at = F.col("published_at")
            stats += [f(F.when(cond, at)).alias(f"{f.__name__}_{kind}") for kind, cond in (("stated", ~est), ("estimated", est)) for f in (F.min, F.max)] + [F.count_if(est.isNull() | at.isNull()).alias("undated")]
        df.observe(seen, *stats).write.parquet(f"{self.root}/{path}")
        return self._told(name, path, seen.get)

    def _told(self, name: str, path: str, got: dict) -> Folder:
        words = None
        if name in KEYS and got["rows"]:
            words = folders.words_for(got["rows"])
            keys = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{path}").select(*KEYS[name])
            folders.bloom(keys, KEYS[name], words).write.parquet(f"{self.root}/{path}.filter")
        if name == "items" and self.indexed:
            own = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{path}")
            bitmaps.bitmaps(own).repartition("kind").sortWithinPartitions("kind", "value", "block").write.parquet(f"{self.root}/{path}.bitmaps")
            bitmaps.trigrams(own).repartitionByRange("gram").sortWithinPartitions("gram", "block").write.parquet(f"{self.root}/{path}.trigrams")
        return Folder(path, got["rows"], words, *(_ranges(got) if name == "items" else (None, None)), self.indexed and name == "items")

    def change(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, last_id: int | None = None) -> None:
        """Adds a folder to some tables and replaces others, all or none: what a batch writes is its own size, not the table's."""
        began = self._state()
        own = {name: [*self._folders(name, began), self._put(name, df)] for name, df in (append or {}).items()}
        own |= {name: [self._put(name, df)] for name, df in (replace or {}).items()}
        if last_id is None and "items" in (replace or {}):
            last_id = self._last_id(began)
        self._point(own, began, last_id)

    def write(self, **tables: DataFrame) -> None:
        """Replaces the tables, all or none."""
        self.change(replace=tables)

    def _last_id(self, state: dict) -> int:
        """The largest number that an item has been given; the items are read where the pointer doesn't know."""
        if state.get("last_id") is not None:
            return state["last_id"]
        return self._read("items", self._folders("items", state)).agg(F.coalesce(F.max("item_id"), F.lit(0))).first()[0]

    def _clustered(self) -> list[Folder]:
        """The items anew, a folder for the dates of each BUCKET_MS, sorted within; of each what the pointer should say."""
        items, root = self.read("items"), f"items/{uuid.uuid4().hex}"
        bucket, at, est = F.floor(F.coalesce("published_at", F.lit(0)) / BUCKET_MS).cast("long"), F.col("published_at"), F.col("date_estimated")
        sizes = items.groupBy(bucket.alias("b")).agg(F.ceil(F.count("*") / FILE_ROWS).alias("files"))
        dealt = items.withColumn("b", bucket).join(sizes, "b").withColumn("file", F.pmod(F.xxhash64("item_id"), F.col("files")))
        dealt.repartition("b", "file").sortWithinPartitions("b", "date_estimated", "published_at", "item_id").drop("file", "files").write.partitionBy("b").parquet(f"{self.root}/{root}")
        stats = [F.min(F.when(c, at)).alias(f"min_{k}") for k, c in (("stated", ~est), ("estimated", est))] + [F.max(F.when(c, at)).alias(f"max_{k}") for k, c in (("stated", ~est), ("estimated", est))]
        own = self.spark.read.schema(SCHEMAS["items"] + ", b long").parquet(f"{self.root}/{root}")
        told = own.groupBy("b").agg(F.count("*").alias("rows"), F.count_if(est.isNull() | at.isNull()).alias("undated"), *stats).orderBy("b").collect()
        # What lies beside all folders is made and written at once, as there are as many folders as buckets.
        known = self.spark.createDataFrame([(r.b, folders.words_for(r.rows), -(-r.rows // FILE_ROWS)) for r in told], "b long, words long, files long")
        with_known = lambda df: df.join(F.broadcast(known), "b")

        def beside(kind: str, df: DataFrame, *order: str) -> None:
            named = df.withColumn("b", F.concat(F.col("b").cast("string"), F.lit(f".{kind}")))
            named.sortWithinPartitions("b", *order).write.mode("append").partitionBy("b").parquet(f"{self.root}/{root}")

        beside("filter", folders.bloom(with_known(own), KEYS["items"], F.col("words"), "b", "files").repartition("b", F.pmod("word", "files")).drop("files"))
        if self.indexed:
            beside("bitmaps", with_known(bitmaps.bitmaps(own, "b")).repartition("b", F.when(F.col("files") > 1, F.col("kind"))).drop("words", "files"), "kind", "value", "block")
            beside("trigrams", bitmaps.trigrams(own, "b").repartitionByRange("b", "gram"), "gram", "block")
        return [Folder(f"{root}/b={r.b}", r.rows, folders.words_for(r.rows), *_ranges(r.asDict()), self.indexed) for r in told]

    def compact(self, most: int = 32, keep: int = 0) -> int:
        """Rewrites tables of more than most folders, items clustered by date, with filters and ranges of the new folders; then removes folders that no table has.

        keep: how many changes ago a folder must have left the pointer before it is removed, so that readers of the
        snapshots since then still find it; 0, for when nobody reads, removes also what a writer that broke off left
        behind. Returns the number of folders removed.
        """
        began = self._state()
        many = [name for name in SCHEMAS if len(self._folders(name, began)) > most]
        if many:
            self._point({name: self._clustered() if name == "items" else [self._put(name, self.read(name))] for name in many}, began, self._last_id(began) if "items" in many else None)
        state = self._state()
        current = {f.path.partition("/")[2].partition("/")[0] for name in SCHEMAS for f in self._folders(name, state)}
        left, gone = {}, set()
        for p, n in state.get("left", {}).items():
            root = p.partition("/")[2].partition("/")[0]
            left[root] = max(n, left.get(root, 0))
        for name in SCHEMAS:
            p, fs, _ = self._fs(f"{self.root}/{name}")
            for s in fs.listStatus(p) if fs.exists(p) else ():
                folder = s.getPath().getName().partition(".")[0]
                if folder not in current and (not keep or left.get(folder, state["change"]) <= state["change"] - keep) and fs.delete(s.getPath(), True):
                    gone.add(folder)
        if gone:
            self._point({}, state | {"left": {p: n for p, n in state.get("left", {}).items() if p.partition("/")[2].partition("/")[0] not in gone}})
        return len(gone)

    # Changes.

    def sync(self, config: DataFrame) -> None:
        self.write(sources=health.sync_sources(self.read("sources"), config))

    def insert(self, rows: DataFrame, now_ms: int, take: int | None = None) -> DataFrame:
        """Rations each source, stores what is new, and returns the decisions (one row) of what was offered.

        rows: an item's columns without item_id and first_seen_at, with source_pos.
        """
        rows = settled(rows)
        fresh = settled(rows.join(self.known(rows), "canonical_hash", "left_anti"))
        if take is not None:
            ranked = rations.newest_per_source(fresh, F.lit(take)).filter("taken").withColumn("pos", F.struct("source_id", F.when(F.col("fresh") > take, F.col("rank")).otherwise(F.col("source_pos")).alias("at")))
        else:
            ranked = fresh.withColumn("pos", F.struct("source_id", F.col("source_pos").alias("at")))
        ranked = ranked.withColumn("pos", F.concat_ws("", "pos.source_id", F.lit("\u0001"), F.lpad(F.col("pos.at").cast("string"), 20, "0")))
        decided = dedupe.decide_fresh(ranked.select(*rows.columns, "pos"), self.near(fresh))
        self._add(decided.filter("decision = 'inserted'"), now_ms)
        return dedupe.stats(decided)

    def _add(self, new: DataFrame, now_ms: int, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> None:
        """Stores new rows (with pos) as items with the next numbers, and other changes with them."""
        last = self._last_id(self._state())
        new = rations.numbered(new, last, "pos").withColumn("first_seen_at", F.lit(now_ms).cast("long")).withColumn("tags", F.array_sort(F.array_distinct("tags")))
        names, count = [f.split()[0] for f in SCHEMAS["items"].split(", ")], new.count()
        more = {name: df for name, df in (append or {}).items() if not df.isEmpty()}
        self.change(({"items": new.select(*names)} if count else {}) | more, replace, last_id=last + count)

    def ingest(self, landed: DataFrame, taxonomy, now_ms: int) -> DataFrame:
        """One run over landed bodies: stores what is new, marks what was visited, records how sources fared; returns the outcomes.

        Items, visits and the registry change together.
        """
        found = ingest.run(landed, self.read("sources"), self, taxonomy, now_ms)
        self._add(found.items, now_ms, {"seen_urls": self._visited(found.visited, now_ms)}, {"sources": health.record_fetches(self.read("sources"), found.fetches)})
        return found.outcomes

    def _visited(self, rows: DataFrame, now_ms: int) -> DataFrame:
        return dedupe.seen_after(self.holding("seen_urls", rows), rows, now_ms)

    def mark_seen(self, rows: DataFrame, now_ms: int) -> None:
        self.change(append={"seen_urls": self._visited(rows, now_ms)})

    def record(self, fetches: DataFrame) -> None:
        self.write(sources=health.record_fetches(self.read("sources"), fetches))

    def prune(self, cutoff_ms: int, now_ms: int) -> dict[str, int]:
        """Removes old items and remembers their hashes, both at once."""
        items = self.read("items")
        before = items.agg(F.count_if(prune.older(cutoff_ms)).alias("deleted"), F.coalesce(F.sum(F.when(prune.older(cutoff_ms), F.size(F.array_distinct("tags")))), F.lit(0)).alias("tags")).first()
        self.write(items=prune.kept(items, cutoff_ms), pruned_urls=prune.tombstones(items, self.read("pruned_urls"), cutoff_ms, now_ms))
        return before.asDict()

    def retag(self, taxonomy) -> None:
        from tidemark.operators.tagging import retag

        self.write(items=retag(self.read("items"), self.read("sources"), taxonomy))
