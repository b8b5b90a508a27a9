"""The store's folders: filters, ranges, bitmaps and trigrams give what whole tables give, and read less."""

import random

import pytest
from pyspark.sql import functions as F
from tidemark import folders, model
from tidemark.model import ItemQuery
from tidemark.operators import dedupe, health
from tidemark.plans import bitmaps, panel
from tidemark.store import SCHEMAS, Store
from tidemark.streaming import loop

from .test_engine import DAY, NOW, QUERIES, items  # noqa: F401

SEEN = "source_id string, canonical_hash string"
TITLED = "pos long, institution string, title_key string, published_at long"


def files(df):
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def item(i, at, h=None, est=False):
    return (i, "s", "inst", f"u{i}", h or f"h{i}", f"Title {i}", f"title {i}", None, at, est, at, [], [f"type:{i % 3}"])


def filled(spark, path, **settings):
    """A store of 100 folders, each with five items of one day."""
    store = Store(spark, f"file://{path}/store", **settings)
    one = store._put("items", spark.createDataFrame([item(i, NOW - i * DAY) for i in range(5)], model.ITEMS))
    assert one.rows == 5 and one.stated == (NOW - 4 * DAY, NOW) and one.estimated is None and one.words == 4
    return store


def test_a_batch_reads_the_folders_that_hold_its_hashes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for n in range(12):
        store.change({"seen_urls": spark.createDataFrame([("s", f"h{n}-{i}", 1) for i in range(50)], model.SEEN_URLS).coalesce(1)})
    asked = spark.createDataFrame([("s", "h3-7"), ("s", "h9-0"), ("other", "h5-1"), ("s", "new"), (None, None)], SEEN)
    got = store.holding("seen_urls", asked)
    assert len(files(store.read("seen_urls"))) == 12 and len(files(got)) == 2
    assert dedupe.unseen(asked, got).count() == dedupe.unseen(asked, store.read("seen_urls")).count() == 3
    store.mark_seen(asked.filter("source_id is not null"), 5)
    assert store.read("seen_urls").filter("seen_at = 5").count() == 2
    store.compact(most=3)
    assert len(files(store.holding("seen_urls", spark.createDataFrame([("s", "none")], SEEN)))) == 0 and store.holding("seen_urls", asked).filter("canonical_hash = 'h3-7'").count() == 1


def test_filters_forget_nothing_and_seldom_err(spark):
    rows = spark.range(3000).select(F.concat(F.lit("a"), "id").alias("h"))
    words = folders.words_for(3000)
    made = folders.bloom(rows, ["h"], words).select(F.lit(0).alias("folder"), F.lit(words).cast("long").alias("words"), "word", "bits").cache()
    assert words == 2048 and folders.hit(rows, ["h"], made, [words]).count() == 1
    asked = rows.filter("h < 'a2'").unionByName(spark.range(20).select(F.concat(F.lit("b"), "id").alias("h")))
    assert folders.hit(asked, ["h"], made, [words, 64]).count() == 1
    assert folders.hit(spark.range(2000).select(F.concat(F.lit("b"), "id").alias("h")), ["h"], made, [words]).count() == 0


def test_a_store_counts_its_items_and_finds_another_writer(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([item(i, NOW, f"x{i}") for i in range(3)], model.ITEMS).drop("item_id", "first_seen_at").withColumn("source_pos", F.col("published_at") * 0 + F.substring("canonical_hash", 2, 1).cast("long"))
    assert store.insert(rows, NOW).first().inserted == 3 and store._state()["last_id"] == 3
    assert store.insert(rows, NOW).first().inserted == 0 and store.read("items").count() == 3
    assert store.prune(NOW + 1, NOW)["deleted"] == 3 and store._state()["last_id"] == 3
    began = store._state()
    store.mark_seen(spark.createDataFrame([("s", "h")], SEEN), 1)
    with pytest.raises(RuntimeError):
        store._point({}, began)


def test_folders_that_readers_may_have_stay(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for i in range(4):
        store.mark_seen(spark.createDataFrame([("s", f"h{i}")], SEEN), i)
    old = store.read("seen_urls")
    assert store.compact(most=2, keep=3) == 0 and old.count() == 4 and store.read("seen_urls").count() == 4
    for i in range(3):
        store.mark_seen(spark.createDataFrame([("s", f"g{i}")], SEEN), i)
    assert store.compact(most=9, keep=3) == 4 and store.read("seen_urls").count() == 7


@pytest.fixture(scope="module")
def stored(spark, items, tmp_path_factory):  # noqa: F811
    """The items in eight folders of mixed dates, then clustered; and as they were."""
    root = tmp_path_factory.mktemp("dated")
    store = Store(spark, f"file://{root}/store", indexed=True)
    for n in range(3):
        store.change({"items": items.filter(f"item_id % 3 = {n}").coalesce(1)})
    store.compact(most=2)
    store.change({"items": items.filter("item_id < 0")})
    plain = Store(spark, f"file://{root}/plain")
    plain.change({"items": items})
    return store, plain


@pytest.mark.parametrize("q", QUERIES)
def test_pages_from_folders(stored, items, q):  # noqa: F811
    store, plain = stored
    for limit, cursor in ((7, None), (50, None), (7, f"0.{NOW - 9 * DAY}.60"), (7, f"1.{NOW - 15 * DAY}.3"), (500, None)):
        own = q.but(limit=limit, cursor=cursor)
        want = [r.item_id for r in panel.page_rows(items, own, NOW).collect()]
        assert [r.item_id for r in store.page_rows(own, NOW).collect()] == want == [r.item_id for r in plain.page_rows(own, NOW).collect()]


def test_a_page_reads_the_newest_folders(stored):
    store, _ = stored
    every = len(files(store.read("items")))
    assert every >= 2 and len(store._page_folders(ItemQuery(since="all", limit=3), NOW)) < every
    assert len(store._page_folders(ItemQuery(since="all", limit=3, sort="oldest"), NOW)) < every
    assert store.between(NOW + DAY, NOW + 2 * DAY).count() == 0 and len(files(store.between(NOW - DAY, NOW))) < every


@pytest.mark.parametrize("q", QUERIES)
def test_facets_from_bitmaps(stored, items, q):  # noqa: F811
    for store in stored[:1] if q is not QUERIES[1] else stored:
        tags, institutions, total = store.facets(q, NOW)
        assert sorted(map(tuple, tags.collect())) == sorted(map(tuple, panel.tag_counts(items, q, NOW).collect()))
        assert sorted(map(tuple, institutions.collect())) == sorted(map(tuple, panel.institution_facet(items, q, NOW).collect()))
        assert total.first()[0] == panel.total(items, q, NOW).first()[0]


def test_search_by_trigrams(stored, items):  # noqa: F811
    store, _ = stored
    for needle in ("INFLATION", "10%", "title 1", "e 11", "le", "zzz", "Title 7 10%", "aaa", ""):
        want = {r.item_id for r in items.filter(panel.text_filter(ItemQuery(q=needle))).collect()}
        assert {r.item_id for r in store.search(needle).collect()} == want
    odd = items.limit(3).withColumns({"title": F.lit("ÄÖ ǅ a😀b"), "summary": F.lit(None).cast("string")})
    assert bitmaps.search(odd, bitmaps.trigrams(odd), "a😀B").count() == 3 and bitmaps.search(odd, bitmaps.trigrams(odd), "äÖ ").count() == 0


# Titles.


def near(rows, stored, window):
    return {p for p, i, k, at in rows if k and any((i, k) == (j, l) and abs(at - t) <= window for _, j, l, t in stored)}


def test_band_join_on_buckets(spark):
    rng = random.Random(7)
    make = lambda n, spread: [(i, rng.choice("ab"), rng.choice(["", "k", "l"]), rng.randrange(-spread, spread)) for i in range(n)]
    rows, old = make(300, 400), make(60, 400) + [(900, "a", "k", None), (901, None, "k", 5)]
    df, st = spark.createDataFrame(rows + [(950, "a", "k", None)], TITLED), spark.createDataFrame(old, TITLED)
    want = near(rows, [r for r in old if r[3] is not None], 10)
    assert {r.pos for r in dedupe.title_matches(df, st, 10).collect()} == want
    assert {r.pos for r in dedupe.not_near_stored(df, st, 10).collect()} == {*range(300), 950} - want
    assert "NestedLoop" not in dedupe.title_matches(df, st, 10)._jdf.queryExecution().toString()


def test_a_hot_title_is_folded_in_spans(spark):
    """One title with many rows over years: cut where nothing is near, the same rows kept."""
    rng = random.Random(8)
    rows = [(i, "a", "hot title", rng.randrange(400) * 100 + rng.randrange(30)) for i in range(2000)] + [(5000 + i, "b", "other", i) for i in range(20)]
    df = spark.createDataFrame(rows, TITLED)
    kept = lambda hot: {r.pos for r in dedupe.greedy(df, window_ms=15, hot=hot).collect() if r.kept}
    assert kept(100) == kept(10**9)
    spans = dedupe._spans(df, 15, 100)
    assert spans.select("__span").distinct().count() > 300 and spans.filter("institution = 'b'").isEmpty()


def test_streamed_fold_as_the_batch_fold(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), rng.choice(["", "k", "l"]), rng.randrange(90) * DAY // 2) for i in range(200)]
    for n in range(3):
        spark.createDataFrame(rows[70 * n : 70 * n + 70], TITLED).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    spark.conf.set(*loop.STATE_STORE)
    stream = spark.readStream.schema(TITLED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = loop.greedy_stream(stream).writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.pos, r.kept) for r in spark.sql("SELECT * FROM kept").collect()}
    want = {(r.pos, r.kept) for r in dedupe.greedy(spark.createDataFrame(rows, TITLED)).collect()}
    assert got == want


def test_streamed_dates_leave_the_state(spark, tmp_path):
    """With a watermark: what is far behind is dropped, and dates that none can meet go by their timers."""
    days = [[(0, 0), (1, 1)], [(2, 100)], [(9, 101)], [(3, 2), (4, 103), (5, 95)], [(6, 300)], [(7, 301), (8, 320)]]
    parts = [[(pos, "a", "k", (1000 + d) * DAY) for pos, d in part] for part in days]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, TITLED).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    spark.conf.set(*loop.STATE_STORE)
    stream = spark.readStream.schema(TITLED).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    q = loop.greedy_stream(stream, late="10 days").writeStream.format("memory").queryName("aged").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.pos: r.kept for r in spark.sql("SELECT * FROM aged").collect()}
    assert got == {0: True, 1: False, 2: True, 9: False, 4: False, 5: False, 6: True, 7: False, 8: True}
    left = spark.read.format("statestore").option("path", f"{tmp_path}/ck").option("stateVarName", "dates").load()
    assert {r.user_map_value.at // DAY for r in left.collect()} <= {1300, 1320}


def test_fresh_rows_of_a_stream_know_what_was_stored_meanwhile(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for n in range(2):
        spark.createDataFrame([(f"h{i}", n) for i in range(3 + n)], "canonical_hash string, n int").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    passed = []

    def step(batch, _):
        got = batch.collect()
        passed.append(len(got))
        store.change({"pruned_urls": spark.createDataFrame([(r.canonical_hash, 1) for r in got], model.PRUNED_URLS)})

    stream = spark.readStream.schema("canonical_hash string, n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = loop.fresh_only(stream, store, step).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None and sorted(passed) in ([1, 3], [0, 4])


# Runs over what is due.


def test_schedule_keeps_gaps_and_lanes(spark):
    rng = random.Random(10)
    rows = [(f"s{i}", f"https://h{rng.randrange(7)}.x/{i}", rng.choice([None, i]), rng.choice([0, 1, 3])) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, homepage string, last_fetch_at long, requests int")
    from tidemark.functions import urls

    got = health.schedule(df, urls.host(F.col("homepage")), F.col("requests"), lanes=3).collect()
    assert len(got) == 60 and {r.lane for r in got} == {0, 1, 2}
    for lane in range(3):
        own = sorted((r for r in got if r.lane == lane), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1))
        assert all(b.start_ms - a.start_ms == max(1, a.requests) * 1000 for a, b in zip(own, own[1:])) and own[0].start_ms == 0
    by_host = {}
    for r in got:
        by_host.setdefault(r.host, set()).add(r.lane)
    assert all(len(lanes) == 1 for lanes in by_host.values())
    assert health.schedule(df.limit(0), F.col("homepage")).count() == 0


def test_a_run_reads_what_is_due(spark, tmp_path):
    from .test_ingest import RSS, TAX, body, feed, source

    store = Store(spark, f"file://{tmp_path}/store")
    rows = [source(s, RSS) for s in "abc"]
    df = spark.createDataFrame(rows, model.SOURCES).withColumn("poll_minutes", F.lit(30)).withColumn("last_fetch_at", F.when(F.col("id") == "b", F.lit(NOW - 1000)))
    store.write(sources=df)
    asked = []

    def fetch(due):
        asked.append(sorted(r.id for r in due.collect()))
        return spark.createDataFrame([body(s, feed(i)) for i, s in enumerate("abc")], model.LANDED)

    outcomes, code = loop.due_run(store, TAX, fetch, NOW)
    assert asked == [["a", "c"]] and {r.source_id for r in outcomes.collect()} == {"a", "c"} and code == 0
    assert loop.due_run(store, TAX, fetch, NOW + 1) == (None, 0) and len(asked) == 1
    outcomes, _ = loop.due_run(store, TAX, fetch, NOW + 2, force=True)
    assert asked[-1] == ["a", "b", "c"] and outcomes.count() == 3


def test_tables_without_rows_start_no_python(spark, tmp_path):
    """createDataFrame([]) is read by Python workers, a task for each core; an empty table is no task at all."""
    store = Store(spark, f"file://{tmp_path}/store")
    for name, schema in SCHEMAS.items():
        read = store.read(name)
        assert read.schema == spark.createDataFrame([], schema).schema and read.count() == 0
        assert "ExistingRDD" not in read._jdf.queryExecution().executedPlan().toString()
    assert [store._put(name, store.read(name)).rows for name in SCHEMAS] == [0] * len(SCHEMAS)  # what is written is counted even so


def test_the_plan_of_a_run_is_one_branch_a_kind(spark):
    """Forty sitemaps and listings, each with patterns and selectors of its own, make a plan as large as two."""
    from tidemark.operators import ingest

    from .test_ingest import TAX, body, source

    def plan(n):
        sources = [source(f"m{i}", {"kind": "sitemap", "url": f"u{i}", "include": [f"/{i}/"], "fetch_metadata": False}, take=25) for i in range(n)] + [source(f"l{i}", {"kind": "html", "url": "u", "selectors": {"item": f"li.c{i}", "link": "a@href", "title": "a"}}) for i in range(n)]
        bodies = [body(f"m{i}", f"<urlset><url><loc>https://m{i}.com/{i}/a-long-title</loc></url><url><loc>https://m{i}.com/x/other</loc></url></urlset>", url=f"u{i}") for i in range(n)] + [body(f"l{i}", f'<li class="c{i}"><a href="/p{i}">A card of some length {i}</a></li><li class="other"><a href="/q">No</a></li>', url=f"https://l{i}.com/") for i in range(n)]
        none = dedupe.Tables(spark.createDataFrame([], model.ITEMS), spark.createDataFrame([], model.PRUNED_URLS), spark.createDataFrame([], model.SEEN_URLS))
        sc = spark.sparkContext
        before = len(sc.statusTracker().getJobIdsForGroup(None))
        found = ingest.run(spark.createDataFrame(bodies, model.LANDED), spark.createDataFrame(sources, model.SOURCES), none, TAX, NOW)
        out = {r.source_id: (r.status, r.inserted) for r in found.outcomes.collect()}
        assert out == {f"{k}{i}": ("ok", 1) for k in "ml" for i in range(n)}
        return len(sc.statusTracker().getJobIdsForGroup(None)) - before

    assert plan(40) <= plan(2) + 12


# Addresses.


def test_plain_addresses_need_no_python(spark):
    from tidemark.functions import urls

    hosts = ["www.a.com", "a.b-c.org", "A.com", "1.2.3.4", "a.1", "xn--a.com", "a.xn--p1ai", "a.com:80", "www.www.org", "a..com", "-a.com", "a.com."]
    paths = ["", "/", "/a", "/a/", "/a//b", "/a/b.html", "/.a", "/a/../b", "/a/./b", "/~x/_y-z", "/a%20b", "/é", "/a?b=1", "/a#x", "/a/b/", "/a...b/c", "/ a", "/a ", "//x.com/a", "/a;b"]
    rows = [(f"{scheme}://{h}{p}", base) for scheme in ("http", "https", "HTTP", "ftp") for h in hosts for p in paths for base in ("https://base.com/x/", None)] + [(p, "https://base.com/x/") for p in paths] + [(None, "https://base.com/"), (" https://a.com/b ", None)]
    df = spark.createDataFrame(rows, "url string, base string")
    got = df.select("url", "base", urls.canonical_from(F.col("url"), F.col("base")).alias("c"), urls.absolute_from(F.col("url"), F.col("base")).alias("a"), urls._is_plain(F.col("url")).alias("plain")).collect()
    assert all((r.c, r.a) == (urls.canonical(r.url, r.base), urls.absolute(r.url, r.base)) for r in got), [tuple(r) for r in got if (r.c, r.a) != (urls.canonical(r.url, r.base), urls.absolute(r.url, r.base))][:5]
    assert sum(r.plain for r in got) > 50


# Sitemaps.

MAPS = [
    '<urlset><url><loc> https://a.x/1 </loc><lastmod>2024-01-01</lastmod></url><url><loc>https://a.x/2?a=1&amp;b=2</loc></url></urlset>',
    '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:n="http://n"><url><loc>https://a.x/1</loc><n:news><n:publication_date>2024-02-02</n:publication_date></n:news></url></urlset>',
    '<sitemapindex><sitemap><loc>https://a.x/m1.xml</loc><lastmod>2024-03-03</lastmod></sitemap><sitemap><loc>https://a.x/m2.xml</loc></sitemap></sitemapindex>',
    '<urlset><url><loc>https://a.x/1</loc><image:image xmlns:image="http://i"><image:loc>https://a.x/i.png</image:loc></image:image></url></urlset>',
    '<urlset><url><loc/></url><url><loc>https://a.x/1</loc><loc>https://a.x/2</loc></url></urlset>', '<urlset><!-- <loc>x</loc> --><url><loc><![CDATA[https://a.x/1]]></loc></url></urlset>', '<urlset><url><loc>https://a.x/1</loc>',
    '<wrap><urlset><url><loc>https://a.x/1</loc></url></urlset></wrap>', '<urlset/>', '', None, 'no xml', '  <urlset><url loc="x"><loc>https://a.x/1</loc><lastmod> </lastmod></url></urlset>', '<urlset><url><loc a="b">https://a.x/1</loc><priority>1</priority></url></urlset>',
    '<urlset><url><loc>https://a.x/1</loc><meta><publication_date>2024-05-05</publication_date></meta></url></urlset>', '<urlset><url><a><loc>https://a.x/1</loc></a></url></urlset>', '<urlset><url><loc>https://a.x/<b>1</b></loc></url></urlset>',
]


def test_sitemaps_by_sparks_reader(spark):
    from tidemark.sources import feeds

    df = spark.createDataFrame([(str(i), "u", m, None) for i, m in enumerate(MAPS)], "source_id string, url string, body string, bytes binary")
    got = {}
    for r in feeds.sitemap_entries(df).orderBy("source_pos").collect():
        got.setdefault(int(r.source_id), []).append((r.is_index, r.loc, r.lastmod))
    for i, m in enumerate(MAPS):
        want = feeds.parse_sitemap(m)
        assert got.get(i, []) == [(want["is_index"], e["loc"], e["lastmod"]) for e in want["entries"]], m
    plain = df.select("source_id", feeds._plain_sitemap(F.col("body")).isNotNull().alias("p")).filter("p").collect()
    assert {r.source_id for r in plain} >= {"0", "1", "2"}


def test_jobs_of_a_compaction_do_not_grow_with_its_folders(spark, tmp_path):
    """Filters, bitmaps and trigrams of all buckets of dates are written together, each where its folder's were."""
    def jobs(n):
        store = Store(spark, f"file://{tmp_path}/s{n}", indexed=True)
        rows = [item(i, NOW - i * 31 * DAY, f"x{i}") for i in range(n)]
        store.change({"items": spark.createDataFrame(rows, model.ITEMS)})
        spark.sparkContext.setJobGroup(f"compact-{n}", "")
        store.compact(most=0)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return store, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"compact-{n}"))

    (few, a), (many, b) = jobs(2), jobs(20)
    own = many._folders("items")
    assert len(few._folders("items")) == 2 and len(own) == 20 and b <= a + 4
    assert all(f.indexed and f.words and spark.read.parquet(f"{many.root}/{f.filter_path}").columns == ["word", "bits"] for f in own)
    want = bitmaps.trigrams(many.read("items"))
    key = lambda df: sorted((r.gram, tuple(r.places)) for r in df.collect())
    assert key(want) == key(many.trigrams().groupBy("gram").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places")))
    asked = spark.createDataFrame([("x7",), ("none",)], "canonical_hash string")
    assert len(many._holding("items", asked)) == 1 and many.holding("items", asked).filter("canonical_hash = 'x7'").count() == 1


def test_trigrams_walk_a_long_text_once(spark):
    """A title of a megabyte, as first lines may be; characters outside the basic plane count as one."""
    from time import perf_counter

    rows = spark.createDataFrame([(1, "ab" * 500_000 + "😀😀cd", None), (2, "ab", "xy\nZ")], "item_id long, title string, summary string")
    began = perf_counter()
    assert {(r.gram, tuple(r.places)) for r in bitmaps.trigrams(rows).collect()} == {("aba", (1,)), ("bab", (1,)), ("ab😀", (1,)), ("b😀😀", (1,)), ("😀😀c", (1,)), ("😀cd", (1,)), ("xy\n", (2,)), ("y\nz", (2,))}
    assert perf_counter() - began < 60
