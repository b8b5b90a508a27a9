import random

import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.model import Cursor, ItemQuery
from tidemark.operators import dedupe, discover, health, prune, rations, tagging
from tidemark.operators.normalise import normalise, rejected, usable
from tidemark.operators.tagging import Rule, Taxonomy
from tidemark.plans import panel
from tidemark.store import Store
from tidemark.streaming import loop

DAY = 86_400_000
NOW = 1_790_000_000_000
TAX = Taxonomy((("asset", "Asset", ("credit", "fx")), ("scope", "Scope", ("macro",))), {"Bonds": ("asset:credit",)}, (Rule("scope:macro", any=("inflation",), none=("micro",)), Rule("asset:fx", all=("euro", "dollar"))))


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(3)
    rows = [
        (i, f"s{i % 4}", f"inst{i % 3}", f"u{i}", f"h{i}", f"Title {i} 10%", f"title {i}", None if i % 5 == 0 else "about inflation", NOW - rng.randrange(40) * DAY - i % 2, i % 4 == 0, NOW - rng.randrange(400) * DAY, ["x"],
         [t for t in ("asset:credit", "asset:fx", "scope:macro", "loose") if rng.random() < 0.5])
        for i in range(120)
    ]
    return spark.createDataFrame(rows, model.ITEMS).cache()


def brute(rows, q, skip=None, cursor=False):
    chosen = {}
    for t in q.tags:
        if ":" in t and t.split(":")[0] != skip:
            chosen.setdefault(t.split(":")[0], set()).add(t)
    return [
        r for r in rows
        if (q.since == "all" or r.published_at >= NOW - model.SINCE_MS[q.since]) and (not q.q or q.q.lower() in r.title.lower() or q.q.lower() in (r.summary or "").lower())
        and (skip == "institution" or not q.institutions or r.institution in q.institutions) and all(set(r.tags) & ts for ts in chosen.values())
    ]


QUERIES = [
    ItemQuery(since="all"), ItemQuery(tags=("asset:credit", "asset:fx", "scope:macro"), since="30d"), ItemQuery(tags=("asset:fx",), institutions=("inst1",), since="7d", sort="oldest"), ItemQuery(q="10%", since="all"),
    ItemQuery(q="INFLATION", since="all", tags=("loose", "scope:macro")), ItemQuery(tags=("asset:none",), since="all"),
]


@pytest.mark.parametrize("q", QUERIES)
def test_pages_join_to_the_whole_order(spark, items, q):
    rows = items.collect()
    want = sorted(brute(rows, q), key=lambda r: (r.date_estimated, *((-r.published_at, -r.item_id) if q.sort == "newest" else (r.published_at, r.item_id))))
    got, cursor = [], None
    while True:
        page = panel.answer(items, q.but(limit=37, cursor=cursor), NOW, TAX.facet_values(spark))
        got += [r.item_id for r in page.items]
        cursor = page.next_cursor
        assert page.total == len(want)
        if not cursor:
            break
    assert got == [r.item_id for r in want]


@pytest.mark.parametrize("q", QUERIES)
def test_facets_as_one_query_each(spark, items, q):
    rows = items.collect()
    got = {(r.facet, r.value): r.n for r in panel.tag_facets(items, q, NOW, TAX.facet_values(spark)).collect()}
    assert got == {(f, v): sum(f"{f}:{v}" in r.tags for r in brute(rows, q, f)) for f, _, vs in TAX.facets for v in vs}
    inst = {r.institution: r.n for r in panel.institution_facet(items, q, NOW).collect()}
    own = brute(rows, q, "institution")
    assert inst == {i: n for i in {r.institution for r in own} if (n := sum(r.institution == i for r in own))}


def test_parameters():
    q = ItemQuery.from_params({"tags": ["a:b, c:d", ""], "institution": "x,y", "limit": "900", "since": "1y", "sort": "up", "cursor": ""})
    assert q == ItemQuery(("a:b", "c:d"), ("x", "y"), "", "7d", "newest", None, 200)
    assert [ItemQuery.from_params({"limit": x}).limit for x in ("", "0", "12.9", "many", "-3")] == [1, 1, 12, 50, 1]
    assert Cursor.parse("1.2.3") == Cursor(1, 2, 3) and Cursor.parse("a.b") is None and Cursor.parse(None) is None


def test_a_bad_cursor_is_no_cursor(items):
    q = ItemQuery(since="all", limit=3)
    assert panel.page_rows(items, q.but(cursor="oops"), NOW).collect() == panel.page_rows(items, q, NOW).collect()


# Tags.


def test_tags(spark):
    rows = spark.createDataFrame([("Inflation up", None, [" BONDS "], ["asset:fx", "no:tag"]), ("micro inflation", "euro and dollar", [], None), ("euro", "only", None, [])], "t string, s string, c array<string>, st array<string>")
    got = [r[0] for r in rows.select(tagging.all_tags(TAX, F.col("t"), F.col("s"), F.col("c"), F.col("st"))).collect()]
    assert got == [["asset:credit", "asset:fx", "scope:macro"], ["asset:fx"], []]
    only_none = tagging.rule_matches(Rule("x", none=("bad",)), F.col("t"))
    assert [r[0] for r in rows.select(only_none).collect()] == [True] * 3


# Dedupe.


def fold(rows, window=dedupe.WINDOW_MS, known=(), stored=()):
    hashes, kept, out = set(known), list(stored), {}
    for pos, inst, key, at, h in rows:
        if h in hashes:
            out[pos] = "duplicate_url"
        elif key and any((i, k) == (inst, key) and abs(a - at) <= window for i, k, a in kept):
            out[pos] = "duplicate_title"
        else:
            out[pos] = "inserted"
            hashes.add(h)
            kept.append((inst, key, at))
    return out


def test_a_rejected_row_does_not_extend_the_window(spark):
    rows = spark.createDataFrame([(i, "a", "some title", d * DAY) for i, d in enumerate((0, 5, 10, 12))], "pos long, institution string, title_key string, published_at long")
    assert {r.pos for r in dedupe.greedy(rows).collect() if r.kept} == {0, 2}


@pytest.mark.parametrize("seed", range(4))
def test_decisions_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"i{rng.randrange(2)}", rng.choice(["", "key one", "key two"]), rng.randrange(60) * DAY, f"h{rng.randrange(40)}") for i in range(80)]
    stored = [(f"i{rng.randrange(2)}", "key one", rng.randrange(60) * DAY, f"h{100 + j}", j) for j in range(2)]
    df = spark.createDataFrame(rows, "pos long, institution string, title_key string, published_at long, canonical_hash string")
    old = spark.createDataFrame(stored, "institution string, title_key string, published_at long, canonical_hash string, item_id long")
    pruned = spark.createDataFrame([("h3", 1)], model.PRUNED_URLS)
    got = {r.pos: r.decision for r in dedupe.decide(df, old, pruned).collect()}
    assert got == fold(rows, known={"h3"}, stored=[s[:3] for s in stored])


def test_decisions_on_a_hash_with_many_copies(spark):
    """One title turns away 30 copies of h1 and so leaves h1 free for the last row; then random rows with hot hashes."""
    rows = [(0, "a", "some title", 0, "h0"), *((i, "a", "some title", DAY, "h1") for i in range(1, 31)), (31, "a", "some title", 9 * DAY, "h1")]
    rng = random.Random(9)
    rows += [(100 + i, f"i{rng.randrange(2)}", rng.choice(["", "key one", "key two"]), rng.randrange(30) * DAY, f"g{rng.randrange(6)}") for i in range(200)]
    df = spark.createDataFrame(rows, "pos long, institution string, title_key string, published_at long, canonical_hash string")
    none = spark.createDataFrame([], "institution string, title_key string, published_at long, canonical_hash string, item_id long")
    got = {r.pos: r.decision for r in dedupe.decide(df, none, spark.createDataFrame([], model.PRUNED_URLS)).collect()}
    assert got[31] == "inserted" and got == fold(rows)


def test_numbers_have_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = rations.numbered(rows, 10, "k").collect()
    assert [r.item_id for r in sorted(got, key=lambda r: r.k)] == list(range(11, 1011))


def test_rations(spark):
    rows = spark.createDataFrame([("a", i, i % 2 == 0, 100 + i) for i in range(6)] + [("b", 0, True, 1)], "source_id string, source_pos long, date_estimated boolean, published_at long")
    taken = rations.newest_per_source(rows, F.lit(3)).filter("taken").collect()
    assert {(r.source_id, r.source_pos) for r in taken} == {("a", 5), ("a", 3), ("a", 1), ("b", 0)}
    assert {r.held for r in taken if r.source_id == "a"} == {3}


# Store, loop, health.


def raw(spark, rows):
    return spark.createDataFrame([("s", i, u, t, None, d, "string", False, []) for i, (u, t, d) in enumerate(rows)], model.RAW_ITEMS)


def configured(spark, store):
    config = spark.createDataFrame(
        [("s", "Bank", "Bank news", "https://bank.com", "rss", "{}", ["scope:macro"], 30, 5, True)],
        "id string, institution string, name string, homepage string, adapter_kind string, config_json string, static_tags array<string>, poll_minutes int, take_per_run int, enabled boolean",
    )
    store.sync(config)


def test_backlog_drains_and_tombstones_hold(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    configured(spark, store)
    feed = raw(spark, [(f"/news/{i}?utm_source=x", f"Article number {i} of many", f"2026-08-{i + 1:02d}") for i in range(6)])
    runs = [loop.ingest_batch(store, TAX, feed, NOW, take=2)["inserted"] for _ in range(4)]
    assert runs == [2, 2, 2, 0]
    got = store.read("items").collect()
    assert sorted(r.item_id for r in got) == list(range(1, 7)) and all(r.tags == ["scope:macro"] for r in got)
    assert {r.item_id: r.title for r in got}[1] == "Article number 5 of many"
    assert store.prune(NOW + 1, NOW)["deleted"] == 6 and store.read("items").count() == 0
    assert loop.ingest_batch(store, TAX, feed, NOW, take=5)["inserted"] == 0
    assert store.compact() > 0 and store.read("pruned_urls").count() == 6
    assert Store(spark, store.root).read("sources").first().id == "s"


def test_unusable_rows_have_reasons(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    configured(spark, store)
    rows = normalise(raw(spark, [("mailto:x", "A title of some length", None), ("/ok", "  ", None), ("/fine", "Fine title | Bank", "soon")]), store.read("sources"), TAX, NOW)
    assert {r.reason for r in rejected(rows).collect()} == {"unusable url", "empty title"}
    r = usable(rows).first()
    assert (r.title, r.date_estimated, r.published_at, r.url) == ("Fine title", True, NOW, "https://bank.com/fine")


def test_stream_ends_when_all_is_taken(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    configured(spark, store)
    raw(spark, [(f"/n/{i}", f"Streamed article number {i}", "2026-08-01") for i in range(3)]).write.parquet(f"{tmp_path}/land/a")
    q = loop.run(spark, store, TAX, f"file://{tmp_path}/land/*", f"file://{tmp_path}/ck", lambda: NOW, 5, None)
    q.awaitTermination(120)
    assert store.read("items").count() == 3


def test_streamed_fold(spark, tmp_path):
    rows = [(i, "a", "some title", d * DAY) for i, d in enumerate((0, 5, 10, 12))] + [(9, "a", "", 0), (10, "a", "", 0)]
    schema = "pos long, institution string, title_key string, published_at long"
    for n, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    spark.conf.set(*loop.STATE_STORE)
    q = loop.greedy_stream(stream).writeStream.format("memory").queryName("folded").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {r.pos for r in spark.sql("SELECT * FROM folded WHERE kept").collect()} >= {9, 10} and spark.sql("SELECT * FROM folded").count() == 6


def test_streamed_windows(spark, tmp_path):
    q = loop.windowed_counts(spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events*.parquet")).writeStream
    q = q.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_health(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    configured(spark, store)
    for status, failures in (("empty", 1), ("error", 2), ("not-modified", 0)):
        store.record(spark.createDataFrame([("s", status, None, 0, "tag" if status == "error" else None, None, NOW)], model.FETCHES))
        s = store.read("sources").first()
        assert (s.consecutive_failures, s.last_status) == (failures, status)
    assert s.etag == "tag"
    due = lambda ms, f: health.due_sources(store.read("sources").withColumn("consecutive_failures", F.lit(f)), F.lit(ms).cast("long")).count()
    assert [due(NOW + m * 60000, f) for m, f in ((29, 0), (30, 0), (59, 1), (60, 1), (479, 9), (480, 9))] == [0, 1, 0, 1, 0, 1]


def test_adapter_chains(spark):
    rows = [("a", 0, True, False, 0, False), ("a", 1, False, False, 0, False), ("b", 0, False, False, 0, False), ("b", 1, False, False, 3, False), ("c", 0, False, True, 0, False), ("d", 0, False, False, 0, True), ("e", 0, False, False, 0, False), ("e", 1, True, False, 0, False)]
    got = health.outcome_status(spark.createDataFrame(rows, "source_id string, attempt int, failed boolean, not_modified boolean, n_items int, healthy_empty boolean"))
    assert {r.source_id: r.status for r in got.collect()} == {"a": "empty", "b": "ok", "c": "not-modified", "d": "ok", "e": "error"}


def test_cutoffs():
    assert prune.cutoff("365d", NOW) == NOW - 365 * DAY and prune.cutoff("7d", NOW, force=True) == NOW - 7 * DAY
    for bad in ("7d", "soon", "0d"):
        with pytest.raises(ValueError):
            prune.cutoff(bad, NOW)


# Discovery.


def test_records_are_found(spark):
    body = '{"page": 1, "data": {"hits": [%s]}}' % ", ".join(f'{{"raw": {{"link": "/a/{i}", "headline": "A headline of some words {i}", "posted": "2024-05-0{i + 1}", "tags": ["x"], "teaser": "{"long words " * 8}"}}}}' for i in range(3))
    r = discover.candidates(spark.createDataFrame([("https://x/api", 200, body), ("https://x/no", 500, body), ("https://x/t", 200, "no json")], "url string, status int, body string"), F.lit(NOW)).collect()
    assert len(r) == 1 and (r[0].path, r[0].best_url, r[0].best_title, r[0].best_published_at, r[0].best_summary, r[0].best_categories) == ("data.hits", "raw.link", "raw.headline", "raw.posted", "raw.teaser", "raw.tags")
    assert discover.suggestion("https://x/insights", r, [], [], [])["items_path"] == "data.hits"
    assert discover.suggestion("https://x/insights/", [], [], [{"url": "s", "matching": 2}], [])["include"] == ["/insights/"]
    assert discover.suggestion("https://x/", [], [], [], []) is None and discover.config_text("https://x/", None) is None


def test_headers_are_redacted(spark):
    h = spark.createDataFrame([({"Accept": "a", "Authorization": "Bearer 1", "X-Odd": "2"},)], "h map<string,string>").select(discover.redacted(F.col("h"))).first()[0]
    assert h == {"accept": "a", "authorization": "Bearer {{token}}"}




def test_shared_folder_is_never_a_local_one_on_a_cluster():
    from types import SimpleNamespace

    from tidemark.lineage import shared_dir

    conf = {}
    spark = SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(spark)
    conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert shared_dir(spark) == "hdfs:///shared"
    conf.clear()
    spark.sparkContext.master = "local[2]"
    assert shared_dir(spark).startswith("file://") and shared_dir(spark) == conf["spark.checkpoint.dir"]
