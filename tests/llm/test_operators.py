"""Each operator against brute force, an exact round trip or held-out accuracy; and odd inputs."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import audio, common, components, exact_dedup, hmm_lm, language_id, mixing, near_dedup, packing, queries, sharding, token_counts, url_filter

from ..conftest import DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, word long, h long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with names that operators use inside."""
    long = "Ab cd\tef " * 4000
    rows = [
        (1, "Same text here for all of us", "en", "a", 1, "x", 1, 1), (2, "Same  text here\nfor all of us", "en", "a", 1, "x", 1, 1), (3, "Sametexthereforallofus", "fr", None, 1, None, None, None), (3, "Sametexthereforallofus", "fr", None, 1, None, None, None),
        (None, "Same text here for all of us", None, "b", None, "y", 2, 2), (5, None, "en", "b", 0, "z", 3, 3), (6, "", None, "c", 0, "z", 3, 3), (7, " \t\n", "fr", "c", 3, "z", 3, 3), (8, long, "en", "a", 9, "q", 4, 4), (9, long + "x", "en", "a", 9, "q", 4, 4),
        (10, "123 !!! 😀", "en", "d", 1, "q", 4, 4), (11, "one two three", "fr", "d", 1, "q", 4, 4), (12, "ONE two three four five six seven", "fr", "d", 1, "q", 4, 4), (None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_as_sql(spark, same_as_sql, name):
    same_as_sql(queries.queries()[name](spark, DATA), queries.SQL[name])


def test_empty_tables(spark, none):
    assert exact_dedup.decide(none).count() == 0 and exact_dedup.keep_one(none).columns == none.columns
    assert near_dedup.near_dedup(none).count() == 0 and near_dedup.keep_one(none).count() == 0
    assert sharding.shard(none).count() == 0 and packing.pack(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0
    assert language_id.identify(none, language_id.fit(none)).count() == 0
    assert hmm_lm.score(none.withColumn("out", F.lit(False)), "out").count() == 0
    assert token_counts.count(none).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert audio.align(audio.tunes(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding"), "vec_id").count() == 0


# 1


def test_exact_dedup(odd):
    got = exact_dedup.decide(odd).collect()
    assert len(got) == 14
    same = [r for r in got if r.group_size == 5]
    assert len(same) == 5 and {r.keep_id for r in same} == {2} and [r.doc_id for r in same if r.kept] == [2]
    blank = [r for r in got if r.text_sha256.startswith("e3b0c442")]
    assert len(blank) == 4 and {r.keep_id for r in blank} == {7} and sum(r.kept for r in blank) == 1
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in got if r.kept), key=str)


def test_ties_keep_the_smallest(spark):
    df = spark.createDataFrame([(4, "ab"), (2, "ab"), (2, "ab"), (9, "a b")], "doc_id long, text string")
    assert [r.doc_id for r in exact_dedup.decide(df).collect() if r.kept] == [9]
    assert [r.doc_id for r in exact_dedup.decide(df.filter("doc_id < 9")).collect() if r.kept] == [2]


def test_no_python_on_the_native_path(odd):
    plan = exact_dedup.decide(odd)._jdf.queryExecution().toString() + exact_dedup.keep_one(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 2


def test_language_held_out(spark):
    got = queries.op2_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_language_of_odd_texts(odd):
    model = language_id.fit(odd)
    got = [(r.text, r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()]
    assert all((p == "und") == (not any(c.isalpha() for c in t or "")) for t, p, _ in got) and {p for _, p, _ in got} <= {"en", "fr", "und"}


def test_bitmask_filter_has_no_false_negative():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    lang = rng.integers(0, 70, 3000)
    m = language_id.build([f"l{i}" for i in range(70)], lang, grams, np.full(3000, 1 / 3000))
    slots = language_id._slots(grams, m.bits)
    for i in range(3000):
        assert all(int(m.tables[lang[i] // 64][s[i]]) >> int(lang[i] % 64) & 1 for s in slots)


# 3


def test_edits_keep_the_count(spark, docs):
    import base64

    import tiktoken

    by = token_counts.counter(token_counts.ranks_path())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.ranks_path(), "rb"))}
    whole = tiktoken.Encoding("t", pat_str=by.pattern, mergeable_ranks=ranks, special_tokens={})
    rng, anew, size = random.Random(2), 0, 0
    signs = " \n'slrex1é.　"
    texts = [r.text for r in docs.limit(20).collect()] + ["", "  ", "don't I'll   've"] + ["".join(rng.choice(signs) for _ in range(600)) for _ in range(20)]
    for t in texts:
        tree = token_counts.Tree(*by.leaves(t))
        for _ in range(10):
            a = rng.randrange(len(t) + 1)
            b = min(len(t), a + rng.choice([0, 1, 3, 20, 500]))
            put = "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 5, 40, 800])))
            want = t[:a] + put + t[b:]
            t, n = token_counts.edit(t, tree, a, b, put, by)
            anew, size = anew + n, size + len(t)
            assert t == want and tree.tokens == len(whole.encode_ordinary(t))
    assert anew < 0.7 * size


def test_token_counts_of_odd_texts(odd):
    got = token_counts.count(odd).collect()
    assert len(got) == 14 and all(r.n_tokens == sum(r.leaf_tokens) and r.n_chars == sum(r.leaf_chars) for r in got) and sum(r.n_tokens == 0 for r in got) == 3


def test_edited_query(spark, docs):
    by = token_counts.counter(token_counts.ranks_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op3_token_counts(spark, DATA).limit(60).collect():
        t = texts[r.doc_id] or ""
        n = len(t) + 1
        a, b = r.doc_id * 7919 % n, r.doc_id * 104729 % n
        t = t[:a] + " put in 'll 42 " + t[a:]
        t = t[:b] + t[b + 40 :]
        assert (r.edited_chars, r.edited_tokens) == (len(t), sum(by.leaves(t)[1]))


# 4


def test_url_rules(spark):
    rows = [
        ("https://WWW.Example.com/en/x?q", "www.example.com/en/", "allow"), ("http://m.example.com/en/1", "example.com/en/", "block"), ("http://notexample.com/en/1", "com/", "allow"), ("http://a.net/fr/", "net/fr/", "block"), ("http://a.net/fr", None, "allow"),
        ("http://example.com", None, "allow"), ("no scheme", None, "allow"), (None, None, "allow"), ("://com/en/", "com/", "allow"), ("http://x.com?://net/es/", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u, r, v) for i, (u, r, v) in enumerate(rows)], "page_id long, url string, want string, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(len(rows))] == [(r, v) for _, r, v in rows]
    assert got[0].host == "www.example.com" and got[0].path == "/en/x" and got[6].host == got[7].path == ""


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "_digest", lambda s: len(s))
    built = url_filter.Digests.build([("block", "ab.c", "/"), ("allow", "xy.z", "/"), ("block", "lm.n", "/")])
    for name, data in built.items():
        (tmp_path / name).write_bytes(data)
    d = url_filter.Digests.open(*(tmp_path / name for name in built), [1])
    found = d.find(["xy.z\0/", "ab.c\0/", "qq.q\0/", "x\0/"])
    assert [None if i < 0 else int(d.verdicts[i]) for i in found] == [0, 1, None, None]


# 5


@pytest.mark.parametrize("cache", [packing.CACHE, 40])
def test_tokens_are_the_tokenizers_own(docs, monkeypatch, cache):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(1)
    some = [r.text for r in docs.limit(60).collect()] + ["it's I'LL don't 'sx", "ÀÉÎ straße ﬁ ① Ⅻ é ́x a b c　d İstanbul ΑΣ <|endoftext|>x a<|startoftext|>b", "日本語 ok… 1234 ab12 x²½ ªº µm ĀāĂ\x1c\x85 z", "😀😀 a_b-c"]
    some += ["".join(rng.choice("aÀé'sS tLl1<|́ß ²œŒÿŸ") for _ in range(30)) for _ in range(800)]
    want = [t.encode(x, add_special_tokens=False).ids for x in some]
    monkeypatch.setattr(packing, "CACHE", cache)
    enc = packing.WordEncoder(packing.tokenizer_path())
    for lot in (50, 7, 200):  # twice and more, so that words come from the cache as well
        for a in range(0, len(some), lot):
            ids, at = enc.ids(some[a : a + lot], 2)
            assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])] == [w + [2] for w in want[a : a + lot]]


def test_pieces_join_to_documents(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    df = odd.repartition(3).withColumn("doc_id", F.monotonically_increasing_id())
    df = common.save(df, "in")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = sorted(packing.pack(df, length=64, with_ids=True).collect(), key=lambda r: (r.sequence_id, r.offset))
    ends = collections.Counter()
    for r in got:
        assert r.offset == ends[r.sequence_id] and r.length > 0 and r.offset + r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32
        ends[r.sequence_id] += r.length
    assert all(n == 64 for s, n in ends.items() if s != max(ends)) and sorted(ends) == list(range(len(ends)))
    for d, text in texts.items():
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist()
        assert ids == t.encode(text or "", add_special_tokens=False).ids + [2] and [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()


# 6


def brute_components(texts):
    def shingles(t):
        w = [x.translate(LOWER) for x in words(t)]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("leaf, block", [(near_dedup.LEAF, near_dedup.BLOCK), (12, 40)])
def test_near_components(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]

    def some(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    def varied(t, k):
        t = list(t)
        for _ in range(k):
            i = rng.randrange(len(t))
            t[i : i + rng.choice([0, 1, 1, 2])] = [rng.choice(vocabulary)]
        return t

    texts, passage, hot, chain = [[], []], some(60), some(150), some(100)
    for _ in range(40):
        base = some(rng.choice([3, 6, 40, 120]))
        texts += [varied(base, rng.choice([0, 1, 2, 4])) if len(base) > 6 else base for _ in range(rng.choice([1, 2, 3]))]
    texts += [varied(hot, rng.choice([0, 1, 2, 3, 5])) for _ in range(150)]
    texts += [some(rng.randrange(5, 60)) + passage + some(rng.randrange(5, 30)) for _ in range(80)]
    for _ in range(40):
        chain = varied(chain, 2)
        texts.append(chain)
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts] + [None, "A b C d e", "a B c D e"]
    got = sorted(near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    n, comp = brute_components(texts)
    assert [r.n_shingles for r in got] == n and [r.component_id for r in got] == comp and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nodes_that_stay_large_branch_on(spark, monkeypatch):
    for name, value in (("LEAF", 3), ("LEADERS", 4), ("MORE_LEADERS", 4)):
        monkeypatch.setattr(near_dedup, name, value)
    labels, save = [], near_dedup.save
    monkeypatch.setattr(near_dedup, "save", lambda df, label: labels.append(label) or save(df, label))
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = rng.choices(vocabulary, k=60)
    texts = [passage + rng.choices(vocabulary, k=rng.randrange(40, 70)) for _ in range(300)]
    for t in rng.sample(texts, 60):  # copies with a word changed, which is what has to be found
        at = rng.randrange(len(t))
        texts.append([*t[:at], "changed", *t[at + 1 :]])
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    got = sorted(near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r.component_id for r in got] == brute_components(texts)[1]
    assert "tree-4" in labels and f"tree-{near_dedup.DEEPEST}" not in labels


def test_trees_follow_from_the_recall():
    assert near_dedup.trees_for(0.9999) == near_dedup.TREES == 5 and near_dedup.trees_for(0.9999, 0.9) < 5


def test_near_dedup_of_odd_texts(odd):
    got = near_dedup.near_dedup(odd).collect()
    assert len(got) == 14 and all(r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (8, 9)} == {(8, 8), (9, 8)}
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 3, 5, 6, 7, 8, 10, 11, 12, None}


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.label for r in components.components(df).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 303


# 7


def check_base(rows, got, fold):
    tokens = {k: [w.translate(LOWER) for w in words(t)] + [None] for k, t in rows}
    c = collections.Counter(w for k, ws in tokens.items() if not fold(k) for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert math.isclose(got[k].base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)


@pytest.mark.parametrize("hot", [hmm_lm.HOT, 500])
def test_language_model(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(hmm_lm, "HOT", hot)
    got = {r.doc_id: r for r in queries.op7_lm_scoring(spark, DATA).collect()}
    check_base([(r.doc_id, r.text) for r in docs.collect()], got, lambda k: zlib.crc32(str(k).encode()) % 10 == 0)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    k, v = 3, 5
    h = hmm_lm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T.copy())
    seqs = [rng.integers(0, v, n) for n in (1, 2, 4, 4, 3)]

    def brute(s):
        total = 0
        for path in np.ndindex(*[k] * len(s)):
            p = h.first[path[0]] * h.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= h.move[path[t - 1], path[t]] * h.emit[s[t], path[t]]
            total += p
        return math.log(total)

    assert np.allclose(h.log_likelihood(seqs), [brute(s) for s in seqs])
    e = h.expected(seqs)
    assert np.isclose(e[:k].sum(), 5) and np.isclose(e[k : k + k * k].sum(), 14 - 5) and np.isclose(e[k + k * k :].sum(), 14)
    before, many = h.log_likelihood(seqs).sum(), e
    first, move, emit = many[:k], many[k : k + 9].reshape(3, 3), many[12:].reshape(v, k)
    better = hmm_lm.Hmm(first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    assert better.log_likelihood(seqs).sum() > before


def test_language_model_of_odd_texts(odd):
    got = hmm_lm.score(odd.withColumn("out", F.col("doc_id") > 8), "out").filter("doc_id is not null and doc_id != 3").collect()
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got) and {r.n_tokens for r in got if r.doc_id in (5, 6, 7)} == {1}
    alone = hmm_lm.score(odd.withColumn("out", F.lit(True)), "out").collect()
    assert {r.train_tokens for r in alone} == {0} and {r.n_known for r in alone} == {0}


# 8


def test_shards(spark, docs):
    df = common.save(docs.repartition(5), "docs")
    got = sharding.shard(df).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(got) == len(texts) and all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "bytes", None) for r in got)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(8):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine))) and abs(sum(r.size for r in mine) - total / 8) <= 2 * largest


def test_shards_of_odd_rows(odd):
    got = sharding.shard(odd, shards=20).collect()
    assert len(got) == 14 and all(0 <= r.shard < 20 for r in got) and sum(r.size == 1 for r in got) == 3


# 9


def test_fingerprints_align(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.13, (60, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, (base[0] + rng.normal(0, 0.004, 64)).tolist()) for i in range(10)] + [(200, base[0].tolist()), (300, None), (301, [0.0]), (302, [])]
    got = {r.vec_id: r for r in audio.align(audio.tunes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"), "vec_id").collect()}
    assert len(got) == len(rows) and got[200].class_id == 0 and got[300].n_prints == 0 and got[300].query_id is None
    f = {k: audio.fingerprint(audio.tune(v)) for k, v in rows}
    true = found = 0
    for k in f:
        for q in (0, 50, 100):
            if k != q and len(f[k]) and got[k].class_id != got[q].class_id and np.bitwise_count(f[k] ^ f[q]).sum() / (32 * len(f[k])) <= audio.MOST_ERRORS:
                true += 1
                found += got[k].n_matches > 0
    assert true and found / true >= 0.9
    assert all(got[k].n_matches == 0 for k in range(1, 50))


def test_alignment_misses_no_pair_within_the_bound(spark):
    """Bits flipped evenly over prints of several lengths, cut and shifted, and a held tone, against all offsets tried one by one."""
    rng = np.random.default_rng(5)
    prints = {0: rng.integers(0, 1 << 32, 54), 50: rng.integers(0, 1 << 32, 20), 100: np.full(40, 12345)}
    for k in range(1, 31):
        q = prints[(0, 50, 100)[k % 3]]
        cut = rng.integers(0, 4)
        flips = (rng.random((len(q) - cut, 32)) < (0.05, 0.1, 0.13)[k % 7 % 3]) @ (1 << np.arange(32))
        prints[k] = np.concatenate([rng.integers(0, 1 << 32, rng.integers(0, 3)), q[cut:] ^ flips])
    df = spark.createDataFrame([(k, p.tolist()) for k, p in prints.items()], "vec_id long, prints array<long>")
    got = {r.vec_id: r for r in audio.align(df, "vec_id").collect()}
    for k, p in prints.items():
        want = {}
        for q in (0, 50, 100):
            for offset in range(-len(p), len(prints[q])) if q != k else ():
                x, y = prints[q][max(offset, 0) :], p[max(-offset, 0) :]
                n = min(len(x), len(y))
                error = np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n) if n >= audio.LEAST_OVERLAP else 1
                if error <= audio.MOST_ERRORS:
                    want[q] = min(want.get(q, (1,)), (error, q, offset, n))
        assert got[k].n_matches == len(want)
        assert (got[k].bit_error, got[k].query_id, got[k].offset, got[k].overlap) == min(want.values(), default=(None,) * 4)
    assert sum(r.n_matches > 0 for r in got.values()) >= 25


def test_most_pairs_are_left_out_by_a_bound_that_is_never_too_large():
    """Melodies of one length: few pairs' bits are compared. Cut ones, of many lengths: none is taken for farther apart than it is."""
    rng = np.random.default_rng(8)
    prints = np.stack(audio.fingerprints_of([audio.tune(v) for v in rng.normal(0, 0.13, (200, 64))]))
    for least in (54, 16):
        sizes = rng.integers(least, 55, 200)
        grid = audio._grid(sizes, np.concatenate([p[:n] for p, n in zip(prints, sizes)]).tobytes())
        signs = audio._signs(sizes, grid)
        axes = audio._axes(signs)
        q_far, far = (audio._shadows(sizes, signs, axes, asks) for asks in (True, False))
        for a, b in ((0, 0), (3, 0), (0, 6), (21, 0)):
            lap = 54 - max(a, b)
            got = audio._squares(q_far, far, a, b, lap)
            overlap = np.maximum(np.minimum.outer(sizes - a, sizes - b), 0)
            wrong = (np.bitwise_count(grid[:, None, a : a + lap] ^ grid[None, :, b : b + lap]) * (np.arange(lap) < overlap[:, :, None])).sum(2)
            assert (got <= 4 * wrong + 1).all()
            assert least < 54 or (got <= 4 * audio.MOST_ERRORS * 32 * lap).mean() < audio.DENSE


def test_fingerprint_of_noisy_and_shifted_sound():
    rng = np.random.default_rng(4)
    pcm = audio.tune(rng.normal(0, 0.13, 64))
    late = np.concatenate([np.zeros(3 * audio.HOP, np.float32), pcm + 0.05 * rng.normal(0, 1, len(pcm)).astype(np.float32)])
    a, b = audio.fingerprint(pcm), audio.fingerprint(late)
    n = min(len(a), len(b) - 3)
    assert np.bitwise_count(a[:n] ^ b[3 : 3 + n]).mean() / 32 < 0.15
    assert len(audio.fingerprint(np.zeros(99999, np.float32))) == len(audio.fingerprint(pcm[:100])) == len(audio.fingerprint(None)) == 0


# 10


def water(sizes, weights, cap=3):
    total, free, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            free.remove(i)
    return target


def test_targets(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 30):
        sizes = [rng.choice([0, 1, 10, 100, 5000, 20000]) for _ in range(n)]
        got = mixing.targets(spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, source_size long")).orderBy("source").collect()
        assert np.allclose([r.target for r in got], water(sizes, [(5, 2, 1)[i % 3] for i in range(n)]))


def test_mix(spark, docs):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert all(r.size == len(words(t)) for r, t in zip(sorted(got, key=lambda r: r.doc_id), [x.text for x in sorted(docs.collect(), key=lambda x: x.doc_id)])) and all(r.taken <= 3 * r.size for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rows in by.values():
        assert rows[0].source_size == sum(r.size for r in rows) and abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
    n = mixing.repeated(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in n} == {r.doc_id: r.repeats for r in got if r.repeats}


def test_mix_of_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == 14 and {r.source for r in got} == {"a", "b", "c", "d", None} and mixing.repeated(odd).columns == odd.columns


# Shared.


def test_word_hashes_tell_words_apart():
    texts = ["A b\tc", None, "", "  a  B ", "abc", "ab c", "é E", "aB"]
    h, at = common.word_hashes(texts)
    by = {}
    for i, t in enumerate(texts):
        own = h[at[i] : at[i + 1]].tolist()
        assert len(own) == len(words(t))
        for w, x in zip(words(t), own):
            assert by.setdefault(w.translate(LOWER), x) == x
    assert len(set(by.values())) == len(by)


# What must not depend on sizes, names, partitions or other runs.


def plain_grams(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    code = f" {' '.join(low.split())} " if low.split() else " "
    return [code[i : i + n] for n in language_id.ORDERS for i in range(len(code) - n + 1)]


def gram_hash(gram):
    h = np.full(1, len(gram), np.uint64)
    for j, c in enumerate(gram):
        h += np.full(1, ord(c), np.uint64) * language_id._STEPS[j]
    return int(common.mix(h)[0])


def test_language_as_plain_sets(spark, docs):
    """Hits of each document counted one n-gram at a time with Python's sets; the filters' false positives are all that may differ."""
    train = docs.filter(common.bucket_of("doc_id", 5) != 0)
    counts = collections.defaultdict(collections.Counter)
    for r in train.collect():
        counts[r.lang].update(plain_grams(r.text))
    n_docs = collections.Counter(r.lang for r in train.collect())
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) for x in langs}
    rate = {x: {g: c / total[x] for g, c in counts[x].items() if c >= max(1, min(language_id.LEAST_COUNT, language_id.LEAST_COUNT * n_docs[x] // language_id.LEAST_DOCS))} for x in langs}
    top = collections.defaultdict(float)
    for x in langs:
        for g, v in rate[x].items():
            top[g] = max(top[g], v)
    own = {x: {g for g, v in rate[x].items() if v >= top[g] * language_id.SHARE} for x in langs}
    usual = {x: sum(rate[x][g] for g in own[x]) for x in langs}
    want = {}
    for r in docs.collect():
        grams = plain_grams(r.text)
        want[r.doc_id] = {x: sum(g in own[x] for g in grams) / len(grams) / usual[x] for x in langs}
    off = 0
    for r in queries.op2_language_id(spark, DATA).collect():
        shares = want[r.doc_id]
        off += r.lang_pred != max(langs, key=lambda x: shares[x])
        assert abs(r.score - min(1, max(shares.values()))) < 0.05
    assert off <= 0.01 * len(want)


def test_ngrams_run_over_windows():
    texts = ["Größe und  Straße, 12 x!" * 30, "", "a", "日本 語"]
    joined = lambda window: sorted((i, int(x)) for h, at in language_id.ngrams(texts, window) for i in range(len(texts)) for x in h[at[i] : at[i + 1]])
    assert joined(7) == joined(1 << 18) == sorted((i, gram_hash(g)) for i, t in enumerate(texts) for g in plain_grams(t) if len(g) > 1 and any(map(str.isalpha, t)))


def test_the_largest_share_decides():
    a, b = ([gram_hash(g) for g in grams] for grams in ([" a", "ab"], ["ab", "b "]))
    m = language_id.build(["aa", "bb"], np.array([0, 0, 1, 1]), np.array(a + b, np.uint64), np.array([0.01, 0.01, 0.005, 0.005]))
    assert m.predict(["ab"])[0] == ["bb"] and m.predict(["ab"])[1][0] == 1


def test_folded_filters_change_no_result(spark, docs, odd, monkeypatch):
    want = sorted(exact_dedup.decide(docs).collect()), sorted(r.doc_id for r in exact_dedup.keep_one(docs).collect()), sorted(r.doc_id for r in near_dedup.keep_one(docs).collect())
    monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", 4)
    assert want == (sorted(exact_dedup.decide(docs).collect()), sorted(r.doc_id for r in exact_dedup.keep_one(docs).collect()), sorted(r.doc_id for r in near_dedup.keep_one(docs).collect()))
    plan = exact_dedup.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    exchanged = plan[plan.rfind("Exchange hashpartitioning(__sha") :]
    assert "SortMergeJoin" not in plan and re.search(r"Filter .*__bits", exchanged) and "BroadcastHashJoin" in exchanged  # texts are sent behind the filter only


def test_scratch_goes_by_owner(spark, docs):
    lazy = exact_dedup.decide(docs)
    with common.owned("another"):
        other = common.save(docs.limit(3), "other")
    common.release("another")
    assert lazy.count() == docs.count()
    with pytest.raises(Exception, match="(?i)exist"):
        other.count()


def test_names_with_dots_and_clashes(spark):
    df = spark.createDataFrame([(1, "Some text of five words here", "en", "s", 7, 8.0, "x"), (1, "Some text of five words here", "en", "s", 7, 8.0, "x")], "doc_id long, text string, lang string, source string, `a.b` long, score double, lang_pred string")
    assert exact_dedup.keep_one(df).columns == df.columns and exact_dedup.keep_one(df).count() == 1
    assert near_dedup.keep_one(df).columns == df.columns and near_dedup.keep_one(df).count() == 1
    assert mixing.repeated(df).columns == df.columns
    found = language_id.identify(df, language_id.fit(df))
    assert found.columns == [*df.columns, "lang_pred_found", "score_found"] and {r.score for r in found.collect()} == {8.0}


def test_repeats_of_rows_alike(spark):
    rows = [(7, "w " * 5, "a")] * 6 + [(None, "v " * 5, "a")] * 4 + [(i, "u " * (i % 9 + 1), "bc"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for weights in ((5.0, 2.0, 1.0), (1.0, 2.0, 5.0), (1.3, 1.1, 1.7)):
        count = collections.Counter()
        for r in mixing.mix(df, weights=weights).collect():
            count[(r.doc_id, r.source)] += r.repeats
        got = collections.Counter((r.doc_id, r.source) for r in mixing.repeated(df, weights=weights).collect())
        assert got == +count


def test_token_trees_are_kept(spark, docs):
    state = common.save(token_counts.count(docs.select("doc_id", "text")), "state")
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("New words. ").alias("put")))
    once = token_counts.update(state.withColumn("edits", edits))
    by = token_counts.counter(token_counts.ranks_path())
    for r in once.collect():
        assert r.n_tokens == sum(by.leaves(r.text)[1]) == sum(r.leaf_tokens) and r.n_chars == len(r.text) == sum(r.leaf_chars)
    twice = token_counts.update(once.withColumn("edits", edits))
    assert twice.agg(F.sum("encoded_chars")).first()[0] < 0.7 * twice.agg(F.sum("n_chars")).first()[0]


def test_edits_at_any_key(spark, tmp_path):
    for kind, keys in (("long", [2**62, -5, None]), ("string", ["x", "12", None])):
        spark.createDataFrame([(k, "Some text here " * 9) for k in keys], f"doc_id {kind}, text string").write.parquet(f"{tmp_path}/{kind}/documents.parquet")
        assert queries.op3_token_counts(spark, f"{tmp_path}/{kind}").count() == 3


def test_blocks_of_steps_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    h = hmm_lm.Hmm(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(50), 4).T.copy())
    seqs = [rng.integers(0, 50, n) for n in (400, 1, 7, 399, 30, 120)]
    want, ll = h.expected(seqs), h.log_likelihood(seqs)
    for cells, width in ((12, 512), (40, 2), (7, 3)):
        monkeypatch.setattr(hmm_lm, "CELLS", cells)
        monkeypatch.setattr(hmm_lm, "WIDTH", width)
        assert np.allclose(h.expected(seqs), want, rtol=1e-4, atol=1e-4) and np.allclose(h.log_likelihood(seqs), ll)


def test_scores_do_not_depend_on_partitions(spark, docs):
    df = docs.select("doc_id", "text").withColumn("out", F.col("doc_id") % 10 == 0)
    a, b = ({r.doc_id: r.score for r in hmm_lm.score(d, "out", passes=1).collect()} for d in (df, df.repartition(5)))
    assert all(math.isclose(a[k], b[k], rel_tol=1e-3) for k in a)


def test_shards_as_plain_sums(spark, docs):
    """Scan order, sizes and middles, one row after another."""
    got = sharding.shard(docs).collect()
    total, at, slots = sum(r.size for r in got), 0, collections.Counter()
    want = {}
    for r in docs.collect():
        size = len((r.text or "").encode()) + 1
        shard = min(7, (2 * at + size) * 8 // (2 * total))
        want[r.doc_id] = (size, shard, slots[shard])
        slots[shard] += 1
        at += size
    assert {r.doc_id: (r.size, r.shard, r.slot) for r in got} == want


def test_urls_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/" + "x" * 50000, "r", "v")] * 2 + [(None, None, None, None)], "page_id long, url string, rule string, verdict string")
    got = url_filter.filter_urls(df).collect()
    assert len(got) == 3 and sorted((str(r.rule), r.verdict) for r in got) == [("None", "allow"), ("net/es/", "block"), ("net/es/", "block")]


def test_recordings_of_odd_tables(spark):
    v = np.random.default_rng(1).normal(0, 0.13, 64).tolist()
    df = spark.createDataFrame([(0, v, "a"), (0, v, "b"), (None, v, "c"), (50, None, "d"), (100, v[:3], "e"), (7, [None] * 64, "f")], "vec_id long, embedding array<double>, prints string")
    got = audio.align(audio.tunes(df, "vec_id", "embedding"), "vec_id").collect()
    assert len(got) == 6 and sum(r.class_id == 0 for r in got) == 3 and all(r.n_matches == 0 for r in got)


def test_packing_of_null_keys(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "c"), (3, None), (3, "")], "doc_id long, text string")
    got = packing.pack(df, length=3).collect()
    assert sum(r.length for r in got) == sum({(r.doc_id, r.start, r.ids_crc32): r.length for r in got}.values()) + 1 and {r.doc_id for r in got} == {None, 3}


# Words whose polynomial hashes are equal, whatever the base.


def thue_morse(times):
    t = "a"
    for _ in range(times):
        t += t.translate({97: 98, 98: 97})
    return t, t.translate({97: 98, 98: 97})


@pytest.mark.parametrize("times", [10, 12])
def test_words_of_a_pattern_don_t_collide(spark, times):
    from tokenizers import Tokenizer

    one, other = thue_morse(times)
    assert len(set(common.word_hashes([one, other])[0].tolist())) == 2
    df = spark.createDataFrame([(1, f"one two three four {one}"), (2, f"one two three four {other}"), (3, other)], "doc_id long, text string").coalesce(1)
    whole = Tokenizer.from_file(packing.tokenizer_path())
    for r in packing.pack(df, with_ids=True).collect():
        want = [*whole.encode(df.filter(F.col("doc_id") == r.doc_id).first().text, add_special_tokens=False).ids, 2]
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.start : r.start + r.length]
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(df).collect()} == {1: 1, 2: 2, 3: 3}
    scored = hmm_lm.score(df.withColumn("out", F.col("doc_id") == 1), "out").collect()
    assert {r.doc_id: r.n_known for r in scored} == {1: 5, 2: 6, 3: 2}


def test_a_batch_whose_hashes_collide_is_encoded_word_by_word(monkeypatch, docs):
    texts = [r.text for r in docs.limit(40).collect()]
    want, _ = packing.WordEncoder(packing.tokenizer_path()).ids(texts, 2)
    plain = packing.span_hashes
    monkeypatch.setattr(packing, "span_hashes", lambda *a, seed=0, **k: plain(*a, seed=seed, **k) & np.uint64(2**64 - 1 if seed else 255))
    assert packing.WordEncoder(packing.tokenizer_path()).ids(texts, 2)[0].tolist() == want.tolist()


def test_settings_with_units(spark):
    most, rows = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most), spark.conf.get(rows)
    for name, value, want in ((most, "64m", common.BATCH), (most, "1k", 1024), (most, "4096b", 4096), (rows, "-1", 1000), (rows, "7", 7)):
        spark.conf.set(name, value)
        common.small_batches(spark)
        got = spark.conf.get(name)
        assert int(got.rstrip("kb")) * (1024 if "k" in got else 1) == want
    spark.conf.set(most, before[0])
    spark.conf.set(rows, before[1])
