"""SimHash, filter audit and alignment against brute force, and odd inputs."""

import base64
import bisect
import collections
import hashlib
import itertools
import random
import re

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tidemark.llm import alignment, filter_audit, hmm_lm, language_id, queries, simhash

from ..conftest import DATA
from .test_operators import LOWER, none, odd, words  # noqa: F401


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# 11


def plain_fingerprint(text):
    w = words((text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(keys, prints):
    up = list(range(len(keys)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(keys)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            up[find(j)] = find(i)
    groups = collections.defaultdict(list)
    for i in range(len(keys)):
        groups[find(i)].append(keys[i])
    return [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(keys))]


def agrees(rows, got):
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_components([k for k, _ in rows], prints)
    assert sorted(((k, f"{p:016x}", c) for (k, _), p, c in zip(rows, prints, want)), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_simhash_query(spark, docs):
    agrees([(r.doc_id, r.text) for r in docs.collect()], queries.op11_simhash(spark, DATA))


def test_simhash_of_odd_texts(odd, none):
    agrees([(r.doc_id, r.text) for r in odd.collect()], simhash.near_simhash(odd))
    assert simhash.near_simhash(none).count() == 0 and simhash.near_simhash(none).columns == ["doc_id", "fingerprint", "component_id"]


def test_fingerprints_over_windows(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("aé bc D \t efg".split(" ")) for _ in range(n)) + rng.choice(["", " ", "\n"]) for n in (0, 1, 2, 3, 4, 700, 5, 0, 2)] + [None, " ", "x" * 5000]
    monkeypatch.setattr(simhash, "WINDOW", 50)
    assert simhash.fingerprints(texts).tolist() == [plain_fingerprint(t) for t in texts]


def test_a_tree_finds_what_is_near():
    rng = random.Random(4)
    values = [rng.getrandbits(12) | rng.choice([0, 1 << 63, 1 << 40]) for _ in range(700)]
    tree = simhash.Tree()
    for v in values:
        tree.add(v)
    for v in values[:200] + [0, 2**64 - 1]:
        for radius in (0, 1, 2, 5):
            assert sorted(tree.near(v, radius)) == sorted(w for w in set(values) if (v ^ w).bit_count() <= radius)


def test_dense_shards_are_dealt_anew(spark):
    """Fingerprints that share most bits: trees of at most 40, so that shards are dealt several times."""
    rng = random.Random(5)
    values = sorted({rng.getrandbits(9) << 5 ^ rng.choice([0, 0, 1 << 50, 3 << 20]) ^ 1 << 63 for _ in range(600)} | {rng.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    got = {frozenset((a % 2**64, b % 2**64)) for a, b in simhash.links(df, len(values), shard=40).collect()}
    assert all((min(p) ^ max(p)).bit_count() <= 2 for p in got)

    def groups(pairs):
        up = {v: v for v in values}

        def find(v):
            while up[v] != v:
                v = up[v]
            return v

        for a, b in pairs:
            up[find(a)] = find(b)
        return sorted(collections.Counter(find(v) for v in values).values())

    assert groups(map(tuple, got)) == groups((a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2)
    for free in (2**64 - 1, 0b1011, 0, 1 << 63 | 7):
        masks = simhash.parts(free)
        assert sum(masks) == free and max(m.bit_count() for m in masks) - min(m.bit_count() for m in masks) <= 1


# 12


def plain_audit(docs, labels):
    first = {}
    for k, t, _ in docs:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, x in labels if x == 1 and k is not None}
    rows = []
    for k, t, part in docs:
        t = t or ""
        w = words(t)
        fails = {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if k is not None and k > first[t] else set()
        rows.append((part or "", fails, k in good, k in toxic))
    out, by = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                gone = [r for r in own if f in r[1] and not before & r[1]]
                by[part, f] += len(gone)
                out[part, "".join(order), step + 1, f] = [
                    sum(not (before | {f}) & r[1] for r in own), len(gone), sum(f in r[1] and bool(before & r[1]) for r in own), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
    return sorted((*k, *v, by[k[0], k[3]]) for k, v in out.items())


def test_audit_as_plain_counts(spark, docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    long = "word Word other " * 200
    rows += [(-1, None, None), (None, long, None), (5000, long, ""), (5001, long, "xx"), (5001, long, "xx"), (5002, "", "xx"), (5003, "A $", "xx")]
    labels = [tuple(r) for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality", "toxic").collect()] + [(5001, 1, 1), (5001, 0, 0), (None, 1, 1), (5003, None, 1)]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, lang string, E string, part boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.verdicts(df, marks), list("ABCDE"), ["good", "toxic"])
    assert got.columns == ["part", "filter", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    cols = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.select(*cols).collect())) == plain_audit(rows, labels)


def test_audit_of_an_empty_table(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.verdicts(none, labels), list("ABCDE"), ["good", "toxic"]).count() == 0


# 13


@pytest.fixture(scope="module")
def both():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(alignment.vocabulary("byte_bpe_50k.json")), SentencePieceProcessor(model_file=alignment.vocabulary("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    ranks = {int(i): base64.b64decode(t) for t, i in map(bytes.split, open(alignment.vocabulary("byte_bpe_50k.tiktoken"), "rb"))}
    return a, b, ranks


def plain_alignment(both, texts):
    """Of each text: n_a, n_b, n_groups, n_links, n_best, count_sum, digest."""
    a, b, ranks = both
    docs, count = [], collections.Counter()
    for t in texts:
        links, groups, x, y = [], [], [], []
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            of_a = [ranks[i] for i in x]
            of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(of_a) == b"".join(of_b) == (" " + t).encode():
                ends_a, ends_b = (list(itertools.accumulate(map(len, z))) for z in (of_a, of_b))
                at = {e: j for j, e in enumerate(ends_b)}
                links = [(x[i], y[at[e]]) for i, e in enumerate(ends_a) if e in at]
                cuts = sorted(set(ends_a) & set(ends_b))
                of_cut = [collections.defaultdict(list), collections.defaultdict(list)]
                for own, ids, ends in zip(of_cut, (x, y), (ends_a, ends_b)):
                    for i, e in zip(ids, ends):
                        own[bisect.bisect_left(cuts, e)].append(str(i))
                groups = [",".join(of_cut[0][c]) + "|" + ",".join(of_cut[1][c]) for c in range(len(cuts))]
            else:
                x = y = []
        count.update(links)
        docs.append((len(x), len(y), links, groups))
    top = collections.Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, len(g), len(ls), sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, ls, g in docs]


STRANGE = [
    None, "", " ", "a", " a", "a ", "a  b", "\n", "x\n\ny  z\t ", "▁", "a▁b c", "<|endoftext|> <s> </s> <unk> <0x41>", "é́ ﬁ ① 한국어 日本語 🏳️‍🌈 café", "it's we'll 12345 ...!!! a,b", "a b 　c   d\u0085e", "\x1c a\x1f b\x00c",
    "word " * 300, "x" * 3000, "  " * 500, "a " + "́" * 50 + " b",
]


def check_alignment(spark, both, texts, **settings):
    rows = [(i if i % 7 else None, t, 1) for i, t in enumerate(texts)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(3), **settings).collect()
    want = [(k, *w) for (k, _, _), w in zip(rows, plain_alignment(both, texts))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_alignment_of_strange_texts(spark, both):
    rng = random.Random(6)
    signs = ["a", "b", " ", " ", "\n", "é", "▁", "'s", "1", ".", "　", "語", "\t"]
    check_alignment(spark, both, STRANGE + ["".join(rng.choice(signs) for _ in range(rng.choice([3, 20, 60]))) for _ in range(150)])


def test_alignment_query(spark, both, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {k: w for (k, _), w in zip(rows, plain_alignment(both, [t for _, t in rows]))}
    got = queries.op13_alignment(spark, DATA)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_segments_give_the_same_as_whole_texts(docs, both, monkeypatch):
    """Small windows and caches: cuts and evictions change nothing."""
    by = alignment.Pair(alignment.vocabulary("byte_bpe_50k.json"), alignment.vocabulary("piece_bpe_32k.model"))
    assert by._cuts
    texts = [r.text for r in docs.limit(30).collect()] + STRANGE[1:]
    want = []
    by._cuts = False
    plain = lambda: [(";".join(g), *rest) for g, *rest in by.align(texts)]
    want = plain()
    by._cuts, by._new, by._old = True, {}, {}
    assert by._fast and plain() == want
    for window, cache, together in ((40, 60, 7), (1 << 18, 5, 1), (40, 10**6, 500)):
        by._new, by._old = {}, {}
        monkeypatch.setattr(alignment, "WINDOW", window)
        monkeypatch.setattr(alignment, "CACHE", cache)
        monkeypatch.setattr(alignment, "TOGETHER", together)
        assert plain() == want


def test_alignment_of_an_empty_table_and_the_dictionary(spark, none):
    assert alignment.align(none).count() == 0 and alignment.dictionary(none).count() == 0
    df = spark.createDataFrame([(1, "the cat the dog")], "doc_id long, text string")
    got = alignment.align(df, with_groups=True).first()
    assert hashlib.sha256(got.groups.encode()).hexdigest() == got.groups_sha256 and got.n_groups == got.groups.count(";") + 1
    pairs = alignment.dictionary(df).collect()
    assert sum(r.n for r in pairs) == got.n_links and max(r.n for r in pairs) == 2 and all(r.best for r in pairs if r.n == 2)
    assert got.count_sum == sum(r.n**2 for r in pairs)


# 2: more than one table of languages, and names of columns


def test_more_languages_than_a_table_has_bits(spark):
    rng = random.Random(11)
    rows = []
    for lang in range(70):
        stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)]
        rows += [(100 * lang + i, " ".join(rng.choice(stems) for _ in range(30)), f"l{lang:02}") for i in range(4)]
    df = spark.createDataFrame(rows + [(9000, None, "l99"), (9001, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert len(model.langs) == 70 and len(model.tables) == 2
    got = language_id.identify(df, model).filter("lang is not null and text is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_columns_named_like_the_operators(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en", "mine", 5.0, "a", "b", "c")], "doc_id long, text string, lang string, __lang string, __score double, score string, score_found string, __verdict string")
    model = language_id.fit(df)
    got = language_id.identify(df, model)
    assert got.columns == [*df.columns, "lang_pred", "score_found_"] and got.first()["__lang"] == "mine" and got.first().lang_pred == "en"
    stage = corpus_pipeline.STAGES[0][1](spark, df, "names")
    assert stage.columns == df.columns and stage.first()["__lang"] == "mine" and stage.first()["__score"] == 5.0


def test_two_runs_of_the_pipeline_at_once(spark):
    """A stage of one run begins while another's is still to be written."""
    from concurrent.futures import ThreadPoolExecutor

    def one(_):
        return sorted((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect())

    with ThreadPoolExecutor(2) as pool:
        first, second = pool.map(one, range(2))
    assert sorted(x[2] for x in first) == sorted(x[2] for x in second) and len(first) > 50


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 977} und{i % 13} é" for i in range(120_000))
    df = spark.createDataFrame([(1, long, "de"), (2, "kurz und gut", "de"), (3, long + " x", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df, language_id.fit(df)).collect()}
    assert got[1].lang_pred == got[3].lang_pred == "de"
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_simhash(df).collect()}[1] == (f"{plain_fingerprint(long):016x}", 1)
    by = alignment.Pair(alignment.vocabulary("byte_bpe_50k.json"), alignment.vocabulary("piece_bpe_32k.model"))
    found = {r.doc_id: r for r in alignment.align(df).collect()}
    assert found[1].n_a == len(by._a.encode(" " + long, add_special_tokens=False).ids) and found[1].n_b == len(by._b.encode(long))
    scored = hmm_lm.score(df.withColumn("out", F.col("doc_id") == 2), "out").collect()
    assert {r.doc_id: r.n_tokens for r in scored} == {1: 360_001, 2: 4, 3: 360_002}
