"""The pipeline's stages, each against its own input, by plainer means."""

import collections

import corpus_pipeline
from tidemark.llm import common, mixing

from ..conftest import DATA
from .test_operators import brute_components


def test_stages(spark):
    before = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, before, DATA), name)
        a, b = before.collect(), after.collect()
        if name != "packing":
            assert after.columns == before.columns
        if name == "language_id":
            assert set(b) <= set(a) and len(b) > 0.97 * len(a) and all(any(c.isalpha() for c in r.text) for r in b)
        if name == "exact_dedup":
            bare = lambda t: "".join((t or "").split(" ")).translate(dict.fromkeys(range(9, 14)))
            groups = collections.defaultdict(list)
            for r in a:
                groups[bare(r.text)].append(r)
            assert sorted(r.doc_id for r in b) == sorted(min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values())
        if name == "near_dedup":
            a.sort(key=lambda r: r.doc_id)
            _, comp = brute_components([r.text for r in a])
            assert sorted(r.doc_id for r in b) == [r.doc_id for i, r in enumerate(a) if comp[i] == i]
        if name == "mixing":
            want = {r.doc_id: r.repeats for r in mixing.mix(before).collect() if r.repeats}
            assert collections.Counter(r.doc_id for r in b) == want
        if name == "packing":
            copies = collections.Counter(r.doc_id for r in a)
            assert collections.Counter(r.doc_id for r in b if r.start == 0) == copies
            assert {r.doc_id: n for r in b for n in [sum(x.length for x in b if x.doc_id == r.doc_id)]} == {r.doc_id: r.doc_tokens * copies[r.doc_id] for r in b}
        before = after
    assert len(b) > 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string"


def through(spark, docs, where):
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, docs, where), name)
        assert name == "packing" or after.columns == docs.columns
        docs = after
    return docs


def test_stages_of_odd_and_empty_tables(spark):
    assert through(spark, spark.createDataFrame([], SCHEMA), "none").count() == 0
    words = "the quick brown fox jumps over the lazy dog and runs away into the dark wood again"
    rows = [(i, f"{words} {i} {words[i:]}", "en", "a", 1, 0.0, "und") for i in range(40)] + [(1, f"{words} 1 {words[1:]}", "en", None, 1, None, None), (None, None, None, None, None, None, None), (99, "", "en", "a", 0, 0.0, ""), (98, "123 !", "en", "a", 0, 0.0, "")]
    got = through(spark, spark.createDataFrame(rows, SCHEMA), "odd").collect()
    assert got and {r.doc_id for r in got} <= set(range(40))


def test_no_language_to_learn(spark):
    df = spark.createDataFrame([(1, "words of some language", None, "a", 1, 0.0, "x"), (2, "12 34", None, "a", 1, 0.0, "x")], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, df, "x").collect()] == [1]
