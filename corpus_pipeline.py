"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage works on all rows that the one before kept, and each table between them is written to
the shared folder and read again, so that a lost executor costs at most one stage's own work.
Scratch tables of a stage go when the next begins.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, exact_dedup, language_id, mixing, near_dedup, packing


def _owner(sf_dir: str) -> str:
    """Two runs at once in one program are in threads of their own."""
    return f"pipeline over {sf_dir} in {threading.get_ident()}"


def _stage(f: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Scratch tables belong to the pipeline over sf_dir: what the stages before left there goes when the next begins."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        owner = _owner(sf_dir)
        common.release(owner)
        with common.owned(owner):
            return f(spark, docs, sf_dir)

    return run


@_stage
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. What has no letter, or resembles no language, goes.

    Null and empty texts have no letter. Where no row has a language to learn from, documents with letters
    stay. Repeated rows are judged alike; an empty table gives an empty one; other columns ride along, those
    that are named like the operator's as well.
    """
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    lang, score = (common.free_name(c, docs.columns) for c in ("__lang", "__score"))
    found = language_id.judged(docs, model, names=(lang, score))
    return found.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= language_id.LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts but for white space, the longest, then that with the smallest doc_id.

    Null texts count as empty, and those are equal; of rows alike one stays; an empty table gives an empty one.
    """
    return exact_dedup.keep_one(docs)


@_stage
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal shingle sets, that with the smallest doc_id.

    Documents without words are linked with nothing and stay; of rows alike one stays; an empty table gives an empty one.
    """
    return near_dedup.keep_one(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, or up to the cap.

    A null source is a source; null and empty texts have no words to take; rows alike are taken one by one;
    an empty table gives an empty one.
    """
    return mixing.repeated(docs)


@_stage
def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences. Null texts are empty and have their end alone; repeated rows are packed each; an empty table gives an empty one."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Predictions and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    common.release(_owner(sf_dir))
    return docs
