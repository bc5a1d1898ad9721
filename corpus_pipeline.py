"""The corpus pipeline: from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result to the shared folder and reads it back as the next stage's docs.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from machlog.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, quality
from machlog.llm.common import cut, fields, quoted, table, whole_row
from machlog.llm.queries import BYTE_BPE, QUALITY_CUT, quality_model
from machlog.session import configure

#: No SQL: the first stage is a learned model.
ORACLE_SQL = None


def _configured(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with the session's settings, also where it is called on its own."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)
    return run


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_model(spark, docs.select("doc_id", "text"), sf_dir)
    packed = docs.select(whole_row(docs, {"text"}).alias("row"), "text")  # columns called like the score stay what they are
    good = quality.score(packed, model, QUALITY_CUT).filter("predicted = 1")
    other = fields("row", docs, {"text"})
    return good.select(*other, "text").select(*map(quoted, docs.columns))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    return exact_dedup.keep_first(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the row with the smallest id."""
    return jaccard_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages."""
    found = decontaminate.find(docs.select(whole_row(docs).alias("row"), "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.filter(~decontaminate.contaminated()).select(*fields("row", docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    return byte_bpe.encode(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", one_of_equal),
    ("jaccard_join", one_of_similar),
    ("decontamination", without_benchmark),
    ("byte_bpe", encoded),
]
STAGES = [(name, _configured(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
