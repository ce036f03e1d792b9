"""A corpus pipeline over `documents`: each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import decontaminate, jaccard, langid, mixing, tokens
from pagemill.llm.common import materialise, release, table, tracked

#: Scratch tables of the stage before, which nothing needs once its rows are written.
_scratch: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _scratch)
        with tracked(_scratch):
            return f(spark, docs, sf_dir)

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told."""
    return langid.identified(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard.deduplicated(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that benchmark passages don't contaminate."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, repeats included."""
    return mixing.mixed(docs)


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.round_trip(docs, file_ids=1 << 22, remembered=1 << 18)  # workers of earlier stages hold memory, too


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
    ("token-ID output", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
