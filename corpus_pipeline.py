"""From raw documents to token ids in five stages, each written and read again before the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tremora.llm import decontaminate, mixing, near_copies, quality_rules, token_planes
from tremora.llm.common import DOCUMENT_COLUMNS, stored, table
from tremora.llm.queries import tokenizer_path
from tremora.session import scratch_path

#: SQL has neither XXH64 nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT_COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted quality rules keep."""
    return quality_rules.keep_good(_columns(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.one_of_each(_columns(docs))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.without_leaks(_columns(docs), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, those taken twice in two rows."""
    return mixing.take(_columns(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document in the written plane blocks."""
    path = scratch_path(spark, "pipeline-planes")
    token_planes.write_planes(_columns(docs), path, tokenizer_path())
    return token_planes.read_documents(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good),
    ("near_duplicates", distinct),
    ("decontamination", uncontaminated),
    ("mixing", mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
