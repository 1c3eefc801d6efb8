"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and is written as Parquet before the next one
reads it. All but the last return the columns of `documents`; the last returns one row per packed token piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basisline.llm.common import stored, table
from basisline.llm.decontamination import clean
from basisline.llm.line_dedup import without_boilerplate
from basisline.llm.near_duplicates import one_of_each
from basisline.llm.packing import pack
from basisline.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines stay in one document only."""
    return without_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, each with its sequence and place there."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("packing", packing)]

#: MinHash candidates, sketches and the tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
