"""Corpus pipeline over ``documents``: each stage is one operator of retailflow.llm.

Every stage takes all that the previous one kept, is written as Parquet and read again
before the next. Stages but the last return the columns of ``documents``.

Nulls, empty texts, repeated rows, empty tables and extra columns are treated as the
operators' docstrings say; rows that share a ``doc_id`` stay or go together in the
filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retailflow.llm import best_fit, cube_mix, hyperminhash, line_dedup, quality_mcd
from retailflow.llm.common import staged, table
from retailflow.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality_mcd.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in one of them."""
    return line_dedup.clean(docs, min_docs=3, min_chars=20)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more."""
    return hyperminhash.keep_representatives(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them."""
    return cube_mix.sample_stage(docs, weights=(5.0, 2.0, 1.0), max_repeats=3.0, share=1.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024."""
    return best_fit.pack(docs, tokenizer_path(), capacity=1024, end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Iterative estimates, a sample and a tokenizer: no SQL statement gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
