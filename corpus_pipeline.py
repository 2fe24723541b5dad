"""The corpus pipeline: documents in five stages, each written as Parquet and read again.

1. ``quality``: lines that fail the line rules go, then documents that lost too much or fail the base rules.
2. ``lines``: lines that repeat an earlier one, exactly (of any length, but for blank ones) or but for one edit or one word,
   go. A document that loses all its lines stays as an empty text (stage 4 gives it no copies).
3. ``near_duplicates``: of documents linked by five-word shingles at a similarity of 0.8 the one with the smallest id stays.
4. ``mixture``: documents are taken as often as their rate for the target domain weights says.
5. ``pieces``: ids of the SentencePiece model, decoded again as a check.

All stages but the last return the columns of their input. Nulls, empty and repeated rows: see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlake.llm import jaccard, lines, mixing, pieces, quality
from runlake.llm.common import documents, stored

#: A classifier and a tokenizer cannot be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeats(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.first_of_groups(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded_and_checked(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixture", mixture_stage),
    ("pieces", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
