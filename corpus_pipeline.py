"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet to the shared folder and hands the reread table to the next stage.
All stages but the last return the columns of ``documents`` and drop rows:

1. language_id: texts without a letter, or whose best language scores under MIN_SCORE;
2. exact_dedup: all but the row with the largest doc_id of equal texts;
3. near_dedup: all but the smallest doc_id of each near-duplicate component
   (shingles of five words, similarity 0.8);
4. decontamination: documents that hold a benchmark window of ten words;
5. packing: the rest as token pieces placed in sequences of 1024.

SQL cannot express stages 1, 3 and 5, so ORACLE_SQL is None and the pipeline is
tested against a brute-force version.

Defined cases: a null, empty or blank text has no letter, so its row goes in stage 1; a
row whose lang is null is judged like any other but teaches nothing; among repeated rows
one stays in stage 2; rows that share an identifier but not a text stay or go together in
stages 3 and 4 (in 3 they stay where any would, in 4 they go where any does); an empty
table gives an empty table; other columns pass through stages 1 to 4, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from warraq.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from warraq.llm.common import stage, table
from warraq.work import work_dir, working_tables

#: Low on purpose: short and mixed texts stay; only texts without evidence go.
MIN_SCORE = 0.15


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language that the labelled rows taught, with at least MIN_SCORE."""
    return language_id.keep_identified(docs, language_id.learn(docs), MIN_SCORE)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the smallest doc_id."""
    return near_dedup.drop_near_copies(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a token piece, with its sequence and its place there."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents; only their results stay in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    work = work_dir(spark, "pipeline")
    for name, function in STAGES:
        with working_tables(spark):
            docs = stage(function(spark, docs, sf_dir), f"{work}/{name}")
    return docs
