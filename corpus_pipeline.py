"""A training-corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet in the
shared folder and reads it again for the next.  All stages but the last return the columns of ``documents``.
Executors may be lost at any time: whatever a later stage reads is a written table.

Defined results of every stage: null and empty texts fail the quality rules; repeated rows are judged alike, and one of them is left by the
near-dedup; texts of one doc_id are told apart; ties go to the smallest doc_id; texts of any length are taken whole; an empty table gives an
empty one; columns beside doc_id and text may have any names and pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglattice.llm import decontaminate, linetree, packing, quality_rules, shinglesets
from loglattice.llm.common import scope, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(docs, table(spark, sf_dir, "labels")).filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates but for each template's first."""
    return linetree.drop_recurring(docs).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word Jaccard similarity 0.8 or more; the smallest doc_id).

    SimHash fingerprints and their pivot tables (op4) give the first pairs, a prefix filter those that they miss; all are verified on whole sets.
    """
    return shinglesets.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into windows."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", clean), ("packing", pack)]
#: SQL can express neither the hashed model of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scope(spark) as written:  # what a stage stashes for itself is removed once its result is written
            docs = written(stage(spark, docs, sf_dir))
    return docs
