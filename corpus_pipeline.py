"""A corpus pipeline in five stages, each written as Parquet and read again by the next.

Any table of documents will do: ids of any type, nulls in any column, no rows at
all. Columns besides those of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import drop_path, stage_path
from quern.llm.line_dedup import drop_recurring_lines
from quern.llm.mixing import mix
from quern.llm.near_dup import drop_near_duplicates
from quern.llm.packing import pack_documents
from quern.llm.quality_rules import keep_quality
from quern.llm.token_counts import token_count


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose histograms are far from their language's go, and those with a
    null, empty or blank text. Short ones stay; repeated rows are judged alike."""
    return keep_quality(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; the documents stay, as an empty text where
    nothing is left. Null texts stay as they are; repeated rows count as one document."""
    return drop_recurring_lines(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id; of
    rows that repeat an id one. Rows without an id or a word are in no group and stay."""
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights in exact tokens; a document taken
    twice is two rows. A null source is one of its own; equal keys are taken together."""
    return mix(docs, tokens=token_count("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the training sequences. Texts
    without tokens have none; repeated rows have places of their own."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_dup_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]

#: MinHash signatures and the packing search can't be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES[:-1]:
        path = stage_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            drop_path(spark, read)
        docs, read = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
