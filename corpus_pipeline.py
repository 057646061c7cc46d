"""The corpus pipeline: from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; what one stage returns is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

A document of a small source may be mixed in twice: then it is packed twice, and queue_start tells its copies apart.

Defined results, as the operators state them: null and empty texts are scored by the classifier as texts without words and
fail the rules; null keys, sources and languages are kept as they are; repeated rows are one document to the near
duplicates; further columns of the documents stay until the last stage, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import mixing, ngram_join, packing, quality_mil, quality_rules
from pulsegrid.llm.common import materialize, release, table, written
from pulsegrid.llm.language_mix import held_out
from pulsegrid.llm.queries import byte_bpe


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, taught by the labels outside the test fold, scores below its threshold."""
    model = quality_mil.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality_mil.keep(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails a rule of the web policy."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return ngram_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the documents of each source up to its target, some twice."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, by pieces with their ids."""
    return packing.pack(docs, byte_bpe())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packed),
]

#: A trained classifier stands at the start: SQL cannot express the rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = written()
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before, docs)  # what the stage itself wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
