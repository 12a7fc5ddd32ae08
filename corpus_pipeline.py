"""A corpus from documents to packed sequences, one stage after the other.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame; all but the last
return the columns of ``documents``. ``run`` writes each stage's result to the
shared folder as Parquet and hands it on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsgraph.llm import decontaminate, language_id, near_dup, packing, quality_rules
from newsgraph.llm.catalog import tokenizer_path
from newsgraph.llm.tables import table
from newsgraph.session import stored

# A winning regression under -0.4 of -1..1: the text is unlike every language.
LEAST_SCORE = 0.3


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    return language_id.keep_identified(docs, LEAST_SCORE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned rules reject."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return near_dup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    pieces = packing.pack_documents(docs, tokenizer_path(), keep_ids=False)
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", languages),
    ("quality_rules", quality),
    ("near_dup", deduplicated),
    ("decontamination", decontaminated),
    ("packing", packed),
]

# The models of the first stages are fitted on the data; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
