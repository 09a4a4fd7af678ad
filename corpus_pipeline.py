"""Training-corpus pipeline: quality, near duplicates, contamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.
All but the last return the columns of documents, others that docs has included, whatever their names; a stage's decision
holds for all later ones. A text is one cell of one task, however long; an empty table gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ladderwork.llm.decontamination import clean_documents
from ladderwork.llm.jaccard import distinct_documents
from ladderwork.llm.pieces import tokenized
from ladderwork.llm.pii import redacted
from ladderwork.llm.quality import accepted
from ladderwork.llm.shared import stage, table

#: Documents that score less are rejected.
QUALITY_THRESHOLD = 0.3
#: Vocabulary file of the last stage.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null texts are judged as empty ones."""
    return accepted(docs, table(spark, sf_dir, "labels"), QUALITY_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates (five-word shingles, similarity 0.8). Documents without
    words and rows without an id stay; rows that share an id stay or go together."""
    return distinct_documents(docs, size=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, each judged by its own text. Null texts are clean."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every identifier replaced by its kind. Null texts stay null."""
    return redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with piece_ids and n_tokens; columns of these names are replaced. Null texts have null ids and 0 tokens."""
    return tokenized(docs, MODEL_PATH)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", personal_data_removed),
    ("pieces", encoded),
]

#: A classifier, components and a segmentation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
