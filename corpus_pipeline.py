"""A training-corpus pipeline: five stages over `documents`, each written and read again before the next.

Quality filter, near-duplicate removal, benchmark decontamination, masking of personal data, and
encoding. The first four return the columns of documents; the last adds token ids.

In every stage null and empty texts, rows without an id, repeated rows, extra columns and empty
tables have a defined result, stated with it; columns that a stage doesn't work on pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, cotraining, decontaminate, neardup, pii
from millrace.llm.shared import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps: a score of 0.5 or more, ties kept.

    Null and empty texts are scored like any other, repeated rows alike; without two classes of labels all stay.
    """
    return cotraining.kept(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, documents without an id last.

    SimHash at its wide radius: links are five-word shingle sets of similarity 0.8 or more, each confirmed.
    Texts without words, null ones too, are one group; of repeated rows one stays.
    """
    return neardup.keep_one(docs, least=0.8, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. Null and empty texts stay; repeated rows stay or go together; an empty benchmark removes none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the text. Null texts stay null with their n_chars null, repeated rows stay repeated."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids and number of tokens; null texts have none. Columns named ids, decoded or n_tokens are replaced."""
    return bpe.encode(docs).drop("decoded").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", encoding),
]

#: The first stage trains a classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
