"""The corpus pipeline: stages over ``documents``, each reading what the last one wrote.

Rejected documents, all but one of each group of near-duplicates, and documents
that hold benchmark passages go; secrets are blotted out; what is left is
encoded. Each stage takes any columns beside those of ``documents`` along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import common as C
from strandline.llm.op02_secrets import redacted
from strandline.llm.op03_quality import without_rejected
from strandline.llm.op06_decontaminate import without_contaminated
from strandline.llm.op08_jaccard import without_near_duplicates
from strandline.llm.op10_bpe import digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant doesn't reject; it learns from the labels of documents that aren't held out."""
    return without_rejected(docs, C.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group with a Jaccard similarity of 0.8 or more."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return without_contaminated(docs, C.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the packed ids of each text, and the number and hashes that op10 gives."""
    return digest(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]
#: SQL can't express the classifier or the encoder: tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
