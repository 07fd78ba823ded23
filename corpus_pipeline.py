"""A corpus pipeline: each stage takes (spark, docs, sf_dir), is written as Parquet, and read by the next.

Toxic documents go; of each group of near copies one stays; personal data is redacted; sources are mixed to
their targets (a document taken twice is two rows); what is left is packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, packing, pii, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below the cut. The network learns from the labelled rows of ``docs``."""
    docs = docs.select(*COLUMNS)
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_texts(docs, net, keep=True).where(F.col("toxic_score") < toxicity.CUT).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows linked by five-word shingles with a similarity of 0.8 or more."""
    return jaccard.one_of_each(docs.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, once or twice."""
    return mixing.taken_rows(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", one_of_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Neither training nor packing can be written in SQL; tests/llm/test_pipeline.py compares each stage, and the whole,
#: with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = _shared(spark)
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def _shared(spark: SparkSession) -> str:
    from tessera.llm.shared import folder

    return f"{folder(spark)}/pipeline-{uuid.uuid4()}"
