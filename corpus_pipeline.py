"""A training-data pipeline over ``documents``: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and reread as
the next one's docs. All but the last return the columns of ``documents``, the fourth with ``position`` beside them. An empty table goes
through empty; null texts are rejected by the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from crateflow.llm import bpe, common, language, mixing, ngram_join, quality

#: Most rows of a batch that goes to a Python worker: whole texts stand in it, in the executor and in the worker at once.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Set for the session, as a stage's result is planned by its reader. A lower number that the session has stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those rejected go."""
    _small_batches(spark)
    return language.keep_identified(docs, language.fit(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality; those rejected go."""
    _small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    _small_batches(spark)
    return ngram_join.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix, with their positions in it, as files keep no order."""
    return mixing.positioned(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' positions in the mix, as ``source_mixing`` gave them, their token ids and the bytes these
    decode to."""
    _small_batches(spark)
    docs = docs if "position" in docs.columns else mixing.numbered(docs)  # a table that was not mixed
    return bpe.encode_documents(docs, outputs=("ids", "decoded"), carried=("position",), kept=0.5, lasting=False)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Fitted classifiers and byte-pair merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote is removed once the next one has read it all."""
    docs = common.table(spark, sf_dir, "documents")
    home = f"{common.shared_dir(spark)}/crateflow-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        before, docs = docs, spark.read.parquet(f"{home}/{name}")
        docs.stored_at = f"{home}/{name}"
        if k:
            common.remove(before)
    return docs
