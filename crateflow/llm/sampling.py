"""Folds and bounded fitting samples by hash, the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def first_by_hash(ids: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows, in the order of a hash of doc_id: ids only, so a small sort."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def with_text(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text and the sample's columns for the sampled ids. The sample is bounded by a
    documented number of rows, and so is broadcast. Of a repeated id the least text stays, with
    the least of the sample's other columns."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    others = [c for c in sample.columns if c != "doc_id"]
    return texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("r")).select("doc_id", "r.*")
