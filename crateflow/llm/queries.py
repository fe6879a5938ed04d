"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, fingerprints, infill, language, licenses, mixing, ngram_join, quality, repair, runs, sampling, token_counts, topk, toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", (sampling.fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(common.table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select(
        "doc_id", (sampling.fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_documents(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").alias("n_detections"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4's result that SQL can express."""
    return licenses.base_places(common.table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(common.table(spark, sf_dir, "documents"), outputs=("ids_sha256", "decoded_sha256"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.table(spark, sf_dir, "embeddings"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(common.table(spark, sf_dir, "documents"))


def edited_text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7's result that SQL can express."""
    return fingerprints.edited_texts(common.table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).select("doc_id", (sampling.fold(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read(repair.write(common.table(spark, sf_dir, "documents")))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(common.table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.fill_in_middle(common.table(spark, sf_dir, "documents")))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.collapsed(common.table(spark, sf_dir, "documents"), plant=True))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ngram_join, op3_quality, op4_licenses, op5_byte_bpe, op6_exact_topk, op7_fingerprints, op8_language, op9_token_ids, op10_pfair_mix, op11_fill_in_middle, op12_token_counts, op13_period_runs, license_base_places, edited_text_hashes)}
SQL = {"op11_fill_in_middle": infill.SQL, "op2_ngram_join": ngram_join.SQL, "op6_exact_topk": topk.SQL, "op10_pfair_mix": mixing.SQL, "license_base_places": licenses.BASE_SQL, "edited_text_hashes": fingerprints.EDITED_SQL}
