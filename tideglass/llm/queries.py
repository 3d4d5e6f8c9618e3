"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt_dedup, decontaminate, language_id, licenses, line_quality, merkle, mixing, ngram_join, preference, token_rollup, token_store, toxicity, vector_codes
from .common import new_path, read_table
from .oracle import ORACLE


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    path = new_path(spark, "rollup")
    for batch_id, changes in token_rollup.document_changes(docs, labels):
        token_rollup.commit_batch(changes, path, batch_id)
    return token_rollup.totals(spark, path)


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.score_lines(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    token_store.write_store(read_table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path(token_store.TOKENIZER), special=True)
    return token_store.read_digest(spark, path)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.format_preferences(*preference.adjacent_pairs(read_table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return pairs.select("pair_id", "n_shared_turns", "prompt", "chosen", "rejected", spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.removal_digest(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents", *merkle.FIELDS))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return language_id.predict_languages(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), public_tokenizers.path(language_id.VOCABULARY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_rollup, op2_line_quality, op3_token_store, op4_ngram_join, op5_decontaminate, op6_preference_pairs, op7_toxicity, op8_license_scan, op9_bwt_dedup, op10_mix_sources,
        op11_vector_codes, op12_merkle_manifest, op13_language_id,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
