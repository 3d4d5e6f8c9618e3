"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.

Every stage reads whole texts of any length and keeps columns beyond those of ``documents``, whatever
their names. An empty table gives an empty one. Documents without words fail the quality rules; rows
with a null doc_id or source take part, as a document of their own text and a source of their own.
Repeated rows are one document to the rules and the join, which keeps one of them; of a group of near
duplicates the one with the least doc_id stays, a null one last. Later stages read what is left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from tideglass.llm import decontaminate, line_quality, mixing, ngram_join, token_store
from tideglass.llm.common import new_path, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their host's frequent lines."""
    return line_quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return ngram_join.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(spark, "tokens")
    token_store.write_store(docs, path, public_tokenizers.path(token_store.TOKENIZER), special=True)
    return token_store.read_digest(spark, path)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID output", token_ids),
]

#: The join's components and the tokenizer's ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
