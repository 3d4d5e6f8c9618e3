"""Delta-maintained token counts by source, language and tokenizer version.

A change is a signed row: an insert adds its tokens and one document, a delete takes them away,
and a revision takes the old count away under its old key and adds the new one. Sums of signed
rows are additive, so a batch is reduced to one row per group before it is written, and the
totals are the sums over all committed batches.

A rollup is a table that is written by key (``sources.tables``): a row a group, and a row a committed
batch id. A commit adds its deltas to the buckets of their groups and its id to the bucket of the id,
and all of it becomes visible with one rename. A batch whose id is there adds nothing, whether it comes
again after a lost driver, by mistake, or from two drivers at once: the second finds the id's bucket
changed, reads it anew and leaves the table as it is. What the driver holds is the list of buckets;
groups and ids are read by Spark, and only from the buckets that a commit touches.

Tokens are counted by pattern in the JVM (``count_tokens``) or by a vocabulary of the tokenizers
library (``vocabulary_counts``); each is a version of its own.

Defined results: null source, language or version are groups of their own; a null count is 0, and
so is a null text's; repeated rows of a batch are separate changes; very long texts are counted
whole; groups whose documents and tokens are both 0 are dropped from the totals; an empty batch is
committed and adds nothing; a folder without commits has no totals; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.tables import KeyedTable
from .common import WORD, stage_table

KEYS = ("source", "lang", "tokenizer_version")
#: The two tokenizer versions that the query counts by.
VERSIONS = {"words-1": WORD, "pieces-2": r"\w+|[^\w\x20\x09-\x0D]"}

#: Buckets of a rollup, versions that are kept, and how old files are before they are deleted (seconds).
BUCKETS, KEPT_VERSIONS, KEPT_SECONDS = 32, 16, 86_400

_DELTAS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
_ROLLUP = f"batch_id string, {_DELTAS}"


def count_tokens(text: str, version: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def vocabulary_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` with n_vocabulary_tokens: ids of the text in a tokenizers file, special tokens not added.

    tokenizer: path of the file, the same on every executor.
    """
    from .token_store import encoder

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer, special=True)
        for batch in batches:
            counts = []
            for at in range(0, batch.num_rows, 200):
                ids = made.encode([t.as_py() or "" for t in batch["text"].slice(at, 200)])
                counts += [len(x) // made.dtype.itemsize for x in ids]
            yield batch.append_column("n_vocabulary_tokens", pa.array(counts, pa.int64()))

    return docs.mapInArrow(count, StructType([*docs.schema.fields, StructField("n_vocabulary_tokens", LongType())]))


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Changes to signed rows.

    changes: op (insert, delete or revise), source, lang, tokenizer_version, n_tokens, and for
    a revision old_source, old_lang, old_version and old_tokens. Rows of any other op are void.
    """
    op = F.lower("op")
    zero = F.lit(0).cast("long")

    def row(sign: int, source: str, lang: str, version: str, tokens: str):
        return F.struct(
            F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(version).cast("string").alias("tokenizer_version"),
            F.lit(sign).cast("long").alias("n_docs"), (sign * F.coalesce(F.col(tokens).cast("long"), zero)).alias("n_tokens"),
        )

    new = ("source", "lang", "tokenizer_version", "n_tokens")
    old = ("old_source", "old_lang", "old_version", "old_tokens")
    rows = F.when(op == "insert", F.array(row(1, *new))).when(op == "delete", F.array(row(-1, *new))).when(op == "revise", F.array(row(-1, *old), row(1, *new)))
    return changes.select(F.explode(rows).alias("r")).select("r.*")


def reduce_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, _ROLLUP, ["batch_id", *KEYS], buckets=BUCKETS)


def commit_batch(changes: DataFrame, path: str, batch_id: str) -> None:
    """Reduce a batch of changes and commit it under ``batch_id``; the same batch may come again."""
    spark = changes.sparkSession
    table, own = _table(spark, path), F.col("batch_id") == batch_id
    nothing = [F.lit(None).cast("string").alias(c) for c in KEYS]
    mark = spark.range(1).select(F.lit(batch_id).cast("string").alias("batch_id"), *nothing, *[F.lit(0).cast("long").alias(c) for c in ("n_docs", "n_tokens")])
    if not table.near(mark).where(own).isEmpty():
        return

    def add(old: DataFrame, new: DataFrame) -> DataFrame:
        if not old.where(own).isEmpty():  # another driver was faster
            return old
        both = old.unionByName(new)
        sums = reduce_deltas(both.where("batch_id IS NULL")).where("n_docs <> 0 OR n_tokens <> 0")
        return both.where("batch_id IS NOT NULL").unionByName(sums.select(F.lit(None).cast("string").alias("batch_id"), "*"))

    deltas = reduce_deltas(signed_deltas(changes)).select(F.lit(None).cast("string").alias("batch_id"), "*")
    made = table.commit(deltas.unionByName(mark), add)
    if made.version % KEPT_VERSIONS == 0:
        table.vacuum(KEPT_VERSIONS, KEPT_SECONDS)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Present totals: source, lang, tokenizer_version, n_docs, n_tokens."""
    return _table(spark, path).read().where("batch_id IS NULL").select(*KEYS, "n_docs", "n_tokens")


def compact(spark: SparkSession, path: str) -> None:
    """Delete all versions but the present one; no commit may be under way. Batch ids stay known."""
    _table(spark, path).vacuum()


def document_changes(docs: DataFrame, labels: DataFrame) -> list[tuple[str, DataFrame]]:
    """The change batches of the query.

    ``load`` inserts every document under words-1. ``labelled`` then follows the labels: a
    document labelled as of low quality is deleted, and every other labelled one is recounted
    under pieces-2. Labels are reduced to one row per doc_id (the lowest quality) first.
    """
    first, second = VERSIONS
    # counted once, so that no text is shuffled or read again
    counted = docs.select("doc_id", "source", "lang", count_tokens("text", first).alias("n_first"), count_tokens("text", second).alias("n_second"))
    counted = stage_table(counted, "counts")
    load = counted.select(F.lit("insert").alias("op"), "source", "lang", F.lit(first).alias("tokenizer_version"), F.col("n_first").alias("n_tokens"), *_no_old())
    quality = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("quality"))
    marked = counted.join(quality, F.col("doc_id") == F.col("labelled"))
    bad = F.coalesce(F.col("quality"), F.lit(1)) == 0
    follow = marked.select(
        F.when(bad, "delete").otherwise("revise").alias("op"), "source", "lang",
        F.when(bad, first).otherwise(second).alias("tokenizer_version"), F.when(bad, F.col("n_first")).otherwise(F.col("n_second")).alias("n_tokens"),
        F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit(first).alias("old_version"), F.col("n_first").alias("old_tokens"),
    )
    return [("load", load), ("labelled", follow)]


def _no_old():
    return [F.lit(None).cast("string").alias(c) for c in ("old_source", "old_lang", "old_version")] + [F.lit(None).cast("long").alias("old_tokens")]
