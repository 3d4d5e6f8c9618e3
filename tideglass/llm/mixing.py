"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash. Words are summed by source and hash bucket; the running
sums of a source's buckets show in which bucket its budget ends. Only that boundary bucket is
cut again by the next hash bits, until the budget ends between two hashes. A document is then
taken by comparing its hash with its source's threshold: no row is ever sorted. Thresholds of
growing budgets are nested, so a smaller mix is a subset of a larger one.

Defined results: a null or empty text has size 0 and is taken 0 words; null sources are one
source, last in order; rows with equal doc_id and text share a hash, so they are taken together,
while rows without doc_id are told apart by their texts; very long texts are counted whole; an
empty table gives no rows; columns other than doc_id, text and source are ignored by ``mix`` and
kept by ``mixed_documents``. A budget above a source's size repeats whole documents: floor(target / source_size) copies of each, and
one more of those under the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage_table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Bits of the hash that each histogram resolves; 60 in all.
LEVELS = (12, 12, 12, 12, 12)
HASH_BITS = 60


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(key: str = "doc_id", text: str = "text") -> Column:
    """The first 60 bits of the MD5 of id and text, which other SQL engines compute as well."""
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target.

    The excess of capped sources is shared again by weight: with sources ordered by
    cap / weight, the common level is that of the first source which stays under its cap.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rank = (F.row_number().over(order) - 1) % len(weights)
    capped = F.lit(float(max_repeats)) * F.col("source_size")
    zero = F.lit(0.0)
    return (
        per_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
        .withColumn("cap", capped)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn(
            "level",
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)),
        )
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
        .select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("level", zero)).alias("target"))
    )


def thresholds(sizes: DataFrame, budgets: DataFrame, levels=LEVELS) -> DataFrame:
    """One row per source: documents with a hash below ``threshold`` fill its budget.

    budgets: source, budget (words). The sum below the threshold is the nearest to the budget
    that whole hashes allow.
    """
    state = budgets.select("source", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("low"), F.lit(False).alias("done"))
    shift = HASH_BITS
    for bits in levels:
        width, shift = 1 << bits, shift - bits
        step = 1 << shift
        inside = sizes.join(state.where(~F.col("done")), sizes["source"].eqNullSafe(state["source"])).where(
            (F.col("hash") >= F.col("low")) & ((F.col("hash") - F.col("low")) < F.lit(step * width))
        )
        histogram = inside.groupBy(sizes["source"].alias("s"), F.shiftright(F.col("hash") - F.col("low"), shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last")
        )
        # at most 2**bits buckets a source
        running = Window.partitionBy("s").orderBy("bucket")
        summed = histogram.withColumn("upto", F.sum("words").over(running))
        edge = (
            summed.join(state.select(F.col("source").alias("t"), "left"), F.col("s").eqNullSafe(F.col("t")))
            .where(F.col("upto") > F.col("left"))
            .groupBy("s")
            .agg(F.min_by(F.struct("bucket", "words", "upto", "first", "last"), "bucket").alias("b"))
        )
        joined = state.join(edge, state["source"].eqNullSafe(edge["s"]), "left")
        under = F.col("left") - (F.col("b.upto") - F.col("b.words"))
        single = F.col("b.first") == F.col("b.last")
        # one hash left: take it if that ends nearer to the budget
        taken = F.when(F.col("b.words") - under < under, F.col("b.first") + 1).otherwise(F.col("b.first"))
        above = F.col("low") + F.lit(step * width)
        state = stage_table(
            joined.select(
                "source",
                F.when(F.col("done") | F.col("b").isNull(), F.col("left")).otherwise(under).alias("left"),
                F.when(F.col("done"), F.col("low")).when(F.col("b").isNull(), above).when(single, taken).otherwise(F.col("low") + F.col("b.bucket") * F.lit(step)).alias("low"),
                (F.col("done") | F.col("b").isNull() | single).alias("done"),
            ),
            "thresholds",
        )
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("source", F.col("low").alias("threshold"))


def mix_plan(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: of, source_size, target, copies, threshold."""
    wanted = stage_table(targets(sizes, weights, max_repeats), "targets")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = wanted.withColumn("copies", copies).withColumnRenamed("source", "of")
    cut = thresholds(sizes, plan.select(F.col("of").alias("source"), (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget")))
    return plan.join(cut, F.col("of").eqNullSafe(F.col("source"))).drop("source")


def times_taken(max_repeats: int) -> Column:
    return F.col("copies") + F.when((F.col("hash") < F.col("threshold")) & (F.col("copies") < max_repeats), F.lit(1)).otherwise(F.lit(0))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source)."""
    sizes = stage_table(docs.select("doc_id", "source", word_count().alias("size"), document_hash().alias("hash")), "sizes")
    plan = mix_plan(sizes, weights, max_repeats)
    return sizes.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times_taken(max_repeats)).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the mix takes it (0 to ``max_repeats`` times)."""
    sizes = stage_table(docs.select("doc_id", "source", word_count().alias("size"), document_hash().alias("hash")), "sizes")
    plan = mix_plan(sizes, weights, max_repeats).select("of", "copies", "threshold")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("source").alias("in_source"), document_hash().alias("hash"))
    taken = keyed.join(plan, F.col("in_source").eqNullSafe(F.col("of")))
    copies = F.explode(F.array_repeat(F.lit(1), times_taken(max_repeats).cast("int")))
    return taken.select("row", copies.alias("copy")).select("row.*")
