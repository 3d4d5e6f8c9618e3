"""Writes to tables that are keyed, as joins and unions of whole tables (K*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _as_order(df: DataFrame, name: str) -> Column:
    """A column that can be sorted by; maps are by their sorted entries."""
    kind = df.schema[name].dataType.typeName()
    return F.to_json(F.array_sort(F.map_entries(name))) if kind == "map" else F.to_json(name) if kind == "variant" else F.col(name)


def latest_per_key(df: DataFrame, keys: list[str], *order: Column, settled: bool = False) -> DataFrame:
    """The first row of each key in ``order``; ties fall by the whole row.

    ``settled``: ``order`` leaves no ties, so that the rest of the row need not be sorted by.
    """
    rest = [] if settled else [_as_order(df, c) for c in df.columns if c not in keys]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def replace_raw(old: DataFrame, new: DataFrame) -> DataFrame:
    """Raw payloads: the newest fetch of (match_id, source) stays."""
    return latest_per_key(old.unionByName(new), ["match_id", "source"], F.col("fetched_at").desc())


def _side_by_side(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    renamed = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new"))
    return old.withColumn("_old", F.lit(True)).join(renamed, keys, "full")


def upsert_supplied(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Columns that ``new`` has are taken from it, nulls included; others stay."""
    both = _side_by_side(old, new, keys)
    supplied = set(new.columns) - set(keys)
    return both.select(*[F.when(F.col("_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in supplied else F.col(c) for c in old.columns])


def fill_gaps(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Known values stay, gaps are filled, unseen keys are added."""
    both = _side_by_side(old, new, keys)
    supplied = set(new.columns) - set(keys)
    return both.select(*[F.coalesce(F.col(c), F.col(f"new_{c}")).alias(c) if c in supplied else F.col(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows with unseen keys are added."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    missing = [F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns if c not in new.columns]
    return old.unionByName(fresh.select(*[c for c in new.columns if c in old.columns], *missing))


def surrogate(*keys: str) -> Column:
    """A key that depends on the natural key alone."""
    return F.xxhash64(*keys)


def supersede(old: DataFrame, decisions: DataFrame, key: str, now: Column) -> DataFrame:
    """Slowly changing rows: the active row of a decided key is closed, the decision becomes active."""
    decided = decisions.select(F.col(key).alias("_key")).distinct()
    closed = old.join(decided, F.col(key) == F.col("_key"), "left").withColumn("superseded_at", F.when(F.col("_key").isNotNull() & F.col("superseded_at").isNull(), now).otherwise(F.col("superseded_at"))).drop("_key")
    added = decisions.withColumns({"decided_at": now, "superseded_at": F.lit(None).cast("timestamp")})
    return closed.unionByName(added, allowMissingColumns=True)
