"""Stored cursors of the sources, an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.upserts import latest_per_key

_CURSORS = "source string, cursor string, updated_at timestamp"


def write_cursor(spark: SparkSession, path: str, source: str, cursor: str) -> None:
    row = spark.range(1).select(F.lit(source).alias("source"), F.lit(cursor).alias("cursor"), F.current_timestamp().alias("updated_at"))
    row.coalesce(1).write.mode("append").parquet(path)


def cursors(spark: SparkSession, path: str) -> DataFrame:
    """The newest cursor of each source; none before the first write."""
    try:
        rows = spark.read.schema(_CURSORS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _CURSORS)
    return latest_per_key(rows, ["source"], F.col("updated_at").desc(), F.col("cursor"))


def read_cursor(spark: SparkSession, path: str, source: str) -> str | None:
    found = cursors(spark, path).where(F.col("source") == source).first()
    return found["cursor"] if found else None
