"""Captured payloads on shared storage, batch and streaming, always with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table, or an empty one of its schema where nothing is stored yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.TABLES[name])


def json_rows(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One payload a line."""
    return spark.read.schema(ddl).json(path)


def raw_payloads(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Whole payloads as text with their match id, whichever field holds it."""
    text = spark.read.text(path).withColumnRenamed("value", "payload")
    match_id = F.coalesce(F.get_json_object("payload", "$.match_id"), F.get_json_object("payload", "$.id")).cast("long")
    return text.select(match_id.alias("match_id"), F.lit(source).alias("source"), F.current_timestamp().alias("fetched_at"), "payload").where("match_id IS NOT NULL")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Wiki pages, one file each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("page"), F.col("value").alias("wikitext"))


def live_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Captured live boards as a stream."""
    return spark.readStream.schema(schemas.LIVE).option("maxFilesPerTrigger", max_files).json(path)


def live_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Captured live boards as a stream of text, for ticks that name what is wrong with a board."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(F.col("value").alias("payload"))
