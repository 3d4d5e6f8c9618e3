"""The domain's tables as views over the benchmark's star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

#: The moment that queries take for now.
NOW = "1998-06-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.expr(f"timestamp_ntz'{NOW}'")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as maps: a customer is a series of two teams that swap sides, its nation the league."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    even, a, b = F.col("o_orderkey") % 2 == 0, F.col("o_custkey"), F.col("o_custkey") + 1000000
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("match_id"), F.col("o_custkey").alias("series_id"), F.col("c_nationkey").cast("long").alias("league_id"),
        F.when(even, a).otherwise(b).alias("radiant_team_id"), F.when(even, b).otherwise(a).alias("dire_team_id"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("radiant_win"), F.col("o_orderdate").alias("start_time"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        key.alias("series_id"), F.col("c_nationkey").cast("long").alias("league_id"), F.lit(None).cast("long").alias("stage_id"), key.alias("team_a_id"), (key + 1000000).alias("team_b_id"),
        rules.lookup((key % 5).cast("int"), {0: "bo1", 1: "bo2", 2: "bo3", 3: "bo5"}).alias("format"), F.lit(None).cast("long").alias("winner_team_id"), (key % 7 == 0).alias("is_draw"),
    )


def leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, region = read(spark, sf_dir, "nation"), F.col("n_regionkey").cast("int")
    return n.select(
        F.col("n_nationkey").cast("long").alias("league_id"), F.col("n_name").alias("name"), rules.lookup(region, {0: "tier1", 1: "tier2", 2: "tier3", 3: "unknown"}).alias("tier"),
        rules.lookup((F.col("n_nationkey") % 5).cast("int"), {0: "professional", 1: "premium", 2: "excluded", 3: "amateur"}).alias("valve_tier"),
        F.when(F.col("n_nationkey") % 3 < 2, F.col("n_nationkey") % 3 == 0).alias("is_lan"),
    )


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping stages a league."""
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("league_id"), k)
    start = F.date_add(F.lit("1992-01-01").cast("date"), F.col("k") * 700 + (F.col("league_id") * 10).cast("int"))
    return n.select((F.col("league_id") * 10 + F.col("k")).alias("stage_id"), "league_id", rules.lookup(F.col("k"), {0: "bo1", 1: "bo3", 2: "bo5"}).alias("default_format"), start.alias("starts_at"), F.date_add(start, 900).alias("ends_at"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the prediction log; discount is the probability, quantity the minute."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), (F.col("l_quantity").cast("int") - 1).alias("minute"), (F.lit(0.01) + F.lit(9.8) * F.col("l_discount")).alias("p_radiant"),
        F.concat(F.lit("v"), F.col("l_linestatus")).alias("model_version"), F.col("l_shipdate").alias("predicted_at"),
        rules.lookup(F.col("l_returnflag"), {"A": "professional", "N": "excluded"}).alias("valve_tier"), (F.col("l_suppkey") % 25).alias("league_id"),
        F.col("l_partkey").alias("tie_1"), F.col("l_suppkey").alias("tie_2"), F.col("l_extendedprice").alias("tie_3"),
    )


TIE = ("tie_1", "tie_2", "tie_3")


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hero picks of decided maps."""
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), (F.col("l_partkey") % 127).alias("hero_id"), (F.col("l_linenumber") % 2 == 1).alias("is_radiant")).distinct()  # noqa: E741
    return l.join(matches(spark, sf_dir).select("match_id", "start_time", "radiant_win"), "match_id")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("account_id"), (F.col("l_linenumber") % 2 == 1).alias("is_radiant"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("match_id"), F.col("ts").alias("captured_at"), F.col("props").alias("payload"))


def series_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 64-minute leads in whole gold, by arithmetic of the vectors' own type: a whole factor would make it double, and 0.053 be 52."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("match_id"), F.transform("embedding", lambda x: F.floor(x * F.lit(1000.0).cast("float")).cast("int")).alias("leads"))
