"""Times of the headline queries as one JSON line; BENCH_SF_DIR and BENCH_CPUS choose data and cores.

The last three are the runs for which times are published: normalising 28,595 summaries and 6,001
details, and rebuilding pre-match rows and snapshots from 6,112 payloads. Their payloads are made
from the tables first, outside the timing, and are as many as the tables allow.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tideglass import schemas
from tideglass.operators import featurize, history, normalize, prematch
from tideglass.plans import catalog, payloads, views
from tideglass.session import build_session

HEADLINE = (
    "q01_scored_metrics", "q05_segment_counts", "q06_calibration_error", "w01_game_numbers", "a09_series_scores", "w05_team_history", "w09_head_to_head",
    "w02_hero_winrates", "w18_series_wins_before", "w20_as_of", "q07_recent", "q14_calendar", "q17_participants", "q23_place_series", "q26_backfill", "l01_time_split", "m13_drift", "m10_bootstrap",
)
SUMMARIES, DETAILS, PAYLOADS = 28_595, 6_001, 6_112


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def rebuilds(spark: SparkSession, folder: str, scratch: str) -> dict[str, float]:
    """Seconds of the three published runs."""

    def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        (df if rows is None else df.limit(rows)).write.parquet(f"{scratch}/{name}")
        return spark.read.schema(df.schema).parquet(f"{scratch}/{name}")

    summaries = stored(payloads.summary(spark, folder), "summaries", SUMMARIES)
    details = stored(payloads.detail_b(spark, folder), "details", PAYLOADS)
    some = stored(details.limit(DETAILS), "some")
    ids = details.select("match_id")
    matches = stored(views.matches(spark, folder).join(ids, "match_id", "left_semi"), "matches")
    series, leagues = stored(views.series(spark, folder), "series"), stored(views.leagues(spark, folder), "leagues")
    players = stored(normalize.details(details)["match_players"], "players")
    times = {}

    start = time.perf_counter()
    for table in normalize.from_summaries(normalize.parse(summaries, schemas.SUMMARY)).values():
        run(table)
    for table in normalize.details(some).values():
        run(table)
    times["normalise"] = time.perf_counter() - start

    start = time.perf_counter()
    rows, rated = prematch.prematch_rows(matches, players)
    block = stored(rows, "block")
    run(rated)
    times["prematch"] = time.perf_counter() - start

    start = time.perf_counter()
    snapshots, _ = featurize.featurize(normalize.parse(details, schemas.DETAIL_B), history.number_games(matches), series, leagues, block)
    run(snapshots.withColumn("stored", F.lit(True)))
    times["featurize"] = time.perf_counter() - start
    return {k: round(v, 3) for k, v in times.items()}


def main() -> None:
    folder, cpus, scratch = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": f"file://{scratch}/checkpoints"})
    spark.sparkContext.setLogLevel("ERROR")
    run(catalog.q01_scored_metrics(spark, folder))  # warm the JVM
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(catalog.QUERIES[name](spark, folder))
        times[name] = round(time.perf_counter() - start, 3)
    times |= rebuilds(spark, folder, f"file://{scratch}")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
