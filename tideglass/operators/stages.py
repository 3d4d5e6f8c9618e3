"""Series placed in tournament stages by interval join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def covers(day: Column, start: Column, end: Column) -> Column:
    """A stage covers a day from one before its start to one after its end."""
    return day.between(F.date_sub(start, 1), F.date_add(end, 1))


def place_series(series: DataFrame, matches: DataFrame, stages: DataFrame) -> DataFrame:
    """series_id, stage_id, default_format, reason for every series with a played map.

    Equi-join on the league; the days are checked within it. Choice: the only covering stage; else
    the only one whose format allows so many maps; else the first of those that agree on a format.
    """
    first = matches.where("series_id IS NOT NULL").groupBy("series_id").agg(F.to_date(F.min("start_time")).alias("day"), F.count(F.lit(1)).alias("maps"))
    s = series.select("series_id", "league_id").join(first, "series_id").where(F.col("day").isNotNull())
    w = stages.where("starts_at IS NOT NULL AND ends_at IS NOT NULL").select("stage_id", F.col("league_id").alias("in_league"), "default_format", F.to_date("starts_at").alias("start"), F.to_date("ends_at").alias("end"))
    on = (F.col("league_id") == F.col("in_league")) & covers(F.col("day"), F.col("start"), F.col("end"))
    fits = rules.lookup(F.col("default_format"), rules.MAX_GAMES) >= F.col("maps")
    stage = F.struct("stage_id", "default_format")
    least = lambda c: F.min(F.when(c, stage))
    g = s.join(w, on, "left").withColumn("fits", fits).groupBy("series_id", "maps").agg(
        F.count("stage_id").alias("covering"), F.count_if("fits").alias("possible"), F.count_distinct(F.when(F.col("fits"), F.col("default_format"))).alias("formats"),
        least(F.col("stage_id").isNotNull()).alias("any"), least(F.col("fits")).alias("fit"),
    )
    one, agree = F.col("covering") == 1, (F.col("possible") == 1) | (F.col("formats") == 1)
    chosen = F.when(one, F.col("any")).when(agree, F.col("fit"))
    # The reasons' texts.
    reason = (
        F.when(F.col("covering") == 0, "no stage covers the dates").when(one, "single stage covers the dates").when(F.col("possible") == 1, "map count ruled out the other stages")
        .when(F.col("possible") == 0, "map count fits no covering stage").when(F.col("formats") == 1, "overlapping stages agree on the format").otherwise("several stages overlap and disagree on the format")
    )
    return g.select("series_id", chosen["stage_id"].alias("stage_id"), chosen["default_format"].alias("default_format"), reason.alias("reason"))


def link_series(series: DataFrame, matches: DataFrame, stages: DataFrame) -> DataFrame:
    """series with stage_id, format, winner_team_id and is_draw where a stage was found (Q23)."""
    placed = place_series(series, matches, stages).select("series_id", F.col("stage_id").alias("new_stage"), "default_format", "reason")
    out = series.join(placed, "series_id", "left").withColumn("format", F.coalesce("default_format", "format"))
    end = rules.series_outcome(F.col("format"), F.col("score_a"), F.col("score_b"))
    return out.withColumns({
        "stage_id": F.coalesce("new_stage", "stage_id"),
        "winner_team_id": F.when(end["winner_is_a"], F.col("team_a_id")).when(~end["winner_is_a"], F.col("team_b_id")).otherwise(F.col("winner_team_id")),
        "is_draw": F.coalesce(end["is_draw"], F.col("is_draw")),
    }).drop("new_stage", "default_format")


def conditional_flags(matches: DataFrame, series: DataFrame) -> DataFrame:
    """match_id, is_conditional_game where format and game number are known (Q24)."""
    return matches.join(series.select("series_id", "format"), "series_id").where("format IS NOT NULL AND game_in_series IS NOT NULL").select("match_id", rules.conditional_game(F.col("format"), F.col("game_in_series")).alias("is_conditional_game"))
