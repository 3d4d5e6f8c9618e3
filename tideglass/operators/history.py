"""What was known before each map: strictly earlier rows in (start_time, match_id) order (W*).

Every operator takes maps and returns one row per map. Frames end one row before the current one,
so that maps of the same second are told apart by id and none sees its own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

DAY = 86400.0
FORM_DAYS, PAIR_DAYS = 120, 180
TEAM_MEMORY, PAIR_MEMORY = 400, 100
HERO_PRIOR = 50.0


def seconds(c: str) -> Column:
    return F.col(c).cast("timestamp").cast("double")


def number_games(matches: DataFrame) -> DataFrame:
    """game: number of the map in its series."""
    order = Window.partitionBy("series_id").orderBy(F.col("start_time").asc_nulls_last(), "match_id")
    return matches.withColumn("game", F.when(F.col("series_id").isNotNull(), F.row_number().over(order)))


def by_team(matches: DataFrame) -> DataFrame:
    """Two rows a decided map: match_id, start_time, side, team_id, opponent_id, won."""
    row = lambda side, a, b, won: F.struct(F.lit(side).alias("side"), F.col(a).alias("team_id"), F.col(b).alias("opponent_id"), won.alias("won"))
    both = F.array(row("radiant", "radiant_team_id", "dire_team_id", F.col("radiant_win")), row("dire", "dire_team_id", "radiant_team_id", ~F.col("radiant_win")))
    known = matches.where(F.col("radiant_win").isNotNull() & F.col("start_time").isNotNull())
    return known.select("match_id", "start_time", F.explode(both).alias("t")).select("match_id", "start_time", "t.*")


def _rate(window, memory: int, days: int, won: Column, empty: float) -> Column:
    """Decayed share of wins among the last ``memory`` earlier rows within ``days`` days."""
    rows = F.collect_list(F.struct(seconds("start_time").alias("t"), won.cast("double").alias("w"))).over(window.rowsBetween(-memory, -1))
    near = F.filter(rows, lambda r: seconds("start_time") - r["t"] <= days * DAY)
    weigh = lambda r: rules.decay(seconds("start_time") - r["t"])
    total = F.aggregate(near, F.lit(0.0), lambda a, r: a + weigh(r))
    return F.when(total > 0, F.aggregate(near, F.lit(0.0), lambda a, r: a + weigh(r) * r["w"]) / total).otherwise(F.lit(empty))


def team_history(matches: DataFrame) -> DataFrame:
    """match_id, side, team_id, form, maps_24h, rest_days of each side before the map.

    A frame holds at most 400 earlier rows of one team, whatever the size of the table.
    """
    order = Window.partitionBy("team_id").orderBy("start_time", "match_id")
    before = order.rowsBetween(-TEAM_MEMORY, -1)
    times = F.collect_list(seconds("start_time")).over(before)
    return by_team(matches).where(F.col("team_id").isNotNull()).select(
        "match_id", "side", "team_id", _rate(order, TEAM_MEMORY, FORM_DAYS, F.col("won"), 0.5).alias("form"),
        F.size(F.filter(times, lambda t: seconds("start_time") - t <= DAY)).alias("maps_24h"),
        ((seconds("start_time") - F.max(seconds("start_time")).over(before)) / DAY).alias("rest_days"),
    )


def pair_history(matches: DataFrame) -> DataFrame:
    """match_id, h2h: radiant's decayed share of earlier maps against this opponent."""
    low, high = F.least("radiant_team_id", "dire_team_id"), F.greatest("radiant_team_id", "dire_team_id")
    m = matches.where("radiant_win IS NOT NULL AND start_time IS NOT NULL AND radiant_team_id IS NOT NULL AND dire_team_id IS NOT NULL").withColumns({"low": low, "high": high})
    order = Window.partitionBy("low", "high").orderBy("start_time", "match_id")
    low_won = F.col("radiant_win") == (F.col("radiant_team_id") == F.col("low"))
    share = _rate(order, PAIR_MEMORY, PAIR_DAYS, low_won, 0.5)
    m = m.withColumn("share", share)
    return m.select("match_id", F.when(F.col("radiant_team_id") == F.col("low"), F.col("share")).otherwise(1 - F.col("share")).alias("h2h"))


def hero_winrates(picks: DataFrame) -> DataFrame:
    """picks (match_id, start_time, hero_id, is_radiant, radiant_win) with winrate before the map.

    Picks of maps without a start time have no place in the order and are left out. A hero is in
    millions of maps, so its running sums are built in two steps: sums within
    (hero, day), running sums over the days, and a window within one day only.
    """
    won = (F.col("is_radiant") == F.col("radiant_win")).cast("long")
    p = picks.where("hero_id IS NOT NULL AND radiant_win IS NOT NULL AND start_time IS NOT NULL").withColumns({"won": won, "day": F.to_date("start_time")})
    # all picks of one map are before or after another map's together, and stay in its row
    rest = [c for c in picks.columns if c not in ("hero_id", "match_id", "start_time")]
    per_map = p.groupBy("hero_id", "day", "start_time", "match_id").agg(F.sum("won").alias("mw"), F.count(F.lit(1)).alias("mn"), F.collect_list(F.struct(*rest)).alias("rest"))
    days = p.groupBy("hero_id", "day").agg(F.sum("won").alias("w"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("hero_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("hero_id", "day", F.coalesce(F.sum("w").over(over), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"))
    same_day = Window.partitionBy("hero_id", "day").orderBy("start_time", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    per_map = per_map.withColumns({"w1": F.coalesce(F.sum("mw").over(same_day), F.lit(0)), "n1": F.coalesce(F.sum("mn").over(same_day), F.lit(0))})
    rate = (F.col("w0") + F.col("w1") + HERO_PRIOR / 2) / (F.col("n0") + F.col("n1") + HERO_PRIOR)
    rated = per_map.join(days, ["hero_id", "day"]).select("hero_id", "match_id", "start_time", rate.alias("winrate"), F.inline("rest"))
    return rated.select(*picks.columns, "winrate")


def draft_advantage(picks: DataFrame) -> DataFrame:
    """match_id, draft_advantage: mean rate of radiant's heroes less dire's, 0 if a side has none."""
    side = lambda r: F.avg(F.when(F.col("is_radiant") == r, F.col("winrate")))
    return hero_winrates(picks).groupBy("match_id").agg(F.coalesce(side(True) - side(False), F.lit(0.0)).alias("draft_advantage"))


def rosters(players: DataFrame) -> DataFrame:
    """match_id, radiant, dire: account arrays of maps with five known accounts a side."""
    side = lambda r: F.array_sort(F.collect_set(F.when(F.col("is_radiant") == r, F.col("account_id"))))
    made = players.where(F.col("account_id").isNotNull()).groupBy("match_id").agg(side(True).alias("radiant"), side(False).alias("dire"))
    return made.where((F.size("radiant") == 5) & (F.size("dire") == 5))


def series_wins_before(matches: DataFrame) -> DataFrame:
    """match_id, radiant_series_wins, dire_series_wins before the map.

    Wins belong to teams, not to sides. One window over the series' games replaces a self-join.
    """
    m = matches.where(F.col("series_id").isNotNull()).withColumn("winner", F.when(F.col("radiant_win"), F.col("radiant_team_id")).when(~F.col("radiant_win"), F.col("dire_team_id")))
    order = Window.partitionBy("series_id").orderBy(F.coalesce("game", F.lit(1))).rangeBetween(Window.unboundedPreceding, -1)
    won = F.collect_set(F.when(F.col("winner").isNotNull() & F.col("game").isNotNull(), F.struct("winner", "game"))).over(order)
    count = lambda team: F.size(F.filter(won, lambda x: x["winner"] == F.col(team))).cast("long")
    return m.select("match_id", count("radiant_team_id").alias("radiant_series_wins"), count("dire_team_id").alias("dire_series_wins"))


def series_scores(matches: DataFrame, series: DataFrame) -> DataFrame:
    """series_id, score_a, score_b from the maps, whichever side a team was on."""
    m = matches.where(F.col("radiant_win").isNotNull() & F.col("series_id").isNotNull()).select("series_id", F.when(F.col("radiant_win"), F.col("radiant_team_id")).otherwise(F.col("dire_team_id")).alias("winner"))
    s = series.select("series_id", "team_a_id", "team_b_id").join(m, "series_id", "left")
    return s.groupBy("series_id").agg(F.count_if(F.col("winner") == F.col("team_a_id")).alias("score_a"), F.count_if(F.col("winner") == F.col("team_b_id")).alias("score_b"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the newest row of ``right`` at or before its time.

    Both tables meet in one shuffle by (key, day); a running last value needs no join at all. What a
    day inherits is the last value of the key's earlier days, found over one row a day and laid
    before the day's own rows. So a key that holds most rows is as many tasks' work as it has days.
    """
    day = lambda c: F.date_trunc("day", F.col(c).cast("timestamp")).alias("_day")
    value = _struct(right, values)
    none = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c != key]
    l = left.select(*left.columns, F.col(left_time).alias("_t"), day(left_time), F.lit(1).alias("_side"), F.lit(None).cast(value).alias("_v"))  # noqa: E741
    r = right.select(key, *none, F.col(right_time).alias("_t"), day(right_time), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    days = l.select(key, "_day", "_t", "_v").unionByName(r.select(key, "_day", "_t", "_v"))
    days = days.groupBy(key, "_day").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_t"))).alias("_last"))
    earlier = F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    carried = days.select(key, *none, F.lit(None).cast(l.schema["_t"].dataType).alias("_t"), "_day", F.lit(-1).alias("_side"), earlier.alias("_v"))
    both = l.unionByName(r.select(*l.columns)).unionByName(carried.select(*l.columns))
    order = Window.partitionBy(key, "_day").orderBy(F.col("_side") >= 0, "_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where(F.col("_side") == 1)
    return filled.select(*left.columns, *[F.col("_v")[v].alias(v) for v in values])


def _struct(df: DataFrame, values: list[str]) -> str:
    return "struct<" + ",".join(f"{v}:{df.schema[v].dataType.simpleString()}" for v in values) + ">"
