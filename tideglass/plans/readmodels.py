"""The questions the service answers (Q*), each one plan over the stored tables.

Tables have the columns of ``schemas.TABLES``; ``now`` is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.upserts import latest_per_key


def scored_predictions(predictions: DataFrame, matches: DataFrame, leagues: DataFrame, segment: str | None = None, per_segment: bool = False, tie: tuple[str, ...] = ()) -> DataFrame:
    """The earliest prediction of each (match, minute, version) with a known result.

    The segment is filtered before duplicates go, so a minute may keep another row per segment.
    """
    p = predictions.withColumnRenamed("p_radiant", "p") if "p_radiant" in predictions.columns else predictions
    p = p.join(leagues.select("league_id", "tier"), "league_id", "left").withColumn("segment", rules.segment(F.col("valve_tier"), F.col("tier")))
    if segment is not None:
        p = p.where(F.col("segment") == segment)
    known = matches.where(F.col("radiant_win").isNotNull()).select("match_id", "radiant_win", "start_time")
    keys = ["match_id", "minute", "model_version"] + (["segment"] if per_segment else [])
    return latest_per_key(p.join(known, "match_id"), keys, F.col("predicted_at"), *[F.col(c) for c in tie], settled=bool(tie))


def versions(scored: DataFrame) -> DataFrame:
    """Scored versions, most rows first."""
    return scored.groupBy("model_version").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "model_version")


def serving_progress(predictions: DataFrame) -> DataFrame:
    """Matches predicted and the span of time, by version."""
    return predictions.groupBy("model_version").agg(F.count_distinct("match_id").alias("matches"), F.min("predicted_at").alias("first_at"), F.max("predicted_at").alias("last_at"))


def segment_counts(predictions: DataFrame, leagues: DataFrame) -> DataFrame:
    """Matches by version and segment; all three segments are there, null apart."""
    p = predictions.join(leagues.select("league_id", "tier"), "league_id", "left").withColumn("segment", rules.segment(F.col("valve_tier"), F.col("tier")))
    counts = p.groupBy("model_version", "segment").agg(F.count_distinct("match_id").alias("matches"))
    grid = predictions.select("model_version").distinct().select("model_version", F.explode(F.array(*map(F.lit, rules.SEGMENTS))).alias("segment"))
    filled = grid.join(counts, ["model_version", "segment"], "left").select("model_version", "segment", F.coalesce("matches", F.lit(0)).alias("matches"))
    return filled.unionByName(counts.where("segment IS NULL"))


def thin(curve: Column, target: int = 30) -> Column:
    """``target`` points of an array, evenly, the last one always in."""
    n = F.size(curve)
    picked = F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda i: F.when(i == target - 1, F.get(curve, n - 1)).otherwise(F.get(curve, F.floor(i * (n / float(target))).cast("int"))))
    return F.when(n <= target, curve).otherwise(picked)


def recent_matches(predictions: DataFrame, matches: DataFrame, leagues: DataFrame, limit: int = 20, tiers: list[str] | None = None) -> DataFrame:
    """The newest finished professional matches with their curves (Q07; a top-k report).

    Maxima of a minute are taken column by column, so p and version may come from different rows.
    """
    league = F.coalesce(F.col("league_id"), F.col("p_league"))
    p = predictions.select("match_id", "minute", "p_radiant", "predicted_at", "model_version", "valve_tier", F.col("league_id").alias("p_league"))
    m = matches.where("radiant_win IS NOT NULL").select("match_id", "league_id", "start_time", "radiant_win")
    pro = p.where(rules.is_pro(F.col("valve_tier")))
    if tiers:
        pro = pro.join(m, "match_id")
        t = leagues.select(F.col("league_id").alias("l_id"), "tier")
        pro = pro.join(t, league == F.col("l_id"), "left").where(rules.display_tier(F.col("valve_tier"), F.col("tier")).isin(*tiers))
    # maps are few against predictions: they are looked up by id, and none is grouped to find the newest
    newest = m.join(pro.select("match_id"), "match_id", "left_semi").withColumnRenamed("league_id", "m_league").orderBy(F.col("start_time").desc_nulls_last(), F.col("match_id").desc()).limit(limit)
    of = p.join(F.broadcast(newest.select("match_id")), "match_id")  # at most ``limit`` ids
    per_minute = of.groupBy("match_id", "minute").agg(F.max("p_radiant").alias("p"), F.max("predicted_at").alias("at"), F.max("model_version").alias("version"))
    tenth = F.min_by(F.struct("minute", "p", "version"), F.when(F.col("minute").between(10, 14), F.col("minute")))
    curves = per_minute.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("minute", "p"))).alias("curve"), tenth.alias("tenth"))
    facts = of.groupBy("match_id").agg(F.max("p_league").alias("p_league"), F.max("valve_tier").alias("valve_tier"))
    out = newest.join(curves, "match_id").join(facts, "match_id").withColumn("league_id", F.coalesce("m_league", "p_league"))
    out = out.join(leagues.select("league_id", "tier"), "league_id", "left")
    return out.select("match_id", "start_time", "radiant_win", "league_id", rules.display_tier(F.col("valve_tier"), F.col("tier")).alias("tier"), "tenth", thin(F.col("curve")).alias("curve"))


def players_of(match_players: DataFrame, heroes: DataFrame, players: DataFrame) -> DataFrame:
    """Players with names (Q09, Q12); a card sorts its own by player_slot."""
    h = heroes.select("hero_id", F.col("localized_name").alias("hero_name"), F.col("image_path").alias("hero_image"))
    return match_players.join(h, "hero_id", "left").join(players.select("account_id", F.col("name").alias("player_name")), "account_id", "left")


def draft_of(match_drafts: DataFrame, heroes: DataFrame) -> DataFrame:
    """Picks and bans with names (Q10); a card sorts its own by order."""
    h = heroes.select("hero_id", F.col("localized_name").alias("hero_name"))
    return match_drafts.join(h, "hero_id", "left").withColumn("is_radiant", F.col("team") == 0)


def timeline_of(match_objectives: DataFrame) -> DataFrame:
    """Events a card shows (Q11), which it sorts by time and ordinal. Of a building, the side that lost it."""
    kind, b = rules.timeline_kind(F.col("type"), F.col("key")), rules.building(F.col("key"))
    side = F.when(F.col("type") == "building_kill", b["is_radiant"]).otherwise(F.col("team") == 2)
    out = match_objectives.select("match_id", "ordinal", "time", rules.game_minute(F.col("time")).alias("minute"), kind.alias("kind"), side.alias("is_radiant"), F.when(F.col("type") == "building_kill", b["lane"]).alias("lane"))
    return out.where("kind IS NOT NULL")


def match_card(match_id: int, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the match with arrays of players, draft, timeline and curve."""
    one = lambda name: tables[name].where(F.col("match_id") == match_id)
    rows = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))  # noqa: E731  rows of one match
    players = rows(players_of(one("match_players"), tables["heroes"], tables["players"]).select("player_slot", "is_radiant", "account_id", "player_name", "hero_name", "kills", "deaths", "assists"), "players")
    draft = rows(draft_of(one("match_drafts"), tables["heroes"]).select("order", "is_pick", "is_radiant", "hero_name"), "draft")
    timeline = rows(timeline_of(one("match_objectives")).select("time", "ordinal", "minute", "kind", "is_radiant", "lane"), "timeline")
    curve = rows(one("predictions").groupBy("minute").agg(F.max("p_radiant").alias("p")), "curve")
    out = one("matches")
    for part in (players, draft, timeline, curve):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


def public_feed(entries: DataFrame, tier: str | None = None) -> DataFrame:
    """Live entries of professional leagues (Q13), best known teams first, else as they came."""
    out = entries.where(rules.is_pro(F.col("valve_tier")))
    if tier:
        out = out.where(F.col("tier") == tier)
    return out.orderBy(F.col("team_history").desc(), "position")


def calendar(leagues: DataFrame, matches: DataFrame, stages: DataFrame, live: DataFrame, now: Column, status: str = "all") -> DataFrame:
    """Leagues with span, maps, stages and status."""
    played = matches.where("league_id IS NOT NULL").groupBy("league_id").agg(F.min("start_time").alias("first_at"), F.max("start_time").alias("last_at"), F.count(F.lit(1)).alias("maps"))
    n_stages = stages.groupBy("league_id").agg(F.count(F.lit(1)).alias("stages"))
    on = live.select("league_id").distinct().withColumn("live", F.lit(True))
    out = leagues.join(played, "league_id").join(n_stages, "league_id", "left").join(on, "league_id", "left")
    out = out.withColumns({"stages": F.coalesce("stages", F.lit(0)), "status": rules.tournament_status(F.col("last_at"), now, F.coalesce("live", F.lit(False)))}).drop("live")
    return out if status == "all" else out.where(F.col("status") == status)


def series_results(series: DataFrame, matches: DataFrame, now: Column) -> DataFrame:
    """Series with maps in order of play and the outcome, recorded or read off the maps."""
    at = F.struct(F.col("start_time").isNull().alias("none"), F.col("start_time").alias("t"), F.col("match_id").alias("id"))
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("match_id").isNotNull(), at))), lambda x: x["id"])
    m = matches.where("series_id IS NOT NULL").groupBy("series_id").agg(F.min("start_time").alias("played_at"), F.max("start_time").alias("last_at"), F.count("match_id").alias("maps"), ids.alias("match_ids"))
    s = series.join(m, "series_id", "left").withColumns({"maps": F.coalesce("maps", F.lit(0)), "match_ids": F.coalesce("match_ids", F.array().cast("array<bigint>"))})
    inferred = F.col("winner_team_id").isNull() & ~F.coalesce("is_draw", F.lit(False)) & rules.settled(F.col("score_a"), F.col("score_b"), F.col("last_at"), now)
    return s.withColumns({
        "outcome_source": F.when(F.col("winner_team_id").isNotNull(), "recorded").when(inferred, "maps"),
        "winner_team_id": F.when(inferred, F.when(F.col("score_a") > F.col("score_b"), F.col("team_a_id")).otherwise(F.col("team_b_id"))).otherwise(F.col("winner_team_id")),
    })


def participants(results: DataFrame) -> DataFrame:
    """Teams of each league with series and maps won and lost.

    results: league_id and the columns of ``series_results``. place: by series won, fewest lost,
    map difference, then first appearance.
    """
    won, draw = F.col("winner_team_id"), F.coalesce("is_draw", F.lit(False))
    side = lambda a, b, n: F.struct(F.col(f"team_{a}_id").alias("team_id"), F.col(f"score_{a}").alias("own"), F.col(f"score_{b}").alias("other"), F.lit(n).alias("side"))
    t = results.select("league_id", "series_id", "played_at", won.alias("winner"), draw.alias("draw"), F.explode(F.array(side("a", "b", 0), side("b", "a", 1))).alias("t")).select("*", "t.*").where("team_id IS NOT NULL")
    tally = t.groupBy("league_id", "team_id").agg(
        F.count_if(~F.col("draw") & (F.col("winner") == F.col("team_id"))).alias("series_won"), F.count_if(~F.col("draw") & (F.col("winner") != F.col("team_id"))).alias("series_lost"),
        F.count_if("draw").alias("series_drawn"), F.sum("own").alias("maps_won"), F.sum("other").alias("maps_lost"), F.min(F.struct(F.col("played_at").isNull(), "played_at", "series_id", "side")).alias("seen"),
    )
    order = Window.partitionBy("league_id").orderBy(F.col("series_won").desc(), "series_lost", (F.col("maps_won") - F.col("maps_lost")).desc(), "seen", "team_id")
    return tally.withColumn("place", F.row_number().over(order)).drop("seen")


def tournament_detail(league_id: int, leagues: DataFrame, matches: DataFrame, series: DataFrame, stages: DataFrame, now: Column) -> DataFrame:
    """One row: span and counts of a league, stages with their series, participants."""
    of = lambda df: df.where(F.col("league_id") == league_id)
    span = of(matches).agg(F.min("start_time").alias("first_at"), F.max("start_time").alias("last_at"), F.count(F.lit(1)).alias("maps"))
    counts = of(series).agg(F.count(F.lit(1)).alias("series"), F.count_if("is_draw").alias("draws"), F.count_if(F.col("format").isNull()).alias("without_format"))
    per_stage = of(stages).join(of(series).groupBy("stage_id").agg(F.count(F.lit(1)).alias("n_series")), "stage_id", "left").agg(F.array_sort(F.collect_list(F.struct("starts_at", "stage_id", "name", F.coalesce("n_series", F.lit(0)).alias("n_series")))).alias("stages"))
    teams = participants(series_results(of(series), of(matches), now)).agg(F.array_sort(F.collect_list(F.struct("place", "team_id", "series_won", "series_lost", "series_drawn"))).alias("participants"))
    out = of(leagues)
    for part in (span, counts, per_stage, teams):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


def unresolved(predictions: DataFrame, matches: DataFrame, raw: DataFrame, now: Column) -> DataFrame:
    """Predicted matches without result and without payload, over ten minutes old."""
    decided = matches.where("radiant_win IS NOT NULL").select("match_id")
    fetched = raw.where(F.col("source").isin("stratz_match", "opendota_match")).select("match_id")
    newest = predictions.groupBy("match_id").agg(F.max("predicted_at").alias("last_at"))  # one row a match before anything is joined
    left = newest.join(decided, "match_id", "left_anti").join(fetched, "match_id", "left_anti")
    return left.where(now.cast("timestamp").cast("double") - F.col("last_at").cast("timestamp").cast("double") > 600).select("match_id")


def missing_details(matches: DataFrame, raw: DataFrame, source: str, limit: int, newest_first: bool = True) -> DataFrame:
    """The next matches to fetch (Q19, J15, D08; a top-k)."""
    left = matches.join(raw.where(F.col("source") == source).select("match_id"), "match_id", "left_anti")
    order = F.col("start_time").desc_nulls_last() if newest_first else F.col("start_time").asc_nulls_last()
    return left.orderBy(order, F.col("match_id").desc() if newest_first else F.col("match_id")).select("match_id").limit(limit)


def league_context(leagues: DataFrame, stages: DataFrame, now: Column) -> DataFrame:
    """league_id, tiers and the format of the stage that runs now, the last to start."""
    running = stages.where((F.col("starts_at") <= now) & (now <= F.col("ends_at"))).groupBy("league_id").agg(F.max_by("default_format", F.struct("starts_at", "stage_id")).alias("format"))
    return leagues.select("league_id", "name", "tier", "valve_tier", "is_lan").join(running, "league_id", "left")


def team_history(matches: DataFrame) -> DataFrame:
    """team_id, maps."""
    sides = matches.select(F.explode(F.array("radiant_team_id", "dire_team_id")).alias("team_id"))
    return sides.where("team_id > 0").groupBy("team_id").agg(F.count(F.lit(1)).alias("maps"))


def newest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest live payload of each match."""
    return snapshots.groupBy("match_id").agg(F.max_by("payload", F.struct("captured_at", "id")).alias("payload"))


def backfill_segments(predictions: DataFrame, snapshots: DataFrame, leagues: DataFrame) -> DataFrame:
    """predictions whose missing league and tier are filled from payloads and leagues."""
    known = F.nullif(F.get_json_object("payload", "$.league_id"), F.lit("0")).cast("long")
    n = newest_snapshot(snapshots).select("match_id", known.alias("snap_league"))
    out = predictions.join(n, "match_id", "left").withColumn("league_id", F.coalesce("league_id", "snap_league"))
    out = out.join(leagues.select("league_id", F.col("valve_tier").alias("now_tier")), "league_id", "left").withColumn("valve_tier", F.coalesce("valve_tier", "now_tier"))
    return out.select(*predictions.columns)
