"""Finished maps unrolled to one row a minute, and the feature vector (T*, F01-F10).

No row of minute m reads an event after m: buildings count events before (m + 1) minutes,
kills up to m minutes, series are clamped to their last value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

# The feature vector in its order, and the block that the pre-match sweep owns.
FEATURES = (
    "minute", "log_minute", "gold_adv", "gold_adv_norm", "tower_diff", "barracks_diff", "radiant_towers", "dire_towers", "kill_diff", "net_worth_diff",
    "radiant_nw_spread", "dire_nw_spread", "is_lan", "is_lan_known", "series_format_known", "game_in_series", "is_conditional_game", "series_len",
    "series_wins_diff", "prematch_prior", "skill_diff", "skill_sigma_sum", "established_diff", "form_diff", "h2h_advantage", "draft_advantage",
    "rest_days_diff", "maps_last_24h_diff",
)
PREMATCH = FEATURES[20:] + ("prematch_prior",)
SERVED = FEATURES[:19]
# Buildings of a whole base.
FULL = {("tower", "top"): 3, ("tower", "mid"): 3, ("tower", "bot"): 3, ("tower", "base"): 2, ("barracks", "top"): 2, ("barracks", "mid"): 2, ("barracks", "bot"): 2}
KINDS = {"tower": "towers", "barracks": "barracks"}
AEGIS_SECONDS, ROSHAN_SECONDS = 300, 570


def spread(values: Column) -> Column:
    """Population standard deviation of an array, 0 under two values."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    squares = F.get(F.transform(F.array(total / n), lambda mean: F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))), F.lit(0))  # the mean is found once, not for each value
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(squares / n))


def minutes(duration: Column) -> Column:
    """0 to duration // 60, both included."""
    return F.sequence(F.lit(0), F.floor(duration / 60).cast("int"))


def _with_falls(d: DataFrame, kills: Column) -> DataFrame:
    """``d`` with radiant_towers_at, ..., dire_barracks_at: when the buildings of a side and kind fell, in no order.

    kills: array of struct(time, b); b is struct(is_radiant, kind, lane), or null where it was no building.
    A lane loses no more than it has, so of its kills only that many first ones count.
    """
    known = F.filter(F.coalesce(kills, F.array().cast("array<struct<time:int,b:struct<is_radiant:boolean,kind:string,lane:string>>>")), lambda k: k["b"].isNotNull() & k["time"].isNotNull())
    d = d.withColumn("_kills", F.sort_array(F.transform(known, lambda k: F.struct(k["b"].alias("b"), k["time"].alias("time")))))
    full = lambda b: rules.lookup(F.concat_ws(" ", b["kind"], b["lane"]), {f"{kind} {lane}": n for (kind, lane), n in FULL.items()})
    d = d.withColumn("_kills", F.filter("_kills", lambda k, i: ~F.coalesce(F.get("_kills", i - full(k["b"]))["b"] == k["b"], F.lit(False))))
    at = lambda radiant, kind: F.transform(F.filter("_kills", lambda k: (k["b"]["is_radiant"] == radiant) & (k["b"]["kind"] == kind)), lambda k: k["time"])
    return d.withColumns({f"{side}_{name}_at": at(side == "radiant", kind) for side in ("radiant", "dire") for kind, name in KINDS.items()}).drop("_kills")


def _standing(side: str, kind: str) -> Column:
    """Buildings of a side and kind that stand at the end of the row's minute."""
    return F.lit(sum(n for (k, _), n in FULL.items() if k == kind)) - F.size(F.filter(f"{side}_{KINDS[kind]}_at", lambda t: t < (F.col("minute") + 1) * 60))


def _side_columns(side: str) -> dict[str, Column]:
    """State of a side at the row's minute, from its worths at it and the times of its kills and falls."""
    return {
        f"{side}_score": F.array_size(F.filter(f"{side}_kills_at", lambda t: t <= F.col("minute") * 60)), f"{side}_worths": F.col(f"{side}_worths"),
        f"{side}_net_worth": F.aggregate(f"{side}_worths", F.lit(0).cast("long"), lambda a, v: a + v),
        f"{side}_towers": _standing(side, "tower"), f"{side}_barracks": _standing(side, "barracks"), f"{side}_picks": F.col(f"{side}_picks"),
    }


def _by_minute(d: DataFrame, duration: str, curve, times) -> DataFrame:
    """A row for each minute of maps whose sides' players are radiant_own and dire_own.

    What does not change over a map is laid out once, before the minutes. curve, times: a player's worth by minute, and its kills.
    """
    both = ("radiant", "dire")
    none = F.array().cast("array<int>")
    d = d.withColumns({f"{s}_curves": F.transform(f"{s}_own", curve) for s in both} | {f"{s}_kills_at": F.flatten(F.transform(f"{s}_own", lambda p: F.coalesce(times(p), none))) for s in both})
    m = d.withColumn("minute", F.explode(minutes(F.col(duration))))
    return m.withColumns({f"{s}_worths": F.transform(f"{s}_curves", lambda c: rules.at_minute(c, F.col("minute"))) for s in both})


def snapshots_b(details: DataFrame) -> DataFrame:
    """Minute rows of parsed maps of the training source (columns of schemas.DETAIL_B)."""
    d = details.where((F.coalesce("parsedDateTime", F.lit(0)) != 0) & (F.size("radiantNetworthLeads") > 0))
    d = _with_falls(d, F.transform("towerDeaths", lambda e: F.struct(e["time"].alias("time"), rules.building_of_npc(e["npcId"]).alias("b"))))
    own = lambda radiant: F.filter("players", lambda p: F.coalesce(p["isRadiant"], F.lit(False)) == radiant)
    picks = lambda radiant: F.filter(F.transform(F.filter("pickBans", lambda e: e["isPick"] & (e["isRadiant"] == radiant)), lambda e: e["heroId"]), lambda h: h > 0)
    d = d.withColumns({f"{s}_{n}": f(s == "radiant") for s in ("radiant", "dire") for n, f in (("own", own), ("picks", picks))})
    m = _by_minute(d, "durationSeconds", lambda p: p["stats"]["networthPerMinute"], lambda p: F.transform(p["stats"]["killEvents"], lambda e: e["time"]))
    lead = rules.at_minute(F.col("radiantNetworthLeads"), F.col("minute"), 1)
    return m.select(F.col("id").alias("match_id"), "minute", F.col("didRadiantWin").alias("radiant_win"), lead.alias("gold_adv"), *[c.alias(n) for s in ("radiant", "dire") for n, c in _side_columns(s).items()])


def snapshots_a(details: DataFrame) -> DataFrame:
    """Minute rows of parsed maps of the other source (columns of schemas.DETAIL_A), with Roshan's state."""
    d = details.where(F.col("version").isNotNull())
    d = _with_falls(d, F.transform(F.filter("objectives", lambda e: e["type"] == "building_kill"), lambda e: F.struct(e["time"].alias("time"), rules.building(e["key"]).alias("b"))))
    d = d.withColumns({
        "roshans_at": F.transform(F.filter("objectives", lambda e: e["type"] == "CHAT_MESSAGE_ROSHAN_KILL"), lambda e: e["time"]),
        "aegises": F.transform(F.filter("objectives", lambda e: e["type"].isin("CHAT_MESSAGE_AEGIS", "CHAT_MESSAGE_AEGIS_STOLEN")), lambda e: F.struct(e["time"].alias("time"), e["team"].alias("team"))),
    })
    own = lambda radiant: F.filter("players", lambda p: (p["player_slot"] < 128) == radiant)
    d = d.withColumns({f"{s}_own": own(s == "radiant") for s in ("radiant", "dire")})
    d = d.withColumns({f"{s}_picks": F.filter(F.transform(f"{s}_own", lambda p: p["hero_id"]), lambda h: h > 0) for s in ("radiant", "dire")})
    m = _by_minute(d, "duration", lambda p: p["gold_t"], lambda p: F.transform(p["kills_log"], lambda e: e["time"]))
    now = (F.col("minute") + 1) * 60
    m = m.withColumns({"roshan": F.filter("roshans_at", lambda t: t < now), "aegis": F.try_element_at(F.filter("aegises", lambda e: e["time"] < now), F.lit(-1))})
    left = F.try_element_at("roshan", F.lit(-1)) + ROSHAN_SECONDS - now
    return m.select(
        "match_id", "minute", "radiant_win", rules.at_minute(F.col("radiant_gold_adv"), F.col("minute")).alias("gold_adv"), *[c.alias(n) for s in ("radiant", "dire") for n, c in _side_columns(s).items()],
        F.size("roshan").alias("roshan_kills"), F.when(now - F.col("aegis.time") <= AEGIS_SECONDS, F.col("aegis.team") == 2).alias("aegis_is_radiant"),
        F.when(left > 0, left).alias("roshan_respawn_in"),
    )


def snapshots_live(games: DataFrame) -> DataFrame:
    """One row per live game whose scoreboard has both sides (schemas.LIVE; T24, T25, T27).

    The feed gives no lead: it is the difference of net worths. Buildings come as bit masks.
    """
    g = games.where(F.col("scoreboard.radiant").isNotNull() & F.col("scoreboard.dire").isNotNull())

    def side(name: str) -> dict[str, Column]:
        s = F.col("scoreboard")[name]
        worth = F.transform(s["players"], lambda p: F.coalesce(p["net_worth"], F.lit(0)))
        summed = F.coalesce(F.aggregate(worth, F.lit(0).cast("long"), lambda a, v: a + v), F.lit(0).cast("long"))
        return {
            f"{name}_score": F.coalesce(s["score"], F.lit(0)), f"{name}_worths": worth, f"{name}_net_worth": F.coalesce(F.nullif(s["net_worth"], F.lit(0)).cast("long"), summed),
            f"{name}_towers": rules.towers_of_mask(s["tower_state"]), f"{name}_barracks": rules.barracks_of_mask(s["barracks_state"]), f"{name}_picks": s["picks_hero_ids"],
            f"{name}_accounts": F.filter(F.transform(s["players"], lambda p: p["account_id"]), lambda a: a > 0),
        }

    made = g.select(
        "match_id", F.floor(F.greatest(F.coalesce("scoreboard.duration", F.lit(0.0)), F.lit(0.0)) / 60).cast("int").alias("minute"), F.lit(None).cast("boolean").alias("radiant_win"),
        *[c.alias(n) for s in ("radiant", "dire") for n, c in side(s).items()], F.col("radiant_series_wins"), F.col("dire_series_wins"), rules.none_if_zero(F.col("league_id")).alias("league_id"),
        F.col("radiant_team.team_id").alias("radiant_team_id"), F.col("dire_team.team_id").alias("dire_team_id"), F.coalesce("stream_delay_s", F.lit(0)).alias("stream_delay_s"),
    )
    return made.withColumn("gold_adv", F.col("radiant_net_worth") - F.col("dire_net_worth"))


def snapshots_realtime(stats: DataFrame) -> DataFrame:
    """One row per realtime sample (schemas.REALTIME; T23, T26): the last graph point, else the difference."""

    def team(number: int) -> Column:
        return F.get(F.filter("teams", lambda t: t["team_number"] == number), F.lit(0))

    def left(number: int, kind: int) -> Column:
        return F.size(F.filter("buildings", lambda b: (b["team"] == number) & (b["type"] == kind) & ~F.coalesce(b["destroyed"], F.lit(False))))

    r, d = team(2), team(3)
    graph = F.try_element_at("graph_data.graph_gold", F.lit(-1))
    return stats.select(
        F.col("match.matchid").alias("match_id"), rules.game_minute(F.col("match.game_time")).alias("minute"), F.coalesce(graph, r["net_worth"] - d["net_worth"]).alias("gold_adv"),
        r["score"].alias("radiant_score"), d["score"].alias("dire_score"), r["net_worth"].alias("radiant_net_worth"), d["net_worth"].alias("dire_net_worth"),
        left(2, 0).alias("radiant_towers"), left(3, 0).alias("dire_towers"), left(2, 1).alias("radiant_barracks"), left(3, 1).alias("dire_barracks"),
        F.transform(r["players"], lambda p: p["net_worth"]).alias("radiant_worths"), F.transform(d["players"], lambda p: p["net_worth"]).alias("dire_worths"),
    )


def feature_columns(df: DataFrame) -> list[Column]:
    """The 28 features from whichever state columns ``df`` has; unknown ones take their defaults."""
    has = set(df.columns)
    get = lambda n, default: F.coalesce(F.col(n).cast("double"), F.lit(float(default))) if n in has else F.lit(float(default))
    minute, gold = F.col("minute").cast("double"), F.col("gold_adv").cast("double")
    diff = lambda n: (F.col(f"radiant_{n}") - F.col(f"dire_{n}")).cast("double")
    fmt = F.col("format") if "format" in has else F.lit(None).cast("string")
    made = {
        "minute": minute, "log_minute": F.log(minute + 1), "gold_adv": gold, "gold_adv_norm": gold / (minute + 5.0),
        "tower_diff": diff("towers"), "barracks_diff": diff("barracks"), "radiant_towers": F.col("radiant_towers").cast("double"), "dire_towers": F.col("dire_towers").cast("double"),
        "kill_diff": diff("score"), "net_worth_diff": diff("net_worth"), "radiant_nw_spread": spread(F.col("radiant_worths")), "dire_nw_spread": spread(F.col("dire_worths")),
        "is_lan": get("is_lan", 0), "is_lan_known": F.col("is_lan").isNotNull().cast("double") if "is_lan" in has else F.lit(0.0),
        "series_format_known": fmt.isNotNull().cast("double"), "game_in_series": get("game_in_series", 1), "is_conditional_game": get("is_conditional_game", 0),
        "series_len": rules.lookup(F.coalesce(fmt, F.lit("bo1")), rules.MAX_GAMES).cast("double"), "series_wins_diff": get("radiant_series_wins", 0) - get("dire_series_wins", 0),
        "prematch_prior": get("prematch_prior", 0.5),
    } | {n: get(n, 0) for n in FEATURES[20:]}
    return [made[n].alias(n) for n in FEATURES]


def features(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[c for c in keep if c not in FEATURES], *feature_columns(df))


def serving_view(df: DataFrame) -> DataFrame:
    """What a live model would see: the pre-match block at its defaults."""
    return df.withColumns({n: F.lit(0.5 if n == "prematch_prior" else 0.0) for n in PREMATCH})


def skip_reason() -> Column:
    """Why a map of the training source is not used, null where it is."""
    return (
        F.when(F.col("id").isNull(), "no match_id").when((F.coalesce("parsedDateTime", F.lit(0)) == 0) | (F.coalesce(F.size("radiantNetworthLeads"), F.lit(0)) <= 0), "not parsed")
        .when(F.col("didRadiantWin").isNull(), "no outcome to label with").otherwise(rules.ineligible_reason(F.col("durationSeconds"), F.col("players"), F.col("radiantTeamId"), F.col("direTeamId")))
    )


def eligible(details: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to use, count of rows by reason) of maps of the training source, those of ``known`` (id) alone if given.

    The reason is found before rows meet ``known``, so that the count moves reasons and not whole maps.
    """
    marked = details.withColumn("skip_reason", skip_reason())
    of = lambda df: df if known is None else df.join(known, "id", "left_semi")
    return of(marked.where(F.col("skip_reason").isNull()).drop("skip_reason")), of(marked.select("id", "skip_reason")).groupBy("skip_reason").count()
