"""JSON payloads of the channels, made from the star schema by plain arithmetic on its keys.

They let the queries run the whole way from stored text to typed tables; the SQL of these queries
computes the same tables from the keys and never sees the JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as v

KEYS = ("npc_dota_goodguys_tower1_top", "npc_dota_badguys_tower1_mid", "npc_dota_goodguys_tower4", "npc_dota_badguys_melee_rax_bot", "npc_dota_goodguys_watch", "npc_dota_badguys_fort", "npc_dota_badguys_tower3_bot", "npc_dota_goodguys_range_rax_mid")
LANES = ("SAFE_LANE", "MID_LANE", "OFF_LANE", "JUNGLE", "ROAMING")
EVENTS = ("CHAT_MESSAGE_ROSHAN_KILL", "CHAT_MESSAGE_AEGIS", "building_kill", "CHAT_MESSAGE_FIRSTBLOOD", "CHAT_MESSAGE_AEGIS_STOLEN")


def _mod(c: Column, n: int) -> Column:
    return (c % n).cast("int")


def _each(n: Column, f) -> Column:
    """f(0), ..., f(n - 1)."""
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>")), f)


def _one_of(words: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), at)


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps of the star schema with their customer's key, dealt out by match.

    A text takes a hundred times as long to write and read as its keys, so the size of the files says little about
    the work; and texts of one match that are made where their keys are need not be moved to meet.
    """
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    m = v.matches(spark, sf_dir).repartition(tasks, "match_id")
    return m.withColumns({"k": F.col("match_id"), "c": F.col("series_id"), "epoch": F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("start_time"))})


def account(k: Column, c: Column, slot: Column) -> Column:
    """Ten accounts a customer, five a team; teams swap sides with the key. Slot 9 is sometimes unknown."""
    seat = _mod(slot + F.when(k % 2 == 0, 0).otherwise(5), 10)
    return F.when(~((k % 29 == 0) & (slot == 9)), c * 10 + seat)


def detail_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, source, payload of the training source."""
    k, c = F.col("k"), F.col("c")

    def player(s: Column) -> Column:
        return F.struct(
            account(k, c, s).alias("steamAccountId"), _mod(k + s * 11, 127).alias("heroId"), (s < 5).alias("isRadiant"), F.when(s < 5, s).otherwise(s + 123).alias("playerSlot"), _mod(k + s, 15).alias("kills"),
            _mod(k * 3 + s, 11).alias("deaths"), _mod(k + s * 7, 23).alias("assists"), _mod(k * s, 30000).alias("networth"), F.when((k % 23 == 0) & (s == 3), "ABANDONED").otherwise("NONE").alias("leaverStatus"),
            _one_of(LANES, _mod(k + s, 5)).alias("lane"),
            F.struct(
                _each(_mod(k + s, 8) + 8, lambda i: _mod(k + s * 31 + i * 97, 9000)).alias("networthPerMinute"),
                _each(F.lit(3), lambda j: F.struct(_mod(k * 11 + s * 37 + j * 401, 1300).alias("time"))).alias("killEvents"),
            ).alias("stats"),
        )

    leads = F.when(k % 17 == 0, F.lit(0)).otherwise(_mod(k, 8) + 10)
    payload = F.struct(
        k.alias("id"), F.col("radiant_win").alias("didRadiantWin"), (_mod(k * 7, 500) + 700).alias("durationSeconds"), F.col("epoch").alias("startDateTime"), F.when(k % 11 == 0, 0).otherwise(1).alias("parsedDateTime"),
        F.col("radiant_team_id").alias("radiantTeamId"), F.when(k % 13 > 0, F.col("dire_team_id")).alias("direTeamId"), _each(leads, lambda i: _mod(k * 7 + i * 13, 2001) - 1000).alias("radiantNetworthLeads"),
        _each(F.when(k % 19 == 0, 9).otherwise(10), player).alias("players"),
        _each(F.lit(10), lambda i: F.struct(i.alias("order"), (i % 2 == 0).alias("isPick"), F.when(i % 2 == 0, _mod(k + i * 3, 127)).alias("heroId"), F.when(i % 2 == 1, _mod(k + i * 5, 127)).alias("bannedHeroId"), (i % 4 < 2).alias("isRadiant"))).alias("pickBans"),
        _each(F.lit(14), lambda i: F.struct(_mod(k * 13 + i * 101, 1200).alias("time"), (_mod(k + i * 5, 36) + 16).alias("npcId"))).alias("towerDeaths"),
    )
    return maps(spark, sf_dir).select("match_id", F.lit("stratz_match").alias("source"), F.to_json(payload).alias("payload"))


def detail_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, source, payload of the other source."""
    k, c = F.col("k"), F.col("c")

    def player(s: Column) -> Column:
        return F.struct(
            F.when(s < 5, s).otherwise(s + 123).alias("player_slot"), account(k, c, s).alias("account_id"), _mod(k + s * 13, 127).alias("hero_id"), _mod(k + s * 2, 15).alias("kills"), _mod(k + s, 3).alias("lane_role"),
            _each(_mod(k + s, 8) + 8, lambda i: _mod(k + s * 31 + i * 97, 9000)).alias("gold_t"), _each(F.lit(3), lambda j: F.struct(_mod(k * 11 + s * 37 + j * 401, 1300).alias("time"))).alias("kills_log"),
        )

    kind = lambda i: _one_of(EVENTS, _mod(k + i, 5))
    event = lambda i: F.struct((i * 60 + _mod(k + i, 60)).alias("time"), kind(i).alias("type"), F.when(kind(i) == "building_kill", _one_of(KEYS, _mod(k + i * 3, 8))).alias("key"), (_mod(k + i, 2) + 2).alias("team"))
    payload = F.struct(
        k.alias("match_id"), F.col("radiant_win"), (_mod(k * 7, 500) + 700).alias("duration"), F.col("epoch").alias("start_time"), F.when(k % 5 > 0, 21).alias("version"), F.lit(58).alias("patch"),
        _each(_mod(k, 8) + 10, lambda i: _mod(k * 7 + i * 13, 2001) - 1000).alias("radiant_gold_adv"), _each(F.lit(10), player).alias("players"),
        _each(F.lit(8), lambda i: F.struct(i.alias("order"), (i % 2 == 1).alias("is_pick"), _mod(k + i * 3, 127).alias("hero_id"), _mod(i, 2).alias("team"))).alias("picks_bans"), _each(F.lit(16), event).alias("objectives"),
    )
    return maps(spark, sf_dir).select("match_id", F.lit("opendota_match").alias("source"), F.to_json(payload).alias("payload"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload of each map's summary; team names change with every third map."""
    k = F.col("k")
    name = lambda side: F.concat(F.lit("T"), F.col(side).cast("string"), F.lit("-"), (k % 3).cast("string"))
    payload = F.struct(
        k.alias("match_id"), F.col("league_id").alias("leagueid"), F.concat(F.lit("L"), k.cast("string")).alias("league_name"), (F.col("c") % 97).alias("series_id"), _mod(k, 3).alias("series_type"),
        F.when(k % 31 > 0, F.col("radiant_team_id")).otherwise(0).alias("radiant_team_id"), name("radiant_team_id").alias("radiant_name"), F.col("dire_team_id"), name("dire_team_id").alias("dire_name"),
        F.col("radiant_win"), F.col("epoch").alias("start_time"), (_mod(k * 7, 500) + 700).alias("duration"), F.when(k % 4 > 0, 21).alias("version"),
    )
    return maps(spark, sf_dir).select(F.to_json(payload).alias("payload"))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload of a running game for each customer."""
    c = v.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("n"))
    k = F.col("k")

    def side(shift: int) -> Column:
        heroes = _each(_mod(k + shift, 3), lambda i: F.struct(_mod(k + i * 7 + shift, 127).alias("hero_id")))
        players = _each(F.lit(5), lambda s: F.struct(s.alias("player_slot"), ((k * 7 + s * 3 + shift) % 2000).alias("account_id"), _mod(k + s + shift, 127).alias("hero_id"), _mod(k + s, 9).alias("kills"), _mod(k + s, 4).alias("death"), _mod(k * 5 + s * 211 + shift, 20000).alias("net_worth")))
        return F.struct(
            _mod(k + shift, 40).alias("score"), _mod(k * 37 + shift, 2048).alias("tower_state"), _mod(k * 11 + shift, 64).alias("barracks_state"), F.when(k % 3 > 0, _mod(k * 3 + shift, 50000)).otherwise(0).alias("net_worth"),
            heroes.alias("picks"), _each(_mod(k + shift, 2), lambda i: F.struct(_mod(k * 3 + shift, 127).alias("hero_id"))).alias("bans"), players.alias("players"),
        )

    team = lambda shift: F.struct(F.when(k % 9 > 0, k * 2 + shift).otherwise(0).alias("team_id"), F.when(k % 8 > 0, F.concat(F.lit("t"), (k * 2 + shift).cast("string"))).otherwise("").alias("team_name"))
    board = F.when(k % 7 > 0, F.struct((_mod(k * 17, 3000) - 60).cast("double").alias("duration"), side(0).alias("radiant"), F.when(k % 10 > 0, side(1)).alias("dire")))
    payload = F.struct(k.alias("match_id"), F.col("n").alias("league_id"), _mod(k, 200).alias("stream_delay_s"), _mod(k, 2).alias("radiant_series_wins"), _mod(k, 3).alias("dire_series_wins"), team(0).alias("radiant_team"), team(1).alias("dire_team"), board.alias("scoreboard"))
    return c.select(F.to_json(payload).alias("payload"))


def references(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One payload each of heroes (an object by id) and leagues (an array), and professional players in pages of a thousand."""
    n, k = v.read(spark, sf_dir, "nation"), F.col("n_nationkey").cast("int")
    hero = F.struct(k.alias("id"), F.when(k % 7 > 0, F.concat(F.lit("npc_"), F.lower("n_name"))).otherwise("").alias("name"), F.when(k % 3 > 0, F.col("n_name")).otherwise("").alias("localized_name"), F.lit("agi").alias("primary_attr"))
    league = F.struct(k.cast("long").alias("leagueid"), F.col("n_name").alias("name"), _one_of(("professional", "premium", "excluded", "amateur", "mystery"), _mod(k, 5)).alias("tier"))
    a = F.col("s_suppkey") % 60  # accounts repeat: the first entry counts
    pro = F.struct(F.col("s_suppkey").alias("place"), a.alias("account_id"), F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("n"), F.col("s_suppkey").cast("string"))).otherwise("").alias("name"), F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("personaname"), F.when(a % 2 == 0, "xx").otherwise("").alias("loccountrycode"), _mod(a, 3).alias("fantasy_role"))
    whole = lambda df, c: df.agg(F.to_json(F.array_sort(F.collect_list(c))).alias("payload"))  # noqa: E731  reference tables of nations
    return {
        "heroes": n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(k.cast("string"), hero)))).alias("payload")),
        "leagues": whole(n, league), "pro_players": v.read(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_suppkey") / 1000).alias("page")).agg(F.to_json(F.array_sort(F.collect_list(pro))).alias("payload")),
    }


def realtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload of a realtime sample for each supplier."""
    k = F.col("s_suppkey")
    team = lambda number: F.struct(F.lit(number).alias("team_number"), _mod(k * number, 50).alias("score"), _mod(k * number * 31, 40000).alias("net_worth"), _each(F.lit(5), lambda s: F.struct(_mod(k * 7 + s * 131 * number, 9000).alias("net_worth"))).alias("players"))
    building = lambda i: F.struct((F.lit(2) + i % 2).alias("team"), _mod(k + i, 3).alias("type"), _mod(i, 3).alias("lane"), _mod(i, 4).alias("tier"), (_mod(k + i, 4) == 0).alias("destroyed"))
    payload = F.struct(F.struct(k.alias("matchid"), (_mod(k * 37, 3000) - 90).alias("game_time")).alias("match"), F.array(team(2), team(3)).alias("teams"), _each(_mod(k, 18), building).alias("buildings"), F.struct(_each(_mod(k, 4), lambda i: _mod(k * 3 + i * 17, 5000) - 2500).alias("graph_gold")).alias("graph_data"))
    return v.read(spark, sf_dir, "supplier").select(F.to_json(payload).alias("payload"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, source, payload of results that arrived late, for every map of every third customer's series."""
    k = F.col("match_id")
    payload = F.struct(k.alias("match_id"), (k % 2 == 0).alias("radiant_win"), (_mod(k * 7, 500) + 700).alias("duration"))
    return v.matches(spark, sf_dir).select("match_id", F.when(F.col("series_id") % 3 == 0, "opendota_match").otherwise("steam").alias("source"), F.to_json(payload).alias("payload"))


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, page, year: a Format section for each part, with groups, two playoff parts and a prize."""
    k = F.col("p_partkey")
    fmt = lambda i: _one_of(("bo1", "bo2", "bo3", "bo5"), _mod(k + i, 4))
    page = F.concat(
        F.lit("intro {{abbr/bo1}}\n== Format ==\n*'''Group Stage''' (May "), (k % 20 + 1).cast("string"), F.lit(" - June "), (k % 9 + 1).cast("string"), F.lit(")\n** matches are {{Abbr/"), fmt(0), F.lit("}}, decider {{abbr/"), fmt(1), F.lit("}}\n"),
        F.lit("*'''Playoffs'''\n** Grand Final is {{abbr/bo5}}, all other matches are {{abbr/"), fmt(2), F.lit("}}\n**'''Lower Bracket''' {{abbr/"), fmt(3), F.lit("}}\n*'''Prize pool''' {{abbr/bo1}}\n==Teams==\n"),
    )
    return v.read(spark, sf_dir, "part").select(k.alias("page_id"), page.alias("page"), F.when(k % 5 > 0, 2020 + k % 5).cast("int").alias("year"))


def wiki_answers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Answers of the wiki for each part: a search of its name, facts of its page, its page's text."""
    k = F.col("p_partkey")
    p = v.read(spark, sf_dir, "part").select(k, "p_size", "p_brand")
    title = lambda c: F.concat(F.lit("Page/"), c.cast("string"))
    hits = F.struct(F.struct(_each(_mod(k, 8), lambda i: F.struct(title(k + i).alias("title"))).alias("search")).alias("query"))
    tier = F.concat(F.lit("Category:Tier "), (k % 4 + 1).cast("string"), F.lit(" Tournaments"))
    page = F.struct(F.when(k % 11 > 0, title(k)).alias("title"), F.when(k % 3 > 0, F.array(F.struct(tier.alias("title")), F.struct(F.lit("Category:Online Tournaments").alias("title")))).alias("categories"), F.struct(F.when(k % 2 == 0, F.concat(F.lit("tournament of "), F.col("p_brand"))).alias("metadescl")).alias("pageprops"))
    facts = F.struct(F.struct(F.create_map(k.cast("string"), page).alias("pages")).alias("query"))
    text = F.struct(F.struct(F.when(k % 7 > 0, title(k)).alias("title"), F.when(k % 5 > 0, F.create_map(F.lit("*"), F.concat(F.lit("text "), F.col("p_brand")))).alias("wikitext")).alias("parse"))
    return {"search": p.select(k.alias("league_id"), F.to_json(hits).alias("payload")), "facts": p.select(F.to_json(facts).alias("payload")), "text": p.select(F.to_json(text).alias("payload"))}
