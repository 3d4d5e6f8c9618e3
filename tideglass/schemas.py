"""Declared schemas of the stored tables and of the JSON payloads; nothing is ever inferred."""

from __future__ import annotations

# Column names and types of the stored tables.
TABLES = {
    "raw_matches": "id long, match_id long, source string, fetched_at timestamp, payload string",
    "raw_live_snapshots": "id long, match_id long, server_steam_id long, source string, captured_at timestamp, payload string",
    "raw_liquipedia": "id long, slug string, fetched_at timestamp, payload string",
    "ingest_checkpoints": "source string, cursor string, updated_at timestamp",
    "leagues": "league_id long, name string, liquipedia_slug string, tier string, is_lan boolean, prize_pool decimal(12,2), organizer string, region string, start_date date, end_date date, valve_tier string",
    "tournament_stages": "stage_id long, league_id long, name string, stage_type string, default_format string, points_rule string, liquipedia_slug string, starts_at timestamp, ends_at timestamp",
    "teams": "team_id long, name string, tag string, logo_url string",
    "heroes": "hero_id int, name string, localized_name string, primary_attr string, attack_type string, roles array<string>, image_path string",
    "players": "account_id long, name string, country string, fantasy_role int",
    "team_rosters": "id long, team_id long, account_id long, valid_from timestamp, valid_to timestamp, is_standin boolean",
    "league_mappings": "id long, league_id long, slug string, tier string, is_lan boolean, score double, decided_by string, decided_at timestamp, superseded_at timestamp, note string",
    "series": "series_id long, valve_series_id long, league_id long, stage_id long, team_a_id long, team_b_id long, format string, score_a int, score_b int, winner_team_id long, is_draw boolean, scheduled_at timestamp, valve_series_type int",
    "matches": "match_id long, league_id long, series_id long, game_in_series int, is_conditional_game boolean, radiant_team_id long, dire_team_id long, radiant_win boolean, start_time timestamp, duration int, is_parsed boolean, patch int",
    "match_players": "match_id long, player_slot int, account_id long, hero_id int, is_radiant boolean, lane_role int, kills int, deaths int, assists int, last_hits int, denies int, net_worth int, gold_per_min int, xp_per_min int, leaver_status int, is_standin boolean",
    "match_drafts": "match_id long, order int, is_pick boolean, hero_id int, team int",
    "match_objectives": "match_id long, ordinal int, time int, type string, team int, key string, player_slot int",
    "match_snapshots": "match_id long, minute int, features map<string,double>, radiant_win boolean",
    "player_ratings": "account_id long, as_of_match_id long, as_of_time timestamp, mu double, sigma double, games long",
    "team_features": "id long, team_id long, as_of_time timestamp, features map<string,double>",
    "match_prematch": "match_id long, features map<string,double>, prematch_prior double, computed_at timestamp",
    "predictions": "match_id long, minute int, predicted_at timestamp, model_version string, p_radiant double, features map<string,double>, league_id long, valve_tier string",
}

# Fields of the JSON payloads of the four channels.
SUMMARY = (
    "match_id long, leagueid long, league_name string, series_id long, series_type int, radiant_team_id long, radiant_name string, "
    "dire_team_id long, dire_name string, radiant_win boolean, start_time long, duration int, version int"
)
DETAIL_A = (
    "match_id long, radiant_win boolean, duration int, start_time long, patch int, version int, radiant_gold_adv array<int>, radiant_xp_adv array<int>, "
    "tower_status_radiant int, tower_status_dire int, barracks_status_radiant int, barracks_status_dire int, "
    "players array<struct<player_slot:int,account_id:long,hero_id:int,lane_role:int,kills:int,deaths:int,assists:int,last_hits:int,denies:int,"
    "net_worth:int,gold_per_min:int,xp_per_min:int,leaver_status:int,gold_t:array<int>,xp_t:array<int>,kills_log:array<struct<time:int,key:string>>>>, "
    "picks_bans array<struct<order:int,is_pick:boolean,hero_id:int,team:int>>, "
    "objectives array<struct<time:int,type:string,key:string,team:int,player_slot:int,slot:int,unit:string,value:int,killer:int>>"
)
DETAIL_B = (
    "id long, didRadiantWin boolean, durationSeconds int, startDateTime long, endDateTime long, parsedDateTime long, leagueId long, radiantTeamId long, direTeamId long, "
    "gameVersionId int, seriesId long, radiantNetworthLeads array<int>, radiantExperienceLeads array<int>, "
    "pickBans array<struct<order:int,isPick:boolean,heroId:int,bannedHeroId:int,isRadiant:boolean>>, "
    "players array<struct<steamAccountId:long,heroId:int,isRadiant:boolean,playerSlot:int,kills:int,deaths:int,assists:int,numLastHits:int,numDenies:int,networth:int,"
    "goldPerMinute:int,experiencePerMinute:int,leaverStatus:string,lane:string,stats:struct<networthPerMinute:array<int>,killEvents:array<struct<time:int>>>>>, "
    "towerDeaths array<struct<time:int,npcId:int,isRadiant:boolean>>"
)
_LIVE_PLAYER = "struct<player_slot:int,account_id:long,hero_id:int,kills:int,death:int,assists:int,last_hits:int,denies:int,net_worth:int,gold_per_min:int,xp_per_min:int,level:int>"
_LIVE_SIDE = (
    f"struct<score:int,tower_state:int,barracks_state:int,net_worth:int,picks:array<struct<hero_id:int>>,bans:array<struct<hero_id:int>>,picks_hero_ids:array<int>,players:array<{_LIVE_PLAYER}>>"
)
_LIVE_TEAM = "struct<team_id:long,team_name:string>"
LIVE = (
    "match_id long, league_id long, server_steam_id long, stream_delay_s int, series_id long, series_type int, radiant_series_wins int, dire_series_wins int, "
    f"radiant_team {_LIVE_TEAM}, dire_team {_LIVE_TEAM}, scoreboard struct<duration:double,roshan_respawn_timer:int,radiant:{_LIVE_SIDE},dire:{_LIVE_SIDE}>"
)
REALTIME = (
    "match struct<matchid:long,server_steam_id:long,game_time:int>, teams array<struct<team_number:int,score:int,net_worth:int,players:array<struct<net_worth:int>>>>, "
    "buildings array<struct<team:int,type:int,lane:int,tier:int,destroyed:boolean>>, graph_data struct<graph_gold:array<int>>"
)
HERO = "id int, name string, localized_name string, primary_attr string, attack_type string, roles array<string>, img string"
PRO_PLAYER = "account_id long, name string, personaname string, loccountrycode string, fantasy_role int"
LEAGUE = "leagueid long, name string, tier string"
WIKI_SEARCH = "query struct<search:array<struct<title:string>>>"
WIKI_FACTS = "query struct<pages:map<string,struct<title:string,categories:array<struct<title:string>>,pageprops:struct<metadescl:string,displaytitle:string>>>>"
WIKI_PARSE = "parse struct<title:string,wikitext:map<string,string>>"


def part(ddl: str, *names: str) -> str:
    """The fields ``names`` of a declared schema; players.kills is a field of the structs of players.

    Text is read whole, but only these fields of it are made.
    """
    from pyspark.sql.types import ArrayType, StructType

    def keep(kind: StructType, of: set[str]) -> StructType:
        fields = []
        for f in kind.fields:
            inner = {n.split(".", 1)[1] for n in of if n.startswith(f"{f.name}.")}
            if inner:
                f.dataType = ArrayType(keep(f.dataType.elementType, inner)) if isinstance(f.dataType, ArrayType) else keep(f.dataType, inner)
            if inner or f.name in of:
                fields.append(f)
        return StructType(fields)

    fields = keep(StructType.fromDDL(ddl), set(names)).fields
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
