"""Payloads to typed tables (P*): every function is one projection over a parsed payload frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..functions import rules
from .upserts import _as_order, latest_per_key, surrogate


def parse(raw: DataFrame, ddl: str, payload: str = "payload") -> DataFrame:
    """JSON text to columns of a declared schema; malformed text gives nulls.

    The columns come out of a generator, not a projection: filters on them stay above it, so that a
    text is read once, and not again for every filter that would be pushed below.
    """
    return raw.select(F.inline(F.array(F.from_json(payload, ddl))))


def match_id_of(payload: Column) -> Column:
    """The id of either dialect, as a number or as text of one; null where there is none."""
    v = F.try_parse_json(payload)
    return F.coalesce(F.try_variant_get(v, "$.match_id", "long"), F.try_variant_get(v, "$.id", "long"))


def parse_checked(raw: DataFrame, ddl: str, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(rows of the declared schema, the payloads that do not fit it: match_id, payload, reason).

    A payload fits if it is a JSON object whose known fields have their types; null and absent fields
    fit. One field of another type costs its own payload, with the field's name as the reason, and no other.
    """
    schema = StructType.fromDDL(ddl)
    text, v = F.col(payload), F.try_parse_json(payload)
    parsed = F.from_json(text, StructType([*schema.fields, StructField("_corrupt", StringType())]), {"columnNameOfCorruptRecord": "_corrupt"})
    present = lambda f: F.try_variant_get(v, f"$.{f.name}", "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(v, f"$.{f.name}", "variant"))
    wrong = F.concat_ws(", ", *[F.when(present(f) & F.try_variant_get(v, f"$.{f.name}", f.dataType.simpleString()).isNull(), f.name) for f in schema.fields])
    reason = (
        F.when(text.isNull(), "no payload").when(v.isNull(), "malformed JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "no JSON object")
        .when(parsed["_corrupt"].isNotNull(), F.concat(F.lit("field of another type: "), F.when(wrong == "", "nested").otherwise(wrong)))
    )
    marked = raw.select(text.alias("_payload"), parsed.alias("_p"), reason.alias("_reason"))
    bad = marked.where("_reason IS NOT NULL").select(match_id_of(F.col("_payload")).alias("match_id"), F.col("_payload").alias("payload"), F.col("_reason").alias("reason"))
    return marked.where("_reason IS NULL").select("_p.*").drop("_corrupt"), bad


def from_summaries(s: DataFrame) -> dict[str, DataFrame]:
    """leagues, teams, series and matches of summaries (schemas.SUMMARY; P01).

    The payload with the largest match_id names a league or team; the smallest pins a series' teams.
    """
    s = s.where(F.col("match_id").isNotNull()).withColumns({c: rules.none_if_zero(F.col(c)) for c in ("leagueid", "series_id", "radiant_team_id", "dire_team_id")})
    newest = lambda c: F.max_by(c, "match_id").alias(c)
    leagues = s.where("leagueid IS NOT NULL").groupBy(F.col("leagueid").alias("league_id")).agg(newest("league_name")).withColumnRenamed("league_name", "name")
    sides = F.array(*[F.struct(F.col(f"{x}_team_id").alias("team_id"), F.col(f"{x}_name").alias("name")) for x in ("radiant", "dire")])
    teams = s.select("match_id", F.explode(sides).alias("t")).select("match_id", "t.*").where("team_id IS NOT NULL")
    teams = teams.groupBy("team_id").agg(F.max_by("name", "match_id").alias("name"))
    oldest = lambda c, n: F.min_by(c, "match_id").alias(n)
    series = s.where("series_id IS NOT NULL AND leagueid IS NOT NULL").groupBy(F.col("leagueid").alias("league_id"), F.col("series_id").alias("valve_series_id")).agg(
        oldest("radiant_team_id", "team_a_id"), oldest("dire_team_id", "team_b_id"), oldest("series_type", "valve_series_type")
    )
    series = series.withColumn("series_id", surrogate("league_id", "valve_series_id"))
    matches = s.select(
        "match_id", F.col("leagueid").alias("league_id"), F.when(F.col("series_id").isNotNull() & F.col("leagueid").isNotNull(), surrogate("leagueid", "series_id")).alias("series_id"),
        "radiant_team_id", "dire_team_id", "radiant_win", rules.utc(F.col("start_time")).alias("start_time"), "duration", F.col("version").isNotNull().alias("is_parsed"),
    )
    return {"leagues": leagues, "teams": teams, "series": series, "matches": matches}


#: Columns of match_players, with the field of each source's players that they come from.
PLAYER_A = {c: c for c in ("player_slot", "account_id", "hero_id", "lane_role", "kills", "deaths", "assists", "last_hits", "denies", "net_worth", "gold_per_min", "xp_per_min", "leaver_status")} | {"is_radiant": "player_slot"}
PLAYER_B = {
    "player_slot": "playerSlot", "account_id": "steamAccountId", "hero_id": "heroId", "is_radiant": "isRadiant", "lane_role": "lane", "kills": "kills", "deaths": "deaths", "assists": "assists", "last_hits": "numLastHits",
    "denies": "numDenies", "net_worth": "networth", "gold_per_min": "goldPerMinute", "xp_per_min": "experiencePerMinute", "leaver_status": "leaverStatus",
}
PLAYERS = ("player_slot", "account_id", "hero_id", "is_radiant", "lane_role", "kills", "deaths", "assists", "last_hits", "denies", "net_worth", "gold_per_min", "xp_per_min", "leaver_status", "is_standin")


def players_a(d: DataFrame, columns: tuple[str, ...] = PLAYERS) -> DataFrame:
    p = d.select("match_id", F.explode("players").alias("p")).where("p.player_slot IS NOT NULL")
    made = {"is_radiant": lambda: F.col("p.player_slot") < 128, "is_standin": lambda: F.lit(False)}
    return p.select("match_id", *[(made[c]() if c in made else F.col(f"p.{c}")).alias(c) for c in columns])


def drafts_a(d: DataFrame) -> DataFrame:
    b = d.select("match_id", F.explode("picks_bans").alias("b")).where("b.order IS NOT NULL AND b.hero_id IS NOT NULL")
    return b.select("match_id", "b.order", "b.is_pick", "b.hero_id", "b.team")


def objectives_a(d: DataFrame) -> DataFrame:
    """An objective's ordinal is its place in the payload, before anything is filtered."""
    o = d.select("match_id", F.posexplode("objectives").alias("ordinal", "o")).where("o.type IS NOT NULL")
    return o.select("match_id", "ordinal", F.coalesce("o.time", F.lit(0)).alias("time"), "o.type", "o.team", rules.short_key(F.col("o.key")).alias("key"), "o.player_slot")


def matches_a(d: DataFrame) -> DataFrame:
    return d.select("match_id", "radiant_win", rules.utc(F.col("start_time")).alias("start_time"), "duration", F.col("version").isNotNull().alias("is_parsed"), "patch")


def players_b(d: DataFrame, columns: tuple[str, ...] = PLAYERS) -> DataFrame:
    p = d.select(F.col("id").alias("match_id"), F.explode("players").alias("p")).where("p.playerSlot IS NOT NULL")
    made = {
        "is_radiant": lambda: F.coalesce("p.isRadiant", F.lit(False)), "lane_role": lambda: rules.lookup(F.col("p.lane"), rules.LANES), "leaver_status": lambda: rules.lookup(F.col("p.leaverStatus"), rules.LEAVER),
        "is_standin": lambda: F.lit(False),
    }
    return p.select("match_id", *[(made[c]() if c in made else F.col(f"p.{PLAYER_B[c]}")).alias(c) for c in columns])


def drafts_b(d: DataFrame) -> DataFrame:
    b = d.select(F.col("id").alias("match_id"), F.explode("pickBans").alias("b"))
    hero = F.when(F.col("b.isPick"), F.col("b.heroId")).otherwise(F.col("b.bannedHeroId"))
    return b.where(F.col("b.order").isNotNull() & hero.isNotNull()).select("match_id", "b.order", "b.isPick", hero.alias("hero_id"), F.when(F.col("b.isRadiant"), 0).otherwise(1).alias("team")).withColumnRenamed("isPick", "is_pick")


def objectives_b(d: DataFrame) -> DataFrame:
    """An objective's ordinal is its place among the known buildings."""
    known = F.filter("towerDeaths", lambda e: rules.building_of_npc(e["npcId"]).isNotNull())
    o = d.select(F.col("id").alias("match_id"), F.posexplode(known).alias("ordinal", "o"))
    side = rules.building_of_npc(F.col("o.npcId"))["is_radiant"]
    return o.select("match_id", "ordinal", F.coalesce("o.time", F.lit(0)).alias("time"), F.lit("building_kill").alias("type"), F.when(side, 2).otherwise(3).alias("team"), rules.npc_building_name(F.col("o.npcId")).alias("key"), F.lit(None).cast("int").alias("player_slot"))


def matches_b(d: DataFrame) -> DataFrame:
    """Series membership is not read."""
    parsed = (F.coalesce("parsedDateTime", F.lit(0)) != 0) & (F.coalesce(F.size("radiantNetworthLeads"), F.lit(0)) > 0)
    return d.select(F.col("id").alias("match_id"), F.col("didRadiantWin").alias("radiant_win"), rules.utc(F.col("startDateTime")).alias("start_time"), F.col("durationSeconds").alias("duration"), parsed.alias("is_parsed"), F.lit(None).cast("int").alias("patch"))


def details_a(d: DataFrame) -> dict[str, DataFrame]:
    """players, drafts, objectives, matches of source A (schemas.DETAIL_A; P06, P09)."""
    return {"match_players": players_a(d), "match_drafts": drafts_a(d), "match_objectives": objectives_a(d), "matches": matches_a(d)}


def details_b(d: DataFrame) -> dict[str, DataFrame]:
    """The same tables of source B (schemas.DETAIL_B; P07, P08, P10)."""
    return {"match_players": players_b(d), "match_drafts": drafts_b(d), "match_objectives": objectives_b(d), "matches": matches_b(d)}


def player_fields(columns: tuple[str, ...] = PLAYERS) -> tuple[list[str], list[str]]:
    """The fields of sources A and B that columns of match_players come from."""
    asked = ("player_slot", *columns)
    return ["match_id", *[f"players.{PLAYER_A[c]}" for c in asked if c in PLAYER_A]], ["id", *[f"players.{PLAYER_B[c]}" for c in asked if c in PLAYER_B]]


def _fields(columns: tuple[str, ...]) -> dict[str, tuple]:
    """By table: how sources A and B make it, and the fields of their texts that it needs."""
    a, b = player_fields(columns)
    return {
        "match_players": (lambda d: players_a(d, columns), lambda d: players_b(d, columns), a, b),
        "match_drafts": (drafts_a, drafts_b, ["match_id", "picks_bans"], ["id", "pickBans"]),
        "match_objectives": (objectives_a, objectives_b, ["match_id", *[f"objectives.{c}" for c in ("time", "type", "key", "team", "player_slot")]], ["id", "towerDeaths.time", "towerDeaths.npcId"]),
        "matches": (matches_a, matches_b, ["match_id", "radiant_win", "start_time", "duration", "version", "patch"], ["id", "didRadiantWin", "startDateTime", "durationSeconds", "parsedDateTime", "radiantNetworthLeads"]),
    }


def details(raw: DataFrame, columns: tuple[str, ...] = PLAYERS) -> dict[str, DataFrame]:
    """Detail tables of raw payloads: source B goes before A, one payload a match.

    Of two payloads of one source the other columns decide, then a hash of the text. A text is read before payloads of a
    match meet, so that the fields of one table are shuffled and not whole texts. columns: those of match_players.
    """
    rank = rules.lookup(F.col("source"), {"stratz_match": 0, "opendota_match": 1})
    rest = [c for c in raw.columns if c not in ("match_id", "source", "payload")]
    order = [*[_as_order(raw, c) for c in rest], F.xxhash64("payload")]
    keyed = raw.select(F.col("match_id").alias("_of"), rank.alias("_from"), *[c.alias(f"_o{k}") for k, c in enumerate(order)], "payload")

    def table(make_a, make_b, fields_a: list[str], fields_b: list[str]) -> DataFrame:
        kinds = {1: schemas.part(schemas.DETAIL_A, *fields_a), 0: schemas.part(schemas.DETAIL_B, *fields_b)}
        read = {r: F.from_json("payload", kind) for r, kind in kinds.items()}
        own = lambda r: keyed.where(F.col("_from") == r).select(*keyed.columns[:-1], *[(read[k] if k == r else F.lit(None).cast(StructType.fromDDL(kinds[k]))).alias(f"_p{k}") for k in kinds])
        best = latest_per_key(own(0).unionByName(own(1)), ["_of"], F.col("_from"), *[F.col(f"_o{k}") for k in range(len(order))], settled=True)
        of = lambda r: best.where(F.col("_from") == r).select(f"_p{r}.*")
        return make_b(of(0)).unionByName(make_a(of(1)))

    return {name: table(*how) for name, how in _fields(columns).items()}


def heroes(payload: DataFrame) -> DataFrame:
    """Heroes from one object keyed by id (column ``payload``; P13, S09)."""
    h = payload.select(F.explode(F.map_values(F.from_json("payload", f"map<string,struct<{_struct(schemas.HERO)}>>"))).alias("h")).select("h.*")
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    return h.where((F.coalesce("id", F.lit(0)) != 0) & said("name").isNotNull()).select(F.col("id").alias("hero_id"), "name", F.coalesce(said("localized_name"), "name").alias("localized_name"), "primary_attr", "attack_type", "roles", F.col("img").alias("image_path"))


def _struct(ddl: str) -> str:
    return ",".join(":".join(f.rsplit(" ", 1)) if " " in f else f for f in ddl.split(", "))


def pro_players(payload: DataFrame) -> DataFrame:
    """Professional players from an array, or several with their page number; the first entry of an account counts."""
    page = F.col("page").cast("long") if "page" in payload.columns else F.lit(0).cast("long")
    p = payload.select(page.alias("page"), F.posexplode(F.from_json("payload", f"array<struct<{_struct(schemas.PRO_PLAYER)}>>")).alias("at", "p")).select(F.struct("page", "at").alias("pos"), "p.*")
    named = p.where(F.coalesce("account_id", F.lit(0)) != 0).select("account_id", "pos", F.coalesce(F.nullif("name", F.lit("")), F.nullif("personaname", F.lit(""))).alias("name"), F.nullif("loccountrycode", F.lit("")).alias("country"), "fantasy_role")
    return latest_per_key(named, ["account_id"], F.col("pos")).drop("pos")


def leagues(payload: DataFrame) -> DataFrame:
    """Leagues from one array; tiers beyond the known four become null."""
    rows = payload.select(F.explode(F.from_json("payload", f"array<struct<{_struct(schemas.LEAGUE)}>>")).alias("l")).select("l.*")
    known = F.col("tier").isin(*rules.PRO_TIERS, *rules.EXCLUDED_TIERS)
    return rows.where(F.coalesce("leagueid", F.lit(0)) != 0).select(F.col("leagueid").alias("league_id"), "name", F.when(known, F.col("tier")).alias("valve_tier"))


def live_teams(games: DataFrame) -> DataFrame:
    """Named teams of live games (P16, P17): positive ids with a name."""
    both = games.select(F.explode(F.array("radiant_team", "dire_team")).alias("t")).select("t.*")
    return both.where("team_id > 0 AND nullif(team_name, '') IS NOT NULL").select("team_id", F.col("team_name").alias("name")).distinct()


def live_standing(fmt: Column) -> Column:
    """Live series: game number is wins so far and one; conditional only when the format is known."""
    game = F.coalesce("radiant_series_wins", F.lit(0)) + F.coalesce("dire_series_wins", F.lit(0)) + 1
    return F.struct(game.alias("game_in_series"), F.coalesce(rules.conditional_game(fmt, game), F.lit(False)).alias("is_conditional_game"), fmt.isNotNull().alias("format_known"), F.coalesce(fmt, F.lit("bo1")).alias("format"))


def live_draft(games: DataFrame) -> DataFrame:
    """Bans then picks of radiant, then of dire, numbered in that order."""
    part = lambda side, kind, pick: F.transform(F.coalesce(F.col("scoreboard")[side][kind], F.array().cast("array<struct<hero_id:int>>")), lambda h: F.struct(h["hero_id"].alias("hero_id"), F.lit(pick).alias("is_pick"), F.lit(side == "radiant").alias("is_radiant")))
    parts = F.concat(*[part(s, k, k == "picks") for s in ("radiant", "dire") for k in ("bans", "picks")])
    return games.select("match_id", F.posexplode(parts).alias("order", "e")).select("match_id", "order", "e.*")


def live_players(games: DataFrame) -> DataFrame:
    """Players of the scoreboard; dire's slots are moved up by 128."""
    side = lambda s, shift: F.transform(F.coalesce(F.col("scoreboard")[s]["players"], F.array().cast(_players_type())), lambda p: F.struct((p["player_slot"] + shift).alias("player_slot"), rules.none_if_zero(p["account_id"]).alias("account_id"), p["hero_id"].alias("hero_id"), p["kills"].alias("kills"), p["death"].alias("deaths"), p["assists"].alias("assists"), p["net_worth"].alias("net_worth"), p["level"].alias("level"), F.lit(s == "radiant").alias("is_radiant")))
    return games.select("match_id", F.explode(F.concat(side("radiant", 0), side("dire", 128))).alias("p")).select("match_id", "p.*")


def _players_type() -> str:
    return f"array<{schemas._LIVE_PLAYER}>"


def wiki_search(raw: DataFrame, most: int = 5) -> DataFrame:
    """league_id, position, title: the first hits of a search for each league (H15). raw: league_id, payload."""
    hits = F.from_json("payload", schemas.WIKI_SEARCH)["query"]["search"]
    return raw.select("league_id", F.posexplode(F.slice(hits, 1, most)).alias("position", "hit")).select("league_id", "position", F.col("hit.title").alias("title"))


def wiki_facts(raw: DataFrame) -> DataFrame:
    """title, categories, description, display_name of every page of batched answers."""
    p = raw.select(F.explode(F.map_values(F.from_json("payload", schemas.WIKI_FACTS)["query"]["pages"])).alias("p")).select("p.*").where(F.coalesce("title", F.lit("")) != "")
    names = F.transform(F.coalesce("categories", F.array().cast("array<struct<title:string>>")), lambda c: c["title"])
    return p.select("title", names.alias("categories"), F.col("pageprops.metadescl").alias("description"), F.col("pageprops.displaytitle").alias("display_name")).dropDuplicates(["title"])


def wiki_text(raw: DataFrame) -> DataFrame:
    """page_title, wikitext of parsed pages; a page that does not exist has no text."""
    p = raw.select(F.from_json("payload", schemas.WIKI_PARSE)["parse"].alias("p"))
    return p.where(F.coalesce("p.title", F.lit("")) != "").select(F.col("p.title").alias("page_title"), F.coalesce(F.get(F.map_values("p.wikitext"), F.lit(0)), F.lit("")).alias("wikitext"))


def wiki_candidates(search: DataFrame, facts: DataFrame) -> DataFrame:
    """The candidates of ``matching.propose``: hits with what their pages state."""
    return search.join(facts, "title", "left").select("league_id", "position", "title", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "display_name", "description")
