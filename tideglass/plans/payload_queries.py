"""Registered queries from stored JSON to typed tables, features and upserts, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import rules, text
from ..operators import featurize, history, metrics, models, normalize, outcomes, prematch, ratings, snapshots, upserts
from ..streaming import live as streaming
from . import payloads
from . import readmodels as rm
from . import views as v


def r4(c):
    return F.floor(c * 10000 + 0.5) / 10000


def _both_sources(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = normalize.PLAYERS) -> dict[str, DataFrame]:
    """Every map has payload A, two of three have B as well, which goes before A. columns: those of match_players."""
    b = payloads.detail_b(spark, sf_dir).where("match_id % 3 > 0")
    return normalize.details(b.unionByName(payloads.detail_a(spark, sf_dir)), columns)


def _details_b(spark, sf_dir):
    return normalize.parse(payloads.detail_b(spark, sf_dir), schemas.DETAIL_B)


def _details_a(spark, sf_dir):
    return normalize.parse(payloads.detail_a(spark, sf_dir), schemas.DETAIL_A)


def p06_match_players(spark, sf_dir):
    """Players of both detail payloads."""
    columns = ("player_slot", "account_id", "hero_id", "is_radiant", "lane_role", "kills", "leaver_status")
    return _both_sources(spark, sf_dir, columns)["match_players"].select("match_id", *columns)


def p07_match_drafts(spark, sf_dir):
    """Picks and bans of both detail payloads."""
    return _both_sources(spark, sf_dir)["match_drafts"].select("match_id", "order", "is_pick", "hero_id", "team")


def p08_match_objectives(spark, sf_dir):
    """Objectives of both detail payloads with their ordinals."""
    return _both_sources(spark, sf_dir)["match_objectives"].select("match_id", "ordinal", "time", "type", "team", "key")


def p09_match_rows(spark, sf_dir):
    """Skeleton rows of both detail payloads."""
    return _both_sources(spark, sf_dir)["matches"].select("match_id", "radiant_win", F.unix_timestamp("start_time").alias("started"), "duration", "is_parsed", "patch")


def q11_timeline(spark, sf_dir):
    """What a card shows of a map's objectives."""
    return rm.timeline_of(_both_sources(spark, sf_dir)["match_objectives"]).select("match_id", "ordinal", "minute", "kind", "is_radiant", "lane")


def _summaries(spark, sf_dir):
    return normalize.from_summaries(normalize.parse(payloads.summary(spark, sf_dir), schemas.SUMMARY))


def p01_matches(spark, sf_dir):
    """Maps of summaries."""
    return _summaries(spark, sf_dir)["matches"].select("match_id", "league_id", F.col("series_id").isNotNull().alias("in_series"), "radiant_team_id", "dire_team_id", "radiant_win", F.unix_timestamp("start_time").alias("started"), "duration", "is_parsed")


def p01_teams(spark, sf_dir):
    """Teams named by their last map, leagues likewise."""
    s = _summaries(spark, sf_dir)
    return s["teams"].select(F.lit("team").alias("kind"), F.col("team_id").alias("id"), "name").unionByName(s["leagues"].select(F.lit("league").alias("kind"), F.col("league_id").alias("id"), "name"))


def p01_series(spark, sf_dir):
    """Series whose teams their first map pins."""
    s = _summaries(spark, sf_dir)["series"]
    return s.select("league_id", "valve_series_id", "team_a_id", "team_b_id", "valve_series_type")


def t12_snapshots_b(spark, sf_dir):
    """Minute states of the training source."""
    s = snapshots.snapshots_b(_details_b(spark, sf_dir))
    return s.select(
        "match_id", "minute", "radiant_win", "gold_adv", *[f"{r}_{c}" for r in ("radiant", "dire") for c in ("score", "net_worth", "towers", "barracks")],
        F.array_join("radiant_picks", ",").alias("radiant_picks"), r4(snapshots.spread(F.col("radiant_worths"))).alias("radiant_spread"),
    )


def t13_snapshots_a(spark, sf_dir):
    """Minute states of the other source with Roshan's."""
    s = snapshots.snapshots_a(_details_a(spark, sf_dir))
    return s.select("match_id", "minute", "gold_adv", *[f"{r}_{c}" for r in ("radiant", "dire") for c in ("score", "net_worth", "towers", "barracks")], "roshan_kills", "aegis_is_radiant", "roshan_respawn_in")


def _synthetic_block(spark, sf_dir):
    """A pre-match block for every third map, so that the rows can be checked without ratings."""
    k = F.col("match_id")
    return v.matches(spark, sf_dir).where(k % 3 == 0).select("match_id", *[((k % (7 + i)) / 2.0).alias(c) for i, c in enumerate(prematch.BLOCK)], (0.3 + (k % 400) / 1000.0).alias("prematch_prior"))


def _featurized(spark, sf_dir):
    m = history.number_games(v.matches(spark, sf_dir)).join(v.series(spark, sf_dir).select("series_id", "format"), "series_id")
    m = m.withColumn("is_conditional_game", rules.conditional_game(F.col("format"), F.col("game"))).drop("format")
    return featurize.featurize(_details_b(spark, sf_dir), m, v.series(spark, sf_dir), v.leagues(spark, sf_dir), _synthetic_block(spark, sf_dir))


def f01_featurize(spark, sf_dir):
    """Training rows: eligible maps, states, series context and pre-match block."""
    rows, _ = _featurized(spark, sf_dir)
    return rows.select("match_id", "minute", "radiant_win", *[r4(F.col(c)).alias(c) for c in snapshots.FEATURES if c != "minute"])


def f08_skips(spark, sf_dir):
    """Payloads by skip reason."""
    _, skipped = _featurized(spark, sf_dir)
    return skipped.select(F.coalesce("skip_reason", F.lit("used")).alias("reason"), F.col("count").alias("n"))


def f04_serving_view(spark, sf_dir):
    """Training rows as a live model sees them, summed by minute."""
    rows = snapshots.serving_view(_featurized(spark, sf_dir)[0])
    return rows.groupBy("minute").agg(F.count(F.lit(1)).alias("n"), r4(F.sum("prematch_prior")).alias("prior"), r4(F.sum("skill_diff")).alias("skill"), r4(F.sum("gold_adv")).alias("gold"))


def players(spark, sf_dir):
    """Seats of the training source; what their texts say by minute is not read."""
    return normalize.players_b(normalize.parse(payloads.detail_b(spark, sf_dir), schemas.part(schemas.DETAIL_B, *normalize.player_fields()[1])))


def w15_rosters(spark, sf_dir):
    """Accounts of complete rosters."""
    r = history.rosters(players(spark, sf_dir))
    return r.select("match_id", F.array_join("radiant", ",").alias("radiant"), F.array_join("dire", ",").alias("dire"))


def w11_prematch(spark, sf_dir):
    """Pre-match rows of every complete map (W11-W17, F15-F17, H07-H11); the rating fold is beyond SQL."""
    m = v.matches(spark, sf_dir)
    rows, _ = prematch.prematch_rows(m, players(spark, sf_dir))
    return rows.select("match_id", *[r4(F.col(c)).alias(c) for c in (*prematch.BLOCK, "prematch_prior")])


def w11_history_block(spark, sf_dir):
    """The part of the pre-match rows that needs no rating."""
    m, p = v.matches(spark, sf_dir), players(spark, sf_dir)
    maps, _ = prematch.swept_maps(m, p)
    return prematch.history_block(maps, p).select("match_id", *[r4(F.col(c)).alias(c) for c in prematch.BLOCK[3:]])


def _live_states(spark, sf_dir):
    return snapshots.snapshots_live(normalize.parse(payloads.live(spark, sf_dir), schemas.LIVE))


def t24_live_states(spark, sf_dir):
    """States of started live games."""
    s = _live_states(spark, sf_dir)
    return s.select("match_id", "minute", "gold_adv", "league_id", "radiant_team_id", "stream_delay_s", *[f"{r}_{c}" for r in ("radiant", "dire") for c in ("score", "net_worth", "towers", "barracks")], F.array_join("radiant_accounts", ",").alias("radiant_accounts"))


def p21_live_draft(spark, sf_dir):
    """Drafts of live games in their order."""
    return normalize.live_draft(normalize.parse(payloads.live(spark, sf_dir), schemas.LIVE)).select("match_id", "order", "hero_id", "is_pick", "is_radiant")


def p22_live_players(spark, sf_dir):
    """Players of live games."""
    return normalize.live_players(normalize.parse(payloads.live(spark, sf_dir), schemas.LIVE)).select("match_id", "player_slot", "account_id", "hero_id", "kills", "deaths")


def p16_live_teams(spark, sf_dir):
    """Named teams of live games."""
    return normalize.live_teams(normalize.parse(payloads.live(spark, sf_dir), schemas.LIVE))


def _stored_ratings(spark, sf_dir):
    e = v.read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("long").alias("account_id"), F.col("event_id").alias("as_of_match_id"), F.col("ts").alias("as_of_time"), (F.lit(20.0) + F.col("event_id") % 11).alias("mu"), (F.lit(1.0) + F.col("event_id") % 7).alias("sigma"), (F.col("event_id") % 40).alias("games"))


def w21_live_block(spark, sf_dir):
    """Skill block and prior of live games from the newest ratings."""
    block = prematch.live_block(_live_states(spark, sf_dir), _stored_ratings(spark, sf_dir))
    return block.select("match_id", *[r4(F.col(c)).alias(c) for c in (*prematch.LIVE_BLOCK, "prematch_prior")])


def r03_live_scores(spark, sf_dir):
    """Feed entries of live games with the fallback predictor."""
    games = normalize.parse(payloads.live(spark, sf_dir), schemas.LIVE)
    context = v.leagues(spark, sf_dir).withColumn("format", rules.lookup((F.col("league_id") % 4).cast("int"), {0: "bo1", 1: "bo3", 2: "bo5"}))
    maps = rm.team_history(v.matches(spark, sf_dir))
    scored = streaming.score_games(games, context, maps)
    return scored.select("match_id", F.col("minute").cast("long").alias("minute"), "league_id", "tier", "game_in_series", "is_conditional_game", "series_len", r4(F.col("p")).alias("p"), "team_history")


def q13_public_feed(spark, sf_dir):
    """Entries of professional leagues, best known first."""
    feed = v.leagues(spark, sf_dir).select("league_id", "valve_tier", "tier", (F.col("league_id") % 6).alias("team_history"), F.col("league_id").alias("position"))
    return rm.public_feed(feed).select("league_id", "tier", "team_history")


def _known_leagues(spark, sf_dir):
    return v.leagues(spark, sf_dir).drop("is_lan").where("league_id < 18")


def k03_supplied(spark, sf_dir):
    """Only supplied columns are written, nulls included."""
    new = v.leagues(spark, sf_dir).where("league_id > 5").select("league_id", F.concat(F.lit("x"), F.col("name")).alias("name"), F.when(F.col("league_id") % 2 == 0, "new").alias("valve_tier"))
    return upserts.upsert_supplied(_known_leagues(spark, sf_dir), new, ["league_id"])


def k09_absent(spark, sf_dir):
    """Unseen leagues alone are added."""
    return upserts.insert_absent(_known_leagues(spark, sf_dir), v.leagues(spark, sf_dir).where("league_id > 5").select("league_id", F.lit("added").alias("name")), ["league_id"])


def k12_children(spark, sf_dir):
    """Rows of a key are replaced as a whole (K05, K12, K14): minutes of maps in the newer half."""
    p = v.predictions(spark, sf_dir).groupBy("match_id", "minute").agg(F.count(F.lit(1)).alias("n"))
    new = p.where("match_id % 2 = 0 AND minute < 20").withColumn("n", -F.col("n"))
    return upserts.replace_rows(p, new, ["match_id"]).groupBy("match_id").agg(F.count(F.lit(1)).alias("minutes"), F.sum("n").alias("n"))


def k13_supersede(spark, sf_dir):
    """A decision closes the active row of its league."""
    k = F.col("league_id")
    old = v.leagues(spark, sf_dir).where("league_id < 20").select("league_id", "tier", F.lit("1997-01-01").cast("timestamp").alias("decided_at"), F.when(k % 4 == 0, F.lit("1998-01-01").cast("timestamp")).alias("superseded_at"))
    new = v.leagues(spark, sf_dir).where("league_id % 3 = 0").select("league_id", F.lit("decided").alias("tier"))
    out = upserts.supersede(old, new, "league_id", F.lit("1999-01-01").cast("timestamp"))
    return out.select("league_id", "tier", F.year("decided_at").alias("decided"), F.year("superseded_at").alias("superseded"))


def l10_platt(spark, sf_dir):
    """Predictions under a given calibration, by version and minute."""
    p = v.predictions(spark, sf_dir).withColumnRenamed("p_radiant", "p")
    one, same = models.Platt(1.2, -0.1).apply(p), models.Platt().apply(p)
    out = one.groupBy("model_version", "minute").agg(F.sum("p").alias("p")).join(same.groupBy("model_version", "minute").agg(F.sum("p").alias("same")), ["model_version", "minute"])
    return out.select("model_version", "minute", r4(F.col("p")).alias("p"), r4(F.col("same")).alias("same"))


def f22_rules(spark, sf_dir):
    """Tiers, segments, formats, outcomes and other rules of single values."""
    k = F.col("p_partkey")
    valve = rules.lookup((k % 5).cast("int"), {0: "professional", 1: "premium", 2: "excluded", 3: "amateur"})
    wiki = rules.lookup((k % 6).cast("int"), {0: "tier1", 1: "tier2", 2: "unknown", 3: "", 4: "tier3"})
    fmt = rules.resolve_format(F.when(k % 7 == 0, "bo2"), F.when(k % 3 == 0, "bo5"), (k % 4).cast("int"))
    end = rules.series_outcome(fmt, (k % 4).cast("int"), (k % 3).cast("int"))
    raw = F.when(k % 3 == 0, (k % 8).cast("string")).when(k % 3 == 1, F.get(F.array(*[F.lit(w) for w in (*rules.LEAVER, "ODD")]), (k % 8).cast("int")))
    return v.read(spark, sf_dir, "part").select(
        "p_partkey", rules.display_tier(valve, wiki).alias("tier"), rules.segment(valve, wiki).alias("segment"), rules.is_pro(valve).alias("pro"), fmt.alias("format"), end["winner_is_a"].alias("winner_is_a"), end["is_draw"].alias("drawn"),
        rules.leaver_value(raw).alias("leaver"), rules.notability(F.when(k % 4 > 0, k % 9), k % 5).alias("known"), r4(rules.decay(k * 3600.0)).alias("decay"), r4(rules.noise_floor(k + 1)).alias("noise"),
        r4(rules.eta_hours(k, 550.0)).alias("eta"), rules.slice_timeout(k).alias("timeout"), rules.none_if_zero(k % 4).alias("id"), r4(rules.sample_weight(wiki, k % 100)).alias("weight"),
    )


def s02_transient(spark, sf_dir):
    """Addresses without credentials, keys cut to size."""
    k = F.col("p_partkey")
    url = F.concat(F.lit("http://h/x?api_key=s"), k.cast("string"), F.lit("&y="), F.col("p_size").cast("string"), F.lit("&token=t"), k.cast("string"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + k * 977)
    return v.read(spark, sf_dir, "part").select("p_partkey", rules.redact(url).alias("url"), rules.short_key(F.repeat(F.col("p_name"), 3)).alias("key"), rules.model_version(at).alias("version"))


def m16_bias(spark, sf_dir):
    """Laplace share of radiant wins and the constant baseline by league."""
    m = v.matches(spark, sf_dir).where("radiant_win IS NOT NULL")
    both = models.constant_baseline(m).select("league_id", F.col("baseline").alias("half")).groupBy("league_id").agg(F.avg("half").alias("half"), F.count(F.lit(1)).alias("n"))
    return models.bias_baseline(m, both).select("league_id", "n", "half", r4(F.col("baseline")).alias("bias"))


def ratings_of_sides(spark, sf_dir):
    """Skill of both sides from stored ratings of their players."""
    e = v.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), (F.col("l_linenumber") % 2 == 1).alias("is_radiant"), (F.col("l_suppkey") % 40 + 5.0).alias("mu"), (F.col("l_partkey") % 8 + 1.0).alias("sigma"), (F.col("l_suppkey") % 45).alias("games"))
    return ratings.team_skill(e).select("match_id", "is_radiant", r4(F.col("mu")).alias("mu"), r4(F.col("sigma")).alias("sigma"), "min_games", "established")


def p13_heroes(spark, sf_dir):
    """Heroes of one object keyed by id."""
    return normalize.heroes(payloads.references(spark, sf_dir)["heroes"]).select("hero_id", "name", "localized_name", "primary_attr")


def p14_pro_players(spark, sf_dir):
    """Professional players, the first entry of an account."""
    return normalize.pro_players(payloads.references(spark, sf_dir)["pro_players"])


def p15_leagues(spark, sf_dir):
    """Leagues with known tiers."""
    return normalize.leagues(payloads.references(spark, sf_dir)["leagues"])


def t26_realtime(spark, sf_dir):
    """States of realtime samples."""
    s = snapshots.snapshots_realtime(normalize.parse(payloads.realtime(spark, sf_dir), schemas.REALTIME))
    return s.select("match_id", "minute", "gold_adv", *[f"{r}_{c}" for r in ("radiant", "dire") for c in ("score", "net_worth", "towers", "barracks")], r4(snapshots.spread(F.col("radiant_worths"))).alias("radiant_spread"))


def h26_outcomes(spark, sf_dir):
    """Undecided maps with late results filled in."""
    m = v.matches(spark, sf_dir).withColumn("duration", F.lit(None).cast("int"))
    resolved, _ = outcomes.resolve(m, m.where("radiant_win IS NULL"), payloads.results(spark, sf_dir))
    return resolved.select("match_id", "radiant_win", "duration", "series_id")


def h27_to_fetch(spark, sf_dir):
    """Ids to ask for, newest first; the number of a job is the feature."""
    return outcomes.to_fetch(v.predictions(spark, sf_dir), payloads.results(spark, sf_dir), outcomes.outcome_source(False), 100)


def f20_map_score(spark, sf_dir):
    """Kills of a map from the scoreboard while it runs, else from its rosters."""
    k = F.col("match_id")
    roster = outcomes.roster_kills(players(spark, sf_dir).where("match_id % 3 > 0"))
    live = F.when(k % 4 > 0, F.struct((k % 60).cast("int").alias("radiant"), (k % 50).cast("int").alias("dire")))
    m = v.matches(spark, sf_dir).select("match_id").join(roster, "match_id", "left").select("match_id", outcomes.map_score(k % 2 == 0, live, F.col("roster")).alias("s"))
    return m.select("match_id", F.col("s.radiant").alias("radiant"), F.col("s.dire").alias("dire"))


def q09_card_players(spark, sf_dir):
    """Players of every map with hero and player names."""
    heroes = v.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("hero_id"), F.col("n_name").alias("localized_name"), F.lower("n_name").alias("image_path"))
    names = v.read(spark, sf_dir, "customer").select((F.col("c_custkey") * 10).alias("account_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"))
    return rm.players_of(players(spark, sf_dir), heroes, names).select("match_id", "player_slot", "hero_name", "player_name")


def q10_card_draft(spark, sf_dir):
    """Drafts of every map with hero names (Q10)."""
    heroes = v.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("hero_id"), F.col("n_name").alias("localized_name"))
    return rm.draft_of(_both_sources(spark, sf_dir)["match_drafts"], heroes).select("match_id", "order", "is_radiant", "hero_name")


def x23_stage_formats(spark, sf_dir):
    """Stages that wiki pages name, with their formats and dates."""
    return text.stage_formats(payloads.wiki_pages(spark, sf_dir)).drop("evidence")


def m16_report(spark, sf_dir):
    """Report lines by minute bucket."""
    p = v.predictions(spark, sf_dir).withColumnRenamed("p_radiant", "p").join(v.matches(spark, sf_dir).where("radiant_win IS NOT NULL").select("match_id", "radiant_win"), "match_id")
    scores = metrics.by_bucket(p).withColumns({c: F.round(c, 3) for c in ("log_loss", "brier", "accuracy")})
    return metrics.report(scores)


def p26_wiki_candidates(spark, sf_dir):
    """Search hits with the facts of their pages."""
    w = payloads.wiki_answers(spark, sf_dir)
    c = normalize.wiki_candidates(normalize.wiki_search(w["search"]), normalize.wiki_facts(w["facts"]))
    page = text.categories(F.col("categories"))
    return c.select("league_id", "position", "title", F.size("categories").alias("n_categories"), page["tier"].alias("tier"), "description")


def h16_wiki_text(spark, sf_dir):
    """Texts of parsed pages."""
    return normalize.wiki_text(payloads.wiki_answers(spark, sf_dir)["text"])


QUERIES = {
    f.__name__: f
    for f in (
        p06_match_players, p07_match_drafts, p08_match_objectives, p09_match_rows, q11_timeline, p01_matches, p01_teams, p01_series, t12_snapshots_b, t13_snapshots_a, f01_featurize, f08_skips, f04_serving_view,
        w15_rosters, w11_prematch, w11_history_block, t24_live_states, p21_live_draft, p22_live_players, p16_live_teams, w21_live_block, r03_live_scores, q13_public_feed, k03_supplied, k09_absent, k12_children,
        k13_supersede, l10_platt, f22_rules, s02_transient, m16_bias, ratings_of_sides, p13_heroes, p14_pro_players, p15_leagues, t26_realtime, h26_outcomes, h27_to_fetch, f20_map_score, q09_card_players,
        q10_card_draft, x23_stage_formats, m16_report, p26_wiki_candidates, h16_wiki_text,
    )
}
