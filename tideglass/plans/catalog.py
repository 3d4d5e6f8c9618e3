"""Registered queries: each applies operators to the views over their whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import history, matching, metrics, models, prematch, ratings, snapshots, stages, upserts
from ..session import checkpointed
from . import oracle, payload_oracle, payload_queries, stored_queries
from . import readmodels as rm
from . import views as v


def r4(c: Column) -> Column:
    """Four digits by the same arithmetic as the SQL."""
    return F.floor(c * 10000 + 0.5) / 10000


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.predictions(spark, sf_dir).withColumnRenamed("p_radiant", "p")
    return rm.scored_predictions(p, v.matches(spark, sf_dir), v.leagues(spark, sf_dir), per_segment=True, tie=v.TIE)


def q01_scored_metrics(spark, sf_dir):
    """Scores by version, segment and minute bucket."""
    out = metrics.by_bucket(_scored(spark, sf_dir), "model_version", "segment")
    return out.select("model_version", "segment", "bucket", r4(F.col("log_loss")).alias("log_loss"), r4(F.col("brier")).alias("brier"), r4(F.col("accuracy")).alias("accuracy"), "n", "matches")


def m06_reliability(spark, sf_dir):
    """Reliability bins by version."""
    return metrics.reliability(_scored(spark, sf_dir), "model_version").select("model_version", "bin", r4(F.col("predicted")).alias("predicted"), r4(F.col("observed")).alias("observed"), "n")


def q06_calibration_error(spark, sf_dir):
    """Calibration error by version and segment."""
    return metrics.calibration_error(_scored(spark, sf_dir), "model_version", "segment").select("model_version", "segment", r4(F.col("ece")).alias("ece"))


def q03_versions(spark, sf_dir):
    """Versions by scored rows."""
    return rm.versions(_scored(spark, sf_dir)).select("model_version", "n")


def q04_serving_progress(spark, sf_dir):
    """Matches and span of time by version."""
    return rm.serving_progress(v.predictions(spark, sf_dir))


def q05_segment_counts(spark, sf_dir):
    """Matches by version and segment, all segments there."""
    return rm.segment_counts(v.predictions(spark, sf_dir), v.leagues(spark, sf_dir))


def w01_game_numbers(spark, sf_dir):
    """Game number and conditional flag of every map."""
    m = history.number_games(v.matches(spark, sf_dir)).join(v.series(spark, sf_dir).select("series_id", "format"), "series_id")
    return m.select("match_id", "game", rules.conditional_game(F.col("format"), F.col("game")).alias("is_conditional"))


def _scored_series(spark, sf_dir):
    s = v.series(spark, sf_dir)
    scores = history.series_scores(v.matches(spark, sf_dir), s)
    return s.join(scores, "series_id")


def a09_series_scores(spark, sf_dir):
    """Series scores, side-swap aware, and outcomes."""
    s = _scored_series(spark, sf_dir)
    end = rules.series_outcome(F.coalesce("format", F.lit("bo1")), F.col("score_a"), F.col("score_b"))
    return s.select("series_id", "score_a", "score_b", end["winner_is_a"].alias("winner_is_a"), end["is_draw"].alias("drawn"), end["is_decided"].alias("is_decided"))


def w18_series_wins_before(spark, sf_dir):
    """Wins in the series before each map."""
    return history.series_wins_before(history.number_games(v.matches(spark, sf_dir)))


def w05_team_history(spark, sf_dir):
    """Form, maps of the last day and rest days of each side."""
    h = history.team_history(v.matches(spark, sf_dir))
    return h.select("match_id", "side", r4(F.col("form")).alias("form"), F.col("maps_24h").cast("long").alias("maps_24h"), r4(F.col("rest_days")).alias("rest_days"))


def w09_head_to_head(spark, sf_dir):
    """Decayed share against the same opponent."""
    return history.pair_history(v.matches(spark, sf_dir)).select("match_id", r4(F.col("h2h")).alias("h2h"))


def w02_hero_winrates(spark, sf_dir):
    """Shrunk win rate of every pick before its map."""
    return history.hero_winrates(v.picks(spark, sf_dir)).select("match_id", "hero_id", "is_radiant", r4(F.col("winrate")).alias("winrate"))


def w03_draft_advantage(spark, sf_dir):
    return history.draft_advantage(v.picks(spark, sf_dir)).select("match_id", r4(F.col("draft_advantage")).alias("draft_advantage"))


def w13_ratings(spark, sf_dir):
    """Rating fold over decided maps with five known accounts a side (W13-W17, H11): by dependency levels."""
    maps, _ = prematch.swept_maps(v.matches(spark, sf_dir), payload_queries.players(spark, sf_dir))
    return ratings.ratings_before(maps)


def w20_as_of(spark, sf_dir):
    """The newest event value of a user at each of its purchases' time."""
    e = v.read(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"))
    right = e.where("event_type = 'click'").select("user_id", "ts", "value")
    return history.as_of(left, right, "user_id", "at", "ts", ["value"]).select("event_id", F.col("value").alias("as_of_value"))


def q07_recent(spark, sf_dir):
    """The twenty newest professional matches."""
    out = rm.recent_matches(v.predictions(spark, sf_dir), v.matches(spark, sf_dir), v.leagues(spark, sf_dir))
    curve = F.array_join(F.transform("curve", lambda x: F.concat_ws(":", x["minute"].cast("string"), F.floor(x["p"] * 1000 + 0.5).cast("string"))), ",")
    return out.select("match_id", "radiant_win", "league_id", "tier", F.col("tenth.minute").alias("tenth_minute"), curve.alias("curve"))


def q14_calendar(spark, sf_dir):
    """Leagues with span, maps, stages and status."""
    live = v.leagues(spark, sf_dir).where(F.col("league_id") % 6 == 1).select("league_id")
    out = rm.calendar(v.leagues(spark, sf_dir), v.matches(spark, sf_dir), v.stages(spark, sf_dir), live, v.now())
    return out.select("league_id", "name", "first_at", "last_at", "maps", "stages", "status")


def q16_series_results(spark, sf_dir):
    """Series with their maps in order and inferred outcome."""
    out = rm.series_results(_scored_series(spark, sf_dir), v.matches(spark, sf_dir), v.now())
    return out.select("series_id", "maps", F.array_join("match_ids", ",").alias("match_ids"), "winner_team_id", "outcome_source")


def q17_participants(spark, sf_dir):
    """Teams of each league by results."""
    return rm.participants(rm.series_results(_scored_series(spark, sf_dir), v.matches(spark, sf_dir), v.now())).select("league_id", "team_id", "series_won", "series_lost", "series_drawn", "maps_won", "maps_lost", "place")


def q15_league_counts(spark, sf_dir):
    """Filtered counts by league."""
    return v.series(spark, sf_dir).groupBy("league_id").agg(F.count(F.lit(1)).alias("series"), F.count_if("is_draw").alias("draws"), F.count_if(F.col("format").isNull()).alias("without_format"))


def q18_unresolved(spark, sf_dir):
    """Predicted matches with neither result nor payload."""
    raw = v.snapshots(spark, sf_dir).select("match_id", F.when(F.col("match_id") % 2 == 0, "stratz_match").otherwise("steam").alias("source"))
    return rm.unresolved(v.predictions(spark, sf_dir), v.matches(spark, sf_dir), raw, v.now())


def q19_missing_details(spark, sf_dir):
    """Matches without payload, newest first (Q19, J15, D08, V06); the number asked for is the feature."""
    raw = v.snapshots(spark, sf_dir).select((F.col("match_id") * 4).alias("match_id"), F.lit("opendota_match").alias("source"))
    return rm.missing_details(v.matches(spark, sf_dir), raw, "opendota_match", 50)


def q20_league_context(spark, sf_dir):
    """Tiers and running stage's format."""
    return rm.league_context(v.leagues(spark, sf_dir), v.stages(spark, sf_dir), F.expr("timestamp_ntz'1994-06-01 00:00:00'")).select("league_id", "tier", "valve_tier", "format")


def q22_team_history(spark, sf_dir):
    """Maps of each team."""
    return rm.team_history(v.matches(spark, sf_dir))


def q23_place_series(spark, sf_dir):
    """Series placed in stages."""
    return stages.place_series(v.series(spark, sf_dir), v.matches(spark, sf_dir), v.stages(spark, sf_dir))


def q26_backfill(spark, sf_dir):
    """League and tier filled from the newest payload."""
    p = v.predictions(spark, sf_dir).withColumns({"valve_tier": F.lit(None).cast("string"), "league_id": F.when(F.col("league_id") % 3 > 0, F.col("league_id"))})
    s = v.snapshots(spark, sf_dir).withColumn("payload", F.concat(F.lit('{"league_id":"'), F.get_json_object("payload", "$.k"), F.lit('"}')))
    out = rm.backfill_segments(p, s, v.leagues(spark, sf_dir))
    return out.groupBy("league_id", "valve_tier").agg(F.count(F.lit(1)).alias("n"), F.sum("minute").alias("minutes"))


def q27_league_evidence(spark, sf_dir):
    """Span, teams and champion of each league."""
    teams = v.series(spark, sf_dir).select(F.explode(F.array("team_a_id", "team_b_id")).alias("team_id")).withColumn("name", F.concat(F.lit("Team-"), (F.col("team_id") % 9).cast("string")))
    out = matching.league_evidence(v.matches(spark, sf_dir), teams)
    return out.select("league_id", "first_match", "last_match", "team_count", F.array_join("teams", ",").alias("teams"), "champion")


def k06_fill_gaps(spark, sf_dir):
    """Full outer fill of known rows from a weaker source."""
    old = v.leagues(spark, sf_dir).drop("is_lan").where("league_id < 18")
    new = v.leagues(spark, sf_dir).where("league_id > 5").select("league_id", F.concat(F.lit("x"), F.col("name")).alias("name"), F.coalesce("tier", F.lit("filled")).alias("tier"), F.coalesce("valve_tier", F.lit("new")).alias("valve_tier"))
    return upserts.fill_gaps(old, new, ["league_id"])


def k01_latest_payload(spark, sf_dir):
    """The newest payload of each (match, kind)."""
    e = v.read(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("match_id"), F.col("event_type").alias("source"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("id"))
    return upserts.replace_raw(rows.where("id % 2 = 0"), rows.where("id % 2 = 1")).select("match_id", "source", "id")


def d14_spread_sample(spark, sf_dir):
    """The evenly spread sample of matches."""
    rows = v.matches(spark, sf_dir).select("match_id", "start_time").where("start_time IS NOT NULL")
    return models.spread_sample(rows, 600).select("match_id")


def l01_time_split(spark, sf_dir):
    """Matches by part of the time split."""
    rows = v.matches(spark, sf_dir).where("radiant_win IS NOT NULL").select("match_id", "start_time")
    return models.split_by_time(rows).groupBy("part").agg(F.count(F.lit(1)).alias("matches"), F.min("start_time").alias("first_at"), F.max("start_time").alias("last_at"))


def f28_weights(spark, sf_dir):
    """Sum of sample weights by league."""
    rows = v.matches(spark, sf_dir).join(v.leagues(spark, sf_dir).select("league_id", "tier"), "league_id", "left")
    return models.with_weights(rows).groupBy("league_id").agg(r4(F.sum("weight")).alias("weight"))


def m13_drift(spark, sf_dir):
    """Drift verdicts by version and segment."""
    s = _scored(spark, sf_dir).withColumn("predicted_at", F.col("predicted_at").cast("timestamp_ntz"))
    return metrics.drift(s, "1998-01-15 00:00:00").select("model_version", "segment", "recent_matches", "earlier_matches", r4(F.col("rise")).alias("rise"), "verdict")


def m10_bootstrap(spark, sf_dir):
    """Block bootstrap against two baselines."""
    s = checkpointed(_scored(spark, sf_dir).select("match_id", "start_time", "minute", "radiant_win", "p"))
    both = models.constant_baseline(s).withColumn("baseline_name", F.lit("constant")).unionByName(models.bias_baseline(s, s).withColumn("baseline_name", F.lit("bias")))
    return metrics.paired_differences(both)


def t04_minutes(spark, sf_dir):
    """Leads unrolled by minute, with their offset and clamp."""
    a = v.series_arrays(spark, sf_dir).withColumn("minute", F.explode(snapshots.minutes(F.lit(70 * 60))))
    return a.select("match_id", "minute", rules.at_minute(F.col("leads"), F.col("minute")).alias("at"), rules.at_minute(F.col("leads"), F.col("minute"), 1).alias("lead"))


def f02_spread(spark, sf_dir):
    """Spread of each vector's values."""
    a = v.series_arrays(spark, sf_dir)
    return a.select("match_id", r4(snapshots.spread(F.col("leads")) / 100).alias("spread"))


def t21_masks(spark, sf_dir):
    """Buildings standing by bit masks."""
    p = v.read(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 37) % 2048).cast("int").alias("t"), ((F.col("p_partkey") * 11) % 64).cast("int").alias("b"))
    return p.select("p_partkey", rules.towers_of_mask(F.col("t")).cast("long").alias("towers"), rules.barracks_of_mask(F.col("b")).cast("long").alias("barracks"))


def f15_priors(spark, sf_dir):
    """Priors, baseline and format odds of supplier pairs."""
    s = v.read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 400).alias("mu"), (F.lit(1.0) + F.col("s_suppkey") % 8).alias("sigma"))
    prior = rules.prior_from_skill(F.col("mu"), F.col("sigma"), F.lit(25.0), F.lit(8.0))
    return s.withColumn("prior", prior).select("s_suppkey", r4(F.col("prior")).alias("prior"), r4(rules.bounded(F.col("prior"))).alias("served"), r4(rules.bo2_probabilities(F.col("prior"))["p11"]).alias("p11"), r4(rules.baseline_probability(F.col("mu"), F.col("sigma"))).alias("baseline"))


def x01_names(spark, sf_dir):
    """Normal names of parts."""
    p = v.read(spark, sf_dir, "part")
    raw = F.concat(F.col("p_name"), F.lit("/The-"), F.col("p_brand"), F.lit(" Season "), F.col("p_size").cast("string"))
    return p.select("p_partkey", text.normal_name(raw).alias("name"), text.normal_team(raw).alias("team"))


def x08_descriptions(spark, sf_dir):
    """Dates, prize and flags read off generated descriptions."""
    p = v.read(spark, sf_dir, "part")
    month = lambda k: F.element_at(F.array(*[F.lit(m.title()) for m in text.MONTHS]), ((F.col("p_partkey") + k) % 12 + 1).cast("int"))
    said = F.concat(F.lit("A Tier "), (F.col("p_size") % 4).cast("string"), F.lit(" offline event from "), month(0), F.lit(" 3 to "), month(1), F.lit(" 9 2024 featuring "), F.col("p_size").cast("string"), F.lit(" teams, prize pool of $1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" USD"))
    d = p.select("p_partkey", text.description(said).alias("d")).select("p_partkey", "d.*")
    overlap = text.date_overlap(F.lit("2024-03-01").cast("date"), F.lit("2024-06-30").cast("date"), F.col("start_date"), F.col("end_date"))
    return d.select("p_partkey", "tier", "is_lan", "start_date", "end_date", "team_count", "prize_pool", "currency", r4(overlap).alias("overlap"))


def x02_name_scores(spark, sf_dir):
    """Similarity of each part's name to its neighbour's (X02, X16, U03); no SQL has the sequence ratio."""
    p = v.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select("p_partkey", text.name_score(F.col("p_name"), F.col("other")).alias("score"), text.same_team(text.normal_team(F.col("p_name")), text.normal_team(F.col("other"))).alias("same"))


def x17_bullets(spark, sf_dir):
    """HTML lists of pages as bullets."""
    return v.read(spark, sf_dir, "pages").select("page_id", F.length(text.html_bullets(F.col("html"))).alias("n"))


def a21_table_counts(spark, sf_dir):
    """Rows of each table."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    out = None
    for n in names:
        one = v.read(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def d18_conflicts(spark, sf_dir):
    """Pages that several leagues claim."""
    p = v.series(spark, sf_dir).select(F.col("series_id").alias("league_id"), (F.col("series_id") % 60).alias("page_title"), (F.col("series_id") % 3 == 0).alias("is_confident"))
    return matching.conflicts(p).select("league_id", "page_title", "claims")


def a17_busiest(spark, sf_dir):
    """Maps of each league in the last year before now, busiest first."""
    m = v.matches(spark, sf_dir).where(F.col("start_time") >= F.expr(f"timestamp_ntz'{v.NOW}' - INTERVAL 365 DAYS"))
    rank = F.row_number().over(Window.orderBy(F.col("maps").desc(), "league_id"))  # one row a league
    return m.groupBy("league_id").agg(F.count(F.lit(1)).alias("maps")).withColumn("place", rank)


_OWN = {
    f.__name__: f
    for f in (
        q01_scored_metrics, m06_reliability, q06_calibration_error, q03_versions, q04_serving_progress, q05_segment_counts, w01_game_numbers, a09_series_scores, w18_series_wins_before,
        w05_team_history, w09_head_to_head, w02_hero_winrates, w03_draft_advantage, w13_ratings, w20_as_of, q07_recent, q14_calendar, q15_league_counts, q16_series_results, q17_participants,
        q18_unresolved, q19_missing_details, q20_league_context, q22_team_history, q23_place_series, q26_backfill, q27_league_evidence, k06_fill_gaps, k01_latest_payload, d14_spread_sample,
        l01_time_split, f28_weights, m13_drift, m10_bootstrap, t04_minutes, f02_spread, t21_masks, f15_priors, x01_names, x08_descriptions, x02_name_scores, x17_bullets, a21_table_counts, d18_conflicts, a17_busiest,
    )
}

QUERIES = _OWN | payload_queries.QUERIES | stored_queries.QUERIES

#: The queries as DuckDB SQL, where SQL can express them.
ORACLE = oracle.ORACLE | payload_oracle.PAYLOAD_ORACLE | stored_queries.STORED_ORACLE
