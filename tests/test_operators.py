"""Operators on small hand-made payloads."""

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass import schemas
from tideglass.functions import rules, text
from tideglass.operators import history, matching, metrics, models, normalize, outcomes, ratings, snapshots, upserts
from tideglass.plans import readmodels


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def detail_b(minutes=13, **more):
    player = lambda slot: {
        "steamAccountId": 100 + slot, "heroId": slot + 1, "isRadiant": slot < 5, "playerSlot": slot if slot < 5 else slot + 123, "kills": 3, "deaths": 1, "assists": 0, "leaverStatus": "NONE", "lane": "MID_LANE",
        "stats": {"networthPerMinute": [100 * m * (slot + 1) for m in range(minutes)], "killEvents": [{"time": 60 * slot}, {"time": 60 * slot + 1}]},
    }
    return {
        "id": 7, "didRadiantWin": True, "durationSeconds": 60 * minutes, "startDateTime": 1700000000, "parsedDateTime": 1, "radiantTeamId": 1, "direTeamId": 2, "radiantNetworthLeads": [10 * m for m in range(minutes + 1)],
        "players": [player(s) for s in range(10)], "pickBans": [{"order": 0, "isPick": True, "heroId": 5, "isRadiant": True}, {"order": 1, "isPick": False, "bannedHeroId": 6, "isRadiant": False}],
        "towerDeaths": [{"time": 119, "npcId": 26}, {"time": 120, "npcId": 27}, {"time": 200, "npcId": 36}, {"time": 300, "npcId": 38}],
    } | more


def parsed(spark, ddl, *payloads):
    return normalize.parse(spark.createDataFrame([(json.dumps(p),) for p in payloads], "payload string"), ddl)


def test_snapshots_follow_the_clock(spark):
    rows = {r.minute: r for r in snapshots.snapshots_b(parsed(spark, schemas.DETAIL_B, detail_b())).collect()}
    assert sorted(rows) == list(range(14))
    assert rows[0].gold_adv == 10 and rows[12].gold_adv == 130 and rows[13].gold_adv == 130  # leads are one ahead, then clamped
    assert (rows[0].dire_towers, rows[1].dire_towers, rows[2].dire_towers) == (11, 10, 9)  # 119 s counts in minute 1, 120 s in 2
    assert rows[4].radiant_barracks == 6 and rows[5].radiant_barracks == 5
    assert rows[1].radiant_score == 1 + 1 + 1 and rows[0].radiant_score == 1  # kills at or before the minute
    assert rows[3].radiant_picks == [5]


def test_no_future_information(spark):
    """Cutting off everything after minute 6 leaves the rows up to it as they were."""
    whole, cut = detail_b(), detail_b()
    cut["radiantNetworthLeads"] = cut["radiantNetworthLeads"][:8]
    cut["towerDeaths"] = [e for e in cut["towerDeaths"] if e["time"] < 7 * 60]
    for p in cut["players"]:
        p["stats"] = {"networthPerMinute": p["stats"]["networthPerMinute"][:7], "killEvents": [e for e in p["stats"]["killEvents"] if e["time"] <= 360]}
    a, b = ([tuple(r) for r in snapshots.snapshots_b(parsed(spark, schemas.DETAIL_B, p)).where("minute <= 6").orderBy("minute").collect()] for p in (whole, cut))
    assert a == b


def test_features_and_serving_view(spark):
    s = snapshots.snapshots_b(parsed(spark, schemas.DETAIL_B, detail_b())).where("minute = 2")
    f = one(snapshots.features(s, "match_id"))
    assert tuple(f.asDict())[1:] == snapshots.FEATURES and abs(f.log_minute - math.log(3)) < 1e-12 and f.gold_adv_norm == 30 / 7
    worths = [200.0 * (k + 1) for k in range(5)]
    assert abs(f.radiant_nw_spread - math.sqrt(sum((w - 600) ** 2 for w in worths) / 5)) < 1e-9
    assert f.prematch_prior == 0.5 and f.series_len == 1 and f.is_lan_known == 0
    assert one(snapshots.serving_view(s.withColumns({"prematch_prior": F.lit(0.9), "form_diff": F.lit(2.0)}))).prematch_prior == 0.5


def test_eligibility_reasons(spark):
    short, few, left, teamless = detail_b(durationSeconds=719), detail_b(), detail_b(), detail_b(direTeamId=None)
    few["players"] = few["players"][:9]
    left["players"][3]["leaverStatus"] = "ABANDONED"
    good, reasons = snapshots.eligible(parsed(spark, schemas.DETAIL_B, detail_b(), short, few, left, teamless, detail_b(parsedDateTime=None), detail_b(didRadiantWin=None)))
    assert good.count() == 1
    assert {r.skip_reason for r in reasons.collect()} == {None, "shorter than 12 minutes", "incomplete roster", "somebody abandoned", "a side has no team", "not parsed", "no outcome to label with"}


def test_details_of_both_sources(spark):
    a = {
        "match_id": 8, "version": 21, "duration": 900, "start_time": 1700000000, "radiant_win": False, "radiant_gold_adv": [0, 5], "players": [{"player_slot": 0, "hero_id": 3, "gold_t": [1, 2]}, {"player_slot": 129, "hero_id": 4, "gold_t": [4]}],
        "objectives": [{"time": -5, "type": "CHAT_MESSAGE_FIRSTBLOOD"}, {"time": 70, "type": "CHAT_MESSAGE_ROSHAN_KILL", "team": 2}, {"time": 80, "type": "CHAT_MESSAGE_AEGIS", "team": 2}, {"time": 90, "type": "building_kill", "key": "npc_dota_badguys_tower1_mid"}],
    }
    raw = spark.createDataFrame([(7, "stratz_match", json.dumps(detail_b())), (7, "opendota_match", "{}"), (8, "opendota_match", json.dumps(a))], "match_id long, source string, payload string")
    t = normalize.details(raw)
    assert t["match_players"].where("match_id = 7").count() == 10 and t["match_players"].where("match_id = 8 AND NOT is_radiant").count() == 1
    assert [(r.order, r.hero_id) for r in t["match_drafts"].orderBy("order").collect()] == [(0, 5), (1, 6)]
    o = t["match_objectives"].where("match_id = 7").orderBy("ordinal").collect()
    assert [(r.ordinal, r.key) for r in o] == [(0, "npc_dota_badguys_tower1_top"), (1, "npc_dota_badguys_tower1_mid"), (2, "npc_dota_goodguys_melee_rax_top")]
    timeline = readmodels.timeline_of(t["match_objectives"].where("match_id = 8")).orderBy("time", "ordinal").collect()
    assert [(r.minute, r.kind, r.is_radiant) for r in timeline] == [(0, "first_blood", None), (1, "roshan", True), (1, "aegis", True), (1, "tower", False)]
    s = {r.minute: r for r in snapshots.snapshots_a(parsed(spark, schemas.DETAIL_A, a)).collect()}
    assert (s[0].roshan_kills, s[1].roshan_kills, s[1].aegis_is_radiant, s[1].roshan_respawn_in) == (0, 1, True, 70 + 570 - 120) and s[7].aegis_is_radiant is None and s[1].dire_towers == 10


def test_summaries(spark):
    rows = [{"match_id": m, "leagueid": 5, "league_name": f"L{m}", "series_id": 9, "series_type": 1, "radiant_team_id": 1 + m % 2, "radiant_name": f"t{m}", "dire_team_id": 0, "radiant_win": True, "start_time": m} for m in (1, 2)]
    t = normalize.from_summaries(parsed(spark, schemas.SUMMARY, *rows))
    assert one(t["leagues"]).name == "L2" and one(t["series"]).team_a_id == 2 and one(t["series"]).team_b_id is None
    assert t["teams"].count() == 2 and t["matches"].select("series_id").distinct().count() == 1


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", None), (2, None, 5)], "k int, x string, y int")
    new = spark.createDataFrame([(2, "n"), (3, None)], "k int, x string")
    assert sorted(map(tuple, upserts.upsert_supplied(old, new, ["k"]).collect())) == [(1, "a", None), (2, "n", 5), (3, None, None)]
    fill = spark.createDataFrame([(1, "z", 9), (3, "q", 1)], "k int, x string, y int")
    assert sorted(map(tuple, upserts.fill_gaps(old, fill, ["k"]).collect())) == [(1, "a", 9), (2, None, 5), (3, "q", 1)]
    assert sorted(map(tuple, upserts.replace_rows(old, fill, ["k"]).collect()), key=str) == [(1, "z", 9), (2, None, 5), (3, "q", 1)]
    assert sorted(map(tuple, upserts.insert_absent(old, fill, ["k"]).collect()), key=str) == [(1, "a", None), (2, None, 5), (3, "q", 1)]
    m = spark.createDataFrame([(1, "tier1", None, None)], "league_id long, tier string, decided_at timestamp, superseded_at timestamp")
    after = upserts.supersede(m, spark.createDataFrame([(1, "tier2")], "league_id long, tier string"), "league_id", F.lit("2024-01-01").cast("timestamp"))
    assert sorted((r.tier, r.superseded_at is None) for r in after.collect()) == [("tier1", False), ("tier2", True)]


def brute_ratings(maps):
    out, state = {}, {}
    for m, _, win, r, d in sorted(maps, key=lambda x: (x[1], x[0])):
        for a in r + d:
            out[m, a] = state.get(a, (25.0, 25.0 / 3, 0))
        w, l = (r, d) if win else (d, r)  # noqa: E741
        new = ratings.update([state.get(a, (25.0, 25.0 / 3, 0))[:2] for a in w], [state.get(a, (25.0, 25.0 / 3, 0))[:2] for a in l])
        for side, after in zip((w, l), new, strict=True):
            state.update({a: (*x, state.get(a, (0, 0, 0))[2] + 1) for a, x in zip(side, after, strict=True)})
    return out


def test_ratings_by_component_equal_one_fold(spark):
    rng, maps, start = random.Random(3), [], datetime(2024, 1, 1)
    for m in range(60):
        pool = rng.sample(range(12), 4) if m % 2 else rng.sample(range(100, 112), 4)
        maps.append((m, start + timedelta(days=m // 3), rng.random() < 0.5, pool[:2], pool[2:]))
    df = spark.createDataFrame(maps, "match_id long, start_time timestamp, radiant_win boolean, radiant array<bigint>, dire array<bigint>")
    got = {(r.match_id, r.account_id): (r.mu, r.sigma, r.games) for r in ratings.ratings_before(df).collect()}
    want = brute_ratings(maps)
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in got for x, y in zip(got[k], want[k], strict=True))


def test_account_components_of_a_long_chain(spark):
    n, rng = 3000, random.Random(5)
    ids = rng.sample(range(10 * n), n + 1)
    maps = [(m, [ids[m]], [ids[m + 1]]) for m in range(n)] + [(n, [-1], [-2])]
    df = spark.createDataFrame(maps, "match_id long, radiant array<bigint>, dire array<bigint>")
    got = {r.match_id: r.component for r in ratings.account_components(df).collect()}
    assert got == dict.fromkeys(range(n), min(ids)) | {n: -2}


def test_rating_update_moves_and_shrinks():
    (w,), (l,) = ratings.update([(25.0, 25 / 3)], [(25.0, 25 / 3)])  # noqa: E741
    assert w[0] > 25 > l[0] and w[1] < 25 / 3 and abs(w[0] + l[0] - 50) < 1e-9
    (w,), _ = ratings.update([(-400.0, 1.0)], [(400.0, 1.0)])
    assert math.isfinite(w[0]) and math.isfinite(w[1])


def test_rules(spark):
    df = spark.createDataFrame([("premium", None), ("premium", "tier2"), ("professional", ""), ("amateur", "tier1"), (None, "tier1")], "v string, w string")
    assert [r[0] for r in df.select(rules.segment(F.col("v"), F.col("w"))).collect()] == ["tier1", "pro", "pro", "excluded", None]
    f = spark.createDataFrame([("bo2", 1, 1), ("bo2", 1, 0), ("bo3", 2, 1), ("bo5", 2, 2), ("bo1", 0, 1)], "f string, a int, b int")
    assert [tuple(r[0]) for r in f.select(rules.series_outcome(F.col("f"), F.col("a"), F.col("b"))).collect()] == [(None, True, True), (None, False, False), (True, False, True), (None, False, False), (False, False, True)]
    names = spark.createDataFrame([(n,) for n in (16, 24, 25, 35, 38, 43, 49, 50, 51, 36, 37)], "n int").select(rules.npc_building_name(F.col("n"))).collect()
    assert [r[0] for r in names] == [f"npc_dota_{x}" for x in ("goodguys_tower1_top", "goodguys_tower3_bot", "goodguys_tower4", "badguys_tower4", "goodguys_melee_rax_top", "goodguys_range_rax_bot", "badguys_range_rax_bot", "goodguys_fort", "badguys_fort")] + [None, None]
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(rules.bucket(F.lit(-1))).collect()
    assert one(spark.range(1).select(rules.redact(F.lit("http://x/?api_key=abc&y=1")).alias("u"))).u == "http://x/?api_key=***&y=1"


def test_percentile_and_bootstrap(spark):
    v = F.array(*[F.lit(float(x)) for x in (5, 1, 4, 2, 3)])
    assert one(spark.range(1).select(metrics.percentile(v, 0.1).alias("a"), metrics.percentile(v, 0.9).alias("b"), metrics.percentile(v, 1.0).alias("c")))[:] == (1.0, 5.0, 5.0)
    rows = [(m, datetime(2024, 1, 1) + timedelta(days=m), k, m % 3 > 0, 0.6, 0.5, "constant") for m in range(30) for k in range(4)]
    scored = spark.createDataFrame(rows, "match_id long, start_time timestamp, minute int, radiant_win boolean, p double, baseline double, baseline_name string")
    d = one(metrics.paired_differences_seeded(scored))
    loss = lambda y, p: -math.log(p if y else 1 - p)
    gaps = [4 * (loss(m % 3 > 0, 0.6) - loss(m % 3 > 0, 0.5)) for m in range(30)]
    rng = random.Random(f"{metrics.SEED}:constant:0-4")
    means = sorted(sum(rng.choices(gaps, k=30)) / 120 for _ in range(500))
    assert abs(d.low - means[50]) < 1e-12 and abs(d.high - means[450]) < 1e-12 and abs(d.difference - sum(gaps) / 120) < 1e-12
    # the distributed one: the same sums by hand, and an interval like the seeded one's
    p = one(metrics.paired_differences(scored.repartition(3)))
    w = metrics.poisson_weights(np.arange(30), 500, metrics.SEED)
    means = sorted(sum(a * g for a, g in zip(w[:, r], gaps)) / (4 * w[:, r].sum()) for r in range(500))
    assert abs(p.low - means[50]) < 1e-12 and abs(p.high - means[450]) < 1e-12 and p.difference == pytest.approx(d.difference) and p.matches == 30
    assert abs(p.low - d.low) < 0.3 * d.margin and abs(p.high - d.high) < 0.3 * d.margin
    big = metrics.poisson_weights(np.arange(-2000, 2000), 500, 1)
    assert abs(big.mean() - 1) < 0.005 and abs(big.var() - 1) < 0.01


def test_text(spark):
    got = one(spark.range(1).select(
        text.normal_name(F.lit("DreamLeague Season 29")).alias("n"), text.name_score(F.lit("DreamLeague Season 29"), F.lit("DreamLeague/29")).alias("same"), text.name_score(F.lit("DreamLeague 29"), F.lit("DreamLeague/28")).alias("other"),
        text.description(F.lit("X is an offline Tier 1 event from Dec 28 to Jan 4 2026 featuring 16 teams with a prize pool of $1,000,000 USD")).alias("d"),
        text.combined_score(F.lit(0.8), F.lit(0.0), F.lit(1.0)).alias("veto"), text.combined_score(F.lit(0.5), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.9), F.lit(False)).alias("roster"),
        text.participants(F.lit("{{Opponent|Team Spirit|score=2}} |team=Team Liquid\n|team2=9\n{{Opponent|score=2}}")).alias("p"), text.winner(F.lit("{{Placement|1|{{Opponent|Team Spirit}}}}")).alias("w"),
    ))
    assert got.n == "dreamleague 29" and got.same == 1.0 and got.other <= 0.49 and got.veto == 0.45 and abs(got.roster - 0.95) < 1e-9
    assert (str(got.d.start_date), str(got.d.end_date), got.d.team_count, got.d.prize_pool, got.d.currency, got.d.tier, got.d.is_lan) == ("2025-12-28", "2026-01-04", 16, 1e6, "USD", "tier1", True)
    assert sorted(got.p) == ["team liquid", "team spirit"] and got.w == "team spirit"
    assert text.greedy_overlap(["virtus pro", "x"], ["virtus.pro"]) == 0.5 and text.greedy_overlap([], ["a"]) is None


PAGE = """==Format==
<ul><li>'''Group Stage''' (August 13 - 16)<ul><li>All matches are {{Abbr/Bo2}}</li></ul></li>
<li>'''Playoffs''' (August 20 - August 23)<ul><li>Grand Final is {{Abbr/Bo5}}, all other matches are {{abbr/bo3}}</li></ul></li><li>'''Prize''' {{Abbr/Bo1}}</li></ul>
==Teams==
"""


def test_stages_of_pages(spark):
    nested = """== Format ==
** not yet a stage {{abbr/bo1}}
*'''Group Stage''' (May 30 - June 2, 2025) {{abbr/bo2}}
**'''Phase One''' {{abbr/bo1}}, every tie is {{abbr/bo3}}
**'''Phase Two''' Feb 30
*** {{abbr/bo3}}; {{abbr/bo5}} {{abbr/bo3}}
*'''Grand Final'''
*All matches of the grand final are {{Abbr/Bo5}}
===Deeper===
==Teams==
*'''Playoffs''' {{abbr/bo5}}
"""
    pages = spark.createDataFrame([(1, PAGE, 2026, "x"), (2, nested, None, "y"), (3, "no section", 2026, "z"), (4, None, None, None), (5, "==Format==\nplain {{abbr/bo1}}\n", 2026, "z")], "page_id int, page string, year int, name string")
    got = {}
    for r in text.stage_formats(pages).orderBy("page_id", "name").collect():
        got.setdefault(r.page_id, []).append((r.name, r.stage_type, r.default_format, r.formats_seen, str(r.start_date), str(r.end_date)))
    assert got == {
        1: [("Group Stage", "group", "bo2", "bo2", "2026-08-13", "2026-08-16"), ("Playoffs", "playoff", "bo3", "bo5,bo3", "2026-08-20", "2026-08-23")],
        2: [
            ("Grand Final", "playoff", "bo5", "bo5", "2025-05-30", "2025-06-02"), ("Group Stage", "group", "bo2", "bo2", "2025-05-30", "2025-06-02"),
            ("Group Stage / Phase One", "group", "bo3", "bo1,bo3", "2025-05-30", "2025-06-02"), ("Group Stage / Phase Two", "group", "bo3", "bo3,bo5,bo3", "2025-05-30", "2025-06-02"),
        ],
    }
    assert text.stage_formats(pages.limit(0)).count() == 0


def test_model_round_trip(spark, tmp_path):
    rng, rows = random.Random(5), []
    for m in range(120):
        edge = rng.gauss(0, 1)
        rows += [(m, datetime(2024, 1, 1) + timedelta(days=m), k, edge * 1000 * k, rng.random() < 1 / (1 + math.exp(-2 * edge)), "tier1") for k in range(1, 6)]
    df = spark.createDataFrame(rows, "match_id long, start_time timestamp, minute int, gold_adv double, radiant_win boolean, segment string").withColumn("tier", F.lit("tier1"))
    parts = models.split_by_time(models.with_weights(df))
    assert {r.part: r.n for r in parts.groupBy("part").agg(F.countDistinct("match_id").alias("n")).collect()} == {"train": 84, "validation": 12, "holdout": 24}
    model = models.train_booster(parts, ("minute", "gold_adv"), rounds=5, minInstancesPerNode=5)
    models.save(model, models.Card("lgbm-1", ["minute", "gold_adv"], passes_gate=True), f"file://{tmp_path}")
    assert one(models.latest_passing(spark, f"file://{tmp_path}")).version == "lgbm-1"
    again = models.PipelineModel.load(f"file://{tmp_path}/models/lgbm-1")
    hold = models.score(again, parts.where("part = 'holdout'"), ("minute", "gold_adv"))
    assert one(hold.agg(F.min("p").alias("a"), F.max("p").alias("b"))).a >= 0.01
    with pytest.raises(ValueError):
        models.score(again, parts, ("gold_adv", "minute"))
    base = models.logistic_baseline(parts.where("part = 'train'"), parts.where("part = 'holdout'"))
    loss = one(base.agg(F.avg(rules.row_log_loss(F.col("radiant_win"), F.col("baseline"))).alias("x"))).x
    assert loss < 0.69
    platt = models.Platt.fit(hold)
    assert math.isfinite(platt.a) and models.calibration_rows(df)[1] == "none"


def test_training_run_writes_a_judged_card(spark, tmp_path):
    rng, rows = random.Random(6), []
    for m in range(60):
        edge = rng.gauss(0, 1)
        won = rng.random() < 1 / (1 + math.exp(-3 * edge))
        rows += [(m, datetime(2024, 1, 1) + timedelta(days=m), k, edge * 800 * (k + 1), won, "tier1", "tier1", 0.9) for k in (1, 6, 12)]
    df = spark.createDataFrame(rows, "match_id long, start_time timestamp, minute int, gold_adv double, radiant_win boolean, segment string, tier string, prematch_prior double")
    card = models.training_run(df, f"file://{tmp_path}", "lgbm-20240101-000000", ("minute", "gold_adv", "prematch_prior"), rounds=3, minInstancesPerNode=3)
    assert card.scores["holdout_matches"] == 12 and card.scores["train_matches"] == 42 and card.scores["log_loss"] < 0.69 and card.calibration == {"a": 1.0, "b": 0.0}
    assert {"log_loss 0-4", "log_loss 5-9", "log_loss 10-14"} <= set(card.scores)
    (stored,) = models.cards(spark, f"file://{tmp_path}").collect()
    assert stored.version == card.version and stored.passes_gate == card.passes_gate and stored.notes == "calibrated on none"
    with pytest.raises(ValueError, match="no snapshots"):
        models.training_run(df.limit(0), f"file://{tmp_path}", "x")


def test_outcomes_fill_gaps_only(spark):
    raw = spark.createDataFrame([(7, "stratz_match", json.dumps(detail_b())), (8, "opendota_match", json.dumps({"match_id": 8, "radiant_win": False, "duration": 900, "start_time": 1700000000})), (9, "opendota_match", "{}")], "match_id long, source string, payload string")
    matches = spark.createDataFrame([(7, None, None, None), (8, True, None, 5)], "match_id long, radiant_win boolean, start_time timestamp, duration int")
    wanted = spark.createDataFrame([(7,), (7,), (8,), (9,)], "match_id long")
    resolved, left = outcomes.resolve(matches, wanted, raw)
    got = {r.match_id: (r.radiant_win, r.duration) for r in resolved.collect() if r.match_id is not None}
    assert got == {7: (True, 780), 8: (True, 5)} and [r.match_id for r in left.collect()] == [9]
    assert [r.match_id for r in outcomes.to_fetch(wanted, raw, outcomes.outcome_source(False), 5).collect()] == [7]
    score = spark.createDataFrame([(True, (1, 2), (3, 4)), (False, (1, 2), (3, 4)), (False, (1, 2), None), (True, None, None)], "l boolean, s struct<radiant:int,dire:int>, r struct<radiant:int,dire:int>")
    assert [tuple(r[0] or ()) for r in score.select(outcomes.map_score(F.col("l"), F.col("s"), F.col("r"))).collect()] == [(1, 2), (3, 4), (1, 2), ()]
    players = spark.createDataFrame([(1, True, 3), (1, True, None), (1, False, 2)], "match_id long, is_radiant boolean, kills int")
    assert tuple(one(outcomes.roster_kills(players)).roster) == (3, 2)


def test_wiki_sync_applies_what_is_certain(spark):
    leagues = spark.createDataFrame([(1, "DreamLeague Season 29", None, None), (2, "Fissure Playground 2", None, None), (3, "Fissure Playground 2", None, None), (4, "Known", "Known/1", None)], "league_id long, name string, liquipedia_slug string, start_date date")
    cats = ["Category:Tier 1 Tournaments", "Category:Tournaments"]
    search = spark.createDataFrame([(1, 0, "DreamLeague/29", cats, None, None), (2, 0, "Fissure Playground/2", cats, None, None), (3, 0, "Fissure Playground/2", cats, None, None)], "league_id long, position int, title string, categories array<string>, display_name string, description string")
    evidence = spark.createDataFrame([], "league_id long, first_match date, last_match date, team_count long, teams array<string>, champion string")
    pages = spark.createDataFrame([("Known/1", PAGE)], "page_title string, wikitext string")
    mappings = spark.createDataFrame([(1, "old", "tier2", None, 0.5, "auto", None, None, None)], "league_id long, slug string, tier string, is_lan boolean, score double, decided_by string, decided_at timestamp, superseded_at timestamp, note string")
    out = matching.sync_mappings(leagues, search, pages, evidence, mappings, F.lit("2024-01-01").cast("timestamp"), budget=2)
    assert [r.league_id for r in out["applied"].collect()] == [1] and sorted(r.league_id for r in out["conflicts"].collect()) == [2, 3]
    assert sorted((r.slug, r.superseded_at is None) for r in out["mappings"].collect()) == [("DreamLeague/29", True), ("old", False)]
    matches = spark.createDataFrame([(4, datetime(2026, 8, 20)), (4, datetime(2026, 8, 13))], "league_id long, start_time timestamp")
    stored = spark.createDataFrame([(9, 4, "Playoffs", "playoff", "bo1", None, "Known/1", None, None), (8, 4, "Gone", "group", "bo1", None, "Known/1", None, None)], schemas.TABLES["tournament_stages"])
    got = {r.name: (r.default_format, str(r.starts_at)[:10]) for r in matching.refresh_stages(leagues, matches, pages, stored).collect()}
    assert got == {"Gone": ("bo1", "None"), "Group Stage": ("bo2", "2026-08-13"), "Playoffs": ("bo3", "2026-08-20")}


def test_as_of_with_one_hot_key_equals_a_plain_search(spark):
    """One key holds most rows over many days, some without any; times differ, so there is one newest row."""
    rng, start = random.Random(12), datetime(2024, 1, 1)
    times = rng.sample(range(40 * 86400), 900)
    rows = [(1 if rng.random() < 0.9 else rng.randrange(2, 6), start + timedelta(seconds=t), i) for i, t in enumerate(times)]
    left = spark.createDataFrame([(i, k, t) for k, t, i in rows if i % 3 == 0] + [(-1, 1, None), (-2, None, start)], "id long, k long, at timestamp")
    right = spark.createDataFrame([(k, t, i, None if i % 7 == 0 else f"v{i}") for k, t, i in rows if i % 3 and not t.day % 5 == 0], "k long, ts timestamp, value long, name string")
    got = {r.id: (r.value, r.name) for r in history.as_of(left.repartition(3), right.repartition(3), "k", "at", "ts", ["value", "name"]).collect()}
    known = [r for r in right.collect()]
    for i, k, t in [tuple(x) for x in left.collect()]:
        before = [r for r in known if t is not None and r.k == k and r.ts <= t]
        newest = max(before, key=lambda r: r.ts, default=None)
        assert got[i] == ((newest.value, newest["name"]) if newest else (None, None))
