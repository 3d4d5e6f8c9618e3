"""Small cases of what reviews found on odd inputs and larger tables."""

import json
import re

import pytest

from tideglass import schemas
from tideglass.operators import normalize, snapshots
from tideglass.plans import catalog, payloads
from tideglass.plans import views as v

FOLDER = "/root/testdata/sf0.001"


def test_leads_are_cut_in_the_vectors_own_type(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [0.053, -0.061, -0.149, 0.5])], "vec_id long, embedding array<float>")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    (row,) = v.series_arrays(spark, str(tmp_path)).collect()
    assert row.leads == [53, -61, -149, 500]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["t12_snapshots_b", "t13_snapshots_a", "f01_featurize", "f04_serving_view", "f20_map_score", "w11_history_block"])
def test_no_filter_reads_a_text_again(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, FOLDER))
    assert "from_json" in plan and not any("from_json" in line for line in plan.splitlines() if "Filter" in line)


def test_texts_are_written_by_many_tasks(spark):
    assert payloads.maps(spark, FOLDER).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["t12_snapshots_b", "t13_snapshots_a"])
def test_buildings_are_told_apart_before_the_minutes(spark, name):
    above = _plan(catalog.QUERIES[name](spark, FOLDER)).split("Generate explode(sequence")[0]
    assert "minute" in above and "kind = tower" not in above


def test_a_lane_loses_no_more_than_it_has(spark):
    mid = [{"time": t, "npcId": 17} for t in (700, 100, 200, 300, 400)]  # five kills of three towers
    game = {"id": 1, "didRadiantWin": True, "durationSeconds": 780, "parsedDateTime": 1, "radiantNetworthLeads": [5], "towerDeaths": [*mid, {"time": 250, "npcId": 99}, {"npcId": 18}, {"time": 60, "npcId": 50}], "players": [], "pickBans": []}
    rows = snapshots.snapshots_b(normalize.parse(spark.createDataFrame([(json.dumps(game),)], "payload string"), schemas.DETAIL_B)).orderBy("minute").collect()
    assert [r.radiant_towers for r in rows] == [11, 10, 10, 9, 9, *[8] * 9] and {r.dire_towers for r in rows} == {11} and {r.radiant_barracks for r in rows} == {6}


def test_part_of_a_schema():
    assert schemas.part("id long, p array<struct<a:int,b:struct<c:int,d:string>>>, q int", "id", "p.b.d") == "id bigint, p array<struct<b:struct<d:string>>>"


@pytest.mark.parametrize("name", ["p06_match_players", "p07_match_drafts", "p08_match_objectives", "p09_match_rows", "q10_card_draft", "q11_timeline"])
def test_no_text_is_shuffled(spark, name):
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().splitlines()
    for at, line in enumerate(plan):
        if "Exchange hashpartitioning" in line:
            below = re.sub(r"from_json.*", "", "".join(plan[at + 1 : at + 2]))
            assert "payload" not in below and "players" not in below


def test_reasons_are_counted_without_moving_maps(spark):
    plan = _plan(catalog.QUERIES["f08_skips"](spark, FOLDER)).splitlines()
    (left,) = [plan[at + 1] for at, line in enumerate(plan) if "Join LeftSemi" in line]
    assert re.search(r"Project \[id#\d+L?, CASE", left)


def test_one_payload_a_match_whatever_its_source(spark):
    b = lambda i, win: json.dumps({"id": i, "didRadiantWin": win, "players": [{"playerSlot": 0, "kills": 7}], "towerDeaths": [{"time": 60, "npcId": 16}]})
    a = lambda i: json.dumps({"match_id": i, "radiant_win": True, "players": [{"player_slot": 0, "kills": 9}], "objectives": [{"time": 5, "type": "x"}]})
    raw = spark.createDataFrame([(1, "stratz_match", b(1, False)), (1, "opendota_match", a(1)), (2, "opendota_match", a(2)), (3, "stratz_match", b(3, True)), (3, "stratz_match", b(3, False)), (4, "steam", a(4)), (5, "opendota_match", None)], "match_id long, source string, payload string")
    tables = normalize.details(raw, ("player_slot", "kills"))
    assert sorted(tuple(r) for r in tables["match_players"].collect()) == [(1, 0, 7), (2, 0, 9), (3, 0, 7)]
    assert sorted((r.match_id, r.type) for r in tables["match_objectives"].collect()) == [(1, "building_kill"), (2, "x"), (3, "building_kill")]
    assert sorted(r.match_id or 0 for r in tables["matches"].collect()) == [0, 1, 2, 3]
