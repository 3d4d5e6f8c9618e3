"""The live tick over files, end to end; the throttle; the paged source."""

import json
import time
import urllib.error
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideglass import schemas
from tideglass.operators import normalize
from tideglass.sources import cursors, files, http
from tideglass.sources.tables import KeyedTable
from tideglass.streaming import live


def game(match_id, started=True):
    side = lambda base: {"score": 3, "tower_state": 2047, "barracks_state": 63, "players": [{"player_slot": i, "account_id": base + i, "hero_id": i + 1, "net_worth": 1000 + base} for i in range(5)]}
    return {"match_id": match_id, "league_id": 3, "radiant_team": {"team_id": 1, "team_name": "A"}, "dire_team": {"team_id": 2, "team_name": "B"}} | ({"scoreboard": {"duration": 605.0, "radiant": side(10), "dire": side(0)}} if started else {})


def test_live_tick(spark, tmp_path):
    (tmp_path / "in").mkdir()
    crowded = game(4)
    crowded["scoreboard"]["radiant"]["players"] *= 2
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(g) for g in (game(1), game(2, started=False), {"league_id": 3}, crowded)))
    rated = spark.createDataFrame([(10, 1, datetime(2024, 1, 1), 30.0, 2.0, 25)], "account_id long, as_of_match_id long, as_of_time timestamp, mu double, sigma double, games long")
    context = spark.createDataFrame([(3, "tier1", "premium", True, "bo3")], "league_id long, tier string, valve_tier string, is_lan boolean, format string")
    history = spark.createDataFrame([(1, 30), (2, 12)], "team_id long, maps long")
    run = live.run_live(files.live_stream(spark, str(tmp_path / "in")), lambda: context, lambda: history, str(tmp_path / "out"), str(tmp_path / "ck"), every=None, player_ratings=lambda: rated)
    run.awaitTermination(120)
    assert run.exception() is None
    assert spark.read.parquet(f"{tmp_path}/out/raw").count() == 4
    assert {r.reason for r in spark.read.parquet(f"{tmp_path}/out/dead_letters").collect()} == {"no match_id", "more than five players a side"}
    (row,) = spark.read.parquet(f"{tmp_path}/out/predictions").collect()
    assert row.match_id == 1 and row.minute == 10 and row.features["gold_adv"] == 50.0 and row.features["radiant_towers"] == 11 and 0.01 <= row.p_radiant <= 0.99 and row.features["series_len"] == 3
    assert row.features["established_diff"] == 1.0 and row.features["prematch_prior"] > 0.5 and row.features["form_diff"] == 0.0
    (entry,) = live.read_feed(spark, str(tmp_path / "out")).collect()
    assert entry.team_history == 12 and entry.tier == "tier1"


def boards(tmp_path, name, *games):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(g) for g in games))


def tick(spark, tmp_path, scorer=live.baseline_scorer, **how):
    context = spark.createDataFrame([(3, "tier1", "premium", True, "bo3")], "league_id long, tier string, valve_tier string, is_lan boolean, format string")
    history = spark.createDataFrame([(1, 30), (2, 12)], "team_id long, maps long")
    run = live.run_live(files.live_stream(spark, str(tmp_path / "in")), lambda: context, lambda: history, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", scorer, every=None, **how)
    try:
        run.awaitTermination(200)
    finally:
        run.stop()


def bad_scorer(wrong):
    """Fails for a batch that holds the wrong game, as a model does that meets a value it cannot take."""
    check = lambda rows: rows.withColumn("minute", F.when(F.col("match_id") == wrong, F.raise_error(F.lit("no such hero")).cast("double")).otherwise(F.col("minute")))
    return lambda rows: live.baseline_scorer(check(rows))


def test_a_game_that_cannot_be_scored_costs_no_other(spark, tmp_path):
    boards(tmp_path, 1, *[game(k) for k in range(1, 41)])
    tick(spark, tmp_path, bad_scorer(17))
    (letter,) = spark.read.parquet(f"{tmp_path}/out/dead_letters").collect()
    assert letter.match_id == 17 and "no such hero" in letter.reason and json.loads(letter.payload)["league_id"] == 3
    assert {r.match_id for r in spark.read.parquet(f"{tmp_path}/out/predictions").collect()} == set(range(1, 41)) - {17}
    assert live.read_feed(spark, f"file://{tmp_path}/out").count() == 39


def test_boards_that_are_no_boards_are_dead_letters(spark, tmp_path):
    """One field of another type, broken text, a list: each its own letter with the reason, and 97 predictions."""
    boards(tmp_path, 1, *[game(k) for k in range(1, 98)], game(98) | {"league_id": "three"}, [game(99)])
    (tmp_path / "in" / "2.json").write_text('{"match_id": 100, "scoreb')
    context = spark.createDataFrame([(3, "tier1", "premium", True, "bo3")], "league_id long, tier string, valve_tier string, is_lan boolean, format string")
    history = spark.createDataFrame([(1, 30), (2, 12)], "team_id long, maps long")
    run = live.run_live(files.live_lines(spark, f"file://{tmp_path}/in"), lambda: context, lambda: history, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", every=None)
    run.awaitTermination(200)
    assert run.exception() is None
    letters = {(r.match_id, r.reason) for r in spark.read.parquet(f"{tmp_path}/out/dead_letters").collect()}
    assert letters == {(98, "field of another type: league_id"), (None, "no JSON object"), (None, "malformed JSON")}
    assert {r.match_id for r in spark.read.parquet(f"{tmp_path}/out/predictions").collect()} == set(range(1, 98))


def test_payloads_are_checked_field_by_field(spark):
    rows = ['{"match_id": 1, "players": [{"account_id": 2}]}', '{"id": "7", "players": null}', '{"match_id": 3, "players": [{"account_id": "x"}]}', '{"match_id": "nine"}', "[1]", "", None, "{", '{"match_id": 1, "other": [1, "a"]}', '"text"']
    df = spark.createDataFrame([(r, "x") for r in rows], "payload string, reason string")
    good, bad = normalize.parse_checked(df, "match_id long, id string, players array<struct<account_id:long>>")
    assert sorted((r.match_id, r.id) for r in good.collect() if r.match_id) == [(1, None), (1, None)] and good.count() == 3
    got = {(r.payload, r.match_id): r.reason for r in bad.collect()}
    assert got == {(rows[2], 3): "field of another type: nested", (rows[3], None): "field of another type: match_id", ("[1]", None): "no JSON object", ("", None): "malformed JSON", (None, None): "no payload", ("{", None): "malformed JSON", ('"text"', None): "no JSON object"}
    ids = spark.createDataFrame([(r,) for r in rows], "p string").select(normalize.match_id_of(F.col("p")).alias("i"))
    assert [r.i for r in ids.collect()] == [1, 7, 3, None, None, None, None, None, 1, None]


def test_a_scorer_that_never_works_is_an_error(spark, tmp_path):
    def broken(rows):
        raise ValueError("no model")

    boards(tmp_path, 1, game(1), game(2))
    with pytest.raises(Exception, match="no model"):
        tick(spark, tmp_path, broken)
    tick(spark, tmp_path)  # the batch is not lost
    assert spark.read.parquet(f"{tmp_path}/out/predictions").count() == 2


def test_feed_expires_and_its_files_do_not_add_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "FEED_SECONDS", 0)
    table = live.feed_table(spark, f"file://{tmp_path}/out")
    now = datetime.now()
    entry = lambda k, at, p: (k, 3, "tier1", "premium", 0, 1, 1, 10.0, p, "m", 1, at)
    df = lambda *rows: spark.createDataFrame(list(rows), live.FEED)
    live.store_feed(table, df(entry(1, now, 0.5), entry(2, now - timedelta(seconds=300), 0.4)), ("s", 1), 120)
    assert {r.match_id: r.p for r in table.read().collect()} == {1: 0.5}  # 2 is stale
    live.store_feed(table, df(entry(1, now - timedelta(seconds=20), 0.9), entry(3, now, 0.1)), ("s", 2), 120)
    assert {r.match_id: r.p for r in table.read().collect()} == {1: 0.5, 3: 0.1}  # a late row does not replace a newer one
    before = table.snapshot().version
    live.store_feed(table, df(entry(9, now, 0.5)), ("s", 2), 120)
    assert table.snapshot().version == before  # the batch came before
    for k in range(3, 9):
        live.store_feed(table, df(entry(1, datetime.now(), 0.6)), ("s", k), 0)
    assert len(table.versions()) <= 3 and len(list((tmp_path / "out/feed/data").iterdir())) <= 3 and not list((tmp_path / "out/feed/drafts").iterdir())
    assert live.read_feed(spark, f"file://{tmp_path}/out", 0).count() == 0


def test_unseen_leagues_are_registered_and_restarts_repeat_nothing(spark, tmp_path):
    leagues = KeyedTable(spark, f"file://{tmp_path}/leagues", "league_id long, name string", ["league_id"], buckets=2)
    leagues.replace(spark.createDataFrame([(3, "known")], "league_id long, name string"))
    boards(tmp_path, 1, game(1), game(2) | {"league_id": 8}, game(5) | {"league_id": 0})
    tick(spark, tmp_path, leagues=leagues)
    assert sorted((r.league_id, r.name) for r in leagues.read().collect()) == [(3, "known"), (8, None)]
    tick(spark, tmp_path, leagues=leagues)  # nothing new
    assert spark.read.parquet(f"{tmp_path}/out/predictions").count() == 3
    boards(tmp_path, 2, game(1), game(7))
    tick(spark, tmp_path, leagues=leagues)
    assert spark.read.parquet(f"{tmp_path}/out/predictions").count() == 5
    assert {r.match_id for r in live.read_feed(spark, f"file://{tmp_path}/out").collect()} == {1, 2, 5, 7}


def test_a_new_checkpoint_is_a_new_run(spark, tmp_path):
    """Batch numbers that start again do not pass for batches that were stored before."""
    boards(tmp_path, 1, game(1))
    tick(spark, tmp_path)
    (tmp_path / "ck").rename(tmp_path / "gone")
    boards(tmp_path, 2, game(2))
    tick(spark, tmp_path)
    assert {r.match_id for r in live.read_feed(spark, f"file://{tmp_path}/out").collect()} == {1, 2}
    marks = live.feed_table(spark, f"file://{tmp_path}/out").snapshot().batches
    assert len(marks) == 2 and all(len(k) == 36 for k in marks)


def claims(spark, tmp_path, name, rows, seconds=900):
    spark.createDataFrame(rows, "league_id long, requested_at timestamp").repartition(2).write.parquet(f"{tmp_path}/in/{name}")
    stream = spark.readStream.schema("league_id long, requested_at timestamp").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = live.throttled(stream, seconds=seconds).writeStream.format("parquet").option("path", f"{tmp_path}/claims").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    for _ in range(120):  # a query with expiring state never ends by itself
        time.sleep(0.5)
        if out.exception() or sum(p.numInputRows for p in out.recentProgress) >= len(rows):
            break
    out.stop()
    assert out.exception() is None
    return sorted((r.key, r.claimed_ms) for r in spark.read.schema("key long, claimed_ms long").parquet(f"{tmp_path}/claims").collect())


def test_throttle_claims_once(spark, tmp_path):
    start = datetime(2024, 1, 1)
    ms = lambda s: int((start + timedelta(seconds=s)).timestamp() * 1000)
    rows = [(1, start + timedelta(seconds=10)), (1, start), (1, start + timedelta(seconds=901)), (2, start), (None, start)]
    first = claims(spark, tmp_path, "a", [r for r in rows if r[0]])
    assert first == [(1, ms(0)), (1, ms(901)), (2, ms(0))]
    # the claims outlive a restart: 1 is held until 1801, 2 until 900
    again = claims(spark, tmp_path, "b", [(1, start + timedelta(seconds=1000)), (2, start + timedelta(seconds=899)), (2, start + timedelta(seconds=900)), (3, start)])
    assert again == sorted([*first, (2, ms(900)), (3, ms(0))])


def test_claims_expire_from_the_store(spark, tmp_path):
    """State lives as long as a claim holds by the clock, whatever the times in the requests."""
    start = datetime(2024, 1, 1)
    assert len(claims(spark, tmp_path, "a", [(1, start)], seconds=1)) == 1
    time.sleep(2)
    assert len(claims(spark, tmp_path, "b", [(1, start)], seconds=1)) == 2  # as good as never seen


def test_realtime_and_publish(spark):
    from tideglass.operators.snapshots import features, snapshots_realtime

    r = {"match": {"matchid": 5, "game_time": 130}, "teams": [{"team_number": 2, "score": 4, "net_worth": 900, "players": [{"net_worth": 900}]}, {"team_number": 3, "score": 1, "net_worth": 400, "players": []}], "buildings": [{"team": 2, "type": 0, "destroyed": False}, {"team": 2, "type": 0, "destroyed": True}], "graph_data": {"graph_gold": [1, 77]}}
    df = spark.createDataFrame([(json.dumps(r),)], "payload string").select(F.from_json("payload", schemas.REALTIME).alias("p")).select("p.*")
    (row,) = features(snapshots_realtime(df), "match_id").collect()
    assert row.minute == 2 and row.gold_adv == 77 and row.radiant_towers == 1 and row.kill_diff == 3


def test_ids_that_were_not_asked_for_show(monkeypatch):
    def answer(url, *rest):
        code = {"a": None, "b": 404, "c": 500, "d": 429, "e": None}[url[-1]]
        if code:
            raise RuntimeError(f"HTTPError at x: HTTP Error {code}")
        return "{}"

    monkeypatch.setattr(http, "fetch", answer)
    rows = list(http._Ids({"url": "http://x/{id}", "ids": "a,b,c,d,e", "interval": "0"}).read(None))
    assert [(r[0], r[2]) for r in rows] == [("a", "ok"), ("b", "missing"), ("c", "failed"), ("d", "not_asked"), ("e", "not_asked")]


def test_pages_backwards_again_and_forwards(monkeypatch):
    """A batch that is read again gives its rows, whatever has been added since."""
    known, asked = list(range(1, 26)), []

    def answer(url):
        asked.append(url)
        before = int(url.split("before=")[1]) if "before=" in url else 10**9
        return json.dumps([{"match_id": i} for i in sorted((x for x in known if x < before), reverse=True)[:10]])

    monkeypatch.setattr(http, "fetch", answer)
    pages = http._Pages({"url": "http://x/m?k=1", "cursor": "before", "interval": "0"})
    start, seen, offsets = pages.initialOffset(), [], []
    for _ in range(4):
        rows, end = pages.read(start)
        seen.append([int(r[0]) for r in rows])
        offsets.append((start, end))
        start = end
    assert seen == [list(range(25, 15, -1)), list(range(15, 5, -1)), list(range(5, 0, -1)), []]
    known += [26, 27, 28]
    assert [[int(r[0]) for r in pages.readBetweenOffsets(*o)] for o in offsets] == seen
    assert "http://x/m?k=1&before=16" in asked
    forward = http._Forward({"url": "http://x/m", "cursor": "before", "interval": "0", "known": "14"})
    assert [int(r[0]) for r in forward.read(None)] == list(range(28, 14, -1))


def test_graphql_errors_are_errors():
    sent = []
    ok = lambda url, body, headers: sent.append(json.loads(body)) or json.dumps({"data": {"match": {"id": 1}}})
    assert json.loads(http.graphql("http://x", "query", {"id": 1}, fetcher=ok)) == {"match": {"id": 1}} and sent == [{"query": "query", "variables": {"id": 1}}]
    with pytest.raises(RuntimeError, match="GraphQL"):
        http.graphql("http://x", "q", {}, fetcher=lambda *a: json.dumps({"errors": [{"message": "no"}]}))


def test_cursors(spark, tmp_path):
    path = f"file://{tmp_path}/cursors"
    assert cursors.read_cursor(spark, path, "a") is None
    for source, cursor in (("a", "1"), ("b", "5"), ("a", "2")):
        cursors.write_cursor(spark, path, source, cursor)
    assert cursors.read_cursor(spark, path, "a") == "2" and cursors.cursors(spark, path).count() == 2


def test_fetch_retries_and_redacts():
    waits = []

    def failing(code):
        def opener(request, timeout):
            raise urllib.error.HTTPError(request.full_url, code, "no", {}, None)

        return opener

    with pytest.raises(RuntimeError, match=r"key=\*\*\*"):
        http.fetch("http://x/?key=secret", opener=failing(503), sleep=waits.append)
    assert waits == [2.0, 4.0, 8.0]
    with pytest.raises(RuntimeError, match="404"):
        http.fetch("http://x/", opener=failing(404), sleep=waits.append)
    assert len(waits) == 3
