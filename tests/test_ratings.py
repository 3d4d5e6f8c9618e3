"""The rating fold by levels, slices and late maps against one plain pass."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideglass.operators import ratings
from tideglass.plans import catalog

MAPS = "match_id long, start_time timestamp, radiant_win boolean, radiant array<bigint>, dire array<bigint>"


def season(seed, n, accounts, side=2, first=0):
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    out = []
    for m in range(first, first + n):
        pool = rng.sample(range(accounts), 2 * side)
        out.append((m, start + timedelta(hours=rng.randrange(n)), rng.random() < 0.5, pool[:side], pool[side:]))  # many maps of one second
    return out


def plain(maps):
    rows = ratings.fold(pd.DataFrame(maps, columns=["match_id", "start_time", "radiant_win", "radiant", "dire"]))
    return {(r.match_id, r.account_id): (r.mu, r.sigma, r.games, r.is_radiant) for r in rows.itertuples()}


def last_states(maps):
    """Each account's rating before a map that follows all others."""
    accounts = sorted({a for m in maps for a in m[3] + m[4]})
    end = [(10**9 + a, datetime(2100, 1, 1), True, [a], []) for a in accounts]
    return {a: plain([*maps, e])[e[0], a][:3] for a, e in zip(accounts, end)}


def collected(before):
    rows = before.collect()
    got = {(r.match_id, r.account_id): (r.mu, r.sigma, r.games, r.is_radiant) for r in rows}
    assert len(got) == len(rows)
    return got


def same(got, want):
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_levels_have_no_account_in_common():
    rng = random.Random(1)
    seats = [rng.sample(range(40), 4) for _ in range(300)]
    level = ratings.levels(seats, 40)
    for k, seat in enumerate(seats):
        earlier = [level[j] for j in range(k) if set(seats[j]) & set(seat)]
        assert level[k] == 1 + max(earlier, default=0)


@pytest.mark.parametrize("slice_,chunk,accounts", [(1000, 1000, 30), (40, 7, 30), (40, 7, 300), (1, 1, 8)])
def test_fold_equals_one_pass_whatever_the_slices(spark, monkeypatch, slice_, chunk, accounts):
    monkeypatch.setattr(ratings, "SLICE", slice_)
    monkeypatch.setattr(ratings, "CHUNK", chunk)
    n = 12 if slice_ == 1 else 150
    maps = season(7, n, accounts) + [(m + 500, t, w, [a + 1000 for a in r], [a + 1000 for a in d]) for m, t, w, r, d in season(8, n // 5, 9)]
    maps += [(999, None, True, [1], [2]), (998, maps[0][1], None, [1], [2])]  # neither takes part
    got = ratings.rate(spark.createDataFrame(maps, MAPS).repartition(3))
    same(collected(got.before), plain(maps[:-2]))
    same({r.account_id: (r.mu, r.sigma, r.games) for r in got.after.collect()}, last_states(maps[:-2]))


def test_a_giant_component_is_many_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(ratings, "SLICE", 60)
    monkeypatch.setattr(ratings, "CHUNK", 1)
    seen = []
    folded = ratings._folded
    monkeypatch.setattr(ratings, "_folded", lambda maps, states: seen.append(maps.select("unit").distinct().count()) or folded(maps, states))
    maps = [(m, t, w, [8 * (m % 30) + a for a in r], [8 * (m % 30) + a for a in d]) for m, t, w, r, d in season(3, 210, 8)]
    maps += [(300 + g, datetime(2025, 1, 1), True, [8 * g, 8 * g + 1], [8 * g + 8]) for g in range(29)]  # links all groups in the end
    df = spark.createDataFrame(maps, MAPS)
    assert ratings.account_components(df).select("component").distinct().count() == 1
    same(collected(ratings.rate(df).before), plain(maps))
    assert len(seen) == 5 and seen[0] == 0 and min(seen[1:4]) > 20  # no short component, and slices that fall apart


def test_ratings_of_empty_and_odd_tables(spark):
    empty = ratings.rate(spark.createDataFrame([], MAPS))
    assert empty.before.count() == 0 and empty.after.count() == 0
    uneven = [(1, datetime(2024, 1, 1), True, [1, 2, 3], [4]), (2, datetime(2024, 1, 1), False, [4], [5, 1])]
    same(collected(ratings.rate(spark.createDataFrame(uneven, MAPS)).before), plain(uneven))


@pytest.mark.parametrize("seed", range(4))
def test_late_maps_equal_a_rebuild(spark, seed):
    rng = random.Random(seed)
    maps = season(seed, 120, 60)
    known, late = maps[:110], maps[110:]
    fixed = [(m, t, not w, r, d) for m, t, w, r, d in rng.sample(known, 2)]  # corrected results
    m, t, w, r, d = known[5]
    fixed.append((m, t - timedelta(hours=3), w, [*r[:1], 77], d))  # another time and roster
    withdrawn = [(m, t, None, r, d) for m, t, _, r, d in rng.sample(known[20:], 1)]
    change = {x[0]: x for x in [*late, *fixed, *withdrawn]}
    df = lambda rows: spark.createDataFrame(rows, MAPS)
    stored = ratings.rate(df(known))
    update = ratings.rate_late(df(known), df(list(change.values())), stored)
    now = [x for x in known if x[0] not in change] + [x for x in change.values() if x[2] is not None]
    whole = ratings.apply_late(stored, update)
    same(collected(whole.before), plain(now))
    want = last_states(now)
    got = {r.account_id: (r.mu, r.sigma, r.games) for r in whole.after.collect()}
    same({a: s for a, s in got.items() if a in want}, want)
    assert all(abs(got[a][0] - 25) < 1e-9 and got[a][2] == 0 for a in got.keys() - want.keys())  # all their maps were taken back


def test_late_maps_leave_the_rest_alone(spark):
    """A late map rewrites later maps that its accounts lead to, and no other."""
    start = datetime(2024, 1, 1)
    maps = [(k, start + timedelta(days=k), True, [10 * (k % 5)], [10 * (k % 5) + 1]) for k in range(100)]  # five pairs that never meet
    df = spark.createDataFrame(maps, MAPS)
    stored = ratings.rate(df)
    late = spark.createDataFrame([(1000, start + timedelta(days=90, hours=1), True, [20], [21])], MAPS)
    update = ratings.rate_late(df, late, stored)
    assert {r.match_id for r in update.rewritten.collect()} == {92, 97, 1000}
    assert update.before.count() == 6 and update.after.count() == 2
    nothing = ratings.rate_late(df, df.limit(0), stored)
    assert nothing.rewritten.count() == 0 and ratings.apply_late(stored, nothing).before.count() == 200
    gone = ratings.rate_late(df, spark.createDataFrame([(99, None, None, None, None)], MAPS), stored)
    assert ratings.apply_late(stored, gone).before.count() == 198 and {r.games for r in gone.after.collect()} == {19}
    assert stored.before.where(F.col("match_id") == 99).count() == 2


def test_late_maps_over_whole_tables(spark):
    """The query over late and corrected maps gives what one fold over all maps gives."""
    folder = "/root/testdata/sf0.001"
    key = lambda df: {(r.match_id, r.account_id): (r.mu, r.sigma, r.games) for r in df.collect()}
    same(key(catalog.QUERIES["r09_late_ratings"](spark, folder)), key(catalog.w13_ratings(spark, folder)))
