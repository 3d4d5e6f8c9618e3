"""Two-team Gaussian skill ratings, folded over maps in time order.

The update is the closed form for two teams of "TrueSkill" (Herbrich, Minka, Graepel, 2006)
without draws. A map depends on the earlier maps of its own accounts alone, so maps fall into
dependency levels: maps of one level have no account in common and are rated together, as arrays.
Components of the account graph do not touch each other and are folded in parallel, many to a task;
a component too large for a task is cut by time. All of it gives what one long fold would.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .components import components

MU, SIGMA = 25.0, 25.0 / 3
BETA, TAU = 25.0 / 6, 25.0 / 300


def update(winners: list[tuple[float, float]], losers: list[tuple[float, float]]) -> tuple[list, list]:
    """(mu, sigma) lists after a map."""
    wide = [[(m, s * s + TAU * TAU) for m, s in side] for side in (winners, losers)]
    c2 = sum(v + BETA * BETA for side in wide for _, v in side)
    c = math.sqrt(c2)
    t = (sum(m for m, _ in wide[0]) - sum(m for m, _ in wide[1])) / c
    tail = 0.5 * math.erfc(-t / math.sqrt(2))
    v = math.exp(-t * t / 2) / math.sqrt(2 * math.pi) / tail if tail > 1e-300 else -t
    w = min(max(v * (v + t), 0.0), 1.0)
    return tuple([(m + sign * var / c * v, math.sqrt(var * max(1 - var / c2 * w, 1e-9))) for m, var in side] for side, sign in zip(wide, (1, -1), strict=True))


#: Maps that one task folds one after another at most; a component with more is cut by time.
SLICE = 200_000
#: Maps that a task takes in one go, whole components together.
CHUNK = 20_000

_RATED = "match_id long, start_time timestamp, account_id long, is_radiant boolean, mu double, sigma double, games long"
_STATES = "account_id long, mu double, sigma double, games long"
_FOLDED = "after boolean, " + _RATED


class Rated(NamedTuple):
    """Ratings before each map (one row per map and account), and every account's rating after its last map."""

    before: DataFrame
    after: DataFrame


def fold(maps: pd.DataFrame) -> pd.DataFrame:
    """Ratings before each map by one plain pass in time order; ``rate`` gives the same."""
    state, out = {}, []
    for row in maps.sort_values(["start_time", "match_id"]).itertuples(index=False):
        sides = [list(row.radiant), list(row.dire)]
        for side, radiant in zip(sides, (True, False), strict=True):
            out += [(row.match_id, row.start_time, a, radiant, *state.get(a, (MU, SIGMA, 0))) for a in side]
        win, lose = sides if row.radiant_win else sides[::-1]
        old = [[state.get(a, (MU, SIGMA, 0)) for a in side] for side in (win, lose)]
        for side, before, after in zip((win, lose), old, update(*[[x[:2] for x in side] for side in old]), strict=True):
            state.update({a: (m, s, b[2] + 1) for a, b, (m, s) in zip(side, before, after, strict=True)})
    return pd.DataFrame(out, columns=[c.split()[0] for c in _RATED.split(", ")])


def levels(seats: list[list[int]], accounts: int) -> np.ndarray:
    """Level of each map in time order: one more than the greatest level of its accounts' earlier maps.

    Maps of one level have no account in common, so they can be rated together.
    """
    last, out = [0] * accounts, np.empty(len(seats), np.int64)
    for k, seat in enumerate(seats):
        level = 1 + max([last[a] for a in seat], default=0)
        for a in seat:
            last[a] = level
        out[k] = level
    return out


def fold_levels(seats: list[list[int]], radiant_size: np.ndarray, radiant_win: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratings before each seat, in order of maps and seats, and after all maps; maps in time order.

    seats: accounts (rows of ``state``: mu, sigma, games) of each map, radiant's first. All maps of
    a level are updated by one closed form over arrays.
    """
    sizes = np.array([len(s) for s in seats])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat, before = np.fromiter((a for s in seats for a in s), np.int64, starts[-1]), np.empty((starts[-1], 3))
    level = levels(seats, len(state))
    order = np.argsort(level, kind="stable")
    for maps in np.split(order, np.flatnonzero(np.diff(level[order])) + 1) if len(seats) else ():
        counts = sizes[maps]
        owner = np.repeat(np.arange(len(maps)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = starts[maps][owner] + within
        who = flat[at]
        old = before[at] = state[who]
        wins = (within < radiant_size[maps][owner]) == radiant_win[maps][owner]
        variance = old[:, 1] ** 2 + TAU * TAU
        c2 = np.bincount(owner, variance + BETA * BETA, len(maps))
        t = np.bincount(owner, np.where(wins, old[:, 0], -old[:, 0]), len(maps)) / np.sqrt(c2)
        tail = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in t])
        v = np.where(tail > 1e-300, np.exp(-t * t / 2) / math.sqrt(2 * math.pi) / np.maximum(tail, 1e-300), -t)
        w = np.clip(v * (v + t), 0, 1)
        mu = old[:, 0] + np.where(wins, 1, -1) * variance / np.sqrt(c2)[owner] * v[owner]
        sigma = np.sqrt(variance * np.maximum(1 - variance / c2[owner] * w[owner], 1e-9))
        for side in (wins, ~wins):
            state[who[side]] = np.stack([mu[side], sigma[side], old[side, 2] + 1], 1)
    return before, state


def _fold_chunk(rows: pa.Table) -> pa.RecordBatch:
    """Maps and starting states of some whole units, which have no account in common, to rows of ``_FOLDED``."""
    is_map = pc.is_valid(rows["match_id"])
    maps, given = rows.filter(is_map), rows.filter(pc.invert(is_map))
    maps = maps.take(pc.sort_indices(maps, [("start_time", "ascending"), ("match_id", "ascending")]))
    radiant, dire = maps["radiant"].to_pylist(), maps["dire"].to_pylist()
    seats = [r + d for r, d in zip(radiant, dire, strict=True)]
    accounts, place = np.unique(np.array([a for s in seats for a in s] + given["account_id"].to_pylist(), np.int64), return_inverse=True)
    state = np.tile(np.array([MU, SIGMA, 0.0]), (len(accounts), 1))
    n = sum(map(len, seats))
    state[place[n:]] = np.stack([given[c].to_numpy().astype(float) for c in ("mu", "sigma", "games")], 1)
    ends = np.cumsum([0, *map(len, seats)]).tolist()
    ids = place[:n].tolist()
    sizes = np.array([len(s) for s in seats], np.int64)
    before, after = fold_levels([ids[a:b] for a, b in zip(ends, ends[1:])], np.array([len(r) for r in radiant], np.int64), maps["radiant_win"].to_numpy().astype(bool), state)
    owner = pa.array(np.concatenate([np.repeat(np.arange(len(seats)), sizes), np.zeros(len(accounts), np.int64)]), mask=np.concatenate([np.zeros(n, bool), np.ones(len(accounts), bool)]))
    side = [k < len(r) for r, s in zip(radiant, seats, strict=True) for k in range(len(s))] + [None] * len(accounts)
    values = np.concatenate([before, after])
    columns = [
        pa.array(np.repeat([False, True], [n, len(accounts)])), maps["match_id"].combine_chunks().take(owner), maps["start_time"].combine_chunks().take(owner),
        pa.array(np.concatenate([accounts[place[:n]], accounts])), pa.array(side, pa.bool_()), pa.array(values[:, 0]), pa.array(values[:, 1]), pa.array(values[:, 2].astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FOLDED.split(", ")])


def _fold_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units in order, about ``CHUNK`` rows or one unit at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            rows = pa.Table.from_batches(held).combine_chunks()
            unit = rows["unit"].to_numpy()
            end = int(np.searchsorted(unit, unit[-1]))
            if end:
                yield _fold_chunk(rows.slice(0, end))
            held, size = rows.slice(end).to_batches(), size - end
    if size:
        yield _fold_chunk(pa.Table.from_batches(held))


def _folded(maps: DataFrame, states: DataFrame | None) -> DataFrame:
    """Maps with a unit, whose accounts no other unit has, folded unit by unit; states: unit, account_id, mu, sigma, games."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = maps.select("unit", *_MAP, none("account_id", "long"), none("mu", "double"), none("sigma", "double"), none("games", "long"))
    if states is not None:
        empty = [none("match_id", "long"), none("start_time", "timestamp"), none("radiant_win", "boolean"), none("radiant", "array<long>"), none("dire", "array<long>")]
        rows = rows.unionByName(states.select("unit", *empty, "account_id", "mu", "sigma", "games"))
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_fold_units, _FOLDED)


_MAP = ("match_id", "start_time", "radiant_win", "radiant", "dire")


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every account of a partition's maps tied to the least account that its maps link it to."""
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    for batch in batches:
        for accounts in batch["accounts"].to_pylist():
            roots = {root(parent.setdefault(a, a)) for a in accounts}
            least = min(roots, default=None)
            parent.update((r, least) for r in roots)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(a) for a in nodes], pa.int64())], ["u", "v"])


def account_components(maps: DataFrame) -> DataFrame:
    """match_id, component: maps whose accounts are linked, directly or over other maps.

    Each partition first ties its own accounts together, which leaves one pair per partition and
    account; the component is its least account. Maps without accounts have none.
    """
    seats = maps.select("match_id", F.array_union("radiant", "dire").alias("accounts"), F.array_min(F.array_union("radiant", "dire")).alias("node"))
    labels = components(seats.select("accounts").mapInArrow(_local_stars, "u long, v long"), checkpointed)
    return seats.join(labels, "node").select("match_id", F.col("label").alias("component"))


def _with_slices(maps: DataFrame) -> DataFrame:
    """Maps (unit, ...) with slice: each unit's maps in time order, cut every ``SLICE`` maps.

    Maps are counted by day first and numbered within their day; a unit has one row a day in a task.
    """
    maps = maps.withColumn("_day", F.to_date("start_time"))
    days = maps.groupBy("unit", "_day").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("unit").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("unit", "_day", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("unit", "_day").orderBy("start_time", "match_id")) - 1
    return maps.withColumn("_within", within).join(days, ["unit", "_day"]).withColumn("slice", F.floor((F.col("_before") + F.col("_within")) / F.lit(SLICE)).cast("int")).drop("_day", "_within", "_before")


def _states_of(maps: DataFrame, states: DataFrame) -> DataFrame:
    """The states of the accounts in ``maps`` (unit, ...), with their unit."""
    seats = maps.select("unit", F.explode(F.array_union("radiant", "dire")).alias("account_id")).distinct()
    return seats.join(states, "account_id").select("unit", "account_id", "mu", "sigma", "games")


def rate(maps: DataFrame, states: DataFrame | None = None) -> Rated:
    """The fold over decided and dated maps, from ``states`` (account_id, mu, sigma, games) or the prior.

    maps: match_id, start_time, radiant_win, radiant, dire (account arrays of complete rosters). Up
    to ``SLICE`` maps are one task's work, level by level over arrays. More are first split in the
    connected components of their accounts, many of which share a task. A component of over ``SLICE``
    maps is cut by time: a slice's maps fall apart into components of their own, which are folded in
    parallel, and the accounts' states are handed on to the next slice in a table.
    """
    known = checkpointed(maps.where("radiant_win IS NOT NULL AND start_time IS NOT NULL").select("match_id", F.col("start_time").cast("timestamp").alias("start_time"), "radiant_win", "radiant", "dire"))
    if known.count() <= SLICE:
        unit = known.select(F.lit(0).cast("long").alias("unit"), "*")
        return _split([checkpointed(_folded(unit, None if states is None else _states_of(unit, states)))])
    unit = checkpointed(known.join(account_components(known), "match_id").withColumnRenamed("component", "unit"))
    long_ = checkpointed(unit.groupBy("unit").count().where(F.col("count") > SLICE).select("unit"))  # at most a SLICE-th of the rows
    short = unit.join(long_, "unit", "left_anti")
    out = [checkpointed(_folded(short, None if states is None else _states_of(short, states)))]
    sliced = checkpointed(_with_slices(unit.join(long_, "unit", "left_semi")).drop("unit"))
    for k in range((sliced.agg(F.max("slice")).first()[0] or 0) + 1 if not long_.isEmpty() else 0):
        own = checkpointed(sliced.where(F.col("slice") == k))
        own = own.join(account_components(own), "match_id").withColumnRenamed("component", "unit")
        folded = checkpointed(_folded(own, None if states is None else _states_of(own, states)))
        moved = folded.where("after").select(*_STATE)
        states = moved if states is None else checkpointed(states.join(moved, "account_id", "left_anti").unionByName(moved))
        out.append(folded)
    return _split(out)


_STATE = ("account_id", "mu", "sigma", "games")


def _split(parts: list[DataFrame]) -> Rated:
    """Rows before maps, and the last state of each account (later parts follow earlier ones)."""
    before = reduce(DataFrame.unionByName, [p.where("NOT after").drop("after") for p in parts])
    if len(parts) == 1:
        return Rated(before, parts[0].where("after").select(*_STATE))
    after = reduce(DataFrame.unionByName, [p.where("after").select(*_STATE, F.lit(k).alias("_k")) for k, p in enumerate(parts)])
    last = after.groupBy("account_id").agg(F.max_by(F.struct("mu", "sigma", "games"), "_k").alias("s"))
    return Rated(before, last.select("account_id", "s.*"))


def ratings_before(maps: DataFrame) -> DataFrame:
    """One row per map and account with its rating before the map."""
    return rate(maps).before


class LateUpdate(NamedTuple):
    """Maps whose rows changed (match_id), their rows now, and the states of the accounts in them."""

    rewritten: DataFrame
    before: DataFrame
    after: DataFrame


def rate_late(maps: DataFrame, late: DataFrame, rated: Rated) -> LateUpdate:
    """What late or corrected maps change, without folding anything that they do not touch.

    maps: all maps before the change; late: new maps, or new versions of known ones (one without a
    result or a time takes the old one back); rated: what ``maps`` gave. Of the maps from the earliest
    change on, only components of accounts with a changed map are folded again, each from its own
    earliest change. Their accounts start from the stored rows: the rating before an account's first
    map after that change, or its last state where it has none.
    """
    timed = lambda df: df.select("match_id", F.col("start_time").cast("timestamp").alias("start_time"), "radiant_win", "radiant", "dire").where("radiant_win IS NOT NULL AND start_time IS NOT NULL")
    ids = checkpointed(late.select("match_id").distinct())
    old, new = timed(maps).join(ids, "match_id", "left_semi"), timed(late)
    changed = checkpointed(old.unionByName(new))
    first = changed.agg(F.min("start_time")).first()[0]
    if first is None:
        empty = maps.sparkSession.createDataFrame
        return LateUpdate(ids, empty([], _RATED), empty([], _STATES))
    suffix = checkpointed(timed(maps).where(F.col("start_time") >= F.lit(first)).join(ids, "match_id", "left_anti").unionByName(new))
    # an old version ties its accounts together as well, under an id of its own
    linked = suffix.select("match_id", "radiant", "dire", F.lit(True).alias("now")).unionByName(old.select("match_id", "radiant", "dire", F.lit(False).alias("now")))
    keyed = checkpointed(linked.withColumn("match_id", F.struct("match_id", "now")).select("match_id", "radiant", "dire"))
    units = checkpointed(account_components(keyed).select("match_id.*", F.col("component").alias("unit")))
    at = F.struct("start_time", "match_id")
    start = checkpointed(changed.join(units, "match_id").groupBy("unit").agg(F.min(at).alias("first")))
    again = checkpointed(suffix.join(units.where("now"), "match_id").join(start, "unit").where(at >= F.col("first")).drop("now", "first"))
    members = again.select("unit", "radiant", "dire").unionByName(old.join(units, "match_id").select("unit", "radiant", "dire"))
    seats = checkpointed(members.select("unit", F.explode(F.array_union("radiant", "dire")).alias("account_id")).distinct().join(start, "unit"))
    stored = rated.before.where(F.col("start_time") >= F.lit(first)).join(seats, "account_id").where(at >= F.col("first"))
    next_ = stored.groupBy("account_id").agg(F.min_by(F.struct("mu", "sigma", "games"), at).alias("s")).select("account_id", "s.*")
    still = seats.select("account_id").join(next_, "account_id", "left_anti").join(rated.after, "account_id").select(*_STATE)
    begin = checkpointed(next_.select(*_STATE).unionByName(still))
    made = rate(again.drop("unit"), begin)
    idle = begin.join(made.after.select("account_id"), "account_id", "left_anti")  # accounts whose only later map was taken back
    return LateUpdate(ids.unionByName(again.select("match_id")).distinct(), made.before, made.after.unionByName(idle))


def apply_late(rated: Rated, change: LateUpdate) -> Rated:
    """The whole tables after a change; a keyed table rewrites only the buckets that hold them."""
    kept = rated.before.join(change.rewritten, "match_id", "left_anti")
    return Rated(kept.unionByName(change.before), rated.after.join(change.after.select("account_id"), "account_id", "left_anti").unionByName(change.after))


def team_skill(rated: DataFrame) -> DataFrame:
    """match_id, is_radiant, mu, sigma, min_games, established of each side."""
    return rated.groupBy("match_id", "is_radiant").agg(
        F.avg("mu").alias("mu"), (F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))) / F.count(F.lit(1))).alias("sigma"), F.min("games").alias("min_games"), F.count_if(F.col("games") >= 20).alias("established")
    )


def skill_or_default(mu: Column, sigma: Column) -> list[Column]:
    """Accounts without a rating take the prior."""
    return [F.coalesce(mu, F.lit(MU)).alias("mu"), F.coalesce(sigma, F.lit(SIGMA)).alias("sigma")]
