"""Keyed tables: versions, buckets, lost and competing writers; pages that are stored with their cursor."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tideglass.operators import upserts
from tideglass.sources import tables
from tideglass.sources.tables import KeyedTable

ROWS = "match_id long, source string, value long, note string"


def made(spark, tmp_path, schema=ROWS, keys=("match_id", "source"), **how):
    return KeyedTable(spark, f"file://{tmp_path}/table", schema, list(keys), **how)


def rows(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_upserts_equal_a_dictionary_and_versions_stay(spark, tmp_path):
    table, rng, state, seen = made(spark, tmp_path, buckets=8), random.Random(2), {}, [[]]
    assert rows(table) == [] and table.snapshot().version == 0
    for k in range(4):
        change = {(rng.randrange(30), rng.choice("ab")): (k, f"n{k}" if rng.random() < 0.6 else None) for _ in range(12)}
        df = spark.createDataFrame([(*key, *v) for key, v in change.items()], ROWS)
        how = ("replace", "fill_gaps", "insert_absent", "supply")[k]
        if how == "supply":
            df = df.drop("value")
        getattr(table, how)(df)
        for key, (value, note) in change.items():
            old = state.get(key)
            new = {"replace": (value, note), "fill_gaps": (value, note) if old is None else (old[0], old[1] if old[1] is not None else note), "insert_absent": old or (value, note), "supply": (old[0] if old else None, note)}[how]
            state[key] = new
        seen.append(sorted((*key, *v) for key, v in state.items()))
    by = lambda rs: sorted(rs, key=repr)
    assert by(rows_ := [tuple(r) for r in table.read().collect()]) == by(seen[4]) and len(rows_) == len(state)
    for version, want in enumerate(seen):
        assert by(tuple(r) for r in table.read(version).collect()) == by(want)
    wanted = spark.createDataFrame([(5, "a"), (77, "b")], "match_id long, source string")
    assert by(tuple(r) for r in table.lookup(wanted).collect()) == [r for r in by(seen[4]) if r[:2] == (5, "a")]
    assert table.vacuum(1) > 0 and by(tuple(r) for r in table.read().collect()) == by(seen[4]) and table.versions() == [4]


def test_only_buckets_with_changed_keys_are_written(spark, tmp_path):
    table = made(spark, tmp_path, buckets=16)
    first = table.replace(spark.range(400).select(F.col("id").alias("match_id"), F.lit("a").alias("source"), F.col("id").alias("value"), F.lit("x").alias("note")))
    second = table.replace(spark.createDataFrame([(3, "a", -1, None)], ROWS))
    changed = {b for b in second.buckets if second.buckets[b] != first.buckets[b]}
    assert len(first.buckets) == 16 and len(changed) == 1
    written = spark.read.parquet(f"{table.path}/{second.buckets[changed.pop()]}").count()
    assert written < 60 and table.read().count() == 400


def test_children_are_replaced_whole_and_decisions_supersede(spark, tmp_path):
    children = made(spark, tmp_path / "c", keys=("match_id", "source"), bucket_by=["match_id"], buckets=4)
    df = lambda rs: spark.createDataFrame(rs, ROWS)
    children.replace_children(df([(1, "a", 1, None), (1, "b", 2, None), (2, "a", 3, None), (3, "a", 4, None)]).select("match_id"), df([(1, "a", 1, None), (1, "b", 2, None), (2, "a", 3, None), (3, "a", 4, None)]))
    children.replace_children(spark.createDataFrame([(1,), (2,)], "match_id long"), df([(1, "c", 9, None)]))
    assert rows(children) == [(1, "c", 9, None), (3, "a", 4, None)]  # 2 has none any more
    children.replace_children(spark.createDataFrame([(1,), (3,)], "match_id long"), df([]))
    assert rows(children) == [] and children.snapshot().buckets == {}
    decided = made(spark, tmp_path / "d", "league_id long, page string, decided_at timestamp, superseded_at timestamp", ("league_id", "decided_at"), bucket_by=["league_id"], buckets=4)
    for day, page in ((1, "p"), (2, "q")):
        decided.supersede(spark.createDataFrame([(7, page)], "league_id long, page string"), F.lit(datetime(2024, 1, day)))
    assert rows(decided.__class__(spark, decided.path, decided.schema, decided.keys, decided.bucket_by, 4)) == [(7, "p", datetime(2024, 1, 1), datetime(2024, 1, 2)), (7, "q", datetime(2024, 1, 2), None)]


def test_a_lost_writer_leaves_no_trace(spark, tmp_path, monkeypatch):
    table, df = made(spark, tmp_path), spark.createDataFrame([(1, "a", 1, None)], ROWS)
    table.replace(df)
    with monkeypatch.context() as lost:
        lost.setattr(KeyedTable, "_publish", lambda self, new: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            table.replace(spark.createDataFrame([(1, "a", 2, None), (2, "a", 2, None)], ROWS), batch=("s", 1), cursors=lambda _: {"c": "2"})
    assert rows(table) == [(1, "a", 1, None)] and table.snapshot().cursors == {} and table.snapshot().batches == {}
    again = table.replace(spark.createDataFrame([(1, "a", 2, None), (2, "a", 2, None)], ROWS), batch=("s", 1), cursors=lambda _: {"c": "2"})
    assert rows(table) == [(1, "a", 2, None), (2, "a", 2, None)] and again.cursors == {"c": "2"}
    assert table.replace(df, batch=("s", 1)).version == again.version and table.replace(df, batch=("s", 0)).version == again.version  # it came before
    assert rows(table) == [(1, "a", 2, None), (2, "a", 2, None)]
    assert table.vacuum() >= 2  # an old version, and the lost writer's folder


@pytest.mark.parametrize("other,merges", [(1, 2), (None, 1)])
def test_two_writers(spark, tmp_path, monkeypatch, other, merges):
    """The second to publish keeps its buckets if they are still as it read them, and merges again if not."""
    table = made(spark, tmp_path, "match_id long, value long", ("match_id",), buckets=64)
    df = lambda rs: spark.createDataFrame(rs, "match_id long, value long")
    table.replace(df([(1, 10), (2, 20)]))
    buckets = lambda k: table._touched(df([(k, 0)]))
    far = next(k for k in range(3, 99) if buckets(k) not in (buckets(1), buckets(2)))
    counts, publish, pending = [], KeyedTable._publish, [df([(other or far, 5)])]

    def second(self, new):
        if pending:  # another writer is faster
            rows_ = pending.pop()
            KeyedTable(spark, table.path, table.schema, table.keys, buckets=64).replace(rows_)
        return publish(self, new)

    monkeypatch.setattr(KeyedTable, "_publish", second)
    add = lambda old, new: counts.append(1) or upserts.replace_rows(old, new.join(old.withColumnRenamed("value", "was"), "match_id", "left").select("match_id", (F.col("value") + F.coalesce("was", F.lit(0))).alias("value")), ["match_id"])
    table.commit(df([(1, 100)]), add)
    want = {1: 105, 2: 20} if other else {1: 110, 2: 20, far: 5}
    assert dict(rows(table)) == want and len(counts) == merges and table.snapshot().version == 3


def test_writers_that_are_never_first_give_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KeyedTable, "_publish", lambda self, new: False)
    monkeypatch.setattr(tables, "ATTEMPTS", 3)
    with pytest.raises(tables.Conflict):
        made(spark, tmp_path).replace(spark.createDataFrame([(1, "a", 1, None)], ROWS))


def test_manifests_are_whole_versions(spark, tmp_path):
    table = made(spark, tmp_path)
    table.replace(spark.createDataFrame([(1, "a", 1, None)], ROWS))
    kept = table.snapshot()
    assert not table._publish(kept) and table.snapshot() == kept  # the number is taken
    assert json.loads((tmp_path / "table/manifests" / f"{1:020d}.json").read_text())["version"] == 1
