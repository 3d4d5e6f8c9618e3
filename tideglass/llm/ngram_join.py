"""Similarity join on word 5-gram Jaccard with Bayesian candidate pruning.

1. Texts with equal shingle sets form a class; only classes are compared.
2. Bands of six of 240 MinHash values name buckets. Only classes that share a bucket are
   compared: with 40 bands a pair at similarity 0.8 shares none with probability
   (1 - 0.8**6)**40 = 5e-6. A class's home is the least class of all its buckets, and a home's
   classes are cut in blocks of about ``BLOCK``. A class is sent to its own block and to each
   block that one of its buckets reaches, once, however many buckets they share.
3. For each pair of blocks one worker compares MinHash values sixteen at a time. With m of n
   values equal and a uniform prior, the similarity has posterior Beta(m + 1, n - m + 1); a pair
   is dropped as soon as the posterior probability of reaching the threshold is under
   ``TOLERANCE``.
4. Pairs that are left are verified exactly on their shingle sets. Workers return link counts
   and a spanning forest of the links, so rows stay in proportion to classes, not to pairs.

Defined results: a text of 1 to 4 words has one shingle, of all its words; a null or empty text
has no shingle, no links and is its own class; rows with null doc_id take part, and their class
has a null id if it holds no other row; repeated rows are copies of one another; ties for the
first document fall by doc_id, then by text; an empty table gives no rows; very long texts are
shingled whole; columns other than doc_id and text are ignored, and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, mix64, shingles, signed, slices, stage_table, text_key
from .graph import components

THRESHOLD = 0.8
WIDTH = 5
ROWS, BANDS = 6, 40
HASHES = ROWS * BANDS
#: MinHash values compared between two looks at the posterior.
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512
#: Representatives and dropped rows are broadcast up to so many rows, and shuffled beyond.
BROADCAST_ROWS = 500_000

_RNG = np.random.Generator(np.random.PCG64(8))
_MUL = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BAND_MUL = _RNG.integers(0, 1 << 64, ROWS // 2 + 1, dtype=np.uint64) | np.uint64(1)


def minhash(values: np.ndarray, starts: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """MinHash values (sets x hashes) of non-empty sets that lie one after another in ``values``."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((hashes, len(starts)), np.uint32)
    for i in range(hashes):
        out[i] = np.minimum.reduceat(low * _MUL[i] + _ADD[i], starts)
    return out.T.copy()


@cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ...: the fewest equal values with which a pair stays.

    P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m), by the Beta-binomial identity.
    """
    found = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append(m)
    return tuple(found)


_SIGNED = "doc_id long, text_key long, set_key binary, n_shingles int, sig binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, texts in slices(batch["text"]):
            values, offsets = shingles(texts, WIDTH)
            sets = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            keys, sigs, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                one, two = np.add.reduceat(flat, starts), np.add.reduceat(mix64(flat ^ np.uint64(0x9E3779B97F4A7C15)), starts)
                sig = minhash(flat, starts)
                folded = sig.view(np.uint64).reshape(len(full), BANDS, ROWS // 2)
                number = np.arange(BANDS, dtype=np.uint64) * _BAND_MUL[-1]
                band = signed(mix64((folded * _BAND_MUL[:-1]).sum(2, dtype=np.uint64) + number))
                short = sig.astype(np.uint16)
                for k, i in enumerate(full):
                    keys[i], sigs[i], bands[i] = one[k].tobytes() + two[k].tobytes(), short[k].tobytes(), band[k]
            part = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["text_key"], pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "set_key", "n_shingles", "sig", "bands"],
            )


_SHINGLED = "cid long, block long, reached array<long>, copies long, sig binary, shingles binary"


def _shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["cid", "block", "reached", "copies", "sig"]
    for batch in batches:
        for start, stop, texts in slices(batch["text"]):
            values, offsets = shingles(texts, WIDTH)
            sets = [np.unique(values[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            part = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([*(part[n] for n in names), pa.array(sets, pa.binary())], [*names, "shingles"])


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] and sets[right]."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[place] > 1
    columns = np.cumsum(count > 1) - 1
    place, owner = columns[place[keep]], owner[keep]
    width = int(columns[-1]) + 1 if len(columns) else 0
    if len(left) * 25e-6 < len(sets) ** 2 * width * 1e-10 + 1e-4:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], np.int64)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, width, 2048):
        a, b = np.searchsorted(place, [at, at + 2048])
        dense = np.zeros((len(sets), 2048), np.float32)
        dense[owner[a:b], place[a:b] - at] = 1
        total += dense @ dense.T
    return total[left, right].astype(np.int64)


def links_of(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs (left, right) reach the threshold: pruned by posterior, then exact."""
    sizes = np.array([len(s) for s in sets])
    found = [np.empty(0, np.int64)]
    for at in range(0, len(left), 1 << 17):
        a, b = left[at : at + (1 << 17)], right[at : at + (1 << 17)]
        alive = np.flatnonzero(np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9)
        equal = np.zeros(len(alive), np.int64)
        for k, least in enumerate(least_matches(threshold)):
            part = sigs[:, k * STEP : (k + 1) * STEP]
            equal += (part[a[alive]] == part[b[alive]]).sum(1)
            stay = equal >= least
            alive, equal = alive[stay], equal[stay]
        found.append(alive + at)
    alive = np.concatenate(found)
    if not len(alive):
        return alive
    shared = _shared(sets, left[alive], right[alive])
    union = sizes[left[alive]] + sizes[right[alive]] - shared
    return alive[shared >= threshold * union - 1e-9]


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it is linked to, over any number of links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            return label
        label = new


_LINKS = "kind int, a long, b long"


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (i, j): link counts (kind 0) and forest edges (kind 1) of each block pair."""

    def solve(rows: dict) -> pa.RecordBatch | None:
        cids = np.array(list(rows), np.int64)
        block = np.array([r["block"] for r in rows.values()])
        one = next(iter(rows.values()))
        if one["i"] == one["j"]:
            left, right = np.triu_indices(len(cids), 1)
        else:
            left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(block == one["i"]), np.flatnonzero(block == one["j"])))
        sigs = np.stack([np.frombuffer(r["sig"], np.uint16) for r in rows.values()])
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows.values()]
        hit = links_of(sigs, sets, left, right)
        if not len(hit):
            return None
        left, right = left[hit], right[hit]
        copies = np.array([r["copies"] for r in rows.values()], np.int64)
        counts = np.bincount(left, copies[right], len(cids)) + np.bincount(right, copies[left], len(cids))
        label = forest(len(cids), left, right)
        linked, below = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(cids)))
        kind = np.repeat([0, 1], [len(linked), len(below)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(np.concatenate([cids[linked], cids[below]])), pa.array(np.concatenate([counts[linked].astype(np.int64), cids[label[below]]]))],
            ["kind", "a", "b"],
        )

    rows, at = {}, None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["i"], row["j"]) != at:
                if len(rows) > 1 and (out := solve(rows)):
                    yield out
                rows, at = {}, (row["i"], row["j"])
            rows[row["cid"]] = row  # a repeated row brings its class again
    if len(rows) > 1 and (out := solve(rows)):
        yield out


def near_classes(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row's set_key, and for each set_key its group and links.

    classes: set_key, copies, exact_id, group_id and the (doc_id, text_key) of the group's
    first document, links (documents of other classes).
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", text_key())
    rows = stage_table(texts.mapInArrow(_sign, _SIGNED), "signed")
    own = rows.where(F.col("n_shingles") > 0).groupBy("set_key")
    classes = own.agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("rep"),
        F.first("sig").alias("sig"), F.first("bands").alias("bands"),
    )
    classes = stage_table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    buckets = classes.select("cid", F.explode("bands").alias("band"))
    roots = buckets.groupBy("band").agg(F.min("cid").alias("root"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("band", "root")
    shared = stage_table(buckets.join(roots, "band"), "buckets")
    homes = shared.groupBy("cid").agg(F.min("root").alias("home"))
    parts = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("cid"), F.col("parts"))
    placed = stage_table(homes.join(parts, "home").select("cid", F.xxhash64("home", part).alias("block")), "blocks")
    # blocks of a bucket, one row each; a bucket of one home's n classes has n / BLOCK of them
    present = shared.join(placed, "cid").select("band", F.col("block").alias("with")).distinct()
    reached = shared.select("cid", "band").join(present, "band").select("cid", "with").distinct()
    reached = reached.groupBy("cid").agg(F.collect_list("with").alias("reached"))

    members = placed.join(reached, "cid").join(classes.select(F.col("cid").alias("node"), "copies", "rep", "sig"), F.col("cid") == F.col("node"))
    members = members.select("cid", "block", "reached", "copies", "sig", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))
    members = stage_table(members, "members")
    same = (F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    held = texts.join(maybe_broadcast(members, BROADCAST_ROWS // 10), same).select("cid", "block", "reached", "copies", "sig", "text")
    dealt = held.mapInArrow(_shingle, _SHINGLED).withColumn("with", F.explode("reached"))
    dealt = dealt.select(F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "cid", "copies", "sig", "shingles")
    dealt = dealt.repartition("i", "j").sortWithinPartitions("i", "j")
    found = stage_table(dealt.mapInArrow(_link, _LINKS), "links")

    counts = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    groups = components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "cid")
    reps = classes.select("set_key", "cid", "copies", "rep")
    linked = reps.join(groups, "cid")
    first = linked.groupBy("label").agg(F.min("rep").alias("first"))
    linked = linked.select("cid", "label").join(first, "label").join(counts, "cid").select("cid", "first", "links")
    out = reps.join(linked, "cid", "left").withColumn("first", F.coalesce("first", "rep"))
    out = out.select(
        "set_key", "copies", F.col("rep.doc_id").alias("exact_id"), F.col("first.doc_id").alias("group_id"),
        F.col("first.text_key").alias("group_key"), F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )
    return rows, stage_table(out, "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, exact_id, n_copies.

    class_id: the least doc_id of the connected near-duplicate group; n_links: other rows whose
    similarity to this one reaches the threshold, copies included; exact_id: the least doc_id
    with the same shingle set; n_copies: rows with that set.
    """
    rows, classes = near_classes(docs)
    joined = rows.select("doc_id", "set_key").join(classes, "set_key", "left")
    alone = F.col("copies").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("exact_id")).alias("exact_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with one document of each near-duplicate group: that with the least doc_id.

    Rows without words stay. Of repeated rows (equal doc_id and text) one stays.
    """
    rows, classes = near_classes(docs)
    placed = rows.select("doc_id", "text_key", "set_key").join(classes, "set_key")
    first = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("text_key") == F.col("group_key"))
    lost = stage_table(placed.where(~first).select(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key")), "lost")
    again = placed.where(first).groupBy("doc_id", "text_key").count().where("count > 1")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("id"), text_key().alias("key"))
    kept = keyed.join(maybe_broadcast(lost, BROADCAST_ROWS), (F.col("key") == F.col("lost_key")) & F.col("id").eqNullSafe(F.col("lost_id")), "left_anti")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["id", "key"])
    return kept.select("row.*")
