"""Product codes of vectors: Lloyd rounds that Hamerly's bounds ("Making k-means even faster", 2010) keep short.

Components become integers floor(256 * x); a vector is cut into ``parts`` equal consecutive parts and
every part position has a codebook of ``entries`` entries. A round assigns each part to the nearest
entry of its codebook (squared Euclidean distance in integers, ties to the lower index) and moves
every used entry to the floor of its parts' mean. Between rounds each part keeps, in a table in the
shared folder, the index of its entry, an upper bound of the distance to it and a lower bound of the
distance to the second-nearest entry. Entries move by known amounts, so a part whose upper bound stays
strictly below its lower bound (or below half the way to the nearest other entry) keeps its entry
unseen; only where this fails is the distance to its own entry taken, and only where that fails too are
all entries scanned. Bounds are rounded outwards and compared strictly, so ties reach the scan.

Every pass is a map over partitions. Sums of a round meet by (part, entry, position), after each
partition added up its own; they, and the codebooks, are as large as a codebook, whatever the rows.

Defined results: a row is dropped if its vector is null, holds null or non-finite components, is not
of a positive multiple of ``parts`` components, or is not as long as the vector of the smallest kept
id. Codebooks start from the ``entries`` smallest (id, vector) rows with an id; with fewer rows they
have fewer entries. Rows with a null id are coded but start no entry (where no row has an id, the
smallest vector starts the only one); repeated rows count each time, and equal entries are ties. Components are held within a bound (2**26 or more up to 256 components)
that keeps squared distances in 64 bits. Sums of errors stop at the largest long. A table without
usable rows gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stage_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Distances held in memory at a time in a scan.
SCAN_CELLS = 1 << 21
#: More labels than this are joined by shuffle.
MAX_LABELS = 100_000
LONG_MAX = (1 << 63) - 1

_STATE = "vec_id long, label {label}, x array<int>, code array<int>, upper array<float>, lower array<float>, scans int"
_CODED = "vec_id long, label {label}, code binary, error long, scans int"


class Codes(NamedTuple):
    """Coded rows (vec_id, label, code with one byte a part, error, scans of all rounds) and the final codebooks."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """sha256 of the entries' components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def component_bound(dimension: int) -> int:
    """Components within it have squared distances below 2**62."""
    return math.isqrt((1 << 62) // max(dimension, 1)) // 2


def quantised(rows: DataFrame, parts: int = PARTS, vector: str = "embedding") -> DataFrame:
    """vec_id, label, x: the integer components of rows with a usable vector."""
    v = F.col(vector).cast("array<double>")
    finite: Column = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0)).where(finite)
    bound = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.size(vector)) / 2).cast("double") - 1
    held = lambda c: F.floor(F.greatest(F.least(c * SCALE, bound), -bound))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(v, lambda c: held(c).cast("int")).alias("x"))


def _out(x: np.ndarray) -> np.ndarray:
    return x * np.where(x > 0, 1 + 2.0**-50, 1 - 2.0**-50)


def _in(x: np.ndarray) -> np.ndarray:
    return x * np.where(x > 0, 1 - 2.0**-50, 1 + 2.0**-50)


def _narrow(x: np.ndarray, toward: float) -> np.ndarray:
    """``x`` as 32-bit floats, rounded outwards."""
    return np.nextafter(x.astype(np.float32), np.float32(toward))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts to as many entries, row by row."""
    return ((x - entries) ** 2).sum(-1)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry, its squared distance, and that of the second-nearest (-1: there is none)."""
    index, first, second = np.empty(len(x), np.int64), np.empty(len(x), np.int64), np.full(len(x), -1, np.int64)
    step = max(1, SCAN_CELLS // book.size)
    for at in range(0, len(x), step):
        d = ((x[at : at + step, None, :] - book[None]) ** 2).sum(-1)
        i, rows = d.argmin(1), np.arange(len(d))
        index[at : at + step], first[at : at + step] = i, d[rows, i]
        if len(book) > 1:
            d[rows, i] = LONG_MAX
            second[at : at + step] = d.min(1)
    return index, first, second


class Moves(NamedTuple):
    """How far the entries of each codebook moved, and how far each is from its nearest neighbour now."""

    own: np.ndarray
    others: np.ndarray
    half_gap: np.ndarray


def moves(old: np.ndarray, new: np.ndarray) -> Moves:
    own = _out(np.sqrt(distances(old, new).astype(float)))
    n = own.shape[1]
    apart = np.where(np.eye(n, dtype=bool), -1.0, own[:, None, :])
    gaps = np.sqrt(((new[:, :, None, :] - new[:, None, :, :]) ** 2).sum(-1).astype(float))
    gaps[:, np.arange(n), np.arange(n)] = np.inf
    return Moves(own, np.maximum(apart.max(2), 0.0), _in(gaps.min(2) / 2))


def assign(x: np.ndarray, books: np.ndarray, state: tuple | None, moved: Moves | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """code, upper, lower of the parts ``x`` (rows, parts, width), and scans by row; ``state`` is what the last round left."""
    rows, parts, _ = x.shape
    if state is None:
        code, upper, lower = np.zeros((rows, parts), np.int64), np.full((rows, parts), np.inf), np.full((rows, parts), -np.inf)
    else:
        code, upper, lower = state[0].astype(np.int64), state[1].astype(float), state[2].astype(float)
    scans = np.zeros(rows, np.int64)
    for p in range(parts):
        loose = np.arange(rows)
        if state is not None:
            upper[:, p] = _out(upper[:, p] + moved.own[p][code[:, p]])
            lower[:, p] = _in(lower[:, p] - moved.others[p][code[:, p]])
            bar = np.maximum(lower[:, p], moved.half_gap[p][code[:, p]])
            loose = np.flatnonzero(~(upper[:, p] < bar))
            upper[loose, p] = _out(np.sqrt(distances(x[loose, p], books[p][code[loose, p]]).astype(float)))
            loose = loose[~(upper[loose, p] < bar[loose])]
        code[loose, p], first, second = scan(x[loose, p], books[p])
        upper[loose, p] = _out(np.sqrt(first.astype(float)))
        lower[loose, p] = np.where(second < 0, np.inf, _in(np.sqrt(np.maximum(second, 0).astype(float))))
        scans[loose] += 1
    return code, _narrow(upper, np.inf), _narrow(lower, -np.inf), scans


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(rows, -1) if rows else np.empty((0, 1))


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), kind))


def _parts(column: pa.Array, rows: int, parts: int) -> np.ndarray:
    return _matrix(column, rows).astype(np.int64).reshape(rows, parts, -1)


def _assigned(rows: DataFrame, label: str, books: np.ndarray, moved: Moves | None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((books, moved))  # as large as the codebooks

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _parts(b["x"], b.num_rows, len(books))
            state = None if moved is None else tuple(_matrix(b[c], b.num_rows) for c in ("code", "upper", "lower"))
            code, upper, lower, scans = assign(x, books, state, moved)
            if moved is not None:
                scans += np.asarray(b["scans"])
            made = [_lists(code, pa.int32()), _lists(upper, pa.float32()), _lists(lower, pa.float32()), pa.array(scans, pa.int32())]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["x"], *made], ["vec_id", "label", "x", "code", "upper", "lower", "scans"])

    return rows.mapInArrow(step, _STATE.format(label=label))


def _moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every used entry moved to the floor of its parts' mean."""
    shape = books.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for b in batches:
            if b.num_rows:
                at = (np.arange(shape[0])[None], _matrix(b["code"], b.num_rows).astype(np.int64))
                np.add.at(totals, at, _parts(b["x"], b.num_rows, shape[0]))
                np.add.at(counts, at, 1)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, shape[2]), pa.int32()), pa.array(np.repeat(entry, shape[2]), pa.int32()), pa.array(np.tile(np.arange(shape[2]), len(part)), pa.int32()), pa.array(totals[part, entry].ravel()), pa.array(np.repeat(counts[part, entry], shape[2]))],
            ["part", "entry", "position", "total", "n"],
        )

    sums = state.select("x", "code").mapInArrow(add_up, "part int, entry int, position int, total long, n long")
    new = books.copy()
    for r in sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # one row a component of the codebooks
        new[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    return new


def _coded(state: DataFrame, label: str, books: np.ndarray) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(books)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for b in batches:
            if b.num_rows:
                code = _matrix(b["code"], b.num_rows).astype(np.int64)
                error = distances(_parts(b["x"], b.num_rows, len(books)), books[np.arange(len(books))[None], code]).sum(1)
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()), pa.array(error), b["scans"]], ["vec_id", "label", "code", "error", "scans"])

    return state.mapInArrow(finish, _CODED.format(label=label))


def encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding") -> Codes:
    """Codebooks of ``rows`` (vec_id, label, ``vector``) after ``rounds`` rounds, and every usable row coded by them.

    ``entries`` is at most 256. Each round writes one table, so a lost executor repeats one round's part.
    """
    x = quantised(rows, parts, vector)
    label = x.schema["label"].dataType.simpleString()
    starts = x.where("vec_id IS NOT NULL").orderBy("vec_id", "x")
    found = starts.limit(1).collect() or x.orderBy("x").limit(1).collect()
    if not found:
        return Codes(rows.sparkSession.createDataFrame([], _CODED.format(label=label)), np.zeros((parts, 0, 0), np.int64))
    dimension = len(found[0]["x"])
    x, starts = x.where(F.size("x") == dimension), starts.where(F.size("x") == dimension)
    first = [r["x"] for r in starts.limit(entries).collect() or found]  # at most `entries` rows
    books = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    state, moved = x, None
    for _ in range(rounds):
        state = stage_table(_assigned(state, label, books, moved), "codes")
        new = _moved_books(state, books)
        moved, books = moves(books, new), new
    return Codes(stage_table(_coded(_assigned(state, label, books, moved), label, books), "coded"), books)


def code_report(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of every usable row."""
    coded = encode(rows, vector=vector)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    by_label = stage_table(coded.rows.groupBy("label").agg(total.alias("label_error")), "label-errors")
    own = coded.rows.alias("r").join(maybe_broadcast(by_label, MAX_LABELS).alias("l"), F.col("r.label").eqNullSafe(F.col("l.label")))
    return own.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))
