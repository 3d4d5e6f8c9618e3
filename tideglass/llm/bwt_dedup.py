"""Removal of long repeated byte strings by column-wise collection BWT.

A byte goes if a ``LENGTH``-byte string that covers it also starts anywhere else in the corpus. A
passage of over ``PASSAGE_WORDS`` whole words that stands in another document too is reported, and
cut only as far as the first rule says: so many words may be under ``LENGTH`` bytes.

1. Windows of two kinds pick anchors by their own content: each ``PASSAGE_WORDS + 1`` words the
   leftmost of its word n-grams with the least hash; each ``LENGTH``-byte window the anchor of its
   first whole word window, or, where it holds none, the leftmost of its ``ANCHOR``-byte substrings
   with the least hash. Equal windows pick equal anchors at equal offsets. The windows of one anchor
   are a segment; only anchors that occur twice or more go on.
2. Segments with equal bytes are counted together. Where an anchor has two or more different
   segments, these are laid side by side with their anchors in one column, and the collection's
   Burrows-Wheeler transform is built column by column from the right: each round inserts one
   symbol per segment, sorts the round's suffixes by (symbol, their order in the round before),
   and updates the common prefixes of neighbours. Because equal windows stand in equal columns,
   a round needs the order of its own column's suffixes only (the positional form of the
   transform), so a round costs the number of segments and not the text built so far. Rounds
   read their column and write order and prefixes one after the other; the tables between the
   phases are sequential files in the shared folder.
3. A byte window whose common prefix with a neighbour reaches ``LENGTH`` is repeated. Repeated
   windows become byte intervals, and each text is cut by its intervals.
4. Equal word windows stand side by side in the same order (white space and the end sort first).
   Those of two documents or more become the intervals of shared passages.

An anchor with more than ``GROUP`` different segments, or with one of over ``LONG`` bytes, is not
gathered in one task: its single windows are counted by their offset from the anchor and 128-bit
hash instead, in rows that spread over all tasks.

Defined results: a null text is an empty one; texts under ``LENGTH`` bytes keep all bytes;
repeated rows repeat one another's strings, so long ones go entirely, and are one another's
passages; a run of one byte repeats itself; a passage's white space is part of it, and one that
comes again in its own document only is not shared; cutting may leave bytes that are no valid UTF-8, and ``deduplicate`` then writes U+FFFD
for what was cut in the middle; the bytes of a text of any length are hashed in pieces of about
``CHUNK``; columns other than doc_id and text are ignored by the digest and kept by
``deduplicate``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import inverse, maybe_broadcast, mix64, powers, stage_table

LENGTH = 400
ANCHOR = 200
#: Passages of more whole words than this that another document has too are reported, whatever their bytes.
PASSAGE_WORDS = 50
#: Different segments of one anchor that a task takes together.
GROUP = 4096
#: Bytes of the longest segment that a task takes together with others.
LONG = 4096
#: Segments that one run of the column-wise construction takes together.
BATCH = 4096
#: Copies of one text that a task takes together.
COPIES = 256
#: Texts with more copies are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
#: Bytes of a text that are hashed together.
CHUNK = 1 << 20
#: Texts are taken through numpy together up to so many bytes.
TOGETHER = 1 << 18

_RNG = np.random.Generator(np.random.PCG64(9))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Symbols of the transform: 1 to 256, white space first; 0 is no symbol.
_SYMBOL = np.zeros(256, np.int16)
_SYMBOL[np.argsort(~_SPACE, kind="stable")] = np.arange(1, 257)
_TABLES = _RNG.integers(0, 1 << 64, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = tuple(int(b) * 2 + 1 for b in _RNG.integers(0, 1 << 63, 2))
_GRAM_BASE = int(_RNG.integers(0, 1 << 63)) * 2 + 1


def _sums(data: np.ndarray, family: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[family][data] * powers(_BASES[family], len(data))[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def _hash(sums: np.ndarray, family: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((sums[end] - sums[start]) * powers(inverse(_BASES[family]), len(sums))[start])


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value of each window x[i : i + width]."""
    n = len(x)
    place = np.arange(n, dtype=np.uint64)
    bits = np.uint64(max(1, int(n).bit_length()))
    packed = (x >> bits << bits) | place
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = packed
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    count = n - width + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _span_hashes(data: np.ndarray, family: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes; start ascends."""
    out = np.empty(len(start), np.uint64)
    cuts = np.searchsorted(start, np.arange(0, len(data) + CHUNK, CHUNK))
    for at, a, b in zip(range(0, len(data), CHUNK), cuts[:-1], cuts[1:], strict=False):
        if a < b:
            sums = _sums(data[at : end[a:b].max()], family)
            out[a:b] = _hash(sums, family, start[a:b] - at, end[a:b] - at)
    return out


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    edge = np.flatnonzero(np.diff(~_SPACE[data], prepend=False, append=False))
    return edge[::2], edge[1::2]


def _runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal values."""
    first = np.flatnonzero(np.diff(values, prepend=values[:1] - 1))
    return first, np.append(first[1:], len(values)) - 1


def word_windows(data: np.ndarray, base: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """begin, end of all words; first, text: of each window of ``width`` words its first word and the text it is in.

    data: texts with one space between; base: where each begins.
    """
    begin, end = word_bounds(data)
    text = np.searchsorted(base, begin, "right") - 1
    n = max(0, len(begin) - width + 1)
    first = np.flatnonzero(text[:n] == text[width - 1 :][:n])
    return begin, end, first, text[first]


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with one space between, where each begins, and their sizes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b" ".join(texts), np.uint8), np.cumsum(sizes + 1) - sizes - 1, sizes


def segments(texts: list[bytes], length: int, anchor: int, width: int) -> tuple[np.ndarray, ...]:
    """(text, anchor_hash, first, stop, lead, v_at, v_end, hash_1, hash_2) arrays of the texts' segments.

    The segment's bytes are texts[text][first:stop], its anchor begins at first + lead; its word
    windows are those of ``width`` words from first + v_at to first + v_end, none where v_end is 0.
    """
    data, base, sizes = _join(texts)
    begin, end, word, text = word_windows(data, base, width)
    delta = np.zeros(len(data) + 2, np.int8)  # steps of: byte windows without an anchor
    long_ = sizes >= length
    delta[base[long_]] += 1
    delta[base[long_] + sizes[long_] - length + 1] -= 1
    parts = []
    if len(word):
        gram = max(1, width // 4)
        sums = np.zeros(len(begin) + 1, np.uint64)
        np.cumsum(_span_hashes(data, 0, begin, end) * powers(_GRAM_BASE, len(begin))[: len(begin)], dtype=np.uint64, out=sums[1:])
        at = np.arange(len(begin) - gram + 1)
        key = mix64((sums[at + gram] - sums[at]) * powers(inverse(_GRAM_BASE), len(begin))[at] + np.uint64(1))
        chosen = sliding_argmin(key, width - gram + 1)[word]
        v_begin, v_end = begin[word], end[word + width - 1]
        # the byte windows whose first whole word begins the word window; they begin and end in sight
        low = np.maximum(np.maximum(np.where(word > 0, begin[word - 1], 0), base[text]), v_end - length + 1)
        high = np.minimum(v_begin - 1, (base + sizes)[text] - length)
        holds = low <= high
        delta[low[holds]] -= 1
        delta[high[holds] + 1] += 1
        a, b = _runs_of(chosen)
        first = np.minimum.reduceat(np.where(holds, low, v_begin), a)
        stop = np.maximum(v_end[b], np.maximum.reduceat(np.where(holds, high + length, 0), a))
        parts.append((key[chosen[a]], first, stop, begin[chosen[a]] - first, v_begin[a] - first, v_end[b] - first))
    # the other byte windows, by stretches
    other = np.flatnonzero(np.cumsum(delta, dtype=np.int8))
    held = []
    for stretch in np.split(other, np.flatnonzero(np.diff(other) > length) + 1) if len(other) else ():
        for some in np.split(stretch, np.searchsorted(stretch, np.arange(stretch[0] + CHUNK, stretch[-1] + 1, CHUNK))):
            if len(some):
                sums = _sums(data[some[0] : some[-1] + length], 0)
                at = np.arange(len(sums) - anchor)
                key = _hash(sums, 0, at, at + anchor)
                chosen = sliding_argmin(key, length - anchor + 1)[some - some[0]]
                a, b = _runs_of(chosen)
                held.append((key[chosen[a]], some[a], some[b], chosen[a] + some[0]))
    if held:
        key, first, last, place = (np.concatenate(c) for c in zip(*held, strict=True))
        a, b = _runs_of(place)  # an anchor may be chosen on both sides of a cut
        none = np.zeros(len(a), np.int64)
        parts.append((key[a], first[a], last[b] + length, place[a] - first[a], none, none))
    if not parts:
        return tuple(np.empty(0, np.uint64 if i in (1, 7, 8) else np.int64) for i in range(9))
    out = []
    for key, first, stop, lead, v_at, v_end in parts:
        # the segment's hashes also tell where its anchor and its word windows stand
        tag = mix64(mix64(mix64(lead.astype(np.uint64)) + v_at.astype(np.uint64)) + v_end.astype(np.uint64))
        one, two = (_span_hashes(data, f, first, stop) for f in (0, 1))
        text = np.searchsorted(base, first, "right") - 1
        out.append((text, key, first - base[text], stop - base[text], lead, v_at, v_end, one ^ tag, two ^ mix64(tag + np.uint64(1 << 32))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


_SEGMENTS = "key_1 long, key_2 long, anchor long, first int, stop int, lead int, v_at int, v_end int, hash_1 long, hash_2 long"


def _find_segments(length: int, anchor: int, width: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SEGMENTS.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 5 + [pa.int64()] * 2

        def made(keys: list[tuple[int, int]], texts: list[bytes]) -> pa.RecordBatch:
            text, *columns = segments(texts, length, anchor, width)
            own = np.array(keys, np.int64)[text]
            columns = [own[:, 0], own[:, 1], *(c.view(np.int64) for c in columns)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), k, safe=False) for c, k in zip(columns, kinds, strict=True)], names)

        # a text that comes again shows that its segments are repeated; further copies add nothing
        seen: dict[tuple[int, int], bool] = {}
        for batch in batches:
            keys, texts, size = [], [], 0
            for one, two, text in zip(batch["key_1"].to_pylist(), batch["key_2"].to_pylist(), batch["text"], strict=True):
                if seen.get((one, two)):
                    continue
                seen[one, two] = (one, two) in seen
                keys.append((one, two))
                texts.append((text.as_py() or "").encode())
                size += len(texts[-1])
                if size > TOGETHER:
                    yield made(keys, texts)
                    keys, texts, size = [], [], 0
            if texts:
                yield made(keys, texts)

    return find


def repeated_runs(rows: list[dict], groups: np.ndarray, length: int, width: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(segment, start, stop) of the runs of windows that another segment of the group repeats, and of
    those of word windows that a segment of the group from another document has.

    The column-wise construction: segments are aligned so that all anchors begin in one column.
    rows: bytes, lead, v_at, v_end and owner (None: several documents) of each segment.
    groups: ascending group numbers; suffixes are compared within a group only.
    """
    m = len(rows)
    left, sizes = np.array([r["lead"] for r in rows]), np.array([len(r["bytes"]) for r in rows])
    shift = left.max() - left
    columns = int((shift + sizes).max())
    laid = np.zeros((m, columns), np.int16)
    for k, r in enumerate(rows):
        laid[k, shift[k] : shift[k] + sizes[k]] = _SYMBOL[np.frombuffer(r["bytes"], np.uint8)]
    symbols = np.ascontiguousarray(laid.T)  # a column is one sequential read
    # several documents are an owner of their own
    owner = np.array([k if r["owner"] is None else m for k, r in enumerate(rows)])
    single = owner == m
    if single.any():
        owner[single] += np.unique([r["owner"] for r in rows if r["owner"] is not None], return_inverse=True)[1]
    # word windows by column
    data, base, _ = _join([r["bytes"][r["v_at"] : r["v_end"]] for r in rows])
    begin, end, word, w_segment = word_windows(data, base, width)
    w_size = end[word + width - 1] - begin[word]
    w_column = begin[word] + (np.array([r["v_at"] for r in rows]) - base + shift)[w_segment]
    by_column = np.argsort(w_column, kind="stable")
    w_segment, w_size = w_segment[by_column], w_size[by_column]
    w_from = np.searchsorted(w_column[by_column], np.arange(columns + 1)).tolist()
    size_here = np.zeros(m, np.int64)

    group = groups.astype(np.int64) * 512
    order, prefix = np.arange(m), np.zeros(m, np.int64)  # prefix[i]: common with the suffix before
    repeated, turns = np.zeros(m, bool), []
    shared = []
    for column in range(columns - 1, -1, -1):
        inserted = symbols[column][order]
        bucket = group[order] + inserted
        place = np.argsort(bucket, kind="stable")
        sorted_bucket = bucket[place]
        same = np.zeros(m, bool)
        same[1:] = (sorted_bucket[1:] == sorted_bucket[:-1]) & (sorted_bucket[1:] % 512 > 0)
        # least prefix between the old places of two neighbours
        new = np.zeros(m, np.int64)
        next_to = same.copy()
        next_to[1:] &= place[1:] == place[:-1] + 1
        new[next_to] = prefix[place[next_to]] + 1
        apart = np.flatnonzero(same & ~next_to)
        if len(apart):
            ends = np.stack([place[apart - 1] + 1, place[apart] + 1], 1).ravel()
            least = np.minimum.reduceat(np.append(prefix, 0), ends)[::2]
            new[apart] = least + 1
        order, prefix = order[place], new
        if columns - column >= length:
            far = np.flatnonzero(prefix >= length)
            now = np.zeros(m, bool)
            now[order[far]] = now[order[far - 1]] = True
            turn = np.flatnonzero(now != repeated)
            if len(turn):
                turns.append((turn, np.full(len(turn), column)))
                repeated = now
        a, b = w_from[column : column + 2]
        if b - a > 1:  # equal word windows are neighbours among those that begin here
            size_here[w_segment[a:b]] = w_size[a:b]
            sizes_in_order = size_here[order]
            size_here[w_segment[a:b]] = 0
            at = np.flatnonzero(sizes_in_order)
            size = sizes_in_order[at]
            equal = (np.minimum.reduceat(prefix[: at[-1] + 1], at[:-1] + 1) >= size[1:]) & (size[1:] == size[:-1])
            if equal.any():
                begins = np.flatnonzero(np.append(True, ~equal))
                here = order[at]
                several = np.minimum.reduceat(owner[here], begins) != np.maximum.reduceat(owner[here], begins)
                found = np.repeat(several, np.diff(np.append(begins, len(at))))
                shared.append((here[found], np.full(found.sum(), column), column + size[found]))
    turns.append((np.flatnonzero(repeated), np.full(repeated.sum(), -1)))
    # by segment and from right to left, a run begins and ends in turn
    segment, column = (np.concatenate(c) for c in zip(*turns, strict=True))
    at = np.argsort(segment, kind="stable")
    segment, column = segment[at], column[at]
    cut = (segment[::2], column[1::2] + 1 - shift[segment[::2]], column[::2] + length - shift[segment[::2]])
    if not shared:
        return cut, (segment[:0],) * 3
    segment, start, stop = (np.concatenate(c) for c in zip(*shared, strict=True))
    at = np.lexsort((start, segment))
    segment, start, stop = segment[at], start[at], stop[at]
    first = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (start[1:] > stop[:-1]))[: len(segment)])
    last = np.append(first[1:], len(segment))[: len(first)] - 1
    return cut, (segment[first], start[first] - shift[segment[first]], stop[last] - shift[segment[first]])


_RUNS = "anchor long, hash_1 long, hash_2 long, start int, stop int, passage boolean"


def _construct(length: int, width: int, batch_size: int):
    def construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by anchor; whole anchors are taken together up to ``batch_size`` rows."""

        def solve(rows: list[dict]) -> pa.RecordBatch:
            number = np.cumsum(np.diff([r["anchor"] for r in rows], prepend=rows[0]["anchor"]) != 0)
            runs = repeated_runs(rows, number, length, width)
            segment, start, stop = (np.concatenate(c) for c in zip(*runs, strict=True))
            same = [pa.array(np.array([r[n] for r in rows], np.int64)[segment]) for n in ("anchor", "hash_1", "hash_2")]
            passage = np.repeat([False, True], [len(r[0]) for r in runs])
            return pa.RecordBatch.from_arrays([*same, pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(passage)], [x.split()[0] for x in _RUNS.split(", ")])

        held, group = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if group and group[0]["anchor"] != row["anchor"]:
                    held, group = held + group, []
                    if len(held) >= batch_size:
                        yield solve(held)
                        held = []
                group.append(row)
        if held or group:
            yield solve(held + group)

    return construct


def _key() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text, F.lit(1)).alias("key_1"), F.xxhash64(F.lit(2), text).alias("key_2")]


_CUT = "anchor long, lead int, v_at int, v_end int, owner long, hash_1 long, hash_2 long, bytes binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the wanted segments from the texts: for each text, an array of them with first and stop."""
    names = [x.split()[0] for x in _CUT.split(", ")]
    for batch in batches:
        flat = batch["wanted"].flatten()
        columns = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
        place = list(zip(columns["first"].to_pylist(), columns["stop"].to_pylist(), strict=True))
        at, held, size = 0, [], 0
        counts = np.diff(batch["wanted"].offsets.to_numpy()).tolist()

        def made(at: int, held: list[bytes], columns=columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()) if n == "bytes" else columns[n].slice(at, len(held)) for n in names], names)

        for text, n in zip(batch["text"], counts, strict=True):
            data = (text.as_py() or "").encode()
            held += [data[first:stop] for first, stop in place[at + len(held) : at + len(held) + n]]
            size += len(data)
            if size > CHUNK:
                yield made(at, held)
                at, held, size = at + len(held), [], 0
        if held:
            yield made(at, held)


_WINDOWS = "hash_1 long, hash_2 long, owner long, start int, stop int, passage boolean, window_1 long, window_2 long"


def _single_windows(length: int, width: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list) -> pa.RecordBatch:
            one, two, owner, several, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
            columns = [pa.array(one), pa.array(two), pa.array(owner, mask=several), *map(pa.array, rest)]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _WINDOWS.split(", ")])

        for batch in batches:
            held, size = [], 0
            for row in batch.to_pylist():
                data = np.frombuffer(row["bytes"], np.uint8)
                at = np.arange(len(data) - length + 1)
                begin, end, word, _ = word_windows(data[row["v_at"] : row["v_end"]], np.zeros(1, np.int64), width)
                for passage, start, stop in ((False, at, at + length), (True, begin[word] + row["v_at"], end[word + width - 1] + row["v_at"])):
                    # compared like columns: equal windows have one anchor at one offset, and no place comes twice
                    tag = mix64(mix64(np.array([row["anchor"]]).view(np.uint64)) + (start - row["lead"]).astype(np.uint64))
                    one, two = ((_span_hashes(data, f, start, stop) ^ mix64(tag + np.uint64(f))).view(np.int64) for f in (0, 1))
                    n = len(start)
                    same = (np.full(n, x) for x in (row["hash_1"], row["hash_2"], row["owner"] or 0, row["owner"] is None))
                    held.append((*same, start.astype(np.int32), stop.astype(np.int32), np.full(n, passage), one, two))
                    size += n
                if size > 50_000:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)

    return split


def repeated_intervals(docs: DataFrame, copies: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, passage: int = PASSAGE_WORDS, long: int = LONG) -> DataFrame:
    """key_1, key_2, spans, passages, copied: for each text that has any, the byte intervals to remove and
    those of over ``passage`` words that another document has (they may overlap), and whether another
    document has the same text.

    copies: key_1, key_2 of the texts of two rows or more.
    """
    width = passage + 1
    keyed = docs.select("text").select(*_key(), "text")
    found = stage_table(keyed.mapInArrow(_find_segments(length, anchor, width), _SEGMENTS), "segments")
    segment = ["anchor", "hash_1", "hash_2"]
    kinds = found.groupBy(*segment).agg(
        F.count(F.lit(1)).alias("n"), F.min("lead").alias("lead"), F.min("v_at").alias("v_at"), F.min("v_end").alias("v_end"),
        F.min(F.struct("key_1", "key_2", "first", "stop")).alias("at"), F.max("key_1").alias("top"),
    )
    # the text that has it; null: several have
    kinds = kinds.withColumn("owner", F.when(F.col("at.key_1") == F.col("top"), F.col("top"))).drop("top")
    size = F.col("at.stop") - F.col("at.first")
    per_anchor = kinds.groupBy("anchor").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.max(size).alias("longest")).where("total > 1")
    # every kind of segment of an anchor that occurs twice or more
    kinds = stage_table(kinds.join(per_anchor, "anchor").drop("total"), "kinds")

    compared = kinds.where("kinds > 1").select(*segment, "lead", "v_at", "v_end", "owner", "at.*")
    wanted = compared.groupBy("key_1", "key_2").agg(F.collect_list(F.struct(*segment, "lead", "v_at", "v_end", "owner", "first", "stop")).alias("wanted"))
    wanted = wanted.withColumnsRenamed({"key_1": "in_1", "key_2": "in_2"})
    held = keyed.join(wanted, (F.col("key_1") == F.col("in_1")) & (F.col("key_2") == F.col("in_2"))).select("key_1", "key_2", "text", "wanted")
    # copies would bring the same segments again
    held = held.dropDuplicates(["key_1", "key_2"]).select("text", "wanted")
    cut = held.mapInArrow(_cut_out, _CUT)
    large = kinds.where((F.col("kinds") > group) | (F.col("longest") > long)).select("anchor").distinct().withColumnRenamed("anchor", "large")
    cut = stage_table(cut.join(large, F.col("anchor") == F.col("large"), "left"), "cut")

    run = ["hash_1", "hash_2", "start", "stop", "passage"]
    small = cut.where("large IS NULL").drop("large").dropDuplicates(segment)
    runs = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_construct(length, width, BATCH), _RUNS).select(*run)
    windows = cut.where("large IS NOT NULL").drop("large").dropDuplicates(segment).mapInArrow(_single_windows(length, width), _WINDOWS)
    windows = stage_table(windows, "windows")
    window = ["window_1", "window_2", "passage"]
    often = windows.groupBy(*window).agg(F.count(F.lit(1)).alias("n"), (F.count("owner") < F.count(F.lit(1))).alias("several"), (F.min("owner") < F.max("owner")).alias("differ"))
    often = often.where("CASE WHEN passage THEN several OR differ ELSE n > 1 END").select(*window)
    single = windows.join(often, window).select(*run)
    # a kind of segment that occurs twice or more is repeated as a whole
    yes, no = F.lit(True).alias("passage"), F.lit(False).alias("passage")
    whole = kinds.where((F.col("n") > 1) & (size >= length)).select("hash_1", "hash_2", F.lit(0).alias("start"), size.alias("stop"), no)
    passages = kinds.where("owner IS NULL AND v_end > 0").select("hash_1", "hash_2", F.col("v_at").alias("start"), F.col("v_end").alias("stop"), yes)
    runs = stage_table(runs.union(single).union(whole).union(passages), "runs")

    placed = found.select("key_1", "key_2", "first", "hash_1", "hash_2").join(runs, ["hash_1", "hash_2"])
    # copies of a text bring equal spans: a set, which is cut down before it is shuffled
    span = F.struct((F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop"))
    spans = placed.select("key_1", "key_2", F.when(~F.col("passage"), span).alias("span"), F.when(F.col("passage"), span).alias("shared"), F.lit(False).alias("copied"))
    none = [F.lit(None).cast(spans.schema[n].dataType).alias(n) for n in ("span", "shared")]
    spans = spans.union(copies.select("key_1", "key_2", *none, F.lit(True)))
    sets = [F.sort_array(F.collect_set(n)).alias(to) for n, to in (("span", "spans"), ("shared", "passages"))]
    return spans.groupBy("key_1", "key_2").agg(*sets, F.max("copied").alias("copied"))


def merged(column: pa.Array) -> list[list[tuple[int, int]]]:
    """For each row the maximal runs of its sorted, possibly overlapping intervals; touching ones are one run."""
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    start, stop = (column.flatten().field(n).to_numpy(zero_copy_only=False).astype(np.int64) + (row << 32) for n in ("start", "stop"))
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
    if len(row):
        stop = np.maximum.accumulate(stop)
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] > stop[:-1])))
        last = np.append(first[1:], len(row)) - 1
        row = row[first]
        for k, a, b in zip(row.tolist(), (start[first] - (row << 32)).tolist(), (stop[last] - (row << 32)).tolist(), strict=True):
            out[k].append((a, b))
    return out


def _kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _with_spans(docs: DataFrame, length: int, anchor: int, group: int, passage: int, long: int) -> DataFrame:
    """row (the other columns by place: c0, c1, ...), text, spans, passages, copied. Texts with over ``COPIES`` copies are dealt to several tasks."""
    copies = stage_table(docs.select(*_key()).groupBy("key_1", "key_2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    spans = stage_table(repeated_intervals(docs, copies, length, anchor, group, passage, long).withColumnsRenamed({"key_1": "in_1", "key_2": "in_2"}), "spans")
    often = copies.where(F.col("n") > COPIES).select(F.col("key_1").alias("hot_1"), F.col("key_2").alias("hot_2"), F.ceil(F.col("n") / COPIES).cast("int").alias("pieces"))
    few = maybe_broadcast(often, BROADCAST_ROWS)

    row = F.struct(F.lit(True).alias("here"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]).alias("row")
    keyed = docs.select(row, F.col("text").cast("string").alias("text"), *_key())
    keyed = keyed.join(few, (F.col("key_1") == F.col("hot_1")) & (F.col("key_2") == F.col("hot_2")), "left")
    keyed = keyed.select("row", "text", "key_1", "key_2", F.pmod(F.monotonically_increasing_id(), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece"))
    dealt = spans.join(few, (F.col("in_1") == F.col("hot_1")) & (F.col("in_2") == F.col("hot_2")), "left")
    dealt = dealt.select("in_1", "in_2", "spans", "passages", "copied", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("in_piece"))
    same = (F.col("key_1") == F.col("in_1")) & (F.col("key_2") == F.col("in_2")) & (F.col("piece") == F.col("in_piece"))
    return keyed.join(dealt, same, "left").select("row", "text", "spans", "passages", "copied")


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, repeats boolean, passage_words int, repeats_passage boolean"


def _words_within(data: bytes, runs: list[tuple[int, int]]) -> int:
    begin = word_bounds(np.frombuffer(data, np.uint8))[0]
    return int(np.diff(np.searchsorted(begin, np.array(runs))).sum())


def _digest(passage: int):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, runs, shared, copied in zip(batch["doc_id"].to_pylist(), batch["text"], merged(batch["spans"]), merged(batch["passages"]), batch["copied"].to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                shared = [(0, len(data))] if copied else shared
                words = _words_within(data, shared) if shared else 0
                words = words if words > passage else 0
                rows.append((doc_id, len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept := _kept(data, runs)).hexdigest(), len(kept), bool(runs), words, words > 0))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], [x.split()[0] for x in _DIGEST.split(", ")])

    return digest


def removal_digest(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, passage: int = PASSAGE_WORDS, long: int = LONG) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept; repeats: something was removed;
    passage_words: the words that stand in strings of over ``passage`` whole words which another
    document has too, be they cut or not; repeats_passage: there are any.
    """
    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, anchor, group, passage, long)
    return rows.select(F.col("row.c0").alias("doc_id"), "text", "spans", "passages", "copied").mapInArrow(_digest(passage), _DIGEST)


def deduplicate(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """``docs`` with repeated strings cut from the text; other columns as they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t.as_py() is None else _kept(t.as_py().encode(), s).decode(errors="replace") for t, s in zip(batch["text"], merged(batch["spans"]), strict=True)]
            keep = [n for n in batch.schema.names if n not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *(batch[n] for n in keep)], ["cut_text", *keep])

    rows = _with_spans(docs, length, anchor, group, PASSAGE_WORDS, LONG).select("row", "text", "spans")
    out = rows.mapInArrow(cut, f"cut_text string, row {rows.schema['row'].dataType.simpleString()}")
    return out.select(*[F.col("cut_text" if c == "text" else f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
