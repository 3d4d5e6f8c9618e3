"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles: (0, 4], (4, 8], ... (64, 128]. For the
class up to L shingles, documents are read in windows of 2L shingles, one every L, so that an
item of the class lies wholly in some window and makes a fixed share of it. The similarity to
look for is then bounded from below however long the document is: with 64 single-value bands a
window that holds an item of more than L / 2 shingles at containment 0.8 is missed with
probability (1 - 0.19)**64 = 1e-6, and one of a single shingle with (1 - 1/8)**64 = 2e-4.
Window minima are built from block minima, so a longer class costs half of the one before.
Items of over 128 shingles are searched by pieces of 128, of which at least one is contained as
much as the whole. Candidates are verified exactly on the document's whole shingle set.

Words are compared in lower case. Defined results: an item of 1 to 4 words has one shingle, of
all its words, and matches only a text of just these words; a null or empty item or text
matches nothing; rows with null ids are searched like others; repeated items or texts give
repeated pairs; empty tables give no pairs; other columns of the documents are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shingles, slices, stage_table

THRESHOLD = 0.8
WIDTH = 5
BASE = 4
LEVELS = 6
HASHES = 64
#: Test items are broadcast in blocks of about so many rows and characters.
ITEMS_PER_BLOCK = 20_000
CHARS_PER_BLOCK = 16 << 20

_RNG = np.random.Generator(np.random.PCG64(5))
_MUL = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_NONE = np.uint32(0xFFFFFFFF)
_LARGEST = BASE << (LEVELS - 1)


def level_of(n: int) -> int:
    """The size class of an item of n shingles."""
    return max(0, ceil(np.log2(max(n, 1) / BASE)))


class ItemIndex:
    """Band tables of one block of test items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        values, offsets = shingles([(t or "").lower() for _, t in items], WIDTH)
        self.ids = [i for i, _ in items]
        self.sets = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.bands: dict[int, list[dict[int, list[int]]]] = {}
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            for at in range(a, b, _LARGEST):
                piece = values[at : min(b, at + _LARGEST)]
                bands = self.bands.setdefault(level_of(len(piece)), [defaultdict(list) for _ in range(HASHES)])
                low = (piece >> np.uint64(32)).astype(np.uint32)
                for i in range(HASHES):
                    bands[i][int((low * _MUL[i] + _ADD[i]).min())].append(k)
        # which upper halves of a value occur: most windows end here
        self.seen = {}
        for level, bands in self.bands.items():
            table = np.zeros((HASHES, 1 << 16), bool)
            for i, band in enumerate(bands):
                table[i, [v >> 16 for v in band]] = True
            self.seen[level] = table

    def candidates(self, values: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs of which a window and an item share a band."""
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        if not len(full) or not self.bands:
            return set()
        top = max(self.bands)
        pad = 2 << top
        blocks = -(-sizes[full] // BASE)
        room = -(-blocks // pad) * pad
        room += np.where(blocks == room, pad, 0)
        begin = np.cumsum(room) - room
        within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(offsets[:-1][full], blocks) + within * BASE
        place = np.repeat(begin, blocks) + within
        low = (values >> np.uint64(32)).astype(np.uint32)
        minima = np.full(int(room.sum()), _NONE, np.uint32)
        found = set()
        for i in range(HASHES):
            minima[place] = np.minimum.reduceat(low * _MUL[i] + _ADD[i], starts)
            level_minima = minima
            for level in range(top + 1):
                if level:
                    level_minima = np.minimum(level_minima[::2], level_minima[1::2])
                if level in self.bands:
                    windows = np.minimum(level_minima[:-1], level_minima[1:])
                    hit = np.flatnonzero(self.seen[level][i][windows >> np.uint32(16)])
                    band = self.bands[level][i]
                    for w, v in zip(hit.tolist(), windows[hit].tolist(), strict=True):
                        if v in band:
                            owner = int(full[np.searchsorted(begin, w << level, "right") - 1])
                            found.update((owner, k) for k in band[v])
                            if w + 1 << level < len(minima):  # the window may begin in the padding of the text before
                                other = int(full[np.searchsorted(begin, w + 1 << level, "right") - 1])
                                found.update((other, k) for k in band[v])
        return found

    def matches(self, texts: list[str], threshold: float) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of all pairs at or above the threshold."""
        values, offsets = shingles([t.lower() for t in texts], WIDTH)
        out, own, at = [], np.empty(0, np.uint64), -1
        for text, item in sorted(self.candidates(values, offsets)):
            if text != at:
                own, at = np.unique(values[offsets[text] : offsets[text + 1]]), text
            wanted = self.sets[item]
            place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            shared = int((own[place] == wanted).sum())
            if shared >= threshold * len(wanted) - 1e-9:
                out.append((text, item, shared))
        return out


_PAIRS = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def _indexes(benchmark: DataFrame):
    """The items in broadcast blocks of bounded rows and text, one block at a time.

    Rows are numbered first, so that repeated items are dealt to different blocks. Documents are
    read once for each block; a benchmark of up to ``ITEMS_PER_BLOCK`` items is one.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("n"))
    items = stage_table(items, "items")
    size = items.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, ceil(size["rows"] / ITEMS_PER_BLOCK), ceil(size["chars"] / CHARS_PER_BLOCK))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).collect()
        yield spark.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in rows]))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every document that contains an item."""
    texts, found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for index in _indexes(benchmark):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            items = index.value
            for batch in batches:
                for start, _, part in slices(batch["text"]):
                    rows = [(batch["doc_id"][start + t].as_py(), items.ids[k], n, len(items.sets[k]), n / len(items.sets[k])) for t, k, n in items.matches(part, threshold)]
                    if rows:
                        kinds = [pa.int64()] * 4 + [pa.float64()]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _PAIRS.split(", ")])

        pairs = texts.mapInArrow(search, _PAIRS)
        found = pairs if found is None else found.union(pairs)
    return found


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with all their columns."""
    for index in _indexes(benchmark):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            items = index.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for start, _, part in slices(batch["text"]):
                    keep[[start + t for t, _, _ in items.matches(part, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
