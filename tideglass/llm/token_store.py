"""Token ids in binary segments whose document boundaries are Elias-Fano encoded.

The store is a folder of two Parquet tables that Spark's committers write, so a lost executor
leaves no half file. ``segments`` holds one row per segment: the ids of consecutive documents in
ascending doc_id order as one little-endian array (16 bits where the vocabulary allows, else 32)
and the boundaries between them, relative to the segment, in Elias-Fano form:

* ``low``: the lowest ``low_bits`` bits of each boundary, packed;
* ``high``: a bit vector with bit ``(boundary >> low_bits) + k`` set for the k-th boundary;
* ``samples``: for every 64th set bit of ``high``, the byte to start counting from.

``select`` finds the k-th set bit from its sample, so an offset costs 2 + low_bits bits and a
short scan, and no 64-bit table is kept. ``bases`` holds the ids before each segment.

Defined results: a null or empty text has the end id alone; rows with equal doc_id are stored
one after the other in the order of their texts; null ids come first; very long texts are
encoded whole; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: A segment is closed at so many ids or documents.
SEGMENT_TOKENS = 1 << 20
SEGMENT_DOCS = 1 << 15
SAMPLE = 64
#: Words whose ids a worker remembers.
MEMO_WORDS = 600_000
MEMO_CHARS = 64

#: A blank before white space or the end, and a line break beside white space or at the end:
#: there the tokenizer does not always split.
_NO_BLANK = re.compile(r" (?=\s|\Z)")
_NO_BREAK = re.compile(r"\n(?=\s|\Z)|\s\n")
#: Latin letters (all of U+00F8 to U+024F are letters), then ASCII punctuation.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-/:-@\[-`{-~]*)")


# --- Elias-Fano ------------------------------------------------------------------------------


def ef_encode(bounds: np.ndarray) -> dict:
    """Encode a non-decreasing array of boundaries (int64, last one the largest)."""
    n, top = len(bounds), int(bounds[-1]) if len(bounds) else 0
    bits = max(0, (top // n).bit_length() - 1) if n else 0
    low = bounds & ((1 << bits) - 1)
    spread = (low[:, None] >> np.arange(bits)) & 1 if bits else np.empty((n, 0), np.int64)
    high = np.zeros((top >> bits) + n + 1, np.uint8)
    places = (bounds >> bits) + np.arange(n)
    high[places] = 1
    samples = np.stack([places[::SAMPLE] >> 3, np.zeros(len(places[::SAMPLE]), np.int64)], 1) if n else np.empty((0, 2), np.int64)
    packed = np.packbits(high, bitorder="little")
    if n:
        # set bits before each sampled byte, as a distance back from the sampled bit: 0 to 7
        for k, (byte, _) in enumerate(samples):
            samples[k, 1] = np.count_nonzero(high[byte * 8 : places[k * SAMPLE]])
    return {
        "n": n,
        "low_bits": bits,
        "low": np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes(),
        "high": packed.tobytes(),
        "samples": (samples[:, 0] * 8 + samples[:, 1]).astype(np.uint32).tobytes(),
    }


_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def ef_select(code: dict, k: int) -> int:
    """The k-th boundary, from the sample before it."""
    high = np.frombuffer(code["high"], np.uint8)
    sample = int(np.frombuffer(code["samples"], np.uint32)[k // SAMPLE])
    byte, need = sample >> 3, k % SAMPLE + (sample & 7)
    while True:
        ones = int(_ONES[high[byte]])
        if need < ones:
            break
        need, byte = need - ones, byte + 1
    place = byte * 8 + int(np.flatnonzero((high[byte] >> np.arange(8)) & 1)[need])
    bits = code["low_bits"]
    low = 0
    if bits:
        at = k * bits
        word = int.from_bytes(code["low"][at >> 3 : (at + bits + 7) >> 3], "little")
        low = (word >> (at & 7)) & ((1 << bits) - 1)
    return ((place - k) << bits) | low


def ef_decode(code: dict) -> np.ndarray:
    """All boundaries at once."""
    n, bits = code["n"], code["low_bits"]
    places = np.flatnonzero(np.unpackbits(np.frombuffer(code["high"], np.uint8), bitorder="little"))[:n]
    low = np.zeros(n, np.int64)
    if bits:
        spread = np.unpackbits(np.frombuffer(code["low"], np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
        low = (spread.astype(np.int64) << np.arange(bits)).sum(1)
    return ((places - np.arange(n)) << bits) | low


# --- encoding --------------------------------------------------------------------------------


class _Memo(dict):
    """Ids of words, learnt when a word is first asked for; emptied at ``MEMO_WORDS`` words. Long ones are not kept."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self.learn(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """The tokenizer, asked once for each word it has not met.

    The vocabulary's pattern always splits before a blank that a non-space follows, and on both
    sides of a single line break, so ids of the pieces in between, each encoded by the library,
    are the ids of the whole text. A piece of Latin letters and trailing ASCII punctuation is
    two units of that pattern, which go straight to the library's BPE model; all other pieces
    go through its whole encoder. With ``special`` the literal of an added token in a text has
    that token's id, as the library gives it by default; it is cut out before the pattern is
    applied, so such a text is encoded as one piece. Without it, the literal is read as prose.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() < 1 << 16 else np.dtype("<u4")
        self.typecode = {2: "H", 4: "I"}[self.dtype.itemsize]
        # the one byte-to-letter table of byte-level vocabularies, as the library applies it
        self.byte_level = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.letters = {c: "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))) for c in range(0x250) if chr(c).isalpha()} if self.byte_level else {}
        blank = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][0] if self.byte_level else ""
        self.newline = self._whole("\n")
        self.first, self.later = _Memo(self._learner("", "")), _Memo(self._learner(" ", blank))
        self.marks = _Memo(self._units)

    def _whole(self, text: str) -> bytes:
        return array(self.typecode, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _units(self, text: str) -> bytes:
        return array(self.typecode, [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def _learner(self, lead: str, blank: str):
        """Ids of a word after ``lead``."""
        plain, letters, units, whole = _PLAIN.fullmatch, self.letters, self._units, self._whole

        def learn(word: str) -> bytes:
            found = plain(word) if self.byte_level else None
            if not found:
                return whole(lead + word)
            core, mark = found.groups()
            return units(blank + (core if core.isascii() else core.translate(letters))) + self.marks[mark]

        return learn

    def encode(self, texts: list[str]) -> list[bytes]:
        first, later, newline = self.first, self.later.__getitem__, self.newline
        out = []
        for text in texts:
            if any(x in text for x in self.literals) or _NO_BLANK.search(text):
                out.append(self._whole(text))
            else:
                # a line cannot end in a blank here: one before its line break would have been found
                lines = [text] if _NO_BREAK.search(text) else text.split("\n")
                parts = []
                for line in lines:
                    word, *rest = line.split(" ")
                    parts.append(first[word] + b"".join(map(later, rest)))
                out.append(newline.join(parts))
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = False) -> Encoder:
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special)
    return _ENCODERS[path, special]


_SEGMENTS = (
    "part int, seq int, first_id long, last_id long, doc_ids array<long>, n_tokens long, id_bytes int, ids binary, "
    "low_bits int, low binary, high binary, samples binary"
)


def _segment_writer(path: str, end_id: int, special: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part, seq = encoder(path, special), TaskContext.get().partitionId(), 0
        end = np.array([end_id], made.dtype).tobytes()
        doc_ids, parts, bounds, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, doc_ids, parts, bounds, total
            code, known = ef_encode(np.array(bounds, np.int64)), [d for d in doc_ids if d is not None]
            row = {
                "part": part, "seq": seq, "first_id": min(known, default=None), "last_id": max(known, default=None), "doc_ids": doc_ids, "n_tokens": total, "id_bytes": made.dtype.itemsize, "ids": b"".join(parts),
                "low_bits": code["low_bits"], "low": code["low"], "high": code["high"], "samples": code["samples"],
            }
            seq += 1
            doc_ids, parts, bounds, total = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_arrow_segments())

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                piece = batch.slice(start, 200)
                for doc_id, ids in zip(piece["doc_id"].to_pylist(), made.encode([t.as_py() or "" for t in piece["text"]]), strict=True):
                    doc_ids.append(doc_id)
                    parts += [ids, end]
                    total += (len(ids) + len(end)) // made.dtype.itemsize
                    bounds.append(total)
                    if total >= SEGMENT_TOKENS or len(bounds) >= SEGMENT_DOCS:
                        yield close()
        if bounds:
            yield close()

    return write


def _arrow_segments() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _SEGMENTS.split(", "))])


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, special: bool = True) -> None:
    """Write the ids of ``docs`` (doc_id, text) to the folder ``path``.

    tokenizer: path of a tokenizers file, the same on every executor; special: whether the
    literal of an added token ('<|endoftext|>') has that token's id, as in the library's ids
    with add_special_tokens=False, or is read as prose.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(_segment_writer(tokenizer, end_id, special), _SEGMENTS).write.parquet(f"{path}/segments")
    segments = spark.read.schema(_SEGMENTS).parquet(f"{path}/segments").select("part", "seq", "n_tokens")
    # one row per range partition: a bounded table
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("part_base"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = segments.withColumn("within", within).join(parts, "part").select("part", "seq", (F.col("part_base") + F.col("within")).alias("base"))
    bases.write.parquet(f"{path}/bases")


_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            bounds = ef_decode(row | {"n": len(row["doc_ids"])})
            starts = np.concatenate([[0], bounds[:-1]])
            ids = np.frombuffer(row["ids"], "<u2" if row["id_bytes"] == 2 else "<u4")
            crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(starts, bounds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"]), pa.array(bounds - starts), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a store with their bases."""
    segments = spark.read.schema(_SEGMENTS).parquet(f"{path}/segments")
    bases = spark.read.schema("part int, seq int, base long").parquet(f"{path}/bases")
    return segments.join(F.broadcast(bases) if bases.limit(1_000_001).count() <= 1_000_000 else bases, ["part", "seq"])


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    return read_segments(spark, path).mapInArrow(_read_docs, _DOCS)


def _read_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            code, ids = row | {"n": len(row["doc_ids"])}, np.frombuffer(row["ids"], "<u2" if row["id_bytes"] == 2 else "<u4")
            for k, doc_id in enumerate(row["doc_ids"]):
                if doc_id == row["wanted"] and doc_id is not None:
                    own = ids[ef_select(code, k - 1) if k else 0 : ef_select(code, k)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([own.tolist()], pa.list_(pa.int64()))], ["doc_id", "ids"])


def document_ids(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """Ids of one document, by two ``select`` calls on its segment.

    The scan skips every row group whose segments' ids do not reach ``doc_id``.
    """
    within = F.lit(doc_id).between(F.col("first_id"), F.col("last_id"))
    segments = read_segments(spark, path).where(within & F.array_contains("doc_ids", F.lit(doc_id))).withColumn("wanted", F.lit(doc_id).cast("long"))
    return segments.mapInArrow(_read_ids, "doc_id long, ids array<long>")
