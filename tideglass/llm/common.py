"""Shared helpers: stage tables in the shared folder, text slices, word and shingle hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as every operator here reads them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents are taken through numpy in slices of about so many bytes.
SLICE_BYTES = 1 << 20

_OWN_DIR: list[str] = []
#: Tables written by this driver, for ``clean_up``.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and everything runs in one process (tests, one machine) a folder of
    our own is made; on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="tideglass-"))
    return _OWN_DIR[0]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tideglass/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Delete what operators wrote to the shared folder; to be called when their results are stored.

    Results are lazy and read these tables, so no operator can delete them itself.
    """
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_key(text: str = "text"):
    """64-bit native key of a text (null and empty alike); a pair of them identifies a text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(whole, F.lit(1))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` (a stage table) has at most ``rows`` rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a stage table of at most ``rows`` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if small_enough(df, rows) else df


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """Cut a string column in runs of about ``max_bytes``; nulls become ''."""
    start, size, texts = 0, 0, []
    for i, x in enumerate(column):
        text = x.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= max_bytes:
            yield start, i + 1, texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield start, len(column), texts


_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_WORD_MUL = _RNG.integers(0, 1 << 64, 5, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(0, 1 << 63)) * 2 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the next call."""
    known = _POWERS.get((base, 0))
    if known is None or len(known) <= n:
        known = np.full(max(n + 1, SLICE_BYTES + 4096), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= 8 * SLICE_BYTES:
            _POWERS[base, 0] = known
    return known


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def prefix_hashes(data: np.ndarray, table: np.ndarray = _BYTE, base: int = _BASE) -> np.ndarray:
    """Running polynomial sums: ``span_hash`` turns two of them into a substring's hash."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(table[data] * powers(base, len(data))[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    return mix64((sums[end] - sums[start]) * powers(inverse(base), len(sums))[start])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte offset of every word of ``data``, in pieces of bounded size."""
    hashes, offsets, at = [], [], 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        piece = np.frombuffer(data, np.uint8, end - at, at)
        word = ~_SPACE[piece]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        first, last = edge[::2], edge[1::2]
        sums = prefix_hashes(piece)
        hashes.append(span_hash(sums, first, last))
        offsets.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(offsets)


def shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word ``width``-grams, text after text, and where each text's begin.

    A text of 1 to ``width - 1`` words has one shingle, of all its words; one without words
    has none. Repeats within a text are kept.
    """
    parts = [t.encode() for t in texts]
    begins = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=begins[1:])
    words, at = word_hashes(b" ".join(parts))
    first = np.searchsorted(at, begins)
    counts = np.diff(first)
    muls = _WORD_MUL if width <= 5 else np.resize(_WORD_MUL, width)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    out = np.empty(offsets[-1], np.uint64)
    if len(words) >= width:
        grams = sum((words[k : len(words) - width + 1 + k] * muls[k] for k in range(width)), np.uint64(width))
        long_ = counts >= width
        owner = np.repeat(np.flatnonzero(long_), sizes[long_])
        within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[long_]) - sizes[long_], sizes[long_])
        out[offsets[owner] + within] = mix64(grams[first[owner] + within])
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[first[i] : first[i + 1]]
        out[offsets[i]] = mix64(np.array([sum(int(w) * int(m) for w, m in zip(own, muls)) + len(own) & (1 << 64) - 1], np.uint64))[0]
    return out, offsets


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
