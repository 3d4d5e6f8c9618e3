"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled rows with ``zstandard.train_dictionary``: one
on windows of ordinary text, one on the windows of toxic text that ordinary text does not explain.
These are one word wide, and are all places of toxic rows where a word, or its beginning, is in a
larger share of toxic than of ordinary documents by more than a calibrated number of standard
errors; wider windows bring the same prose as ordinary ones and drown what is toxic. The toxic
dictionary is laid over the ordinary one, and the ordinary one has as many bytes trained on other
ordinary windows in its place, so that both compress common prose alike and the difference in
length is what toxic windows save. Every window of eight words of a text is compressed with both;
the differences of its windows make the text's features, and a logistic curve fitted on other
labelled rows turns them into a score. The bound of the windows and the size of the dictionary
are calibrated on those rows too, by log loss over folds.

Training rows are a bounded sample: of rows with crc32(doc_id as text) mod 3 other than 1, up to
``TRAIN_DOCS`` per label in the order of a hash of the id, and up to ``TRAIN_BYTES`` of their
texts. Labels, language, source and doc_id are no inputs of a score.

Defined results: a null or empty text scores as one without windows; with no usable rows of a
label in the sample every text scores the share of toxic labels (0 without labels); a doc_id
with several labels counts as toxic if one of them is 1; a null doc_id is not held out; repeated
rows get equal scores; very long texts are read whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

WINDOW = 8
TRAIN_DOCS = 2000
TRAIN_BYTES = 8 << 20
ORDINARY_BYTES = 8192
#: Candidate bounds, in standard errors, of how far a toxic window stands out, and dictionary sizes.
BOUNDS = (5.0, 6.0, 8.0)
TOXIC_BYTES = (1024, 1536)
#: Lengths of the beginnings of words that are pieces too, the blank before included.
STEMS = (5, 6, 7)
PREDICTED_FROM = 0.7

_WORDS = re.compile(WORD)
_PARAMETERS = {"window_log": 17, "chain_log": 14, "hash_log": 14, "search_log": 3, "min_match": 4, "strategy": zstandard.STRATEGY_GREEDY, "target_length": 0}


def windows(text: str, width: int = WINDOW) -> list[bytes]:
    words = _WORDS.findall(text.lower())
    return [(" " + " ".join(words[i : i + width]) + " ").encode() for i in range(0, len(words), width)]


def _forms(word: str) -> list[str]:
    """A word without outer punctuation, after a blank, and its beginnings."""
    bare = word.strip(".,;:!?\"'()|*#")
    return [" " + bare, *((" " + bare)[:n] for n in STEMS if len(bare) >= n)] if bare else []


def _pieces(text: str) -> set[str]:
    return {f for w in _WORDS.findall(text.lower()) for f in _forms(w)}


def toxic_windows(texts: list[str], pieces: set[str]) -> list[bytes]:
    """The one-word windows of ``texts`` of which a form is in ``pieces``, repeats included."""
    return [f" {w} ".encode() for t in texts for w in _WORDS.findall(t.lower()) if not pieces.isdisjoint(_forms(w))]


def train_dictionary(size: int, samples: list[bytes]) -> bytes:
    """zstandard's trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples[:: max(1, len(samples) // 60_000)]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    """Two dictionaries and a logistic curve over the features of the length differences."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    base_rate: float

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic, "weights": self.weights, "base_rate": self.base_rate}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._pair = None

    def differences(self, text: str) -> np.ndarray:
        """Compressed length under the ordinary less that under the toxic dictionary, window by window."""
        if self._pair is None:
            self._pair = tuple(_compressor(d).compress for d in (self.ordinary, self.toxic))
        ordinary, toxic = self._pair
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], np.int64)

    def score(self, text: str) -> float:
        if not self.weights:
            return self.base_rate
        return float(_logistic(features(self.differences(text)) @ np.array(self.weights)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS, write_content_size=False, write_dict_id=False, write_checksum=False)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def features(differences: np.ndarray) -> np.ndarray:
    """1, the three largest differences (0 to 8), and how many windows, and what share of them, gain 1 to 4 bytes or more."""
    top = np.sort(np.clip(differences, 0, 8))[::-1][:3].astype(float)
    top = np.pad(top, (0, 3 - len(top)))
    counts = np.array([(differences >= k).sum() for k in (1, 2, 3, 4)], float)
    return np.concatenate([[1.0], top / 4, np.log1p(counts), np.sqrt(counts / max(len(differences), 1))])


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the weighted log loss with a small ridge."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty, x.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Log loss of five folds, each scored by a curve of the others."""
    total, fold = 0.0, np.arange(len(y)) % 5
    for k in range(5):
        train, test = fold != k, fold == k
        p = np.clip(_logistic(x[test] @ fit_logistic(x[train], y[train], weight[train])), 1e-6, 1 - 1e-6)
        total -= (weight[test] * np.where(y[test] == 1, np.log(p), np.log(1 - p))).sum()
    return total / weight.sum()


def standing_out(toxic: list[str], ordinary: list[str]) -> list[tuple[float, str]]:
    """(standard errors, piece) by which a piece's share of toxic documents exceeds that of ordinary ones."""
    a, b = (Counter(p for t in texts for p in _pieces(t)) for texts in (toxic, ordinary))
    found = []
    for piece, n in a.items():
        p = (n + b[piece]) / (len(toxic) + len(ordinary))
        if n > 1 and p < 1:
            z = (n / len(toxic) - b[piece] / len(ordinary)) / np.sqrt(p * (1 - p) * (1 / len(toxic) + 1 / len(ordinary)))
            found.append((float(z), piece))
    return sorted(found)


def train(rows: list[tuple[str, int]], base_rate: float) -> Model:
    """Fit on (text, label) rows in a fixed order: even rows for dictionaries, odd ones for the curve."""
    sides = [[(t, y) for k, (t, y) in enumerate(r for r in rows if r[1] == label) if k % 2 == half] for half in (0, 1) for label in (0, 1)]
    if any(len(s) < 5 for s in sides):
        return Model(b"", b"", (), base_rate)
    ordinary, toxic = ([t for t, _ in s] for s in sides[:2])
    fit = [r for pair in zip(sides[2], sides[3], strict=False) for r in pair]
    fit += sides[2][len(sides[3]) :] + sides[3][len(sides[2]) :]
    y = np.array([label for _, label in fit])
    weight = np.where(y == 1, base_rate / max(y.mean(), 1e-9), (1 - base_rate) / max(1 - y.mean(), 1e-9))
    samples = [w for t in ordinary for w in windows(t)]
    base = train_dictionary(ORDINARY_BYTES, samples)
    pieces, best = standing_out(toxic, ordinary), None
    for bound in BOUNDS:
        chosen = toxic_windows(toxic, {p for z, p in pieces if z >= bound})
        for size in TOXIC_BYTES if chosen else ():
            content = train_dictionary(size, chosen)
            other = train_dictionary(size, samples[1::2])[-len(content) :].rjust(len(content))
            model = Model(base + other, base + content, (), base_rate)
            x = np.stack([features(model.differences(t)) for t, _ in fit])
            loss = _loss(x, y, weight)
            if best is None or loss < best[0]:
                best = (loss, Model(model.ordinary, model.toxic, tuple(fit_logistic(x, y, weight)), base_rate))
    return best[1] if best else Model(b"", b"", (), base_rate)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> tuple[list[tuple[str, int]], float]:
    """The bounded sample and the share of toxic labels among all rows it is drawn from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    base_rate = usable.agg(F.avg("toxic")).first()[0] or 0.0
    order = F.xxhash64("labelled", F.lit(7))
    rows = []
    for label in (0, 1):
        ids = usable.where(F.col("toxic") == label).orderBy(order, "labelled").limit(per_label)  # at most per_label ids: safe to broadcast
        own = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled"))
        size = 0
        for r in own.select("text", "labelled").orderBy(order, "labelled", F.xxhash64("text")).limit(2 * per_label).toLocalIterator():
            rows.append((r["text"], label))
            size += len(r["text"])
            if size >= max_bytes:
                break
    return rows, float(base_rate)


_SCORES = "doc_id long, score double"


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(train(*training_rows(docs, labels)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.value.score(t.as_py() or "") for t in batch["text"]], pa.float64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], scores], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, _SCORES)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))
