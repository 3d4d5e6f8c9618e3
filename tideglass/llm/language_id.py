"""Language of a text by unigram pieces, summed over all segmentations.

Pieces are those of a fixed public byte-level vocabulary, in which every byte is a piece, so that every
word can be segmented. For every language the model has a probability of each piece; the probability of
a word is the sum over all ways to cut its bytes into pieces (a forward pass over the bytes), and of a
text the product over its words. Words are runs of letters in lower case with a blank before them, of
up to ``WORD_LETTERS`` letters (a longer run is cut, as no piece crosses a word); a text's segmentations
are then all choices of its words' segmentations.

Probabilities are learned from all training rows by ``ROUNDS`` rounds of expectation maximisation. The
corpus is read once into counts by (language, word), added up within each partition before they are
shuffled; each round is a map over that table, whose expected piece counts meet by (language, piece).
They are counted in whole 1/1024s, so that sums do not depend on their order. Languages are taken in
blocks of ``BLOCK``, each with its own pass, so that a model (block x vocabulary) is bounded.

The score is the posterior probability of the predicted language given the text, with the languages'
shares of the training rows as prior; ties go to the language first by code point.

Training rows have crc32(doc_id as text) mod 4 other than 2, a lang and a letter in their text; a null
doc_id is not held out. Neither lang, source nor doc_id is an input of a prediction.

Defined results: a null text, or one without a letter, and every text where no row can be learned
from, gives `und` and score 0; repeated rows are learned from as often as they occur; very long texts
are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stage_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ROUNDS = 2
#: Pseudo-count of every piece.
SMOOTHING = 0.1
BLOCK = 32
WORD_LETTERS = 64
#: Words that a task keeps scores of, or counts of, at a time.
KEPT_WORDS = 500_000
UNDETERMINED = "und"



def _letters(end: int) -> re.Pattern:
    """Runs of letters below a code point, as a class of ranges (far faster than a class with exceptions)."""
    edges = [i for i in range(end + 1) if (i < end and chr(i).isalpha()) != (i > 0 and chr(i - 1).isalpha())]
    spans = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(edges[::2], edges[1::2], strict=True))
    return re.compile(f"[{spans}]{{1,{WORD_LETTERS}}}")


_BASIC, _ANY = _letters(0x10000), _letters(0x110000)
_UNIT = 1024
#: Sums of products above this natural logarithm are kept as they are, smaller ones as logarithms.
_LEAST_LOG = -650.0


def words(text: str) -> list[str]:
    """Runs of letters in lower case, cut at ``WORD_LETTERS``."""
    text = text.lower()
    basic = len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
    return (_BASIC if basic else _ANY).findall(text)


class Pieces:
    """The vocabulary, sorted by length and bytes; it turns the words of a batch into lattices of piece ids."""

    def __init__(self, lines: list[bytes]) -> None:
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}
        missing = [b for b in range(256) if bytes([b]) not in ids]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.size = max(ids.values()) + 1
        self.by_length = {}
        for n in sorted({len(p) for p in ids}):
            own = sorted(p for p in ids if len(p) == n)
            keys = np.array([int.from_bytes(p) for p in own], np.uint64) if n <= 8 else np.array(own, f"S{n}")
            self.by_length[n] = keys, np.array([ids[p] for p in own], np.int32)

    def _found(self, n: int, wanted: np.ndarray) -> np.ndarray:
        keys, ids = self.by_length[n]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, ids[at], self.size)

    def lattice(self, data: np.ndarray) -> np.ndarray:
        """ids[w, i, k]: the piece that is the k + 1 bytes of word w up to byte i, or ``size``."""
        n = data.shape[1]
        ids = np.full((*data.shape, min(n, max(self.by_length))), self.size, np.int32)
        key = np.zeros(data.shape, np.uint64)
        for k in range(min(n, max(self.by_length))):
            if k < 8:
                key = key[:, (k > 0) :] | data[:, : n - k].astype(np.uint64) << np.uint64(8 * k)
                wanted = key
            else:
                wanted = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, k + 1, axis=1)).view(f"S{k + 1}")[:, :, 0]
            if k + 1 in self.by_length:
                ids[:, k:, k] = self._found(k + 1, wanted)
        return ids

    def lattices(self, batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``batch``, lattice) of words of one length in bytes, the blank before included."""
        coded = [b" " + w.encode() for w in batch]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        for n in np.unique(lengths):
            places = np.flatnonzero(lengths == n)
            step = max(1, (1 << 20) // int(n * min(n, max(self.by_length))))
            for first in range(0, len(places), step):
                at = places[first : first + step]
                yield at, self.lattice(np.frombuffer(b"".join(coded[k] for k in at), np.uint8).reshape(len(at), n))


def _plain(ids: np.ndarray, logs: np.ndarray) -> bool:
    """Whether no sum of products over these lattices can be too small for a float: the bytes alone make up every word."""
    return ids.shape[1] * logs[:-1].min() > _LEAST_LOG


def _times(plain: bool):
    """(zero, one, product, sum) of probabilities, or of their logarithms."""
    return (0.0, 1.0, np.multiply, np.add) if plain else (-np.inf, 0.0, np.add, np.logaddexp)


def _ahead(ids: np.ndarray, logs: np.ndarray, plain: bool) -> np.ndarray:
    """Summed probability of each prefix: [bytes + 1, words, languages]; logs: [pieces + 1, languages]."""
    zero, one, product, plus = _times(plain)
    p = np.exp(logs) if plain else logs
    n, length, width = ids.shape
    sums = np.full((length + 1, n, logs.shape[1]), zero)
    sums[0] = one
    for i in range(length):
        for k in range(min(i + 1, width)):
            hit = np.flatnonzero(ids[:, i, k] < len(logs) - 1)
            if len(hit):
                sums[i + 1, hit] = plus(sums[i + 1, hit], product(sums[i - k, hit], p[ids[hit, i, k]]))
    return sums


def forward(ids: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """log probability of each word, summed over its segmentations: [words, languages]."""
    plain = _plain(ids, logs)
    sums = _ahead(ids, logs, plain)[-1]
    return np.log(sums) if plain else sums


def expected(ids: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Posterior probability of each piece of the lattices for one language: like ``ids``."""
    plain = _plain(ids, logs)
    zero, one, product, plus = _times(plain)
    p = np.exp(logs) if plain else logs
    n, length, width = ids.shape
    ahead = _ahead(ids, logs[:, None], plain)[:, :, 0]
    behind = np.full((length + 1, n), zero)
    behind[length] = one
    out = np.zeros(ids.shape)
    for i in range(length - 1, -1, -1):
        for k in range(min(i + 1, width)):
            hit = np.flatnonzero(ids[:, i, k] < len(logs) - 1)
            if len(hit):
                to_end = product(p[ids[hit, i, k]], behind[i + 1, hit])
                behind[i - k, hit] = plus(behind[i - k, hit], to_end)
                both = product(ahead[i - k, hit], to_end)
                out[hit, i, k] = both / ahead[length, hit] if plain else np.exp(both - ahead[length, hit])
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of the training rows; the row of each language without a word counts its documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, counts in held.items() for word, n in counts.items()]
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(("lang", "word", "n"), r, strict=True)) for r in rows], _COUNTS)

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                found = words(text.as_py())
                if found:
                    held[lang].update(found)
                    held[lang][""] += 1
                    if sum(map(len, held.values())) >= KEPT_WORDS:
                        yield out()
        yield out()

    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _piece_counts(counts: DataFrame, pieces, model) -> DataFrame:
    """lang, piece, n: expected counts of pieces, in 1/1024s."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pieces.value
        langs, logs = model.value if model else ((), None)
        flat = np.append(np.full(found.size, -np.log(found.size)), -np.inf)
        totals, current = np.zeros(found.size + 1, np.int64), None

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(totals[:-1])
            batch = pa.RecordBatch.from_arrays([pa.array([current] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(totals[at])], ["lang", "piece", "n"])
            totals[:] = 0
            return batch

        for batch in batches:
            columns = (batch["lang"].to_pylist(), batch["word"].to_pylist(), batch["n"].to_pylist())
            for lang, rows in groupby(zip(*columns, strict=True), key=lambda r: r[0]):
                if lang != current and current is not None:
                    yield out()
                current, rows = lang, list(rows)
                times = np.array([r[2] for r in rows])
                for at, ids in found.lattices([r[1] for r in rows]):
                    share = expected(ids, flat if logs is None else logs[:, langs.index(lang)])
                    np.add.at(totals, ids, np.rint(share * times[at][:, None, None] * _UNIT).astype(np.int64))
        if current is not None:
            yield out()

    by_language = counts.where("word <> ''").sortWithinPartitions("lang")
    return by_language.mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def train(counts: DataFrame, langs: list[str], pieces) -> np.ndarray:
    """log probabilities [pieces + 1, languages] of a block of languages; the last row is that of no piece."""
    context, model, size = counts.sparkSession.sparkContext, None, pieces.value.size
    own = counts.where(F.col("lang").isin(langs))
    for _ in range(ROUNDS):
        found = np.zeros((size, len(langs)))
        rows = _piece_counts(own, pieces, model).groupBy("lang").agg(F.collect_list("piece").alias("pieces"), F.collect_list("n").alias("n"))
        for r in rows.toLocalIterator():  # a row a language, each as large as the vocabulary at most
            found[r["pieces"], langs.index(r["lang"])] = np.array(r["n"]) / _UNIT
        logs = np.log((found + SMOOTHING) / (found.sum(0) + SMOOTHING * size))
        logs = np.vstack([logs, np.full(len(langs), -np.inf)])
        model = context.broadcast((langs, logs))
    return logs


_SCORED = "doc_id long, text string, best string, top double, total double"


def _score_block(rows: DataFrame, langs: list[str], logs: np.ndarray, priors: np.ndarray, pieces) -> DataFrame:
    """``rows`` with the best language so far, its log probability and that of all languages so far."""
    shared = rows.sparkSession.sparkContext.broadcast((logs, priors))  # a block's model: bounded by the vocabulary

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (logs, priors), found = shared.value, pieces.value
        known: dict[str, int] = {}
        table = np.empty((0, len(langs)))
        for batch in batches:
            best, top, total = (batch[c].to_pylist() for c in ("best", "top", "total"))
            for start, _, texts in slices(batch["text"], 4 << 20):
                counted = [Counter(words(text)) for text in texts]
                every = set().union(*counted)
                new = sorted(every.difference(known))
                if len(known) + len(new) > KEPT_WORDS and known:
                    known.clear()
                    new = sorted(every)
                if new:
                    first = len(known)
                    if len(table) < first + len(new):
                        table = np.vstack([table[:first], np.empty((first + 2 * len(new), len(langs)))])
                    for at, ids in found.lattices(new):
                        table[first + at] = forward(ids, logs)
                    known.update(zip(new, range(first, first + len(new)), strict=True))
                for row, counts in enumerate(counted, start):
                    if not counts:
                        continue
                    sums = priors + np.fromiter(counts.values(), float, len(counts)) @ table[[known[w] for w in counts]]
                    k = int(sums.argmax())
                    if top[row] is None or sums[k] > top[row]:
                        best[row], top[row] = langs[k], float(sums[k])
                    total[row] = float(np.logaddexp.reduce(sums if total[row] is None else np.append(sums, total[row])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(best, pa.string()), pa.array(top, pa.float64()), pa.array(total, pa.float64())], ["doc_id", "text", "best", "top", "total"])

    return rows.mapInArrow(score, _SCORED)


def predict_languages(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang); ``vocabulary``: a file of base64 pieces and ids."""
    with open(vocabulary, "rb") as file:
        pieces = docs.sparkSession.sparkContext.broadcast(Pieces(file.read().splitlines()))
    counts = stage_table(word_counts(docs), "words")
    shares = counts.where("word = ''")
    n = shares.agg(F.sum("n")).first()[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("total"))
    after = None
    while block := shares.where(F.lit(after is None) | (F.col("lang") > F.lit(after))).orderBy("lang").limit(BLOCK).collect():  # at most BLOCK rows
        langs, after = [r["lang"] for r in block], block[-1]["lang"]
        priors = np.log(np.array([r["n"] for r in block]) / n)
        rows = _score_block(rows, langs, train(counts, langs, pieces), priors, pieces)
    return rows.select("doc_id", held_out().alias("held_out"), F.coalesce("best", F.lit(UNDETERMINED)).alias("lang_pred"), F.when(F.col("best").isNull(), 0.0).otherwise(F.least(F.exp(F.col("top") - F.col("total")), F.lit(1.0))).alias("score"))
