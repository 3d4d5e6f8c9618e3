"""Quality rules by cross-document line frequency.

Base rules read one text alone. The method then hashes every normalised line (lower case,
runs of white space as one blank), counts for each host in how many distinct documents a line
stands, removes the lines above the limit, and rejects documents that keep too few words.

Distinct documents: rows of a host with the same whole text are one document, all others are
distinct. So exact copies never turn their own lines into boilerplate; over the limit, near
copies do, as each of them is a document that holds the lines. The query takes ``source`` as
the host.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a
null host is a host of its own; repeated rows get equal verdicts and count once; a line that
stands twice in a document counts once; a line in exactly as many documents as the limit stays;
very long texts are read whole; columns other than doc_id, text and the host are ignored by the
digest and kept by ``clean_documents``; an empty table gives no rows. Verdicts depend on (host,
text) only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, maybe_broadcast, stage_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate of its host above so many distinct documents and above this share of the host's.
LINE_MIN_DOCS = 30
LINE_SHARE = 0.02
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.2
#: Frequent lines are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 500_000

_WORDS = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")

_SCHEMA = (
    "doc_id long, host string, key binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<hash:long,n:int>>"
)


def normal_line(line: str) -> str:
    return " ".join(_WORDS.findall(line.lower()))


def line_hash(normal: str) -> int:
    """60 bits of MD5, which SQL can compute too."""
    return int.from_bytes(md5(normal.encode()).digest()[:8], "big") >> 4


def repeat_words(words: list[str]) -> int:
    """Words inside a 3-word window that stands twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    count = reach = 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            count += i + 3 - max(i, reach)
            reach = i + 3
    return count


def features(text: str) -> tuple:
    words = _WORDS.findall(text)
    lines, earlier, dups = Counter(), set(), 0
    for line in text.split("\n"):
        own = _WORDS.findall(line)
        if own:
            dups += line in earlier
            earlier.add(line)
            lines[" ".join(own).lower()] += len(own)
    hashed = [{"hash": line_hash(k), "n": n} for k, n in lines.items()]
    return (
        len(words),
        sum(map(len, words)),
        len(_SYMBOLS.findall(text)),
        dups,
        repeat_words(words),
        hashed,
    )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int32())]))]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            rows = [features(t.as_py() or "") for t in part["text"]]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["host"], part["key"], *columns], ["doc_id", "host", "key", *names])


def text_digest(host: str = "host") -> Column:
    """16 bytes for (host, text)."""
    marked = F.concat(F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("-")), F.lit("\0"), F.coalesce(F.col("text"), F.lit("")))
    return F.unhex(F.md5(marked))


def parsed(docs: DataFrame, host: str = "source") -> DataFrame:
    """Stage table: one row per row of ``docs`` with its base counts and line hashes."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    return stage_table(keyed.withColumn("key", text_digest()).mapInArrow(_parse, _SCHEMA), "lines")


def frequent_lines(rows: DataFrame, min_docs: int = LINE_MIN_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """Lines above the limit: host, hash, n_docs."""
    # one row for each distinct text first, so that plain counts combine before the shuffle
    texts = rows.where(F.size("lines") > 0).groupBy("key").agg(F.first("host").alias("host"), F.first("lines.hash").alias("hashes"))
    texts = stage_table(texts.select("host", "hashes"), "texts")
    counts = texts.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    hosts = hosts.withColumnRenamed("host", "of")
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n_docs") > share * F.col("host_docs")).select("host", "hash", "n_docs")


def verdicts(rows: DataFrame, frequent: DataFrame, min_left: float = MIN_LEFT) -> DataFrame:
    """``rows`` with removed (words in frequent lines), hashes (of those lines), base_failed and kept."""
    lines = rows.select("host", "key", F.explode("lines").alias("line")).select("host", "key", "line.hash", "line.n")
    common = frequent.select(F.col("host").alias("in_host"), F.col("hash").alias("in_hash"))
    hits = lines.join(maybe_broadcast(common, BROADCAST_ROWS), (F.col("hash") == F.col("in_hash")) & F.col("host").eqNullSafe(F.col("in_host")))
    # equal (host, text) rows bring equal lines: one of each is enough
    hits = hits.groupBy("key", "hash").agg(F.first("n").alias("n"))
    hits = hits.groupBy("key").agg(F.sum("n").alias("removed"), F.collect_set("hash").alias("hashes")).withColumnRenamed("key", "hit_key")
    joined = rows.join(hits, F.col("key") == F.col("hit_key"), "left").drop("hit_key")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= min_left * F.col("n_words")))


def score_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """The digest of the rules, one row per document row."""
    rows = parsed(docs, host)
    frequent = stage_table(frequent_lines(rows), "frequent")
    return verdicts(rows, frequent).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_frequent_line_words"),
    )


def without_lines(text: Column, hashes: Column) -> Column:
    """``text`` without the lines whose hash is in ``hashes``."""
    def of(line: Column) -> Column:
        normal = F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))
        return F.conv(F.substring(F.md5(normal), 1, 15), 16, 10).cast("long")

    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(hashes, of(line))), "\n")


def clean_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The kept rows of ``docs``, all their columns, frequent lines removed from the text.

    Where ``docs`` has n_chars it is counted anew for texts that lost lines.
    """
    rows = parsed(docs, host)
    frequent = stage_table(frequent_lines(rows), "frequent")
    kept = verdicts(rows, frequent).where("kept").groupBy("key").agg(F.first("hashes").alias("hashes"))
    kept = stage_table(kept.withColumnRenamed("key", "kept_key"), "kept")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(host).cast("string").alias("host"), "text").withColumn("key", text_digest()).select("row", "key")
    joined = keyed.join(kept, F.col("key") == F.col("kept_key"))
    cut = F.when(F.col("hashes").isNotNull(), without_lines(F.col("row.text"), F.col("hashes"))).otherwise(F.col("row.text"))
    out = joined.select("row", cut.alias("cut"), F.col("hashes").isNotNull().alias("was_cut"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("cut")
        if c == "n_chars":
            return F.when(F.col("was_cut"), F.length("cut").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c])
        return F.col("row")[c]

    return out.select(*[column(c).alias(c) for c in docs.columns])
