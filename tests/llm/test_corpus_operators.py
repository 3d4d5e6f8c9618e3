"""Small tables and odd cases for the other corpus operators, and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideglass.llm import line_quality, mixing, preference, token_rollup, token_store, toxicity
from tideglass.llm.common import new_path
from tideglass.sources.tables import KeyedTable

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source=lambda i: f"src{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], DOCS)


# --- token rollup


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, source string, lang string, tokenizer_version string, n_tokens long, old_source string, old_lang string, old_version string, old_tokens long")


def as_dict(df):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in df.collect()}


def test_rollup_adds_signed_changes_and_commits_once(spark):
    path = new_path(spark, "test-rollup")
    assert as_dict(token_rollup.totals(spark, path)) == {}
    first = changes(spark, [("insert", "a", "en", "v1", 10, None, None, None, None)] * 2 + [("insert", None, None, "v1", None, None, None, None, None), ("nonsense", "a", "en", "v1", 5, None, None, None, None)])
    token_rollup.commit_batch(first, path, "1")
    token_rollup.commit_batch(first, path, "1")
    assert as_dict(token_rollup.totals(spark, path)) == {("a", "en", "v1"): (2, 20), (None, None, "v1"): (1, 0)}
    token_rollup.commit_batch(changes(spark, [("revise", "a", "en", "v2", 13, "a", "en", "v1", 10), ("DELETE", "a", "en", "v1", 10, None, None, None, None)]), path, "2")
    want = {("a", "en", "v2"): (1, 13), (None, None, "v1"): (1, 0)}
    assert as_dict(token_rollup.totals(spark, path)) == want
    token_rollup.commit_batch(first.limit(0), path, "3")
    for _ in range(2):
        token_rollup.compact(spark, path)
        assert as_dict(token_rollup.totals(spark, path)) == want
        token_rollup.commit_batch(first, path, "1")  # a replay after compaction
        assert as_dict(token_rollup.totals(spark, path)) == want
    token_rollup.commit_batch(first, path, "4")
    assert as_dict(token_rollup.totals(spark, path)) == want | {("a", "en", "v1"): (2, 20), (None, None, "v1"): (2, 0)}


def test_rollup_of_lost_and_doubled_attempts_and_of_many_batches(spark, monkeypatch):
    path, publish = new_path(spark, "test-rollup"), KeyedTable._publish
    one = changes(spark, [("insert", "a", "en", "v1", 10, None, None, None, None)])
    two = changes(spark, [("insert", None, "en", "v1", 3, None, None, None, None)])

    def lost(self, new):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):  # the driver is lost before the rename
        patch.setattr(KeyedTable, "_publish", lost)
        token_rollup.commit_batch(one, path, "0")
    assert as_dict(token_rollup.totals(spark, path)) == {}
    others = [("0", one), ("x", two)]

    def second(self, new):
        if others:  # two other drivers are faster, one with the same batch
            token_rollup.commit_batch(others.pop()[1], path, "0" if not others else "x")
        return publish(self, new)

    with monkeypatch.context() as patch:
        patch.setattr(KeyedTable, "_publish", second)
        token_rollup.commit_batch(one, path, "0")
    assert as_dict(token_rollup.totals(spark, path)) == {("a", "en", "v1"): (1, 10), (None, "en", "v1"): (1, 3)}
    monkeypatch.setattr(token_rollup, "KEPT_VERSIONS", 2)
    monkeypatch.setattr(token_rollup, "KEPT_SECONDS", -5)
    for k in range(1, 5):
        token_rollup.commit_batch(one, path, str(k))
        token_rollup.commit_batch(one, path, "1")
    assert as_dict(token_rollup.totals(spark, path)) == {("a", "en", "v1"): (5, 50), (None, "en", "v1"): (1, 3)}
    assert len(token_rollup._table(spark, path).versions()) <= 3


def test_document_changes_and_counts(spark):
    texts = ["a b, c", "d e", None, "long " * 50_000, "d e"]
    docs = docs_of(spark, texts).withColumn("n_first", F.lit("clash"))
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (2, 0), (9, 0), (None, 0), (4, None)], "doc_id long, quality int")
    path = new_path(spark, "test-rollup")
    for batch_id, rows in token_rollup.document_changes(docs, labels):
        token_rollup.commit_batch(rows, path, batch_id)
    # 0 and 2 are deleted, 1 and 4 are counted anew, 3 stays
    want = {("src0", "en", "words-1"): (1, 50_000), ("src1", "en", "pieces-2"): (2, 4)}
    assert as_dict(token_rollup.totals(spark, path)) == want
    file = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(file)
    got = {r.doc_id: r.n_vocabulary_tokens for r in token_rollup.vocabulary_counts(docs, file).collect()}
    assert got == {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


# --- line quality


def brute_repeat(words):
    seen = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_repeat_words_equal_brute_force():
    rng = random.Random(2)
    for n in range(60):
        words = [rng.choice("abc") for _ in range(n)]
        assert line_quality.repeat_words(words) == brute_repeat(words)


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    footer = "Subscribe to our Letter \t and follow us"
    texts = [prose(40) + "\n" + footer + "\n" + prose(40) + "\n" + prose(9) for _ in range(160)]
    texts += ["\n".join([footer] * 3 + [footer.upper()] * 9) + "\n" + " ".join(word() for _ in range(8))]  # little else
    clean = prose(100)
    texts += [clean] * 80 + ["", None, " \n ", prose(10)]
    docs = docs_of(spark, texts, lambda i: None if i % 2 else "h")
    got = {r.doc_id: r for r in line_quality.score_lines(docs).collect()}
    assert all(got[i].kept and got[i].n_frequent_line_words == 7 for i in range(160))
    assert not got[160].kept and got[160].n_dup_lines == 10
    assert all(got[i].kept and got[i].n_frequent_line_words == 0 for i in range(161, 241))  # copies are one document
    assert not any(got[i].kept for i in range(241, 245)) and got[242].n_words == 0
    kept = line_quality.clean_documents(docs).collect()
    assert sorted(r.doc_id for r in kept) == [i for i in range(245) if got[i].kept]
    assert all("Subscribe" not in r.text and r.n_chars == len(r.text) for r in kept)
    assert line_quality.score_lines(docs.limit(0)).count() == 0 and line_quality.clean_documents(docs.limit(0)).count() == 0


def test_a_shared_line_counts_every_distinct_document(spark):
    """Forty footers, each in 200 different two-line documents: all go, whatever their hashes."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(40):
        footer = " ".join(word() for _ in range(6))
        rows += [(len(rows) + i, " ".join(word() for _ in range(60)) + "\n" + footer, f"h{k}", k) for i in range(200)]
    # mostly boilerplate: twenty shared lines and one of its own
    shared = [" ".join(word() for _ in range(8)) for _ in range(20)]
    first = len(rows)
    rows += [(first + i, "\n".join([*shared, " ".join(word() for _ in range(9))]), "poor", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, hash int")
    got = {r.doc_id: r for r in line_quality.score_lines(docs).collect()}
    assert all(got[i].n_frequent_line_words == 6 and got[i].kept for i in range(first))
    assert all(got[first + i].n_frequent_line_words == 160 and not got[first + i].kept for i in range(200))


def test_lines_at_the_limit_long_texts_and_odd_letters(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    odd = "İstanbul ΟΔΟΣ ΣΑΣ straße"
    rows = [(i, " ".join(word() for _ in range(70)) + "\n" + odd + ("\nat limit here" if i < 30 else "") + ("\nover limit here" if i < 31 else ""), "h", "x", b"k") for i in range(60)]
    rows.append((60, " ".join(word() for _ in range(200_000)) + "\n" + odd, "h", "x", b"k"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lines string, key binary")
    got = {r.doc_id: r.n_frequent_line_words for r in line_quality.score_lines(docs).collect()}
    assert got == {i: 4 + 3 * (i < 31) for i in range(61)}
    kept = line_quality.clean_documents(docs).collect()
    assert len(kept) == 61 and not any(odd in r.text or "over limit" in r.text for r in kept)
    assert sum("at limit here" in r.text for r in kept) == 30 and kept[0].lines == "x"


# --- token store


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (1, 7), (64, 64), (65, 1), (300, 100_000), (129, 1 << 40)):
        bounds = np.sort(rng.integers(0, top + 1, n))
        code = token_store.ef_encode(bounds)
        assert token_store.ef_decode(code).tolist() == bounds.tolist()
        assert [token_store.ef_select(code, k) for k in range(n)] == bounds.tolist()
    assert token_store.ef_decode(token_store.ef_encode(np.empty(0, np.int64))).tolist() == []
    big = token_store.ef_encode(np.sort(rng.integers(0, 1 << 20, 10_000)))
    assert (len(big["low"]) + len(big["high"])) * 8 / 10_000 < 2.1 + np.log2((1 << 20) / 10_000)


ODD = ["a  b", " a b ", "a\n b", "a\n\nb", "\na", "a\n", "a \nb", "a\t\nb", "x' s 's", "it's 12 3", "<|endoftext|> x", "tab\t x", "a　 b", "naïve Übung, s'il?", "a b   c", "\x1c a", "😀 😀\n😀"]


@pytest.mark.parametrize("special", [True, False])
def test_token_store_round_trip(spark, special):
    texts = [*ODD, "", None, "word " * 20_000, "same", "same"]
    docs = spark.createDataFrame([(len(texts) - i if i % 7 else None, t, "extra") for i, t in enumerate(texts)] + [(5, "again", "extra")], "doc_id long, text string, ids string")
    path, file = new_path(spark, "test-tokens"), public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_store(docs, path, file, special=special)
    rows = sorted(token_store.read_digest(spark, path).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(file)
    plain.encode_special_tokens = not special
    want = defaultdict(list)
    for r in docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got, at = defaultdict(list), 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        got[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.doc_id for r in rows]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    one = token_store.document_ids(spark, path, 20).collect()
    assert [len(r.ids) for r in one] == [n for n, _ in want[20]]


def test_literals_of_added_tokens_have_their_ids():
    file, end = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
    plain, made = Tokenizer.from_file(file), token_store.Encoder(file, special=True)
    around = ["", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t ", "x", "x ", " x", "x\n", "\nx", "é!", "　"]
    texts = [*ODD, *(o + end + o for o in ODD), *(a + end + b for a in around for b in around), "x\n\n " + end + end + " it's"]
    for _ in range(2):  # learnt, then remembered
        assert [np.frombuffer(x, made.dtype).tolist() for x in made.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(made.encode([f"foo {end} bar"])[0], made.dtype).tolist() == [21943, 220, 50256, 2318]


def test_query_keeps_ids_of_literals(spark, tmp_path):
    from tideglass.llm import queries

    text = "foo <|endoftext|> bar"
    docs_of(spark, [text]).write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = queries.op3_token_store(spark, str(tmp_path)).collect()
    assert (row.n_tokens, row.ids_crc32) == (5, zlib.crc32(np.array([21943, 220, 50256, 2318, 2], "<u4").tobytes()))


def test_empty_token_store(spark):
    path = new_path(spark, "test-tokens")
    token_store.write_store(spark.createDataFrame([], DOCS), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.read_digest(spark, path).count() == 0


# --- preference pairs


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, prompt string")


def test_preference_pairs(spark):
    row = lambda p, i, r, t: (p, i, r, t, "x")
    chosen = [row(1, 0, "user", "hi"), row(1, 1, "assistant", "yes"), row(2, 0, "user", "q"), row(3, 0, "user", None), row(4, 0, "user", "alone"), row(None, 0, "user", "none")]
    rejected = [row(1, 0, "user", "hi"), row(1, 1, "assistant", "no"), row(1, 2, "user", "?"), row(2, 0, "user", "other"), row(3, 0, "user", None), row(3, 1, "assistant", "é")]
    got = {r.pair_id: r for r in preference.format_preferences(turns(spark, chosen), turns(spark, rejected)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].prompt == "<|user|>\nhi\n" and got[1].chosen == "<|assistant|>\nyes\n" and got[1].n_shared_turns == 1
    assert got[1].rejected == "<|assistant|>\nno\n<|user|>\n?\n"
    assert [got[1].rejected[s.start : s.end] for s in got[1].rejected_mask] == ["no\n"]
    assert got[2].prompt == "" and got[2].chosen_mask == []
    assert got[3].chosen == "" and got[3].prompt == "<|user|>\n\n" and [got[3].rejected[s.start : s.end] for s in got[3].rejected_mask] == ["é\n"]
    assert preference.format_preferences(turns(spark, []), turns(spark, rejected)).count() == 0


def test_preference_pairs_of_ties_and_long_turns(spark):
    row = lambda p, i, r, t: (p, i, r, t, "x")
    long_ = "é " * 200_000
    chosen = [row(1, None, "user", "a"), row(1, 1, "user", "b"), row(1, 1, "user", "b"), row(1, 1, "assistant", long_)]
    rejected = [row(1, None, "user", "a"), row(1, 1, "assistant", long_), row(1, 1, "user", "b"), row(1, 2, None, "<|assistant|>\nforged")]
    (got,) = preference.format_preferences(turns(spark, chosen), turns(spark, rejected)).collect()
    assert got.n_shared_turns == 3 and got.prompt == f"<|user|>\na\n<|assistant|>\n{long_}\n<|user|>\nb\n"
    assert got.chosen == "<|user|>\nb\n" and got.chosen_mask == []
    assert got.rejected == "<||>\n<|assistant|>\nforged\n" and got.rejected_mask == []


# --- toxicity


def labelled(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "the", "re", "ti", "on", "ed", "in", "or", "sh", "ea"]
    bad = ["worthless", "pathetic", "scumbag", "clowns"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(30, 120))]
        toxic = int(rng.random() < 0.3)
        for _ in range(4 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled(900, 6)
    docs = spark.createDataFrame([(d, t, "s") for d, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (None, "x", "s"), (0, rows[0][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(0, None), (None, 1), (5, 7)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {d: y for d, _, y in rows}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("score > 0").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_scores_equal_plain_python(spark):
    """The query's scores, computed again text by text with zstandard alone."""
    rows = labelled(700, 9)
    extra = [(5000, "word " * 30_000 + "scumbag clowns " * 9), (5001, ""), (5002, None), (5003, "pathetic")]
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows] + [(d, t, "x") for d, t in extra] * 2, "doc_id long, text string, labelled string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(*toxicity.training_rows(docs, labels))
    assert len(model.toxic) == len(model.ordinary) and model.toxic != model.ordinary
    packers = []
    for content in (model.ordinary, model.toxic):
        parameters = zstandard.ZstdCompressionParameters(**toxicity._PARAMETERS, write_content_size=False, write_dict_id=False, write_checksum=False)
        packers.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))

    def plain(text):
        words, gains = (text or "").lower().split(), []
        for i in range(0, len(words), 8):
            window = (" " + " ".join(words[i : i + 8]) + " ").encode()
            gains.append(len(packers[0].compress(window)) - len(packers[1].compress(window)))
        top = sorted((min(max(g, 0), 8) for g in gains), reverse=True)[:3] + [0, 0, 0]
        counts = [sum(g >= k for g in gains) for k in (1, 2, 3, 4)]
        x = [1.0, *(g / 4 for g in top[:3]), *(math.log1p(c) for c in counts), *(math.sqrt(c / max(len(gains), 1)) for c in counts)]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, model.weights, strict=True))))))

    got = toxicity.score_toxicity(docs, labels).collect()
    texts = {d: t for d, t, _ in rows} | dict(extra)
    assert len(got) == len(rows) + 8
    assert all(abs(r.score - plain(texts[r.doc_id])) < 1e-9 for r in got)


# --- mixing


def brute_mix(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s] + 1e-9}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return sizes, target


@pytest.mark.parametrize("seed", range(2))
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), rng.choice(["a", "b", "c", "d", None, "big", "big", "big"])) for i in range(500)]
    rows += [(1000, None, "a"), (None, "w w", "a"), (1, "w", "tiny"), (1, "w", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    sizes, target = brute_mix(rows)
    by = {d: s for d, _, s in rows}
    taken = defaultdict(int)
    for r in got.collect():
        s = "tiny" if r.source_size == sizes["tiny"] and r.size == 1 and r.doc_id == 1 else by[r.doc_id]
        if r.doc_id == 1 and r.source_size != sizes["tiny"]:
            s = rows[1][2]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 40
    words = sum(len((r.text or "").split()) for r in mixing.mixed_documents(docs).collect())
    assert words == sum(taken.values()) and mixing.mix(docs.limit(0)).count() == 0


def test_mix_divides_rows_without_ids_and_keeps_clashing_columns(spark):
    rows = [(None, f"a{i} b c d", "x", i, "o") for i in range(600)] + [(i, "w " * 9, "y", 0, "p") for i in range(40)] + [(None, None, None, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, hash int, of string").withColumns({"size": F.lit("s"), "copies": F.lit(9), "threshold": F.lit(0), "row": F.lit("r")})
    got = mixing.mix(docs).collect()
    sizes, target = brute_mix([r[:3] for r in rows])
    by = {v: k for k, v in sizes.items()}
    taken = Counter()
    for r in got:
        taken[by[r.source_size]] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 20 for s in sizes)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and sum(len(r.text.split()) for r in out.collect() if r.text) == sum(taken.values())


# --- pipeline


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, an empty table and columns that clash with the stages' own."""
    import corpus_pipeline

    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    same, item, long_ = prose(120), prose(40), prose(60_000)
    texts = [(1, same), (1, same), (None, same), (None, prose(90)), (2, None), (3, ""), (4, prose(200) + " " + item), (5, long_), (6, long_ + " end"), (7, prose(80))]
    rows = [(d, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None, "h", i) for i, (d, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS + ", host string, `row` int").withColumns({c: F.lit("clash") for c in ("key", "hash", "size", "copies", "text_key", "set_key", "hashes", "cut_text", "lost_id", "id")})
    spark.createDataFrame([(1, item), (1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, table in (("full", docs), ("empty", docs.limit(0))):
        out = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{name}-{k}")
            out = spark.read.parquet(f"{tmp_path}/{name}-{k}")
            found = out.collect()
            if k < 4:
                assert sorted(out.columns) == sorted(docs.columns)
            if name == "empty":
                assert not found
            elif k == 0:  # without words or too short: out; repeated rows stay
                assert sorted(r.row for r in found) == [0, 1, 2, 3, 6, 7, 8, 9]
            elif k == 1:  # one of a group, the one without id last; of rows 0 and 1 either
                assert sorted(max(r.row, 1) for r in found) == [1, 3, 6, 7, 9]
            elif k == 2:
                assert sorted(max(r.row, 1) for r in found) == [1, 3, 7, 9]
            elif k == 4:
                assert all(r.n_tokens > 80 for r in found)



def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(30)
    texts = [prose(100) for _ in range(30)]
    near = prose(200)
    texts += [near, near, near + " more words"]  # 30, 31, 32: 30 stays
    texts += [prose(80) + " " + item + " " + prose(80), prose(20), None, ""]  # 33 is contaminated, 34 to 36 are too short
    docs_of(spark, texts, lambda i: f"s{i % 2}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(sorted(r.doc_id for r in docs.collect()))
        if k < 4:
            assert sorted(docs.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
    assert seen[0] == [*range(34)] and seen[1] == [*range(31), 33] and seen[2] == [*range(31)]
    assert seen[3] == seen[4] and set(seen[3]) <= set(seen[2])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, docs.collect()))
