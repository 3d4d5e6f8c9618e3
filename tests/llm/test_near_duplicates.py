"""The n-gram join, decontamination and repeat removal against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tideglass.llm import bwt_dedup, decontaminate, graph, ngram_join

WORDS = [f"w{i}" for i in range(3000)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def grams(text, width=5):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def corpus():
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(30, 200)) for _ in range(60)]
    base = prose(rng, 150)
    texts += [edited(rng, base, rng.randrange(0, 8)) for _ in range(80)]  # one large near-copy group
    texts += [base] * 5 + [texts[0]] * 3 + ["", "  \n", None, None, "one two", "one two", "one two three"]
    passage = prose(rng, 60)
    texts += [prose(rng, 60) + " " + passage + " " + prose(rng, 60) for _ in range(30)]
    texts += [prose(rng, 20_000)]
    texts += [edited(rng, texts[-1], 100)]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_links(rows):
    sets = [grams(t or "") for _, t, *_ in rows]
    linked = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                linked[i].add(j)
                linked[j].add(i)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        todo = [i]
        while todo:
            for x in linked[todo.pop()]:
                if label[x] > label[i]:
                    label[x] = label[i]
                    todo.append(x)
    return {i: (label[i], len(linked[i])) for i in range(len(rows))}


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute_links(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == want


def test_near_duplicates_in_small_blocks(spark):
    rows = corpus()
    want = brute_links(rows)
    signed, classes = ngram_join.near_classes(spark.createDataFrame(rows, SCHEMA), block=16)
    got = {r.doc_id: (r.group_id, r.links + r.copies - 1) for r in signed.join(classes, "set_key").collect()}
    assert got == {i: v for i, v in want.items() if i in got} and len(got) == sum(bool(grams(t or "")) for _, t, *_ in rows)


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = corpus()
    want = brute_links(rows)
    docs = spark.createDataFrame(rows + [rows[0]], SCHEMA)  # a repeated row
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (c, _) in want.items() if c == i)


def test_join_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.deduplicate(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f g", 1), (None, "a b c d e f g", 2), (None, None, 3), (5, None, 4)], "doc_id long, text string, label long")
    assert sorted((r.doc_id is None, r.n_links) for r in ngram_join.near_duplicates(odd).collect()) == [(False, 0), (True, 0), (True, 1), (True, 1)]
    assert ngram_join.deduplicate(odd).count() == 3


def test_posterior_bounds():
    bounds = ngram_join.least_matches()
    assert list(bounds) == sorted(bounds) and bounds[-1] < 0.8 * ngram_join.HASHES
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** ngram_join.BANDS > 1 - 1e-5


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    sizes = [1, 3, 5, 6, 8, 12, 20, 40, 60, 100, 130, 400]
    items = [(i, prose(rng, n)) for i, n in enumerate(sizes)] + [(50, None), (51, ""), (52, "Upper Case Words Are Equal Too")]
    texts = [prose(rng, n) for n in (0, 3, 30, 200, 4000)] * 3
    for i, item in items[:12]:
        texts.append(prose(rng, 500) + " " + item + " " + prose(rng, 2000))
        texts.append(item)
        words = item.split(" ")
        texts.append(prose(rng, 100) + " " + " ".join(words[: max(1, int(len(words) * 0.9))]))
        texts.append(prose(rng, 10) + " " + " ".join(words[: len(words) // 2]) + " " + prose(rng, 500))
    texts += ["upper case words are equal too", None]
    docs = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contaminated_pairs(docs, benchmark).collect()}
    want = set()
    for d, t in enumerate(texts):
        for k, item in items:
            q, own = grams((item or "").lower()), grams((t or "").lower())
            if q and len(q & own) >= 0.8 * len(q) - 1e-9:
                want.add((d, k, len(q & own)))
    assert got == want
    clean = decontaminate.remove_contaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _, _ in want}
    assert decontaminate.contaminated_pairs(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated_pairs(docs, benchmark.limit(0)).count() == 0


def brute_removed(texts, length):
    starts = defaultdict(list)
    data = [(t or "").encode() for t in texts]
    for i, d in enumerate(data):
        for p in range(len(d) - length + 1):
            starts[d[p : p + length]].append((i, p))
    gone = [np.zeros(len(d), bool) for d in data]
    for places in starts.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = True
    out = []
    for d, g in zip(data, gone, strict=True):
        kept = bytes(b for b, x in zip(d, g, strict=True) if not x)
        runs = int(np.count_nonzero(np.diff(np.concatenate([[False], g]).astype(int)) == 1))
        out.append((len(d), int(g.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeats():
    rng = random.Random(9)
    raw = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = raw(700), raw(90)
    texts = [raw(rng.randrange(0, 900)) for _ in range(20)]
    texts += [raw(rng.randrange(0, 50)) + passage[rng.randrange(0, 200) : rng.randrange(300, 700)] + raw(rng.randrange(0, 50)) for _ in range(40)]
    texts += [raw(30) + other + raw(30) + other for _ in range(3)]
    texts += ["a" * 300, "ab" * 150, "x" * 39, "x" * 40, "", None, passage, passage, raw(10)]
    long_ = raw(3000)
    texts += [long_, long_[:1500] + "Z" + long_[1500:], long_[:1000] + raw(5) + long_[1020:]]
    return texts


def test_repeat_removal_equals_brute_force(spark):
    texts = repeats()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_removed(texts, 40)
    for group in (4096, 3):  # 3: nearly every anchor takes the way for large groups
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_dedup.removal_digest(docs, 40, 20, group).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_repeat_removal_of_odd_tables(spark):
    assert bwt_dedup.removal_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "é" * 500, 7), (1, None, 8), (2, "é" * 500, 9), (2, "é" * 500, 9)], "doc_id long, text string, spans int")
    assert sorted(r.n_removed for r in bwt_dedup.removal_digest(docs).collect()) == [0, 1000, 1000, 1000]
    out = bwt_dedup.deduplicate(docs)
    assert out.columns == docs.columns and sorted((r.text or "-") for r in out.collect()) == ["-", "-", "-", "-"]


def test_many_copies_dealt_to_several_tasks(spark, monkeypatch):
    rng = random.Random(21)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, hot = prose(500), prose(900)
    rows = [(i, hot) for i in range(40)] + [(100 + i, prose(200) + shared + prose(100)) for i in range(3)] + [(200, prose(700)), (None, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, bwt_dedup.removal_digest(docs).collect()), key=str)
    monkeypatch.setattr(bwt_dedup, "COPIES", 4)
    assert sorted(map(tuple, bwt_dedup.removal_digest(docs).collect()), key=str) == whole
    removed = {r[0]: (r[2], r[3]) for r in whole}
    assert len(whole) == len(rows) and removed[0] == (900, 1) and removed[200] == (0, 0) and removed[None] == (0, 0)
    assert all(500 <= removed[100 + i][0] <= 510 and removed[100 + i][1] == 1 for i in range(3))


def test_shared_passages_of_over_fifty_words_are_reported(spark):
    """Passages of 52 to 60 short words, under 400 bytes, in two to five documents; one word less in others."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 7)))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], set()
    for k in range(40):
        passage = words(52 + k % 9)
        assert len(passage) < 400
        for _ in range(2 + k % 4):
            planted.add(len(rows))
            rows.append((len(rows), words(rng.randrange(60, 200)) + " " + passage + " " + words(rng.randrange(60, 200))))
    clean = set(range(len(rows), len(rows) + 60))
    rows += [(i, words(300)) for i in sorted(clean)]
    short = set(range(len(rows), len(rows) + 30))
    for i in sorted(short):
        if i % 2 == 0 or i == min(short):
            passage = words(47)
        rows.append((i, words(150) + " " + passage + " " + words(150)))
    got = {r.doc_id: r for r in bwt_dedup.removal_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {i for i, r in got.items() if r.repeats_passage}
    assert not found & clean and not found & short and len(found & planted) >= 0.7 * len(planted)
    assert all(51 <= got[i].passage_words <= 62 and not got[i].repeats and got[i].n_removed == 0 for i in found)


def test_repeats_across_the_cuts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "CHUNK", 101)
    texts = repeats()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_dedup.removal_digest(docs, 40, 20).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, 40)


def brute_passage_words(texts: list[str | None], passage: int) -> list[int]:
    """Words in strings of passage + 1 whole words that another text has too."""
    data = [(t or "").encode() for t in texts]
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    strings = [[d[w[k][0] : w[k + passage][1]] for k in range(len(w) - passage)] for d, w in zip(data, words, strict=True)]
    where: dict[bytes, set[int]] = {}
    for i, row in enumerate(strings):
        for x in row:
            where.setdefault(x, set()).add(i)
    return [len({k + j for k, x in enumerate(row) if len(where[x]) > 1 for j in range(passage + 1)}) for row in strings]


def passages():
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 3, 5, 9, 30])))
    words = lambda n: "".join(word() + rng.choice([" ", " ", "\n", "\t "]) for _ in range(n))
    shared = [words(rng.randrange(4, 40)) for _ in range(12)]
    texts = [words(rng.randrange(0, 30)) + rng.choice(shared) + words(rng.randrange(0, 30)) for _ in range(60)]
    texts += [words(rng.randrange(0, 30)) + rng.choice(shared).strip() + rng.choice(["", "\x01", "x", "\n"]) for _ in range(20)]
    texts += [rng.choice(["", "x", "\x01", " "]) + rng.choice(shared) + words(5) for _ in range(20)]
    own = [words(30) for _ in range(6)]
    texts += [words(9) + x + words(9) + x + words(3) for x in own[:4]] + [own[4], own[4], "a b c d", "a b c d", "a b c d e", "a b c d e", "", None]
    texts += ["z " * 40, "a " * 70, "b " * 70 + "c", "b " * 50, "é" * 300 + " " + shared[0], shared[0] + "é" * 300]
    return texts


@pytest.mark.parametrize(("group", "long"), [(4096, 4096), (3, 4096), (4096, 130)])
def test_shared_passages_equal_brute_force(spark, group, long):
    """Byte windows that hold whole word windows, and those that hold none; passages at both ends and
    beside other words; strings that only their own document repeats; copies. Small anchors and large ones."""
    texts = passages()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length, passage in ((60, 4), (40, 9)):
        got = {r.doc_id: r for r in bwt_dedup.removal_digest(docs, length, length // 2, group, passage, long).collect()}
        got = [got[i] for i in range(len(texts))]
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_removed(texts, length)
        want = brute_passage_words(texts, passage)
        assert [r.passage_words for r in got] == want and [r.repeats_passage for r in got] == [w > 0 for w in want]
        assert 20 < sum(w > 0 for w in want) < len(texts)


def test_every_shared_passage_and_none_of_one_document_is_reported(spark):
    """Passages of 51 to 59 words in other words and unchanged copies; passages that one document repeats."""
    rng = random.Random(43)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    texts = []
    for k in range(60):
        passage = words(51 + k % 9)
        texts += [" ".join([words(rng.randrange(1, 120)), passage, words(rng.randrange(1, 120))]) for _ in range(2)]
    alone = [words(90) for _ in range(20)]
    texts += [" ".join([words(30), x, words(30), x, words(30)]) for x in alone] + [words(300)] * 2 + [words(52)] * 2 + [words(50)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bwt_dedup.removal_digest(docs).collect()}
    assert [got[i].passage_words for i in range(len(texts))] == [51 + k // 2 % 9 for k in range(120)] + [0] * 20 + [300, 300, 52, 52, 0, 0]
    assert all(got[i].n_removed > 0 for i in range(120, 142))


def test_segments_do_not_depend_on_the_pieces(monkeypatch):
    texts = [(t or "").encode() for t in [*repeats(), *passages()]]
    together = bwt_dedup.segments(texts, 60, 30, 5)
    monkeypatch.setattr(bwt_dedup, "CHUNK", 101)
    for i, text in enumerate(texts):
        one = bwt_dedup.segments([text], 60, 30, 5)
        assert all(np.array_equal(a, b[together[0] == i]) for a, b in zip(one[1:], together[1:], strict=True))


def test_near_duplicates_of_a_chain_in_small_blocks(spark):
    """Neighbours of a long chain of revisions are linked, and each class goes to few blocks."""
    rng = random.Random(17)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(words[i : i + 100]), "x") for i in range(0, 300, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    want = brute_links([(i, t) for i, (_, t, _) in enumerate(rows)])
    signed, classes = ngram_join.near_classes(docs, block=4)
    got = {r.doc_id // 3: (r.group_id // 3, r.links + r.copies - 1) for r in signed.join(classes, "set_key").collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    n, rng = 4000, random.Random(9)
    ids = rng.sample(range(10 * n), n)
    edges = [*zip(ids, ids[1:]), (-5, -5), (-7, -6), (-6, -7)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(ids, min(ids)) | {-5: -5, -6: -7, -7: -7}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
