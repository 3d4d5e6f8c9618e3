"""Vector codes, the Merkle manifest and language identification against plain Python, and the SQL of this subpackage."""

import hashlib
import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tideglass.llm import language_id, merkle, vector_codes
from tideglass.llm.oracle import ORACLE
from tideglass.llm.queries import QUERIES

sys.path.append(str(Path(__file__).resolve().parents[1]))
from compare import both, duck  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_match_sql(spark, con, name):
    columns, names, got, want = both(spark, con, QUERIES[name], ORACLE[name], FOLDER)
    assert columns == names and got == want


# --- vector codes


def brute_codes(rows, entries=64, rounds=2, parts=16):
    """(codes and errors by row, codebooks) with full scans in Python integers."""
    kept = [(i, v, label) for i, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v) and len(v) % parts == 0]
    cut = [[tuple(math.floor(c * 256) for c in v[p * len(v) // parts : (p + 1) * len(v) // parts]) for p in range(parts)] for _, v, _ in kept]
    order = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], cut[k]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        codes = [[nearest(x[p], books[p])[1] for p in range(parts)] for x in cut]
        for p in range(parts):
            for j in range(len(order)):
                own = [x[p] for x, c in zip(cut, codes) if c[p] == j]
                if own:
                    books[p][j] = tuple(sum(c) // len(own) for c in zip(*own))
    last = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    return [(k[0], "".join(f"{j:02x}" for _, j in c), sum(d for d, _ in c), k[2]) for k, c in zip(kept, last)], books


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string"


def vector_rows(n, dim, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    out = [(int(i), [float(np.float32(c)) for c in centres[rng.integers(7)] + spread * rng.normal(size=dim)], int(rng.integers(3)) if i % 5 else None) for i in rng.permutation(n)]
    return out + out[:9] + [(None, out[-1][1], 1), (n + 1, None, 1), (n + 2, [1.0, None] * (dim // 2), 1), (n + 3, [float("nan")] * dim, 2), (n + 4, [], None), (-5, [float("inf")] * dim, 2)]


@pytest.mark.parametrize("n,dim", [(300, 32), (40, 16), (1, 48)])
def test_vector_codes_equal_full_scans(spark, n, dim):
    rows = vector_rows(n, dim, n)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS).repartition(3)
    got = vector_codes.code_report(df).collect()
    want, books = brute_codes(rows)
    by_label = {}
    for _, _, e, label in want:
        by_label[label] = by_label.get(label, 0) + e
    key = lambda r: repr(r)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=key) == sorted(((i, c, e, by_label[label]) for i, c, e, label in want), key=key)
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_bounds_save_scans_and_change_nothing(spark):
    rows = [(i, v, label) for i, v, label in vector_rows(900, 32, 5, 0.01) if v and i is not None]
    df = spark.createDataFrame([(*r, None, None) for r in rows], VECTORS)
    few = vector_codes.encode(df, entries=8, rounds=6)
    used = few.rows.agg(F.sum("scans"), F.count(F.lit(1))).first()
    assert used[0] < 0.5 * 7 * 16 * used[1]
    want, books = brute_codes(rows, 8, 6)
    assert few.codebooks.tolist() == [[list(e) for e in book] for book in books]
    assert sorted((r.vec_id, bytes(r.code).hex(), r.error) for r in few.rows.collect()) == sorted(w[:3] for w in want)


def test_ties_bounds_and_huge_components():
    rng = np.random.default_rng(1)
    x, old = rng.integers(-4, 5, (400, 16, 2)), rng.integers(-4, 5, (16, 20, 2))  # many ties and equal entries
    state = vector_codes.assign(x, old, None, None)
    for _ in range(4):
        new = old + rng.integers(-1, 2, old.shape)
        state = vector_codes.assign(x, new, state[:3], vector_codes.moves(old, new))
        full = ((x[:, :, None] - new[None]) ** 2).sum(-1).argmin(2)
        assert (state[0] == full).all()
        old = new
    bound = vector_codes.component_bound(64)
    assert 64 * (2 * bound) ** 2 <= 1 << 62 and bound >= 1 << 26


def test_vector_codes_of_tables_without_usable_rows_and_with_huge_components(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.code_report(empty).collect() == []
    assert vector_codes.code_report(spark.createDataFrame([(1, None, 1, "", ""), (2, [1.0] * 15, 1, "", "")], VECTORS)).collect() == []
    huge = spark.createDataFrame([(1, [3e38] * 16, 1, "", ""), (2, [-3e38] * 16, 1, "", ""), (None, [0.0] * 16, None, "", "")], VECTORS)
    got = {r.vec_id: r for r in vector_codes.code_report(huge).collect()}
    assert got[1].code == "00" * 16 and got[2].code == "01" * 16 and got[1].label_error == got[1].error + got[2].error > 0 and got[None].label_error == got[None].error > 0
    only_null = spark.createDataFrame([(None, [2.0] * 16, 1, "", ""), (None, [1.0] * 16, 1, "", "")], VECTORS)
    assert {r.code for r in vector_codes.code_report(only_null).collect()} == {"00" * 16}


# --- Merkle manifest

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, n long, tree string"


def tree_of(leaves):
    """(root, paths): each path lists (siblings left, siblings right) upwards."""
    paths, nodes, owners = [[] for _ in leaves], list(leaves), [[k] for k in range(len(leaves))]
    while len(nodes) > 1:
        runs = [(nodes[k : k + 3], owners[k : k + 3]) for k in range(0, len(nodes), 3)]
        for hs, own in runs:
            for place, members in enumerate(own):
                for k in members:
                    paths[k].append((hs[:place], hs[place + 1 :]))
        nodes, owners = [H(*hs) for hs, _ in runs], [sum(own, []) for _, own in runs]
    return nodes[0], paths


def brute_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(part, (r[0], r[3], r[2], r[4], text)))
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree_of([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order]
    root, tops = tree_of([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(order, trees, tops):
        for (_, _, h, r), path in zip(sorted(sources[s], key=lambda x: x[:3]), paths):
            told = r[1]
            if told is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                told = told.replace("\n", "")
            node = leaf(r, told)
            for left, right in path + top:
                node = H(*left, node, *right)
            out.append((r[0], h, subroot, root, H(*[x for left, right in path + top for x in left + right]), node, node == root))
    return sorted(out, key=repr)


def manifest_of(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], DOCS).repartition(parts)
    return sorted((tuple(r) for r in merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_equals_plain_trees(spark):
    rng = random.Random(4)
    source = lambda: rng.choice(["hot"] * 9 + [None, "", "é", "z", "a"])
    rows = []
    for i in range(-20, 1500):
        text = rng.choice(["one\nline\n", "plain", "", None, "ü\n"])
        rows.append((i, text, rng.choice(["en", None]), source(), rng.choice([3, None])))
    rows += rows[:7] + [(None, "x\ny", "en", "hot", 1), (None, None, None, None, None), (5, "single\n", "en", "alone", 2)] + [(900, "tie\n" * k, "en", "hot", k) for k in range(4)]
    assert sum(r[3] == "hot" for r in rows) > merkle.BUCKET
    got = manifest_of(spark, rows)
    assert got == brute_manifest(rows)
    assert 0 < sum(r[6] for r in got) < len(got)


def test_manifest_with_small_blocks_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 5)
    rows = [(i, f"t{i}\n", "en", f"s{i % 800}", i) for i in range(1700)]  # the tree of sources has more than one round
    assert manifest_of(spark, rows) == brute_manifest(rows)


def test_manifest_of_few_rows(spark):
    assert manifest_of(spark, []) == []
    for n in (1, 2, 3, 4):
        rows = [(i, "long text \n" * 30_000, "en", None, 1) for i in range(n)]
        assert manifest_of(spark, rows) == brute_manifest(rows)


# --- language identification


def all_segmentations(data, logs, ids):
    if not data:
        return 1.0
    return sum(math.exp(logs[ids[data[:k]]]) * all_segmentations(data[k:], logs, ids) for k in range(1, len(data) + 1) if data[:k] in ids)


@pytest.fixture(scope="module")
def pieces():
    import base64

    lines = open(public_tokenizers.path(language_id.VOCABULARY), "rb").read().splitlines()
    return language_id.Pieces(lines), {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def test_forward_sums_all_segmentations(pieces):
    found, ids = pieces
    rng = np.random.default_rng(0)
    logs = np.append(np.log(rng.dirichlet(np.full(found.size, 0.5)) + 1e-9), -np.inf)
    batch = ["a", "the", "other", "über", "naïve", "日本", "queueing", "zzz"]
    for place, lattice in found.lattices(batch):
        got, share = language_id.forward(lattice, logs[:, None])[:, 0], language_id.expected(lattice, logs)
        for row, at in enumerate(place):
            data = b" " + batch[at].encode()
            assert math.isclose(got[row], math.log(all_segmentations(data, logs, ids)), rel_tol=1e-9)
            assert math.isclose(sum(share[row, i, k] * (k + 1) for i in range(len(data)) for k in range(share.shape[2])), len(data), rel_tol=1e-9)  # every byte is in one piece


def test_logarithms_and_probabilities_agree(pieces, monkeypatch):
    found, _ = pieces
    logs = np.append(np.full(found.size, -11.0), -np.inf)
    lattices = list(found.lattices(["straightforward", "unglaublich", "x" * 64, "ключ"]))
    plain = [(language_id.forward(i, logs[:, None]), language_id.expected(i, logs)) for _, i in lattices]
    monkeypatch.setattr(language_id, "_LEAST_LOG", 1.0)
    for (_, i), (a, b) in zip(lattices, plain):
        assert np.allclose(a, language_id.forward(i, logs[:, None])) and np.allclose(b, language_id.expected(i, logs))


def test_words():
    assert language_id.words("Über-cool ½ x2y Ⅷ _a_ 日本\U00010400 " + "Q" * 70) == ["über", "cool", "x", "y", "a", "日本\U00010428", "q" * 64, "q" * 6]
    assert language_id.words("12 %½²") == []


LANG = "doc_id long, text string, lang string, best string, total double"


def test_languages_of_odd_tables(spark, monkeypatch):
    vocabulary = public_tokenizers.path(language_id.VOCABULARY)
    rng = random.Random(3)
    stems = {"aa": ["foo", "bar", "bazzle"], "bb": ["ich", "und", "nicht"], "cc": ["qui", "lesse", "que"], "": ["zig", "zag", "zug"]}
    rows = [(i, " ".join(rng.choices(stems[lang], k=1 + i % 40)), lang) for i, lang in enumerate(list(stems) * 60)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 %½", "bb"), (None, "foo bar", "aa"), (1003, "ich nicht " * 40_000, None), (1004, "foo", None)] + rows[:5]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], LANG).repartition(3)
    got = sorted((tuple(r) for r in language_id.predict_languages(df, vocabulary).collect()), key=repr)
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    assert all(by_id[i][2:] == ("und", 0.0) for i in (1000, 1001, 1002)) and by_id[1003][2] == "bb" and by_id[1004][2] == "aa" and by_id[None][1:3] == (False, "aa")
    assert all(r[1] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in got)
    right = [by_id[i][2] == lang for i, _, lang in rows if lang is not None and i is not None and i < 1000]
    assert sum(right) == len(right) and all(0 <= r[3] <= 1 for r in got)
    monkeypatch.setattr(language_id, "BLOCK", 2)  # languages in several passes
    monkeypatch.setattr(language_id, "KEPT_WORDS", 3)
    again = sorted((tuple(r) for r in language_id.predict_languages(df, vocabulary).collect()), key=repr)
    assert [r[:3] for r in again] == [r[:3] for r in got] and np.allclose([r[3] for r in again], [r[3] for r in got])
    assert language_id.predict_languages(df.limit(0), vocabulary).collect() == []
    unlearned = language_id.predict_languages(df.withColumn("lang", F.lit(None).cast("string")), vocabulary).collect()
    assert len(unlearned) == len(rows) and {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)}


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op13_language_id"](spark, FOLDER).where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert found[0] > 0.95
