import random
import re

from tideglass.llm import licenses as L

FILLER = [f"v{i}" for i in range(500)]


def prose(rng, n):
    return " ".join(rng.choice(FILLER) for _ in range(n))


def words_of(text):
    found = (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower()))
    return [w for w in found if w]


def grams_of(text):
    words = words_of(text)
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(texts, templates=None):
    out = set()
    for d, text in enumerate(texts):
        own = grams_of(text or "")
        for name, notice in (templates or L.TEMPLATES).items():
            grams = grams_of(notice)
            shared = len(own & grams)
            if grams and shared >= 0.8 * len(grams) - 1e-9:
                out.add((d, name, shared))
    return out


def test_notices_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (0, 3, 5, 40, 3000)] + [None, ""]
    for notice in L.TEMPLATES.values():
        for lead in (0, 1, 2, 3, 7, 50, 701):
            texts.append(prose(rng, lead) + " " + notice + " " + prose(rng, rng.randrange(100)))
        texts.append(prose(rng, 20) + "\n" + notice.upper() + "\n" + prose(rng, 20))
        words = notice.split(" ")
        texts.append(prose(rng, 9) + " " + " ".join(words[: len(words) // 2]) + " " + prose(rng, 9))
        texts.append(prose(rng, 9) + " " + " ".join(words[1:]) + " " + prose(rng, 9))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license, r.n_shared) for r in L.license_notices(docs).collect()}
    assert got == brute(texts)
    assert L.license_notices(docs.limit(0)).count() == 0


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License.")], "doc_id long, text string")
    found = L.license_notices(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sorted(str(r.doc_id) for r in found.collect()) == ["1", "1", "None"]


def test_templates_of_hundreds_of_words(spark):
    rng = random.Random(8)
    templates = {f"t{n}": prose(rng, n) for n in (4, 5, 30, 104, 150, 300, 700)}
    templates["twin"] = templates["t150"]  # a tie
    texts = [prose(rng, n) for n in (0, 50, 2000)]
    for text in templates.values():
        words = text.split(" ")
        for lead in (0, 3, 11, 500):
            texts.append(prose(rng, lead) + " " + text + " " + prose(rng, rng.randrange(60)))
        texts += [" ".join(words[: int(len(words) * 0.9)]), prose(rng, 7) + " " + " ".join(words[: len(words) // 2]), " ".join(words[:10] + ["changed"] + words[10:])]
    texts.append(prose(rng, 30_000) + " " + templates["t104"] + " " + prose(rng, 30_000))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    table = spark.createDataFrame([*templates.items(), (None, "no name has this one here"), ("no text", None)], "license string, text string")
    got = {(r.doc_id, r.license, r.n_shared) for r in L.license_notices(docs, table).collect()}
    assert got == brute(texts, templates)
    assert L.license_notices(docs, table.limit(0)).count() == 0


def test_templates_beyond_one_plan_are_scanned_for_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    templates = {f"t{n}": prose(rng, n) for n in (6, 7, 9, 12, 40)}
    texts = [prose(rng, 20) + " " + t + " " + prose(rng, 20) for t in templates.values()] + [" ".join(templates.values())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(templates.items()), "license string, text string")
    monkeypatch.setattr(L, "MAX_TEMPLATE_WORDS", 20)  # four blocks, one of a template that is longer
    assert len(list(L._template_blocks(table))) == 4
    assert {(r.doc_id, r.license, r.n_shared) for r in L.license_notices(docs, table).collect()} == brute(texts, templates)
