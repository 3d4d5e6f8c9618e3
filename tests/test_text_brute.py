"""Name scores and HTML lists, which no SQL expresses, against plain Python over whole small tables."""

import random
import re
from difflib import SequenceMatcher
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tideglass.functions import text
from tideglass.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def words(name):
    flat = re.sub(r"[^\w\s]", " ", re.sub(r"[/_]+", " ", name.lower()))
    return [w for w in flat.split() if w not in text.STOPWORDS]


def similarity(a, b):
    x, y = words(a), words(b)
    if not x or not y or not set(x) & set(y):
        return 0.0 if not (x and y) else None
    return (len(set(x) & set(y)) / len(set(x) | set(y)) + SequenceMatcher(None, " ".join(x), " ".join(y)).ratio()) / 2


def test_name_scores(spark):
    parts = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect()}
    rows = catalog.x02_name_scores(spark, FOLDER).collect()
    assert len(rows) == len(parts) - 1
    for r in rows:
        a, b = parts[r.p_partkey], parts[r.p_partkey + 1]
        want = similarity(a, b)
        if want is not None and {w for w in words(a) if w.isdigit()} == {w for w in words(b) if w.isdigit()}:
            assert abs(r.score - want) < 1e-9, (a, b)
        team = lambda n: " ".join(re.sub(r"[^\w\s]", " ", n.lower()).split())
        assert r.same == (SequenceMatcher(None, team(a), team(b)).ratio() >= text.SAME_TEAM)


class Lists(HTMLParser):
    """Items of lists with their depth, one line each."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.depth, self.lines, self.open, self.items = 0, [], None, 0

    def _end(self):
        if self.open is not None and "".join(self.open).split():
            self.lines.append("*" * max(self.depth, 1) + " ".join("".join(self.open).split()))
        self.open = None

    def handle_starttag(self, tag, attrs):
        if tag in ("ul", "ol"):
            self._end()
            self.depth += 1
        elif tag == "li":
            self._end()
            self.open, self.items = [], self.items + 1
        elif self.open is not None:
            self.open.append(" ")

    def handle_endtag(self, tag):
        if tag in ("ul", "ol", "li"):
            self._end()
            self.depth -= tag != "li" and self.depth > 0
        elif self.open is not None:
            self.open.append(" ")

    def handle_data(self, data):
        if self.open is not None:
            self.open.append(data)


def test_bullets_of_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.n for r in catalog.x17_bullets(spark, FOLDER).collect()}
    same = lists = 0
    for p in pages:
        parser = Lists()
        parser.feed(p.html or "")
        parser.close()
        if parser.items:
            lists += 1
            same += got[p.page_id] == len("\n".join(parser.lines))
        elif p.html is not None:
            assert got[p.page_id] == len(p.html)
    assert same >= 0.95 * lists, (same, lists)


def test_ratio_bound_is_the_matchers_own(spark):
    rng = random.Random(6)
    names = ["", "a", "team spirit", "spirit team"] + ["".join(rng.choice("abcde é") for _ in range(rng.randrange(14))) for _ in range(40)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(400)] + [(None, "a"), ("a", None), ("", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.ratio_bound(F.col("a"), F.col("b")).alias("bound"), text.same_team(F.col("a"), F.col("b")).alias("same")).collect()
    for r in rows:
        if r.a is None or r.b is None:
            assert r.bound is None and r.same is None
            continue
        m = SequenceMatcher(None, r.a, r.b)
        assert abs(r.bound - m.quick_ratio()) < 1e-12 and r.bound >= m.ratio()
        if r.a and r.b:
            assert r.same == (m.ratio() >= text.SAME_TEAM)
            assert text._is_near(r.a, r.b) == r.same
