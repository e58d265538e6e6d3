"""News clusters against the greedy rule, pair by pair."""

import datetime as dt
import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import news

D = dt.date(2024, 3, 1)


def normal(title):
    out = unicodedata.normalize("NFKC", title).lower()
    for _ in range(3):
        out = re.sub(r"^\s*(\[[^\]]{1,24}\]|\([^)]{1,24}\))", "", out)
    return " ".join(re.findall("[0-9a-z가-힣]+", re.sub("[\"'`“”‘’]", "", out)))


def like(a, b):
    if not a or not b:
        return 0
    one, two = a.replace(" ", ""), b.replace(" ", "")
    if a == b:
        return 1
    if one == two:
        return 0.98
    if min(len(one), len(two)) >= 12 and (one in two or two in one):
        return 0.9
    x, y = ({w for w in s.split() if len(w) > 1} for s in (a, b))
    n = len(x & y)
    return max(n / len(x | y), n / min(len(x), len(y)) * 0.9) if min(len(x), len(y)) > 1 and n > 1 else 0


def clusters(rows, days):
    out = []
    for k in {r[0] for r in rows}:
        opened = []
        for _, t, title, source in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1].toordinal(), r[2], r[3])):
            hit = next((c for c in opened if abs((c[1] - t).days) <= days and like(normal(c[2]), normal(title)) >= 0.72), None)
            if hit is None:
                opened.append([k, t, title, 1, {source}])
            else:
                hit[3], hit[4] = min(100, hit[3] + 1), hit[4] | {source}
        out += opened
    return sorted((k, t, title, n, tuple(sorted(s))) for k, t, title, n, s in out)


@pytest.mark.parametrize("days", [0, 2])
def test_clusters_equal_the_greedy_rule(spark, days):
    r = random.Random(days)
    words = "steel mill profit rises falls quarter record orders port strike fund bank rate cut a".split()
    rows = []
    for _ in range(260):
        title = " ".join(r.choice(words) for _ in range(r.randint(1, 7)))
        if r.random() < 0.3 and rows:
            title = r.choice(rows)[2] + r.choice(["", " today", "!", " a"])
        if r.random() < 0.2:
            title = title.replace(" ", "", r.randint(1, 3))
        rows.append((r.randint(1, 3), D + dt.timedelta(days=r.randint(0, 30)), r.choice(["", "[News] ", "(1) [x] "]) + title, r.choice("abc")))
    rows += [(9, D, "same headline again", f"s{i % 3}") for i in range(150)]
    df = spark.createDataFrame(rows, "k int, t date, title string, source string").repartition(3)
    got = sorted((x.k, x.t, x.title, x.size, tuple(sorted(x.sources))) for x in news.cluster_news(df, days).collect())
    assert got == clusters(rows, days) and len(got) < len(rows) - 150


def test_normalised_headlines(spark):
    cases = ["[속보] (종합) “삼성” ＡＢＣ １２３!", "[a] [b] [c] [d] x", "(" + "x" * 30 + ") y", "  ", None, "it's A-b"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "x string").select(text.normalize_headline(F.col("x"))).collect()]
    assert got == ["삼성 abc 123", "d x", "x" * 30 + " y", "", None, "its a b"]


def test_many_similar_headlines_of_a_day(spark):
    """Each is like all others: pairs would be 18 million."""
    rows = spark.range(6000).select(F.lit("x").alias("k"), F.date_add(F.lit(D), (F.col("id") % 2).cast("int")).alias("t"), F.concat(F.lit("steel order worth about "), F.col("id") + 10).alias("title"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    began = time.monotonic()
    got = [(r.t, r.title, r.size, sorted(r.sources)) for r in news.cluster_news(rows, 2).collect()]
    assert got == [(D + dt.timedelta(days=1), "steel order worth about 1001", 100, ["s0", "s1", "s2"])]
    assert time.monotonic() - began < 60


def test_headlines_without_a_word_stay_alone(spark):
    rows = [(1, D, "[News] !", "a"), (1, D, "[News] !", "b"), (1, D, "?", "a"), (1, D - dt.timedelta(days=1), "?", "a"), (1, D, "steel rises today", "a"), (1, D, "Steel rises today!", "b")]
    got = sorted((x.k, x.t, x.title, x.size, tuple(sorted(x.sources))) for x in news.cluster_news(spark.createDataFrame(rows, "k int, t date, title string, source string"), 2).collect())
    assert got == clusters(rows, 2) and len(got) == 5


def test_likeness_of_the_walk_equals_that_of_columns(spark):
    r = random.Random(3)
    words = "steel mill up a 포스코 order 12 today orders".split()
    pairs = [tuple(r.choice(["", " "]).join(r.choice(words) for _ in range(r.randint(0, 6))) for _ in range(2)) for _ in range(400)]
    a, b = F.col("a"), F.col("b")
    found = spark.createDataFrame(pairs, "a string, b string").select(a, b, text.likeness(a, b, text.headline_words(a), text.headline_words(b)).alias("x")).collect()
    assert all(news.likeness(news.Headline(x.a), news.Headline(x.b)) == x.x for x in found) and len({x.x for x in found}) > 4


@pytest.mark.parametrize("days", [0, 3])
def test_clusters_that_close_and_open_again(spark, days):
    r = random.Random(10 + days)
    words = "steel mill profit rises falls quarter record".split()
    rows = [(r.randint(1, 2), D + dt.timedelta(days=r.choice([0, 1, 2, 3, 4, 5, 9, 10, 14])), " ".join(r.choice(words) for _ in range(r.randint(1, 4))), r.choice("ab")) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, t date, title string, source string").repartition(5)
    got = sorted((x.k, x.t, x.title, x.size, tuple(sorted(x.sources))) for x in news.cluster_news(df, days).collect())
    assert got == clusters(rows, days)
