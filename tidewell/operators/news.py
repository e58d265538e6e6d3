"""Clusters of news: headlines of one key, a few days apart, that say the same.

The clusters are greedy by definition: a headline joins the first one before it (later dates first, then by title) that opened a cluster and is similar. So a
headline is compared only with those that opened a cluster in the days before it, not with all similar headlines, whose pairs grow with the square of a day's.
Of these it meets the ones with which it shares what similar headlines must share: of the smaller set of words one of its rarest (as many as may be missing, and
one more), or one run of twelve letters of a headline that lies in another. A key's run of dates without a larger gap is walked in order, and only the clusters
opened in the last days are held.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_headline

# Similarity of one event, letters of a contained headline, and how large clusters and their lists of sources are told.
LEAST, LETTERS, MOST_SIZE, MOST_SOURCES = 0.72, 12, 100, 8


def _headlines(df: DataFrame, days: int) -> DataFrame:
    """Equal headlines of a key and day as one, with the run of dates that they belong to. Headlines without a word are like no other and stay alone (``alone``)."""
    rows = df.select("k", "t", F.trim("title").alias("title"), "source").filter("k IS NOT NULL AND t IS NOT NULL AND title <> ''").withColumn("normal", normalize_headline(F.col("title")))
    rows = rows.withColumn("alone", F.when(F.col("normal") == "", F.monotonically_increasing_id()))
    one = rows.groupBy("k", "t", "normal", "alone").agg(F.min("title").alias("title"), F.count("*").alias("size"), F.array_sort(F.collect_set("source")).alias("sources"))
    w = Window.partitionBy("k").orderBy(F.desc("t"))
    gap = F.coalesce((F.datediff(F.lag("t").over(w), "t") > days).cast("int"), F.lit(0))
    return one.withColumn("gap", gap).withColumn("run", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("gap", "alone")


class Headline:
    """A normalised headline as it is compared: its letters, words and runs of letters."""

    def __init__(self, normal: str):
        self.normal, self.letters = normal, normal.replace(" ", "")
        self.words = dict.fromkeys(w for w in normal.split(" ") if len(w) >= 2)
        self.grams = dict.fromkeys(self.letters[i : i + LETTERS] for i in range(len(self.letters) - LETTERS + 1))


def likeness(a: Headline, b: Headline) -> float:
    """``functions.text.likeness`` of two headlines."""
    if not a.normal or not b.normal:
        return 0.0
    if a.letters == b.letters:
        return 1.0 if a.normal == b.normal else 0.98
    if a.grams and b.grams and (a.letters in b.letters or b.letters in a.letters):
        return 0.9
    fewer, shared = min(len(a.words), len(b.words)), len(a.words.keys() & b.words.keys())
    return max(shared / (len(a.words) + len(b.words) - shared), shared / fewer * 0.9) if fewer >= 2 and shared >= 2 else 0.0


class Opened:
    """The clusters that one key's headlines opened in the last days, numbered in order, found by what a similar headline must share with their own."""

    def __init__(self):
        self.first, self.clusters = 0, deque()  # of each: its headline, what it is found by, the headlines known to belong to it, its row
        self.known: dict[str, int] = {}
        self.letters, self.words, self.rare, self.grams, self.gram = ({} for _ in range(5))

    def _rare(self, x: Headline) -> list[str]:
        """As many words as may be missing from the larger set, and one more, that the fewest open clusters have."""
        least = max(2, math.ceil(len(x.words) * LEAST - 1e-9))
        return sorted(x.words, key=lambda w: (len(self.words.get(w, ())), -len(w)))[: max(0, len(x.words) - least + 1)]

    def _gram(self, x: Headline) -> list[str]:
        """The run of letters that the fewest open clusters have."""
        return [min(x.grams, key=lambda g: len(self.grams.get(g, ())))] if x.grams else []

    def _similar(self, x: Headline) -> int | None:
        found = set(self.letters.get(x.letters, ()))
        for by, keys in ((self.words, self._rare(x)), (self.rare, x.words), (self.grams, self._gram(x)), (self.gram, x.grams)):
            for key in keys:
                found.update(by.get(key, ()))
        return next((n for n in sorted(found) if likeness(self.clusters[n - self.first][0], x) >= LEAST), None)

    def similar(self, normal: str) -> list | None:
        """The row of the first open cluster that a headline belongs to. New clusters come last, so it stays the first until it is closed."""
        n = self.known.get(normal)
        if n is None and normal:
            n = self._similar(Headline(normal))
            if n is not None:
                self.known[normal] = n
                self.clusters[n - self.first][2].append(normal)
        return None if n is None else self.clusters[n - self.first][3]

    def open(self, normal: str, row: list) -> None:
        """A cluster of its own; without a word none finds it."""
        x, n, places = Headline(normal), self.first + len(self.clusters), []
        if normal:
            places = [(self.letters, [x.letters]), (self.rare, self._rare(x)), (self.gram, self._gram(x)), (self.words, x.words), (self.grams, x.grams)]
            self.known[normal] = n
        for by, keys in places:
            for key in keys:
                by.setdefault(key, deque()).append(n)
        self.clusters.append((x, places, [normal] if normal else [], row))

    def closed(self, t=None, days: int = 0) -> Iterator[list]:
        """The rows of clusters that were opened more than some days before, all without a date; they are first wherever they are found."""
        while self.clusters and (t is None or (self.clusters[0][3][1] - t).days > days):
            _, places, members, row = self.clusters.popleft()
            self.first += 1
            for normal in members:
                del self.known[normal]
            for by, keys in places:
                for key in keys:
                    by[key].popleft()
                    if not by[key]:
                        del by[key]
            yield row


def cluster_news(df: DataFrame, days: int = 2) -> DataFrame:
    """(k, t, title, size, sources): one row a cluster, that of the headline that opened it. df: k, t, title, source."""
    kind = dict(df.dtypes)["k"]
    names = ["k", "t", "title", "size", "sources"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, day, opened = None, None, Opened()
        for batch in batches:
            done = []
            for k, t, title, size, sources, normal in zip(*(batch[c] for c in [*names, "normal"]), strict=True):
                if k != last and (k == k or last == last):  # NaN is one key
                    done += opened.closed()
                if t != day:
                    done += opened.closed(t, days)
                last, day = k, t
                row = opened.similar(normal)
                if row is None:
                    opened.open(normal, [k, t, title, min(size, MOST_SIZE), list(sources)[:MOST_SOURCES]])
                else:
                    row[3] = min(row[3] + size, MOST_SIZE)
                    row[4] = list(dict.fromkeys([*row[4], *sources]))[:MOST_SOURCES]
            yield pd.DataFrame(done, columns=names)
        yield pd.DataFrame(list(opened.closed()), columns=names)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, as the rows are few bytes and long work
    rows = _headlines(df, days).repartition(tasks, "k", "run").sortWithinPartitions("k", F.desc("t"), "title")
    return rows.select(*names, "normal").mapInPandas(walk, f"k {kind}, t date, title string, size int, sources array<string>")
