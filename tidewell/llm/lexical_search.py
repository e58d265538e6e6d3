"""Ranked lexical search: the best documents of all for each of a set of query items, by the Best Position Algorithm.

One pass over the documents keeps, of each, its length and how often it holds the items' terms. Counts over all documents give the
terms' weights. Then every task searches its own documents, block by block. A block has an impact list for each term: its
documents by falling share of a score. For an item, the lists of its terms are read from the top, a few positions at a time. A
document that comes up for the first time is scored at once by direct accesses to the other lists, and these accesses mark their
positions as seen too. The best position of a list is the end of what is seen without a gap; no document that is still unseen can have more than the sum of
the impacts there. Reading stops once the kth score is strictly above that sum, so that ties are all found. A task's kth score goes on from block to block.
The best of the tasks are merged by a window, whose rows are k an item and task at most.

Items are searched in slices of ``SLICE_BYTES`` of text (or one longer item), whose terms tasks hold; there is one pass for each slice.

Defined results: a null or empty text, or one without terms, counts as no document and is never found. Rows are ranked one by
one, equal or not; of equal scores the smaller doc_id comes first, and a null doc_id last. Rows that share an item_id (null
included) are one item with the terms of all; an item without terms finds nothing, as does an empty table. Texts are read whole.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .common import materialized, texts

#: Bytes between terms: all of ASCII but digits and letters.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_LOWER = {65 + i: 97 + i for i in range(26)}
#: Bytes of items' texts that are searched together.
SLICE_BYTES = 1 << 21
#: Postings of one block of documents.
BLOCK_POSTINGS = 1 << 20
#: Positions that are first read of each list; twice as many each time after.
DEPTH = 16
NULL_ID = np.iinfo(np.int64).max

INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").translate(_LOWER)))


class Items:
    """A slice of the items: the numbers of their terms."""

    def __init__(self, rows: list):
        own: dict[int | None, set[str]] = {}
        for r in rows:
            own.setdefault(r.item_id, set()).update(terms_of(r.text))
        self.number = {t.encode(): k for k, t in enumerate(sorted(set().union(*own.values())))}
        self.ids = list(own)
        self.terms = [np.array(sorted(self.number[t.encode()] for t in terms), np.int64) for terms in own.values()]


def _indexed(docs: DataFrame, items) -> DataFrame:
    """Of each document its length in terms, and how often it has each term of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = items.value.number
        for rows, data, offs in textkit.blocks(batches):
            words = textkit.Words(data, offs, lower=True, between=BETWEEN)
            term = np.array([number.get(w, -1) for w in words.distinct], np.int64)[words.number[0]] if len(words.start) else np.zeros(0, np.int64)
            some = term >= 0
            key, tf = np.unique(words.row[some] * (len(number) + 1) + term[some], return_counts=True)
            first = np.searchsorted(key, np.arange(len(offs)) * (len(number) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int32))) for x in (key % (len(number) + 1), tf)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(words.first).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return texts(docs).mapInArrow(run, INDEX)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Block:
    """Documents with the impact lists of the terms that they hold."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, length: int):
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        m = 50 + 50 * n * n_docs // length
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        some = impact > 0
        doc, self.term, impact = doc[some], term[some], impact[some]
        self.ids, self.impact = ids, impact
        #: Postings of document d are first[d]..first[d + 1].
        self.first = np.searchsorted(doc, np.arange(len(ids) + 1))
        order = np.lexsort((-impact, self.term))
        self.place = np.empty_like(order)
        self.place[order] = np.arange(len(order))
        self.list_doc, self.list_impact = doc[order], impact[order]
        #: The list of term t is start[t]..start[t + 1].
        self.start = np.searchsorted(self.term[order], np.arange(len(weight) + 1))
        self.seen = np.zeros(len(order), bool)
        self.met = np.zeros(len(ids), bool)
        self.asked = np.zeros(len(weight), bool)

    def scores(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents by direct access, and the places in the asked lists where they stand."""
        size = self.first[docs + 1] - self.first[docs]
        total = np.append(0, np.cumsum(size))
        posting = np.repeat(self.first[docs] - total[:-1], size) + np.arange(total[-1])
        asked = self.asked[self.term[posting]]
        running = np.append(0, np.cumsum(np.where(asked, self.impact[posting], 0)))
        return running[total[1:]] - running[total[:-1]], self.place[posting[asked]]

    def best(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents read) of an item: its k best and more; none is left out whose score is floor or more."""
        start, stop = self.start[terms], self.start[terms + 1]
        there = stop > start
        at, stop = start[there].copy(), stop[there]
        start = at.copy()
        self.asked[terms] = True
        docs, scores, marks = [], np.zeros(0, np.int64), []
        low, step = 0, DEPTH
        kth = floor
        while len(at):
            reach = [np.arange(min(a + low, b), min(a + low + step, b)) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
            new = self.list_doc[np.concatenate(reach)]
            new = np.unique(new[~self.met[new]])
            low, step = low + step, 2 * step
            if len(new):
                self.met[new] = True
                score, place = self.scores(new)
                self.seen[place] = True
                docs.append(new)
                marks.append(place)
                scores = np.append(scores, score)
                if len(scores) >= k:
                    kth = max(kth, int(np.partition(scores, -k)[-k]))
            # Best positions: the ends of what is seen without a gap.
            for i, (a, b) in enumerate(zip(at.tolist(), stop.tolist(), strict=True)):
                if a < b:
                    part = self.seen[a:b]
                    gap = int(part.argmin())
                    at[i] = b if part[gap] else a + gap
            open_lists = at < stop
            if not open_lists.any() or kth > int(self.list_impact[at[open_lists]].sum()):
                break
        self.asked[terms] = False
        for place in marks:
            self.seen[place] = False
        docs = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.met[docs] = False
        keep = scores >= max(kth, 1)
        return docs[keep], scores[keep], len(docs)


def _blocks(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, n, first, term, tf) of consecutive documents."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def joined() -> tuple[np.ndarray, ...]:
        ids, n, count, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        return ids, n, np.append(0, np.cumsum(count)), term, tf

    for batch in batches:
        ids = batch.column(0).fill_null(NULL_ID).to_numpy()
        n = batch.column(1).to_numpy()
        lists = [batch.column(k) for k in (2, 3)]
        count = np.diff(lists[0].offsets.to_numpy())
        held.append((ids, n, count, *(x.flatten().to_numpy().astype(np.int64) for x in lists)))
        size += int(count.sum())
        if size >= postings:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _searched(index: DataFrame, items, weight, n_docs: int, length: int, k: int, postings: int) -> DataFrame:
    """The k best documents of each task's for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = items.value
        none = np.zeros(0, np.int64)
        found = [(none, none)] * len(held.ids)
        for ids, n, first, term, tf in _blocks(batches, postings):
            block = Block(ids, n, first, term, tf, weight.value, n_docs, length)
            for i, terms in enumerate(held.terms):
                doc, score = found[i]
                own, scores, _ = block.best(terms, k, int(score.min()) if len(score) == k else 0)
                doc, score = np.append(doc, block.ids[own]), np.append(score, scores)
                order = np.lexsort((doc, -score))[:k]
                found[i] = doc[order], score[order]
        doc, score = (np.concatenate([none, *(f[x] for f in found)]) for x in (0, 1))
        item = pa.array([i for i, f in zip(held.ids, found, strict=True) for _ in range(len(f[0]))], pa.int64())
        yield pa.RecordBatch.from_arrays([item, pa.array(doc, mask=doc == NULL_ID), pa.array(score)], names=["item_id", "doc_id", "score"])

    return index.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, slice_bytes: int = SLICE_BYTES, postings: int = BLOCK_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    slices = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // slice_bytes
    out = None
    for turn in range(slices):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == turn) if slices > 1 else items
        here = Items(rows.collect())
        shared = spark.sparkContext.broadcast(here)
        index = materialized(_indexed(docs, shared).filter("n > 0"), "search-index")
        n_docs, length = index.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(here.number), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
            df[r.term] = r.n
        weight = spark.sparkContext.broadcast(weights(df, n_docs))
        found = _searched(index, shared, weight, n_docs, length or 1, k, postings)
        out = found if out is None else out.unionByName(found)
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
