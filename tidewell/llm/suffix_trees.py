"""Exact removal of repeated word sequences by prefix-partitioned suffix trees.

The suffixes that matter (see ``anchors``) are split into groups by prefixes of variable length: a group whose first word is
too frequent for one task's memory is split by its second, and so on. The suffix trees of a task's groups are built top down
(``subtrees``): an edge goes on while its suffixes agree on their next word, an internal node stands where they part, and
suffixes alone on an edge are leaves that nothing more is read of. What reaches a depth of ``LENGTH`` words with several
suffixes below it is a repeat.

Defined results: a null text, or one without words, has none and loses none; a text of fewer than ``LENGTH`` words loses
nothing. Of equal sequences the one with the smallest (doc_id, start) stays; a null id counts as smallest. Rows that repeat
an id with its text are one document and get equal results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors, textkit
from .common import partitions

LENGTH = 20
#: Words of the longest prefix.
LEAD = 6
#: Groups for each task, at least, that the most frequent prefixes are split into.
GROUPS_A_TASK = 8


@dataclass(frozen=True)
class SubTrees:
    """The internal nodes of a task's subtrees, parents first, and the suffixes below those that are ``LENGTH`` words deep.

    parent: a node's parent, -1 at the top. depth: words from the top; the edge to a node is labelled with the words from its
    parent's depth to its own, of any suffix below it. A deep node stands for the repeat of all its ``deep`` suffixes, whose
    ``below`` names the node that its edge comes from.
    """

    parent: np.ndarray
    depth: np.ndarray
    deep: np.ndarray
    group: np.ndarray
    below: np.ndarray


def subtrees(words: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> SubTrees:
    """Built top down and level by level: suffixes with one next word stay on one edge, a node stands where they part."""
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    above = np.full(1, -1)
    parents, depths, count = [], [], 0
    for depth in range(length):
        order, group, part_of, split = anchors.refine(order, group, words[starts[order] + depth])
        nodes = np.flatnonzero(split)
        parents.append(above[nodes])
        depths.append(np.full(len(nodes), depth))
        now = above.copy()
        now[nodes] = count + np.arange(len(nodes))
        count += len(nodes)
        above = now[part_of]
        if not len(order):
            break
    return SubTrees(np.concatenate(parents), np.concatenate(depths), order, group, above)


def _deep(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    trees = subtrees(words, starts)
    return trees.deep, trees.group


SCHEME = anchors.Scheme(LENGTH, LEAD, anchors.word_tokens)


def _prefixes(leads: list[bytes]) -> np.ndarray:
    """Hashes of the first 1 .. LEAD words of each lead, by row and length."""
    data, offs = textkit.text_bytes(pa.array(leads, pa.binary()))
    words = textkit.Words(data, offs)
    sums = textkit.prefix_sums(words.hash)
    first = words.first[:-1]
    return np.stack([textkit.spans_hash(sums, first, np.minimum(first + k, words.first[1:])) for k in range(1, LEAD + 1)], 1)


def frequent_prefixes(leads: list[bytes], groups: int) -> np.ndarray:
    """Prefixes, sorted, that more than one of ``groups`` leads has; there are at most LEAD * groups."""
    prefix, n = np.unique(_prefixes(leads), return_counts=True) if leads else (np.zeros(0, np.uint64), np.zeros(0, int))
    return prefix[n * groups > max(len(leads), groups)]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, span) of identified docs: spans (start << 32 | end, in words) whose every word lies in a sequence that also starts earlier."""
    tasks = partitions(docs.sparkSession)
    frequent = frequent_prefixes(anchors.sampled_leads(docs, SCHEME), GROUPS_A_TASK * tasks)

    def group_of(leads: list[bytes]) -> np.ndarray:
        prefix = _prefixes(leads)
        length = np.minimum(np.isin(prefix, frequent).cumprod(1).sum(1), LEAD - 1)
        return prefix[np.arange(len(length)), length].view(np.int64)

    found = anchors.contexts(docs, anchors.repeated_anchors(docs, SCHEME), SCHEME, group_of)
    return found.repartition(tasks, "bucket").mapInArrow(anchors.grouped(SCHEME, _deep), "doc_id long, span long")


def _digest(rows, data, offs, row, begin, end) -> pa.RecordBatch:
    words = textkit.Words(data, offs)
    gone = anchors.marked(len(words.start), words.first[row] + begin, words.first[row] + end)
    total = np.append(0, np.cumsum(gone))
    raw = data.tobytes()
    spans = [raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
    keep = (~gone).tolist()
    digests = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        digests.append(hashlib.sha256(b" ".join([w for w, k in zip(spans[a:b], keep[a:b], strict=True) if k])).hexdigest())
    arrays = [anchors.public_id(rows.column(0)), pa.array(np.diff(words.first)), pa.array(np.diff(total[words.first])), pa.array(digests)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words that are left, joined by one space."""
    docs = anchors.identified(docs)
    return anchors.with_spans(docs, repeated_spans(docs), _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
