"""Exact removal of repeated byte strings by sorted suffixes.

The suffixes that matter (see ``anchors``) are range-partitioned by their leading bytes, between sampled splitters; tasks hold
consecutive ranges. A task sorts its suffixes by multikey quicksort with eight bytes as one character: groups that still tie
are split by their next eight bytes. What ties on all ``LENGTH`` bytes is a repeated string. Splitters fall between different
leading bytes, and equal strings have equal leading bytes, so no run of equal suffixes crosses a boundary.

Defined results: a null text is empty; a text shorter than ``LENGTH`` bytes loses nothing. Of equal strings the one with
the smallest (doc_id, start) stays; a null id counts as smallest. Rows that repeat an id with its text are one document
and get equal results. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import anchors
from .common import partitions

LENGTH = 100
#: Leading bytes by which suffixes are dealt to buckets.
LEAD = 32
#: Buckets for each task, so that tasks have about equal shares.
BUCKETS_A_TASK = 8


def tied(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes, in order, that tie with another on all ``LENGTH`` bytes, and the group of each, by multikey quicksort."""
    padded = np.zeros(len(data) + 8, np.uint64)
    padded[: len(data)] = data
    word = np.zeros(len(data), np.uint64)
    for k in range(8):
        word |= padded[k : k + len(data)] << np.uint64(56 - 8 * k)
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for at in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        order, group, _, _ = anchors.refine(order, group, word[starts[order] + at])
        if not len(order):
            break
    return order, group


SCHEME = anchors.Scheme(LENGTH, LEAD, anchors.byte_tokens)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, span) of identified docs: spans (start << 32 | end, in bytes) whose every byte lies in a string that also starts earlier."""
    tasks = partitions(docs.sparkSession)
    leads = sorted(anchors.sampled_leads(docs, SCHEME))
    count = BUCKETS_A_TASK * tasks
    splitters = np.array([leads[len(leads) * k // count] for k in range(1, count)] if leads else [], f"S{LEAD}")
    found = anchors.contexts(docs, anchors.repeated_anchors(docs, SCHEME), SCHEME, lambda some: np.searchsorted(splitters, np.array(some, splitters.dtype), "right"))
    # Neighbouring buckets go to one task, so tasks hold consecutive ranges of suffixes. Settled spans have any number for a bucket.
    task = F.pmod(F.col("bucket"), F.lit(count)) * tasks / count
    buckets = found.repartitionById(tasks, F.floor(task).cast("int"))
    return buckets.mapInArrow(anchors.grouped(SCHEME, tied), "doc_id long, span long")


def _runs(gone: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Maximal runs of removed bytes in each row."""
    start = gone.copy()
    start[1:] &= ~gone[:-1]
    rows = offs[:-1][np.diff(offs) > 0]
    start[rows] = gone[rows]
    total = np.append(0, np.cumsum(start))
    return total[offs[1:]] - total[offs[:-1]]


def _digest(rows, data, offs, row, begin, end) -> pa.RecordBatch:
    gone = anchors.marked(len(data), offs[row] + begin, offs[row] + end)
    total = np.append(0, np.cumsum(gone))
    kept = data[~gone].tobytes()
    left = offs - total[offs]
    digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
    arrays = [anchors.public_id(rows.column(0)), pa.array(np.diff(offs)), pa.array(np.diff(total[offs])), pa.array(_runs(gone, offs)), pa.array(digests)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that are left."""
    docs = anchors.identified(docs)
    return anchors.with_spans(docs, repeated_spans(docs), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _texts(rows, data, offs, row, begin, end) -> pa.RecordBatch:
    gone = anchors.marked(len(data), offs[row] + begin, offs[row] + end)
    # A character goes only as a whole.
    tail = (data & 0xC0) == 0x80
    number = np.cumsum(~tail) - 1
    if len(data):
        heads = np.flatnonzero(~tail)
        whole = np.logical_and.reduceat(gone, heads)
        gone = whole[number]
    total = np.append(0, np.cumsum(gone))
    kept = data[~gone].tobytes()
    left = offs - total[offs]
    known = rows.column(1).is_valid().to_pylist()
    texts = [kept[a:b].decode() if k else None for a, b, k in zip(left[:-1].tolist(), left[1:].tolist(), known, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(np.diff(total[offs])), rows.column(2)], names=["text", "n_removed", "rest"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; all columns stay, ``n_chars`` (if there) follows the text."""
    columns = docs.columns
    ids = anchors.identified(docs, [c for c in columns if c != "text"])
    schema = StructType([StructField("text", StringType()), StructField("n_removed", LongType()), StructField("rest", ids.schema["rest"].dataType)])
    cut = anchors.with_spans(ids, repeated_spans(ids), _texts, schema)
    changed = {"text": F.col("text")}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cut.select(*[changed.get(c, F.col("rest")[c].alias(c)) for c in columns])
