"""Repeated windows of whole corpora, found through content-chosen anchors.

A window is ``n`` consecutive tokens (words or bytes) of one text. To find every window that also starts earlier, without
moving a row for each window, each window is handed to the least (by hash) of its runs of ``k`` tokens: its anchor. Equal
windows have equal anchors at the same distance, so:

* ``repeated_anchors``: only anchors whose run occurs at least twice in the corpus matter; a shuffle of (hash, place) tells.
* ``contexts``: these anchors' windows, as slices of text around the anchor, go to the groups of their leading tokens. What
  a task already knows to be a repetition of its own earlier windows is settled there and never sent, so a passage that
  stands in a third of all rows reaches a group once a task.
* the operator (suffix array or suffix tree) finds equal windows inside groups by comparing tokens themselves.

* ``with_spans``: the found spans meet their texts again; the shuffle of the texts by id is the one of the contexts, reused.

Hashes only propose: every window that is removed has been compared with an earlier one, token by token and byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkit
from .common import partitions

U64 = np.uint64
#: Stands for a null id inside the operators; as the smallest id, such a row comes first.
NO_ID = -(1 << 63)
#: Windows that a task settles among themselves at a time.
HELD_WINDOWS = 1_000_000


@dataclass(frozen=True)
class Tokens:
    """Tokens of a block: codes, first token of each row, and the bytes of a run of tokens."""

    codes: np.ndarray
    first: np.ndarray
    start: np.ndarray | None
    end: np.ndarray | None

    def slices(self, lo: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte bounds of the tokens lo..to."""
        if self.start is None:
            return lo, to
        return self.start[lo], self.end[to - 1]


def byte_tokens(data: np.ndarray, offs: np.ndarray) -> Tokens:
    return Tokens(textkit.byte_codes(data), offs, None, None)


def word_tokens(data: np.ndarray, offs: np.ndarray) -> Tokens:
    words = textkit.Words(data, offs)
    return Tokens(words.hash, words.first, words.start, words.end)


@dataclass(frozen=True)
class Scheme:
    """n: tokens of a window. k: tokens of an anchor's run; n - k must be under 256."""

    n: int
    k: int
    tokens: Callable[[np.ndarray, np.ndarray], Tokens]


def identified(docs: DataFrame, rest: list[str] | None = None) -> DataFrame:
    """(doc_id, text), with a struct of further columns if asked, dealt by id; never null ids, so that no filter differs between uses and Spark reuses the shuffle."""
    columns = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")]
    if rest is not None:
        columns.append(F.struct(*rest).alias("rest"))
    return docs.select(*columns).repartition(partitions(docs.sparkSession), "doc_id")


def _block_anchors(tokens: Tokens, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in row, windows before the anchor: first and last, hash) of the anchors of all windows."""
    n, k = scheme.n, scheme.k
    grams = textkit.windows_hash(textkit.prefix_sums(tokens.codes), k)
    anchor = textkit.sliding_argmin(grams, n - k + 1)
    row = np.repeat(np.arange(len(tokens.first) - 1), np.diff(tokens.first))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + n <= tokens.first[row + 1])
    anchor, row = anchor[start], row[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1 if len(at) else at
    return row[at], anchor[at] - tokens.first[row[at]], anchor[at] - start[at], anchor[at] - start[last], grams[anchor[at]]


def repeated_anchors(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, places): the anchors whose run of k tokens occurs at least twice; a place is (position, before first, before last)."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for rows, data, offs in textkit.blocks(batches):
            row, place, far, near, key = _block_anchors(scheme.tokens(data, offs), scheme)
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            held.append((key, ids[row], (place << 16) | (far << 8) | near))
        if not held:
            return
        key, ids, place = (np.concatenate(x) for x in zip(*held, strict=True))
        again = textkit.twice(key)
        known = np.unique(key[again])
        yield from _anchor_rows(key[~again], ids[~again], place[~again], 0)
        yield from _anchor_rows(known, np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), 1)
        yield from _anchor_rows(textkit.mix(ids[again].view(U64)), ids[again], place[again], 2)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        textkit.release()
        for batch in batches:
            kind = batch.column(3).to_numpy(zero_copy_only=False)
            if (kind == 2).any():
                yield batch.filter(pa.array(kind == 2)).select([1, 2])
            if (kind < 2).any():
                held.append(batch.filter(pa.array(kind < 2)))
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, kind = table.column(0).to_numpy(), table.column(3).to_numpy()
        keep = (textkit.twice(key.view(U64))) & (kind == 0)
        yield from table.select([1, 2]).filter(pa.array(keep)).to_batches(1 << 16)

    rows = docs.mapInArrow(own, "key long, doc_id long, place long, kind byte").repartition(partitions(docs.sparkSession), "key")
    return rows.mapInArrow(judged, "doc_id long, place long").groupBy("doc_id").agg(F.collect_list("place").alias("places"))


def _anchor_rows(key: np.ndarray, ids: np.ndarray, place: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(key), 1 << 16):
        p = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[p].view(np.int64)), pa.array(ids[p]), pa.array(place[p]), pa.array(np.full(len(key[p]), kind, np.int8))], names=["key", "doc_id", "place", "kind"]
        )


#: Documents, about, whose anchors tell how leading tokens are spread, and anchors of one document.
SAMPLE_DOCS, SAMPLE_ANCHORS = 4096, 64


def sampled_leads(docs: DataFrame, scheme: Scheme) -> list[bytes]:
    """Leading tokens of anchors of some documents, for splitters alone: what they are has no effect on results."""
    step = max(1, docs.select("doc_id").count() // SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in textkit.blocks(batches):
            tokens = scheme.tokens(data, offs)
            row, place, _, _, key = _block_anchors(tokens, scheme)
            order = np.lexsort((key, row))
            first = np.searchsorted(row, np.arange(len(offs)))
            at = order[np.arange(len(row)) - first[row[order]] < SAMPLE_ANCHORS]
            begin = tokens.first[row[at]] + place[at]
            lo, to = tokens.slices(begin, begin + scheme.k)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[a:b] for a, b in zip(lo.tolist(), to.tolist(), strict=True)], pa.binary())], names=["lead"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    return [bytes(r.lead) for r in some.mapInArrow(run, "lead binary").collect()]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls inside; a null list is empty."""
    if column.null_count:
        column = pa.array([x or [] for x in column.to_pylist()], column.type)
    offs = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]], offs - offs[0]


#: lead: the anchor's leading tokens. slice: the text of the windows lo .. lo + windows - 1. A row with no windows is a settled span.
CONTEXT = "bucket long, lead binary, doc_id long, lo long, windows int, anchor int, span long, slice binary"


def _span(lo: np.ndarray, to: np.ndarray) -> np.ndarray:
    return (lo.astype(np.int64) << 32) | to


def _context_rows(bucket, lead, doc, lo, windows, anchor, span, piece) -> pa.RecordBatch:
    names = [c.split()[0] for c in CONTEXT.split(", ")]
    arrays = [pa.array(bucket), pa.array(lead, pa.binary()), pa.array(doc), pa.array(lo.astype(np.int64)), pa.array(windows.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(span), pa.array(piece, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _known(hashes: np.ndarray, token: np.ndarray, data: np.ndarray, token_start: np.ndarray, token_end: np.ndarray, n: int) -> np.ndarray:
    """Whether a window's tokens are those of an earlier one with its hash; tokens themselves are compared."""
    order = np.argsort(hashes, kind="stable")
    new = np.append(True, hashes[order][1:] != hashes[order][:-1])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    again, head = order[~new], head[~new]
    if not len(again):
        return np.zeros(len(hashes), bool)
    single = len(token_end) == 0 or bool((token_end - token_start == 1).all())
    number = data[token_start] if single else textkit.numbered(data, token_start, token_end)[0]
    same = np.ones(len(again), bool)
    x, y = token[again], token[head]
    for k in range(n):
        same &= number[x + k] == number[y + k]
    out = np.zeros(len(hashes), bool)
    out[again[same]] = True
    return out


def contexts(docs: DataFrame, anchors: DataFrame, scheme: Scheme, bucket_of: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """Slices of text around the repeated anchors, without the windows that the task could settle; these come as spans (start << 32 | end, in tokens of the text)."""
    n = scheme.n

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        doc, lo, count, anchor, begin, data, token_start, token_end, hashes = held
        # Windows by document and place, so that of equal ones the first stays in front.
        inner = np.lexsort((lo, doc))
        # Rows that repeat an id with its text have the same windows: they count once.
        once = np.append(True, (doc[inner][1:] != doc[inner][:-1]) | (lo[inner][1:] != lo[inner][:-1])) if len(inner) else np.zeros(0, bool)
        inner = inner[once]
        first_window = (np.cumsum(count) - count)[inner]
        doc, lo, count, anchor, begin = doc[inner], lo[inner], count[inner], anchor[inner], begin[inner]
        before = np.cumsum(count) - count
        hashes = hashes[np.repeat(first_window - before, count) + np.arange(int(count.sum()))]
        row = np.repeat(np.arange(len(doc), dtype=np.int32), count)
        place = (np.arange(len(row)) - np.repeat(before, count)).astype(np.int32)
        known = _known(hashes, begin[row] + place, data, token_start, token_end, n)
        del hashes
        # Runs of windows of one anchor that are known, or not.
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (known[1:] != known[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(row)))
        r, p, done = row[at], place[at], known[at]
        first = lo[r] + p
        raw = data.tobytes()
        # Settled windows of neighbouring anchors are one span.
        k = np.flatnonzero(done)
        if len(k):
            joins = np.append(False, (doc[r[k]][1:] == doc[r[k]][:-1]) & (first[k][1:] == first[k][:-1] + size[k][:-1]))
            head = np.flatnonzero(~joins)
            tail = np.append(head[1:], len(k)) - 1
            begin_at, end_at = first[k[head]], first[k[tail]] + size[k[tail]] + n - 1
            names = doc[r[k[head]]]
            for a in range(0, len(head), 1 << 15):
                q = slice(a, a + (1 << 15))
                empty = [None] * len(names[q])
                yield _context_rows(textkit.mix(names[q].view(U64)).view(np.int64), empty, names[q], begin_at[q], np.zeros(len(empty)), np.zeros(len(empty)), _span(begin_at[q], end_at[q]), empty)
        k = np.flatnonzero(~done)
        r, p, first, size = r[k], p[k], first[k], size[k]
        token = begin[r] + p
        byte_lo, byte_to = token_start[token].tolist(), token_end[token + size + n - 2].tolist()
        lead_lo, lead_to = token_start[begin[r] + anchor[r]].tolist(), token_end[begin[r] + anchor[r] + scheme.k - 1].tolist()
        for a in range(0, len(k), 1 << 14):
            q = slice(a, a + (1 << 14))
            leads = [raw[x:y] for x, y in zip(lead_lo[q], lead_to[q], strict=True)]
            slices = [raw[x:y] for x, y in zip(byte_lo[q], byte_to[q], strict=True)]
            yield _context_rows(bucket_of(leads), leads, doc[r[q]], first[q], size[q], anchor[r[q]] - p[q], _span(first[q], first[q] + size[q] + n - 1), slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        total = tokens_held = bytes_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                held = [np.concatenate(x) for x in zip(*parts, strict=True)]
                parts.clear()
                yield from settle(held)
                held.clear()
                textkit.release()

        for rows, data, offs in textkit.blocks(batches):
            tokens = scheme.tokens(data, offs)
            places, at = _lists(rows.column(rows.schema.get_field_index("places")))
            if not len(places):
                continue
            row = np.repeat(np.arange(rows.num_rows), np.diff(at))
            order = np.lexsort((places, row))
            row, places = row[order], places[order]
            position, far, near = places >> 16, (places >> 8) & 255, places & 255
            keep = np.ones(len(row), bool)
            keep[1:] = (row[1:] != row[:-1]) | (places[1:] != places[:-1])
            row, position, far, near = row[keep], position[keep], far[keep], near[keep]
            lo, count = position - far, far - near + 1
            begin = tokens.first[row] + lo
            size = count + n - 1
            hashes = textkit.windows_hash(textkit.prefix_sums(tokens.codes), n)
            which = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            # Only the tokens around the anchors are kept.
            needed = np.zeros(len(tokens.codes) + 1, np.int64)
            np.add.at(needed, begin, 1)
            np.add.at(needed, begin + size, -1)
            kept = np.cumsum(needed[:-1]) > 0
            start = np.arange(len(data)) if tokens.start is None else tokens.start
            end = start + 1 if tokens.end is None else tokens.end
            joined = np.zeros(len(data) + 1, np.int64)
            np.add.at(joined, start[kept], 1)
            np.add.at(joined, end[kept], -1)
            body = np.cumsum(joined[:-1]) > 0
            body[1:] |= np.cumsum(joined[:-1])[:-1] > 0  # and the separator behind each token
            where = np.cumsum(body) - body
            number = np.cumsum(kept) - kept
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            parts.append((ids[row], lo, count, far, number[begin] + tokens_held, data[body], where[start[kept]] + bytes_held, where[end[kept] - 1] + 1 + bytes_held, hashes[which]))
            tokens_held += int(kept.sum())
            bytes_held += int(body.sum())
            total += len(which)
            if total > HELD_WINDOWS:
                yield from flush()
                total = tokens_held = bytes_held = 0
        yield from flush()

    joined = docs.join(anchors.hint("shuffle_hash"), "doc_id").select(*docs.columns, "places")
    return joined.mapInArrow(run, CONTEXT)


def refine(order: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step of a multikey sort: members of a group are split by their next key; singles are dropped.

    order: places, group by group. group: a number for each, ascending. key: each place's next key. Groups whose members
    all agree stay as they are without sorting. Also returned: the group that each new group was part of, and which groups
    were split.
    """
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(group)))
    agrees = key == np.repeat(key[starts], size)
    split = np.add.reduceat(~agrees, starts) > 0 if len(starts) else np.zeros(0, bool)
    mixed = np.repeat(split, size)
    if mixed.any():
        at = np.flatnonzero(mixed)
        inner = np.lexsort((key[at], group[at]))
        order, key = order.copy(), key.copy()
        order[at], key[at] = order[at][inner], key[at][inner]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    single = new & np.append(new[1:], True)
    left = np.cumsum(new & ~single) - 1
    return order[~single], left[~single], np.repeat(np.arange(len(starts)), size)[new & ~single], split


#: (tokens as numbers, places) -> the places whose next n tokens another place has too, group by group, and their groups.
Ties = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def repeats_of(rows: pa.Table, scheme: Scheme, ties: Ties, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """(doc_id, span) of the windows in groups' contexts that also start earlier. rows: whole groups, sorted by group."""
    n = scheme.n
    leads = rows.column("lead").to_pylist()
    sizes = pa.compute.binary_length(rows.column("slice")).fill_null(0).to_numpy()
    total = np.append(0, np.cumsum(sizes))
    at = 0
    while at < rows.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
        while to < rows.num_rows and leads[to] == leads[to - 1]:
            to += 1
        part = rows.slice(at, to - at)
        at = to
        data, offs = textkit.text_bytes(part.column("slice"))
        tokens = scheme.tokens(data, offs)
        doc, lo, count = (part.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "lo", "windows"))
        row = np.repeat(np.arange(len(doc)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        starts = tokens.first[row] + place
        order, group = ties(data if tokens.start is None else textkit.numbered(data, tokens.start, tokens.end)[0], starts)
        if not len(order):
            continue
        position = lo[row[order]] + place[order]
        inner = np.lexsort((position, doc[row[order]], group))
        order, position = order[inner], position[inner]
        later = np.zeros(len(order), bool)
        same = (doc[row[order]][1:] == doc[row[order]][:-1]) & (position[1:] == position[:-1])
        later[1:] = (group[1:] == group[:-1]) & ~same
        # A place that is given twice, by rows of one id, is one place.
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        lead_doc, lead_place = doc[row[order[head]]], position[head]
        number = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
        later &= (doc[row[order]] != lead_doc[number]) | (position != lead_place[number])
        found = np.sort(order[later])
        if not len(found):
            continue
        r, p = row[found], place[found]
        new = np.ones(len(found), bool)
        new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
        a = np.flatnonzero(new)
        length = np.diff(np.append(a, len(found)))
        first = lo[r[a]] + p[a]
        yield pa.RecordBatch.from_arrays([pa.array(doc[r[a]]), pa.array(_span(first, first + length + n - 1))], names=["doc_id", "span"])


def grouped(scheme: Scheme, ties: Ties) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for ``mapInArrow`` over partitions that hold whole groups: settled spans pass, contexts are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        textkit.release()
        for batch in batches:
            open_ = batch.column(4).to_numpy(zero_copy_only=False) > 0
            if not open_.all():
                yield batch.filter(pa.array(~open_)).select([2, 6])
            if open_.any():
                held.append(batch.filter(pa.array(open_)))
        if held:
            table = pa.Table.from_batches(held)
            held.clear()
            table = table.take(pa.compute.sort_indices(table, [("lead", "ascending")]))
            yield from repeats_of(table, scheme, ties)

    return run


def with_spans(docs: DataFrame, spans: DataFrame, finish: Callable, schema: str | StructType) -> DataFrame:
    """``finish(rows, data, offs, spans by row)`` over all texts with the spans that were found in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in textkit.blocks(batches):
            values, at = _lists(rows.column(rows.schema.get_field_index("spans")))
            yield finish(rows, data, offs, np.repeat(np.arange(rows.num_rows), np.diff(at)), values >> 32, values & 0xFFFFFFFF)

    gathered = spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    return docs.join(gathered.hint("shuffle_hash"), "doc_id", "left").select(*docs.columns, "spans").mapInArrow(run, schema)


def marked(length: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each place lies in one of the spans."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def public_id(ids: pa.Array) -> pa.Array:
    return pa.array([None if i == NO_ID else i for i in ids.to_pylist()], pa.int64())
