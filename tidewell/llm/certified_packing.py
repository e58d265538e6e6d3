"""Best-fit-decreasing packing of documents into sequences, with a certificate for each lot and exchanges between lots that lack one.

Tasks encode their documents and pack them by lots. Each lot's number of sequences is held against a lower bound: dual-feasible
functions map a piece's share of a sequence to a number such that whatever fits into one sequence sums to 1 at most, so the sum
over all pieces, rounded up, bounds the number of sequences of any packing. A lot that meets its bound with no more room than
one sequence's is certified: no packing of its pieces is better, nor could others' pieces fill it, and only its emptiest sequence goes on. A lot with
a gap hands on all sequences with room, the emptiest first. What is handed on is dealt anew, whole sequences at a time, to fewer lots, which
rerun best-fit decreasing; a lot that doesn't get better keeps the sequences that came. From the second round on a lot hands on an eighth of what it may hold at most (the
rest keeps its place), so the rounds are as many as the logarithm of the number of lots, and the last one is a single bounded lot.
They end earlier when all sequences together meet the bound of all pieces.

Only lengths and checksums are exchanged: ids are cut into pieces, summed up and dropped where they are made.

Defined results: a null or empty text is one piece of the closing id alone. Rows are packed one by one, equal or not; a null
doc_id stays null. An empty table gives no pieces. Texts are encoded whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .bpe_automaton import WordEncoder
from .common import materialized, texts

CAPACITY = 2048
CLOSING_ID = 0
#: Pieces that are packed together.
LOT = 1 << 16
#: Words whose ids a worker keeps before it begins anew.
TABLE_WORDS = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, settled boolean"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]


class Rows:
    """Growing rows of numbers, end to end."""

    def __init__(self) -> None:
        self.flat, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes, dtype=np.int64)])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the rows, end to end; their bounds)."""
        total = np.append(0, np.cumsum(self.first[rows + 1] - self.first[rows]))
        place = np.repeat(self.first[rows] - total[:-1], np.diff(total)) + np.arange(total[-1])
        return self.flat[place], total


class WordIds:
    """Ids of whole texts by way of their distinct words, and of these by way of the pieces that the vocabulary splits words into. Both are kept."""

    def __init__(self, path: str):
        self.encoder = WordEncoder(path)
        self._forget_words()
        self._forget_pieces()

    def _forget_words(self) -> None:
        self.words: dict[bytes, int] = {}
        self.of_word = Rows()

    def _forget_pieces(self) -> None:
        self.pieces: dict[bytes | str, int] = {}
        self.of_piece = Rows()

    def _split(self, word: str) -> list[bytes | str]:
        """The pieces of a word; an added token is a string."""
        encoder = self.encoder
        if encoder.split_added is None or "<" not in word:
            return encoder._pieces(word)
        return [p for part in encoder.split_added.split(word) for p in ([part] if part in encoder.added else encoder._pieces(part))]

    def _learn(self, words: list[bytes]) -> None:
        split = [self._split(w.decode()) for w in words]
        new = [p for p in dict.fromkeys(p for own in split for p in own) if p not in self.pieces]
        plain = [p for p in new if isinstance(p, bytes)]
        added = [p for p in new if isinstance(p, str)]
        for p in [*plain, *added]:
            self.pieces[p] = len(self.pieces)
        flat, first = self.encoder.automaton.encode(plain)
        self.of_piece.add(np.concatenate([flat, np.array([self.encoder.added[p] for p in added], np.int64)]), np.append(np.diff(first), np.ones(len(added), np.int64)))
        sizes = np.array([len(own) for own in split], np.int64)
        flat, bounds = self.of_piece.of(np.array([self.pieces[p] for own in split for p in own], np.int64))
        ends = bounds[np.cumsum(sizes)]
        self.of_word.add(flat, np.diff(np.append(0, ends)))
        for w in words:
            self.words[w] = len(self.words)

    def block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's rows, and the first of each row."""
        if len(self.words) > TABLE_WORDS:
            self._forget_words()
        if len(self.pieces) > TABLE_WORDS:
            self._forget_pieces()
        words = textkit.Words(data, offs)
        distinct = words.distinct
        if missing := [w for w in distinct if w not in self.words]:
            self._learn(missing)
        flat, total = self.of_word.of(np.array([self.words[w] for w in distinct], np.int64)[words.number[0]])
        return flat.astype("<u4"), total[words.first]


@lru_cache(maxsize=1)
def _ids(path: str) -> WordIds:
    return WordIds(path)


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: the largest first, each into the fullest bin that has room."""
    which, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = bins = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            to = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, to, bins = capacity, bins, bins + 1
        which[item], offset[item] = to, capacity - room
        by_room[room - size].append(to)
        open_rooms |= 1 << (room - size)
    return which, offset


@lru_cache(maxsize=4)
def _dual_feasible(capacity: int, steps: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(values by function and size, whole number that stands for 1 by function). All are exact in whole numbers.

    Three families over sizes 0..capacity: rounding in k steps (a size that is a multiple of a step keeps its own value); large
    sizes count whole and those below a threshold not at all; and sizes over a half count what they leave in units of the threshold.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    rows, ones = [size], [capacity]
    for k in range(1, steps + 1):
        steps_in = (k + 1) * size
        rows.append(np.where(steps_in % capacity == 0, k * size, capacity * (steps_in // capacity)))
        ones.append(k * capacity)
    for least in range(1, capacity // 2 + 1):
        rows.append(np.where(size > capacity - least, capacity, np.where(size >= least, size, 0)))
        ones.append(capacity)
        units = capacity // least
        rows.append(np.where(2 * size > capacity, units - (capacity - size) // least, np.where(size >= least, 1, 0)))
        ones.append(units)
    return np.stack(rows), np.array(ones, np.int64)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of the bounds on the bins of items, counted by size."""
    values, ones = _dual_feasible(capacity)
    return int((-(-(values @ counts) // ones)).max())


def handed_on(sizes: np.ndarray, which: np.ndarray, certified: bool, most: int, capacity: int = CAPACITY) -> np.ndarray:
    """Whether each item lies in a bin that takes part in the next exchange: bins with room, the emptiest first, up to so many items."""
    n = int(which.max(initial=-1)) + 1
    room = capacity - np.bincount(which, sizes, n).astype(np.int64)
    order = np.argsort(-room, kind="stable")[: 1 if certified else n]
    order = order[room[order] > 0]
    order = order[np.cumsum(np.bincount(which, minlength=n)[order]) <= most]
    chosen = np.zeros(n, bool)
    chosen[order] = True
    return chosen[which]


class Lot:
    """Pieces that are packed together, gathered column by column."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in range(7)]

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, *rows: list) -> None:
        for held, new in zip(self.columns, rows, strict=False):
            held += new

    def packed(self, number: int, last: bool, capacity: int, most: int) -> pa.RecordBatch:
        """The pieces with their sequences, which are numbered from ``number`` on."""
        sizes = np.array(self.columns[3], np.int64)
        which, offset = best_fit_decreasing(sizes, capacity)
        bins = int(which.max(initial=-1)) + 1
        came = len(self.columns[5]) > 0
        if came:
            former, before = np.unique(np.array(self.columns[5], np.int64), return_inverse=True)
            if len(former) <= bins:
                which, offset, bins = before, np.array(self.columns[6], np.int64), len(former)
        certified = bins == lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) and bins * capacity - int(sizes.sum()) < capacity
        settled = np.ones(len(sizes), bool) if last else ~handed_on(sizes, which, certified, most, capacity)
        ids, crc = pa.array(self.columns[0], pa.int64()), pa.array(self.columns[4], pa.int64())
        piece, start = pa.array(self.columns[1], pa.int32()), pa.array(self.columns[2], pa.int64())
        return pa.RecordBatch.from_arrays([ids, piece, start, pa.array(sizes), crc, pa.array(number + which), pa.array(offset), pa.array(settled)], names=_NAMES)


def _first_round(docs: DataFrame, path: str, capacity: int, lot_size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        encoder, lot = _ids(path), Lot()
        for rows, data, offs in textkit.blocks(batches):
            flat, first = encoder.block(data, offs)
            flat = np.insert(flat, first[1:], CLOSING_ID)
            first = first + np.arange(len(first))
            for doc_id, a, b in zip(rows.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                starts = list(range(0, b - a, capacity))
                ends = [min(s + capacity, b - a) for s in starts]
                lot.add([doc_id] * len(starts), list(range(len(starts))), starts, [e - s for s, e in zip(starts, ends, strict=True)], [zlib.crc32(flat[a + s : a + e].tobytes()) for s, e in zip(starts, ends, strict=True)])
            if len(lot) >= lot_size:
                yield lot.packed(number, False, capacity, len(lot))
                number, lot = number + len(lot), Lot()
        if len(lot):
            yield lot.packed(number, False, capacity, len(lot))

    return texts(docs).mapInArrow(run, PIECES)


def _again(waiting: DataFrame, lots: int, turn: int, capacity: int, lot_size: int) -> DataFrame:
    """The sequences that were handed on, dealt to so many lots and packed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = Lot()
        for batch in batches:
            lot.add(*(batch.column(k).to_pylist() for k in range(7)))
        if len(lot):
            yield lot.packed((turn << 57) + (TaskContext.get().partitionId() << 32), lots == 1, capacity, lot_size // 8)

    return waiting.repartition(lots, "sequence_id").mapInArrow(run, PIECES)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, lot_size: int = LOT) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    done = materialized(_first_round(docs, path, capacity, lot_size), "packing-round")
    bound = lower_bound(_lengths(done, capacity), capacity)
    parts, turn, kept = [], 0, 0
    while True:
        # Each sequence has one piece at its beginning.
        ends, there, n = done.selectExpr("count_if(settled AND offset = 0)", "count_if(offset = 0)", "count_if(NOT settled)").first()
        if not n or kept + there <= bound:
            parts.append(done)
            break
        kept, turn = kept + ends, turn + 1
        parts.append(done.filter("settled"))
        done = materialized(_again(done.filter("NOT settled"), max(1, round(n / lot_size)), min(turn, 63), capacity, lot_size), "packing-round")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.drop("settled")


def _lengths(pieces: DataFrame, capacity: int) -> np.ndarray:
    """How many pieces have each length. The driver gets one number for each, so a sequence's tokens at most."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    return counts


def certificate(pieces: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, lower bound) of a whole packing."""
    return pieces.filter("offset = 0").count(), lower_bound(_lengths(pieces, capacity), capacity)
