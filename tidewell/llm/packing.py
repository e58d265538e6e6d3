"""Vector bin packing of documents into sequences under several limits at once.

Every piece has a vector: tokens, segments (one) and loss-bearing tokens. Of 1024 tokens 1023 have a next one to predict, so
that is the limit of loss-bearing tokens: a sequence holds a closing id, which bears none, or leaves one token free. Whole
sequences are cut from long documents first. The rest fills open sequences: of all waiting pieces that fit, the one whose vector has the largest dot product
with the room that is left (both scaled by the limits) comes next. When none fits, one is cut to fill the room; room
of up to ``SLACK`` tokens is left as padding rather than cut for. Tasks pack their own rows, a lot at a time, with nothing
shuffled; each lot of ``LOT`` documents leaves at most one sequence unfilled.

Defined results: a null or empty text is one piece of the closing id alone. Rows are packed one by one, equal or not. A
null doc_id stays null. An empty table gives no pieces. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textkit, token_ids
from .common import texts

#: Tokens, segments, loss-bearing tokens of one sequence.
LIMITS = (1024, 512, 1023)
SLACK = 4
#: Documents that are packed together.
LOT = 4096
CLOSING_ID = 0


def pack(sizes: np.ndarray, loss: Callable[[int, int, int], int], limits: tuple[int, int, int] = LIMITS, slack: int = SLACK) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length). loss(item, start, length): loss-bearing tokens of a piece; it grows with the length, and is at most 1 more for each token."""

    def longest(item: int, at: int, most: int, room: float) -> int:
        if loss(item, at, most) <= room:
            return most
        low, high = 0, most
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if loss(item, at, middle) <= room else (low, middle)
        return low

    room_tokens, room_segments, room_loss = limits
    scale = np.array([1 / x for x in limits])
    waiting = []
    for item, size in enumerate(sizes.tolist()):
        at = 0
        while size - at >= room_tokens:
            length = longest(item, at, room_tokens, room_loss)
            if not length:
                raise ValueError(f"a token of item {item} bears more loss than a sequence may")
            if length >= room_tokens - slack:
                yield [(item, at, length)]
            else:
                waiting.append((item, at, length))
            at += length
        if size > at:
            waiting.append((item, at, size - at))
    # One row for each waiting piece: its vector. A piece that was cut goes on with what is left of it.
    vector = np.array([[length, 1, loss(item, at, length)] for item, at, length in waiting], float).reshape(-1, 3)
    scaled = vector * scale
    free = np.ones(len(waiting), bool)
    left = len(waiting)
    order = np.argsort(-vector[:, 0], kind="stable")
    head = 0
    while left:
        room = np.array(limits, float)
        inside: list[tuple[int, int, int]] = []
        while left and room[0] > 0 and room[1] > 0:
            if inside:
                score = np.where(free & (vector <= room).all(1), scaled @ (room * scale), -1.0)
                best = int(score.argmax())
                fits = score[best] >= 0
            else:
                while not free[order[head]]:
                    head += 1
                best, fits = int(order[head]), bool((vector[order[head]] <= room).all())
            item, at, length = waiting[best]
            if not fits:
                if room[0] <= slack and inside:
                    break
                # The largest piece that waits is cut to the room.
                best = int(np.where(free, vector[:, 0], -1).argmax())
                item, at, length = waiting[best]
                take = longest(item, at, min(length, int(room[0])), room[2])
                if not take:
                    if not inside:
                        raise ValueError(f"a token of item {item} bears more loss than a sequence may")
                    break
                inside.append((item, at, take))
                room -= (take, 1, loss(item, at, take))
                if take == length:
                    free[best], left = False, left - 1
                else:
                    waiting[best] = (item, at + take, length - take)
                    vector[best] = (length - take, 1, loss(item, at + take, length - take))
                    scaled[best] = vector[best] * scale
                continue
            free[best], left = False, left - 1
            inside.append((item, at, length))
            room -= vector[best]
        yield inside


def _lots(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids of documents, token ids with the closing id, first of each document) of consecutive documents."""
    encoder = token_ids.text_encoder(path)
    names: list = []
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    for rows, data, offs in textkit.blocks(batches):
        flat, first = encoder.block(data, offs)
        parts.append(np.insert(flat, first[1:], CLOSING_ID))
        sizes.append(np.diff(first) + 1)
        names += rows.column(0).to_pylist()
        if len(names) >= LOT:
            yield names, np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes)))
            names, parts, sizes = [], [], []
    if names:
        yield names, np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes)))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"


def packed(docs: DataFrame, path: str, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """One row a piece. A sequence's last piece carries its padding: up to the limit, none at a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for names, flat, first in _lots(batches, path):
            sizes = np.diff(first)
            flat = flat.astype("<u4")
            # In plain text every token bears loss but the closing one.
            loss = lambda item, at, length: length - (at + length == sizes[item])  # noqa: E731, B023
            out: list[tuple] = []
            for inside in pack(sizes, loss, limits):
                offset = 0
                for k, (item, at, length) in enumerate(inside):
                    ids = flat[first[item] + at : first[item] + at + length]
                    total = offset + length
                    pad = 0 if k < len(inside) - 1 or total & (total - 1) == 0 else limits[0] - total
                    out.append((names[item], at, length, zlib.crc32(ids.tobytes()), int(sizes[item]), number, offset, pad))
                    offset = total
                number += 1
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PIECES.split(", ")])

    return texts(docs).mapInArrow(run, PIECES)
