"""Array kernels over Arrow text columns: words, rolling hashes, windows, minimisers.

Everything works on one bounded block of rows at a time (``blocks``), so a task's memory is set by the block size and
its longest row, not by its partition. Rolling hashes are 64-bit and depend on content only, so that tasks, executors and
retries agree on them; they collide on texts that are made to, so they only propose what is equal: ``numbered`` and
``window_numbers`` decide by the bytes, and ``Words.digests`` is a real digest for what tasks can't compare.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Of the C library, where it has this.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Bytes of text that one block holds (a longer row is a block of its own).
BLOCK_BYTES = 1 << 18

U64 = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_BASE, _BASE_INVERSE):
        out = np.full(max(n, BLOCK_BYTES + 2), base, U64)
        out[0] = 1
        made.append(np.multiply.accumulate(out))
    # Those of a row that is longer than a block are not kept.
    if n <= BLOCK_BYTES + 2:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of values[i] * base**i, one longer than the input."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span; equal sequences have equal hashes wherever they stand."""
    raw = (sums[end] - sums[start]) * powers(len(sums))[1][start]
    return mix(raw + (end - start).astype(U64) * U64(0x8EBC6AF09C88C6E3))


def windows_hash(sums: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on (fewer places than values by n - 1)."""
    count = max(0, len(sums) - n)
    return mix((sums[n:] - sums[:count]) * powers(len(sums))[1][:count])


def release() -> None:
    """Give back to the system what earlier blocks and tasks of this worker held: workers live on, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the offsets of the rows in them, without a copy where there is none to make. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    for again in (False, True):
        _, offsets, data = column.buffers()
        offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        if again or not column.null_count or not np.diff(offs)[column.is_null().to_numpy(zero_copy_only=False)].any():
            break
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows whose text has about ``size`` bytes together."""
    release()
    for batch in batches:
        data, offs = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
    release()


def _differ(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each span start..end has other bytes than the span other..other_end."""
    out = end - start != other_end - other
    rest = np.flatnonzero(~out & (start != other) & (end > start))
    size = (end - start)[rest]
    total = np.append(0, np.cumsum(size))
    at = 0
    while at < len(rest):
        to = max(at + 1, int(np.searchsorted(total, total[at] + BLOCK_BYTES, "right")) - 1)
        n, k = size[at:to], rest[at:to]
        place = np.repeat(start[k] - (total[at:to] - total[at]), n) + np.arange(int(total[to] - total[at]))
        unlike = data[place] != data[place - np.repeat(start[k] - other[k], n)]
        out[k] = np.logical_or.reduceat(unlike, total[at:to] - total[at])
        at = to
    return out


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span, a span of each number): spans have one number if and only if their bytes are equal."""
    _, at, number = np.unique(spans_hash(prefix_sums(_CODE[data]), start, end), return_index=True, return_inverse=True)
    wrong = np.flatnonzero(_differ(data, start, end, start[at[number]], end[at[number]])) if len(number) else number
    if len(wrong):
        known: dict[bytes, int] = {}
        firsts = []
        for k in wrong.tolist():
            piece = data[start[k] : end[k]].tobytes()
            if piece not in known:
                known[piece] = len(at) + len(known)
                firsts.append(k)
            number[k] = known[piece]
        at = np.append(at, firsts)
    return number, at


def window_numbers(number: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n numbers (fewer runs than numbers by n - 1), equal if and only if the runs are equal."""
    width = 1
    while width < n:
        step = min(width, n - width)
        if len(number) <= step:
            return np.zeros(0, np.int64)
        a, b = number[:-step], number[step:]
        number = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]
        width += step
    return number


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows of a block, or what other bytes lie between: places, rows, numbers and hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False, between: np.ndarray = _WHITE):
        self.data, self.offs = (_LOWER[data] if lower else data), offs
        black = ~between[data]
        before = np.zeros_like(black)
        before[1:] = black[:-1]
        inner = offs[:-1][np.diff(offs) > 0]
        before[inner] = False
        after = np.zeros_like(black)
        after[:-1] = black[1:]
        after[offs[1:][np.diff(offs) > 0] - 1] = False
        self.black = black
        self.start = np.flatnonzero(black & ~before)
        self.end = np.flatnonzero(black & ~after) + 1
        #: Words of row r are first[r]..first[r + 1].
        self.first = np.searchsorted(self.start, offs)
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        self._hash: np.ndarray | None = None
        self._number: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = spans_hash(prefix_sums(_CODE[self.data]), self.start, self.end)
        return self._hash

    @property
    def number(self) -> tuple[np.ndarray, np.ndarray]:
        """``numbered`` of the words: numbers hold within the block only."""
        if self._number is None:
            self._number = numbered(self.data, self.start, self.end)
        return self._number

    @property
    def distinct(self) -> list[bytes]:
        """The distinct words, by number."""
        raw, at = self.data.tobytes(), self.number[1]
        return [raw[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each word, in two halves: what other tasks know it by."""
        digest = xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join([digest(w) for w in self.distinct]), np.dtype("<u8")).reshape(-1, 2)[self.number[0]]
        return both[:, 0], both[:, 1]

    def runs(self, n: int) -> np.ndarray:
        """First words of all runs of n words within one row."""
        count = max(0, len(self.start) - n + 1)
        return np.flatnonzero(np.arange(count) + n <= self.first[self.row[:count] + 1])


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _CODE[data]


def twice(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands in the array at least twice."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier in the array."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order][1:] == keys[order][:-1]
    return out


def covered(marks: np.ndarray, n: int, first: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a place lies in a marked window of n places of its own row. marks: by place, at the windows' starts."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    place = np.arange(len(marks))
    return total[1:] > total[np.maximum(place - n + 1, first[row])]


def by_row(row: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Numbers that are equal only within one row."""
    return row * (int(number.max(initial=0)) + 1) + number


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each w consecutive values, the leftmost of equals (by the values' upper 32 bits)."""
    n = len(values)
    if n < w:
        return np.zeros(0, np.int64)
    keyed = (values & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
    width = -(-n // w) * w
    padded = np.full(width, np.iinfo(np.uint64).max, U64)
    padded[:n] = keyed
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    return (least & U64(0xFFFFFFFF)).astype(np.int64)
