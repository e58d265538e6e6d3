"""Training-order materialisation: token sequences written to fixed-stride shards in a keyed random order.

Texts become token ids, each closed by ``CLOSING_ID``; every input partition is cut into sequences of one length, the last
filled up. A text has at most one token a byte, so a partition's bytes bound its sequences, and the bounds give each sequence
a number before anything is encoded. A keyed Feistel network over the smallest even number of bits, walked on until it falls
inside the range, permutes these numbers. The permuted numbers are partitioned by range and sorted; a range is written as a
shard, and a sequence's global slot is its rank over all ranges: the sequences before its shard and before it in the shard.
In a shard it begins at byte ``(slot - first slot) * stride``, so that a reader resumes anywhere by one seek and reads on in
training order. So texts are encoded once and ids are moved once, in the width that the vocabulary needs.

The bounds and the sequences must see the same partitions: ``docs`` is a table scan, or was written before. A partition
with more sequences than its bound stops the job. Shards of failed tasks have names that no manifest holds.

Defined results: a null or empty text is the closing id alone. Rows are written one by one, equal or not; a null doc_id is
named by null. Texts of any length are written whole, over as many sequences as they need. An empty table gives no shards
and no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit, token_ids
from .common import materialized, new_folder, texts

LENGTH = 512
CLOSING_ID = 0
KEY = 20240131
ROUNDS = 6
#: Numbers of one shard, at least; about two fifths of them are in use. There are at most MAX_SHARDS shards.
SHARD, MAX_SHARDS = 32768, 50_000


def _feistel(x: np.ndarray, bits: int, key: int) -> np.ndarray:
    half = np.uint64(bits // 2)
    low = np.uint64((1 << (bits // 2)) - 1)
    left, right = x >> half, x & low
    for k in range(ROUNDS):
        left, right = right, left ^ (textkit.mix(right + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1342543DE82EF95) % (1 << 64))) & low)
    return (left << half) | right


def permuted(x: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """Where each of the numbers below ``size`` goes: a bijection of them, chosen by the key."""
    bits = max(2, (max(size - 1, 1)).bit_length())
    bits += bits % 2
    out = _feistel(x.astype(np.uint64), bits, key)
    while (outside := out >= np.uint64(size)).any():
        out[outside] = _feistel(out[outside], bits, key)
    return out.astype(np.int64)


_SEQUENCE = "part long, number long, n_tokens int, doc_ids array<long>, ids binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a table of numbers."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _cut(docs: DataFrame, path: str, length: int) -> DataFrame:
    """The sequences of all texts, numbered within their tasks."""
    width = token_ids.id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = token_ids.text_encoder(path)
        done = 0
        rest, owner, names = np.zeros(0, np.uint32), np.zeros(0, np.int64), pa.array([], pa.int64())

        def rows(count: int) -> pa.RecordBatch:
            used = np.minimum(length, len(rest) - np.arange(count) * length)
            ids = np.full(count * length, CLOSING_ID, width)
            ids[: len(rest)] = rest[: count * length]
            own = owner[: count * length]
            # The documents of a sequence, in order; one that goes on from the sequence before is named again.
            new = np.append(True, own[1:] != own[:-1])
            new[::length] = True
            at = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(count + 1) * length), pa.int32()), names.take(pa.array(own[at])))
            arrays = [pa.array(np.full(count, part)), pa.array(done + np.arange(count)), pa.array(used.astype(np.int32)), lists, _binary(ids.reshape(count, length))]
            return pa.RecordBatch.from_arrays(arrays, names=_names(_SEQUENCE))

        for batch, data, offs in textkit.blocks(batches):
            flat, first = encoder.block(data, offs)
            rest = np.concatenate([rest, np.insert(flat, first[1:], CLOSING_ID)])
            owner = np.concatenate([owner, len(names) + np.repeat(np.arange(batch.num_rows), np.diff(first) + 1)])
            names = pa.concat_arrays([names, batch.column(0)])
            if count := len(rest) // length:
                yield rows(count)
                done += count
                rest, owner = rest[count * length :], owner[count * length :]
                low = int(owner[0]) if len(owner) else len(names)
                names, owner = names[low:], owner - low
        if len(rest):
            yield rows(1)

    return docs.mapInArrow(run, _SEQUENCE)


_MANIFEST = "slot long, sequence long, shard long, file string, offset long, id_bytes int, n_tokens int, doc_ids array<long>, ids_crc32 long"
_PLACED = "shard long, place long, sequence long, file string, offset long, id_bytes int, n_tokens int, doc_ids array<long>, ids_crc32 long"


def _running(rows: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """(key, name): the sum of n over smaller keys. A row for each task or shard."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", (F.sum(n).over(before) - F.col(n)).alias(name))


def written(docs: DataFrame, path: str, length: int = LENGTH, key: int = KEY, folder: str | None = None) -> DataFrame:
    """The manifest: a row for each sequence, with the file and byte offset where it stands. Ids are little-endian numbers of ``id_bytes`` bytes."""
    spark = docs.sparkSession
    rows = texts(docs)
    width = token_ids.id_type(path)
    size = np.dtype(width).itemsize
    bytes_of = rows.select(F.spark_partition_id().cast("long").alias("part"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes"))
    bounds = bytes_of.groupBy("part").agg(F.ceil(F.sum("bytes") / length).alias("bound"))
    bounds = materialized(_running(bounds, "part", "bound", "base"), "bounds")
    total = bounds.agg(F.coalesce(F.sum("bound"), F.lit(0))).first()[0]
    wide = max(SHARD, -(-total // MAX_SHARDS))
    folder = folder or new_folder(spark, "shards")

    @F.pandas_udf("long")
    def permute(number: pd.Series) -> pd.Series:
        return pd.Series(permuted(number.to_numpy(), total, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        file, place, shard, name = None, 0, -1, ""
        try:
            for batch in batches:
                n = batch.num_rows
                if n and file is None:
                    shard = batch.column(0)[0].as_py() // wide
                    name = f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
                    store.create_dir(root, recursive=True)
                    file = store.open_output_stream(f"{root}/{name}")
                crcs = []
                for piece in batch.column(4).to_pylist():
                    file.write(piece)
                    crcs.append(zlib.crc32(np.frombuffer(piece, width).astype("<u4").tobytes()))
                at = place + np.arange(n)
                place += n
                arrays = [np.full(n, shard), at, batch.column(1), [f"{folder}/{name}"] * n, at * length * size, np.full(n, size, np.int32), batch.column(2), batch.column(3), crcs]
                kinds = [pa.int64(), pa.int64(), None, pa.string(), pa.int64(), pa.int32(), None, None, pa.int64()]
                yield pa.RecordBatch.from_arrays([x if k is None else pa.array(x, k) for x, k in zip(arrays, kinds, strict=True)], names=_names(_PLACED))
        finally:
            if file is not None:
                file.close()

    numbered = _cut(rows, path, length).join(F.broadcast(bounds), "part")
    sequence = F.when(F.col("number") < F.col("bound"), F.col("number") + F.col("base")).otherwise(F.raise_error(F.lit("a partition has more sequences than its bytes allow: docs is no written table")).cast("long"))
    moved = numbered.select(permute(sequence).alias("permuted"), sequence.alias("sequence"), "n_tokens", "doc_ids", "ids")
    # The permuted numbers fill their range evenly, so the bounds of the shards are known without a sample.
    ranges = moved.repartitionById(max(1, -(-total // wide)), F.floor(F.col("permuted") / wide).cast("int"))
    placed = materialized(ranges.sortWithinPartitions("permuted").mapInArrow(run, _PLACED), "manifest")
    first = _running(placed.groupBy("shard").agg(F.count("*").alias("n")), "shard", "n", "first")
    return placed.join(F.broadcast(first), "shard").select((F.col("first") + F.col("place")).alias("slot"), *[c for c in _names(_MANIFEST) if c != "slot"])


def sequences(manifest: DataFrame, length: int = LENGTH, start_slot: int = 0) -> DataFrame:
    """The manifest's rows from a slot on, with the ids (32 bits each) read back from their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        uri, file = None, None
        for batch in batches:
            ids = []
            for now, offset, size in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True):
                if now != uri:
                    if file is not None:
                        file.close()
                    store, path = fs.FileSystem.from_uri(now)
                    uri, file = now, store.open_input_file(path)
                file.seek(offset)
                ids.append(np.frombuffer(file.read(length * size), f"<u{size}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, "ids"])

    return manifest.filter(F.col("slot") >= start_slot).mapInArrow(run, _MANIFEST + ", ids binary")
