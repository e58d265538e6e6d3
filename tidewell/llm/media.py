"""Media columns: payloads kept as images in archives, read back by a data source of their own.

``write_archives`` stores each payload losslessly as 8-bit grey samples of a PNG image, 64 samples a row, in ZIP archives,
one for each task; rows of a task that fails leave a file that no catalogue names. ``MediaArchives`` is a Spark data source
that plans byte ranges of the archives from their sizes alone. A reader takes the members that begin in its range from
the archive's own directory, reads each at its offset, on its own and again if that fails, and streams the batches through
Arrow. A member that can't be read is a row with its error; the others are not touched by it.

Defined results: a null or empty text is one row of 64 zero samples with ``n_bytes`` 0. Equal texts give equal images. Rows
are stored one by one, equal or not; a null id stays null. Texts of any length are stored whole. An empty table gives no
archives and no rows. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import textkit
from .common import materialized, new_folder, texts

ROW = 64
_PNG = b"\x89PNG\r\n\x1a\n"
RANGE_BYTES = 8 << 20
ATTEMPTS = 3


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(raw: bytes) -> bytes:
    """The bytes, filled with zeros to whole rows (at least one), as a PNG; their number is kept in a text chunk."""
    height = max(1, -(-len(raw) // ROW))
    grid = np.zeros((height, ROW + 1), np.uint8)
    flat = np.zeros(height * ROW, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    grid[:, 1:] = flat.reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(grid.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> tuple[bytes, int]:
    """The samples of such an image, and how many of them are not filling."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, body, length, size = 8, b"", 0, (0, 0)
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        part = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", part[:8])
        elif kind == b"tEXt":
            length = int(part.split(b"\0")[1])
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    grid = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], size[0] + 1)
    return grid[:, 1:].tobytes(), length


def describe(samples: bytes) -> str:
    """A short description of the samples: mean, deviation, crossings of the mean, and a histogram of 16 bins in 16ths."""
    x = np.frombuffer(samples, np.uint8)
    mean = x.mean()
    above = x > mean
    bins = np.bincount(x >> 4, minlength=16) * 15 // len(x)
    return f"{mean:.3f}|{x.std():.3f}|{int((above[1:] != above[:-1]).sum())}|{''.join('%x' % b for b in bins)}"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """(archive, bytes, members): a row for each archive that a finished task wrote. folder: a URI that all executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
        members = 0
        stream = archive = None
        for rows, data, offs in textkit.blocks(batches):
            if archive is None:
                store.create_dir(root, recursive=True)
                stream = store.open_output_stream(f"{root}/{name}")
                archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
            raw = data.tobytes()
            for doc, a, b in zip(rows.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                archive.writestr(zipfile.ZipInfo(f"{members}_{'' if doc is None else doc}.png"), to_image(raw[a:b]))
                members += 1
        if archive is not None:
            archive.close()
            size = stream.tell()
            stream.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "bytes": [size], "members": [members]})

    return texts(docs).mapInArrow(run, "archive string, bytes long, members long")


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        super().__init__((archive, start, end))
        self.archive, self.start, self.end = archive, start, end


MEMBERS = "doc_id long, archive string, offset long, attempts int, media binary, error string"


class MediaArchives(DataSource):
    """Format ``media_archives``; option ``archives``: JSON list of [URI, bytes]; option ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return MediaReader(json.loads(self.options.get("archives", "[]")), int(self.options.get("range_bytes", RANGE_BYTES)))


class MediaReader(DataSourceReader):
    def __init__(self, archives: list, range_bytes: int):
        self.archives, self.range_bytes = archives, range_bytes

    def partitions(self) -> list[InputPartition]:
        return [Range(uri, at, min(size, at + self.range_bytes)) for uri, size in self.archives for at in range(0, max(size, 1), self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, path = _store(partition.archive)
        with store.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            members = sorted((m.header_offset, m.file_size, m.filename) for m in archive.infolist() if partition.start <= m.header_offset < partition.end)
        held: list[tuple] = []
        size = 0
        for offset, length, name in members:
            media, error, attempts = member_at(store, path, offset, length)
            doc = name.rpartition("_")[2].removesuffix(".png")
            held.append((int(doc) if doc else None, partition.archive, offset, attempts, media, error))
            size += length
            if size > (4 << 20) or len(held) >= 4096:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string())
    names = [c.split()[0] for c in MEMBERS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


_open: dict[str, object] = {}


def member_at(store, path: str, offset: int, length: int, attempts: int = ATTEMPTS) -> tuple[bytes | None, str | None, int]:
    """The member whose header is at an offset; a failed read is tried again on a newly opened file."""
    error = ""
    for attempt in range(1, attempts + 1):
        try:
            file = _open.get(path)
            if file is None:
                _open.clear()
                file = _open[path] = store.open_input_file(path)
            file.seek(offset)
            head = file.read(30)
            if head[:4] != b"PK\3\4":
                raise ValueError("no member begins here")
            names, extra = struct.unpack("<HH", head[26:30])
            file.seek(offset + 30 + names + extra)
            media = file.read(length)
            if len(media) != length:
                raise ValueError("the archive ends inside the member")
            return media, None, attempt
        except (OSError, ValueError, struct.error) as e:
            error = f"{type(e).__name__}: {e}"
            _open.pop(path, None)
    return None, error, attempts


def read_archives(spark: SparkSession, archives: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("archives", json.dumps([list(x) for x in archives])).option("range_bytes", str(range_bytes)).load()


def decoded(media: DataFrame) -> DataFrame:
    """doc_id, media, payload (the samples), n_bytes, feature, error, of the columns of the data source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload, sizes, features, errors = [], [], [], []
            for image, error in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                samples = n = feature = None
                if image is not None:
                    try:
                        samples, n = from_image(image)
                        feature = describe(samples)
                    except (ValueError, zlib.error) as e:
                        error = f"{type(e).__name__}: {e}"
                payload.append(samples), sizes.append(n), features.append(feature), errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(payload, pa.binary()), pa.array(sizes, pa.int64()), pa.array(features, pa.string()), pa.array(errors, pa.string())],
                names=["doc_id", "media", "payload", "n_bytes", "feature", "error"],
            )

    return media.select("doc_id", "media", "error").mapInArrow(run, "doc_id long, media binary, payload binary, n_bytes long, feature string, error string")


def stored(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` as media, written to the shared folder and read back."""
    spark = docs.sparkSession
    catalogue = materialized(write_archives(docs, new_folder(spark, "media")), "media-catalogue")
    return decoded(read_archives(spark, [(r.archive, r.bytes) for r in catalogue.select("archive", "bytes").collect()]))
