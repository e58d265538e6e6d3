"""Tables in versions: every write makes new files, then swaps one pointer, so readers see whole versions and a failed write changes nothing.

A table is cut into parts by an expression. A version names a folder for each part, and a write makes folders for the parts that it
touches alone; the others stay as they are. So an upsert of a mutable tail rewrites the tail's parts, whatever the history behind it. The manifest that names the
folders is one small file with a line of text for each part. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, part: str = "'all'"):
        """part: SQL of a row's part, of few values, made of key columns so that a row never changes its part."""
        self.spark, self.path, self.schema, self.part = spark, path.rstrip("/"), schema, part

    # -- small files, by whatever file system the path names

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        files, at = self._files(), self._at(name)
        if not files.exists(at):
            return None
        stream = files.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """Written beside and renamed over: there is the old text or the new one, never a part."""
        jvm = self.spark._jvm
        beside = self._at(f"_{uuid.uuid4().hex}")
        self._files().mkdirs(self._at(name).getParent())
        stream = self._files().create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, self._at(name), options)

    # -- versions

    def manifest(self, version: int | None = None) -> dict:
        """version, batch (the last one that a stream wrote), parts: folder and rows by part."""
        if version is None:
            text = self._text("current")
            version = int(text) if text else 0
        text = self._text(f"manifests/{version}.json")
        return json.loads(text) if text else {"version": 0, "batch": -1, "parts": {}}

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        held = self.manifest(version)["parts"]
        folders = [p["folder"] for k, p in held.items() if parts is None or k in parts]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _write(self, df: DataFrame) -> dict[str, dict]:
        """Folders of the rows' parts, by part."""
        folder = f"data/{uuid.uuid4().hex}"
        named = df.withColumn("_part", F.expr(self.part).cast("string"))
        # A part's rows come together in a few tasks, by the size of what is written.
        named.repartition("_part", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        counts = {r[0]: r[1] for r in self.spark.read.parquet(f"{self.path}/{folder}").groupBy(F.col("_part").cast("string")).count().collect()}
        # Spark writes a part's text with percent signs for what a path can't hold.
        names = [x.getPath().getName() for x in self._files().listStatus(self._at(folder)) if x.isDirectory()]
        parts = {urllib.parse.unquote(n.partition("=")[2]): n for n in names}
        return {k: {"folder": f"{folder}/{n}", "rows": counts.get(k, 0)} for k, n in parts.items()}

    def _commit(self, before: dict, parts: dict, batch: int) -> None:
        version = before["version"] + 1
        self._put(f"manifests/{version}.json", json.dumps({"version": version, "batch": batch, "parts": parts}))
        self._put("current", str(version))

    def replace(self, df: DataFrame) -> bool:
        """All rows anew; parts that df lacks go. An empty result keeps what there is."""
        before = self.manifest()
        parts = {} if df.isEmpty() else self._write(df)
        if parts:
            self._commit(before, parts, before["batch"])
        return bool(parts)

    def parts_of(self, df: DataFrame) -> list[str]:
        """The parts that rows belong to, which are few."""
        return [r[0] for r in df.select(F.expr(self.part).cast("string")).distinct().collect() if r[0] is not None]

    def upsert(self, df: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int) -> bool:
        """The parts that df touches, merged with it: merge(old, new). A batch that was written before changes nothing."""
        before = self.manifest()
        if batch <= before["batch"]:
            return False
        touched = self.parts_of(df)
        parts = dict(before["parts"])
        if touched:
            parts |= self._write(merge(self.read(before["version"], touched), df))
        self._commit(before, parts, batch)
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Delete what only versions before the last ``keep`` name, and what no version does; the number of folders that went."""
        files, last = self._files(), self.manifest()["version"]
        kept = {p["folder"].rpartition("/")[0] for v in range(max(1, last - keep + 1), last + 1) for p in self.manifest(v)["parts"].values()}
        gone = 0
        for status in files.listStatus(self._at("data")) if files.exists(self._at("data")) else []:
            name = f"data/{status.getPath().getName()}"
            if name not in kept:
                files.delete(status.getPath(), True)
                gone += 1
        for v in range(1, last - keep + 1):
            files.delete(self._at(f"manifests/{v}.json"), False)
        return gone


def summary(table: VersionedTable) -> DataFrame:
    """Manifest of the rows by key: how many, from when, until when, and a fingerprint that doesn't depend on their order."""
    rows = table.read()
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct("t", "v")), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("latest"), F.sum(digest).alias("fingerprint"))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the folder that all executors share, and read back: what is used several times is worked out once, and no lost executor undoes it."""
    from ..streaming.streams import shared_folder

    folder = f"{shared_folder(df.sparkSession)}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
