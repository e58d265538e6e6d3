"""Shared helpers of the subpackage: table reading, shared storage, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Only Spark opens the path, so it may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset one is set, on a single machine alone."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        held = context._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors share no folder")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """The rows written once to the shared folder and read back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    folder = new_folder(spark, purpose)
    df.write.parquet(folder, compression=compression)
    return spark.read.schema(df.schema).parquet(folder)


def texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns, whatever their names, never enter an operator."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def with_rest(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): the columns but the text travel along as one struct, so that no name clashes and no join brings them back."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest"))


def without_rest(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in columns])


#: Slots of the filter of ids, 64 of them a row: 65,536 rows at most.
SLOTS = 1 << 22


def in_slots(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id's hash slot is one of those of ``ids``: a filter, exact in what it lets through only together with a join, that spares
    most other texts a shuffle as long as ids are fewer than slots. Spark joins it, as bits: a Python filter before another Python function of
    the same stage would keep twice as many workers alive."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    words = ids.select(slot.alias("slot")).groupBy(F.expr("slot DIV 64").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("__bits"))
    words = materialized(words, "slots")
    near = docs.withColumn("__slot", slot).withColumn("__word", F.expr("__slot DIV 64")).join(F.broadcast(words), "__word")
    return near.filter("shiftright(__bits, cast(__slot % 64 AS int)) & 1L = 1").select(*docs.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
