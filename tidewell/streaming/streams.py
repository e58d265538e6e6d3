"""Structured Streaming forms of the polling rules: windows, sessions, deduplication, upserts of mutable tails."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVERLAP = "3 days"


def source(spark: SparkSession, sf_dir: str, marks: str | None = None) -> DataFrame:
    """The events table as a stream with a watermark. marks: a folder for rows that only move the watermark on."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    if marks:
        events = events.unionByName(spark.readStream.schema(schema).parquet(marks))
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", OVERLAP)


def daily_last(events: DataFrame) -> DataFrame:
    """Daily bars of a stream: last value, number and sum by user and day."""
    w = F.window("ts", "1 day")
    return events.groupBy(w.alias("w"), F.col("user_id").alias("k")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"), F.count("*").alias("n"), F.sum("value").alias("total")).select("k", F.to_date("w.start").alias("t"), "v", "n", "total")


def rolling_days(events: DataFrame, days: int = 7) -> DataFrame:
    w = F.window("ts", f"{days} days", "1 day")
    return events.groupBy(w.alias("w"), F.col("event_type").alias("k")).agg(F.count("*").alias("n"), F.avg("value").alias("v")).select("k", F.to_date("w.start").alias("t"), "n", "v")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Activity sessions whose gap slides with every event."""
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), F.col("user_id").alias("k")).agg(F.count("*").alias("n")).select("k", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset one is made, on a single machine alone."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors share no folder")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-stream-")
    return folder.rstrip("/")


def drained(stream: DataFrame, at: str | None = None) -> DataFrame:
    """All that a bounded stream gives, by running it until its source is empty. at: a folder whose checkpoint and output go on."""
    spark = stream.sparkSession
    at = at or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("path", at + "/out").option("checkpointLocation", at + "/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(at + "/out")


#: A time after all others. A row of then closes every window before it, and its own stays open.
END = "2200-01-01"


def closed(spark: SparkSession, sf_dir: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a transformation of the events gives in append mode once all windows are closed: the stream is drained, then goes on with a row of the end of times."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.createDataFrame([], schema).write.parquet(at + "/marks")
    build = lambda: transform(source(spark, sf_dir, at + "/marks"))
    drained(build(), at)
    mark = spark.range(1).select(*[(F.lit(END) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    mark.write.mode("append").parquet(at + "/marks")
    return drained(build(), at)


def asof_stream(left: DataFrame, right: DataFrame, lag_days: int, max_age_days: int) -> DataFrame:
    """(k, t, v, t_right, v_right): the last right row that is known at each left row, ``lag_days`` after its own date and not older than ``max_age_days`` then.

    Both sides (k, t, v) are streams; the interval bounds what either keeps. A left row comes once the watermark says that no right row for it can.
    """
    l = left.withColumn("ts", F.col("t").cast("timestamp")).withWatermark("ts", OVERLAP).alias("l")
    r = right.select("k", "t", "v", (F.date_add("t", lag_days)).cast("timestamp").alias("known")).withWatermark("known", OVERLAP).alias("r")
    within = F.expr(f"l.k = r.k AND r.known <= l.ts AND r.known >= l.ts - INTERVAL {max_age_days} DAYS")
    rows = l.join(r, within, "left").select("l.k", "l.ts", F.col("l.v").alias("v"), F.col("r.t").alias("t_right"), F.col("r.v").alias("v_right"))
    best = F.max_by(F.struct("t_right", "v_right"), "t_right")
    return rows.groupBy("k", F.window("ts", "1 day").alias("w"), "v").agg(best.alias("m")).select("k", F.to_date("w.start").alias("t"), "v", "m.t_right", "m.v_right")
