"""Batches of a stream into a versioned table: checked, repaired, merged where they are still mutable, and quarantined where not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.merge import merge_prefer_incoming
from ..sources.versioned import VersionedTable

def judged(batch: DataFrame, held: DataFrame, latest: DataFrame, tail_days: int, jump: float) -> DataFrame:
    """The batch's last row of each key and date, with the value that is held, and the reason for which it is refused, null if it isn't.

    ``invalid``: no date, no number, or none above 0. ``settled``: before the mutable tail of a key that is known. ``jump``: a revision by more
    than a factor; the value that is held stays. held: k, t, v of the batch's parts at least; latest: k, latest.
    """
    last = F.row_number().over(Window.partitionBy("k", "t").orderBy(F.desc("seq")))
    rows = batch.withColumn("_n", last).filter("_n = 1").drop("_n", "seq")
    rows = rows.join(held.select("k", "t", F.col("v").alias("held")), ["k", "t"], "left").join(latest, "k", "left")
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    ratio = F.when(F.col("held") > 0, F.col("v") / F.col("held"))
    reason = (
        F.when(F.col("t").isNull() | F.col("k").isNull() | ~finite | (F.col("v") <= 0), "invalid")
        .when(F.col("t") < F.date_sub("latest", tail_days), "settled")
        .when((ratio > jump) | (ratio < 1 / jump), "jump")
    )
    return rows.withColumn("reason", reason).drop("latest")


class Landing:
    """A table (k, t, v) that takes batches, what it refused, and the latest date of each key, which spares reading the table for it."""

    def __init__(self, spark: SparkSession, folder: str, kind: str, part: str, tail_days: int = 45, jump: float = 1.8):
        self.spark, self.folder, self.kind, self.tail_days, self.jump = spark, folder, kind, tail_days, jump
        self.table = VersionedTable(spark, folder + "/table", f"k {kind}, t date, v double", part)
        self.latest = VersionedTable(spark, folder + "/latest", f"k {kind}, latest date")

    def land(self, batch: DataFrame, number: int) -> bool:
        """One batch (k, t, v, seq): rows that are refused go to the quarantine folder of its number, the others into a new version of the table.

        A batch can be repeated after any failure: it has one folder in quarantine, no table takes it twice, and against a table that has
        its rows already it is judged as before.
        """
        held = self.table.read(parts=self.table.parts_of(batch))
        rows = judged(batch, held, self.latest.read(), self.tail_days, self.jump).persist()
        try:
            rows.filter("reason IS NOT NULL").select("k", "t", "v", "reason", "held").write.mode("overwrite").parquet(f"{self.folder}/quarantine/batch={number}")
            good = rows.filter("reason IS NULL").select("k", "t", "v")
            taken = self.table.upsert(good, merge_prefer_incoming, number)
            newest = good.groupBy("k").agg(F.max("t").alias("latest"))
            self.latest.upsert(newest, lambda old, new: old.unionByName(new).groupBy("k").agg(F.max("latest").alias("latest")), number)
            return taken
        finally:
            rows.unpersist()

    def run(self, stream: DataFrame) -> None:
        """Everything that has landed so far, batch by batch; goes on from the checkpoint in the folder."""
        query = stream.writeStream.foreachBatch(lambda df, number: self.land(df, number) and None).option("checkpointLocation", self.folder + "/log").trigger(availableNow=True).start()
        query.awaitTermination()

    def quarantined(self) -> DataFrame:
        return self.spark.read.schema(f"k {self.kind}, t date, v double, reason string, held double, batch int").parquet(self.folder + "/quarantine")
