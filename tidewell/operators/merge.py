"""Reconciling providers of one panel. Panels are long: key k, date t, value v; null is missing, never zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KT = ["k", "t"]


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in the given order (arrival has no order of its own in Spark)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def normalize_rows(df: DataFrame, raw_date: str, raw_value: str, seq: str) -> DataFrame:
    """Typed rows of text rows: bad dates go, bad numbers, NaN and infinities are null, the last row of a date wins."""
    value = F.expr(f"try_cast({raw_value} AS DOUBLE)")
    value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    t = F.expr(f"CASE WHEN {raw_date} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN try_cast({raw_date} AS DATE) END")
    return last_wins(df.select("k", t.alias("t"), value.alias("v"), seq).filter("t IS NOT NULL"), KT, [seq]).select("k", "t", "v")


def acceptable(v: str = "v", low: str = "min_value", high: str = "max_value", reject_zero: str = "reject_zero") -> Column:
    """Whether a value is finite, not a rejected zero, and within its policy's limits (null: no limit)."""
    x = F.col(v)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return finite & ~(F.coalesce(F.col(reject_zero), F.lit(False)) & (x == 0)) & (F.col(low).isNull() | (x >= F.col(low))) & (F.col(high).isNull() | (x <= F.col(high)))


def _both(old: DataFrame, new: DataFrame, keys: list[str] = KT) -> DataFrame:
    a = old.select(*keys, F.col("v").alias("old_v"))
    b = new.select(*keys, F.col("v").alias("new_v"))
    return a.join(b, keys, "full")


def merge_prefer_incoming(old: DataFrame, new: DataFrame) -> DataFrame:
    """Incoming values win; an incoming null erases nothing."""
    return _both(old, new).select(*KT, F.coalesce("new_v", "old_v").alias("v"))


def merge_preserve_existing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Incoming values fill holes only."""
    return _both(old, new).select(*KT, F.coalesce("old_v", "new_v").alias("v"))


def merge_dated_series(old: DataFrame, new: DataFrame, policy: DataFrame) -> DataFrame:
    """Incoming values win where the policy of their key accepts them; rows without a value go. policy: k and limits, a dimension."""
    good = new.join(policy, "k", "left").filter(acceptable()).select(*KT, "v")
    return merge_prefer_incoming(old, good).filter("v IS NOT NULL")


def combine_first(*frames: DataFrame) -> DataFrame:
    """Values of several panels; later ones win where they have one."""
    rows = reduce(DataFrame.unionByName, [f.select(*KT, "v", F.lit(i).alias("priority")) for i, f in enumerate(frames)])
    return rows.groupBy(*KT).agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("priority"))).alias("v"))


def replace_tail(old: DataFrame, official: DataFrame) -> DataFrame:
    """Old rows before the first official date of their key, official rows from then on."""
    first = official.groupBy("k").agg(F.min("t").alias("first"))
    kept = old.join(first, "k", "left").filter("first IS NULL OR t < first").select(*KT, "v")
    return kept.unionByName(official.select(*KT, "v"))


def merge_bounded(dense: DataFrame, official: DataFrame) -> DataFrame:
    """Official over dense values; null beyond the official latest date of the key."""
    last = official.groupBy("k").agg(F.max("t").alias("last"))
    rows = merge_prefer_incoming(dense, official).join(last, "k", "left")
    return rows.select(*KT, F.when((F.col("last").isNotNull()) & (F.col("t") > F.col("last")), None).otherwise(F.col("v")).alias("v"))


def merge_changes(old: DataFrame, new: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """By key: dates added, values updated beyond the tolerance, latest date."""
    rows = _both(old, new)
    added = F.col("old_v").isNull() & F.col("new_v").isNotNull()
    updated = F.abs(F.col("old_v") - F.col("new_v")) > tolerance
    return rows.groupBy("k").agg(F.sum(added.cast("int")).alias("added"), F.sum(F.coalesce(updated, F.lit(False)).cast("int")).alias("updated"), F.max("t").alias("latest"))


def merge_fallback(primary: DataFrame, secondary: DataFrame, live: str | None = None) -> DataFrame:
    """Secondary rows on dates that the primary lacks, and on one live date."""
    more = secondary.join(primary.select(*KT), KT, "left_anti")
    base = primary
    if live:
        base = primary.join(secondary.filter(F.col("t") == F.lit(live)).select(*KT), KT, "left_anti")
        more = more.unionByName(secondary.filter(F.col("t") == F.lit(live)).join(primary.select(*KT), KT, "left_semi"))
    return base.select(*KT, "v").unionByName(more.select(*KT, "v"))


def append_after(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows, and new ones strictly after the latest old date of their key."""
    last = old.groupBy("k").agg(F.max("t").alias("last"))
    return old.select(*KT, "v").unionByName(new.join(last, "k", "left").filter("last IS NULL OR t > last").select(*KT, "v"))


def merge_ohlcv(primary: DataFrame, supplement: DataFrame) -> DataFrame:
    """The supplement's price wins; its other fields win where they have a value."""
    columns = ["open", "high", "low", "v", "volume"]
    a = primary.select(*KT, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = supplement.select(*KT, *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, KT, "full").select(*KT, *[F.coalesce(f"b_{c}", f"a_{c}").alias(c) for c in columns])


def union_dates(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select("t") for f in frames]).distinct()


def new_signal_rows(candidate: DataFrame, base: DataFrame, days: int = 5) -> DataFrame:
    """Signals (k, side, t) of the candidate without one of the base's within some days, of the same series and side: the base's nearest before and after tell."""
    rows = candidate.select("k", "side", "t", F.lit(False).alias("known")).unionByName(base.select("k", "side", "t", F.lit(True).alias("known")))
    there = F.when(F.col("known"), F.col("t"))
    w = Window.partitionBy("k", "side")
    before = F.last(there, True).over(w.orderBy("t").rangeBetween(Window.unboundedPreceding, 0))
    after = F.last(there, True).over(w.orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0))
    near = F.coalesce(F.datediff("t", "before") <= days, F.lit(False)) | F.coalesce(F.datediff("after", "t") <= days, F.lit(False))
    return rows.withColumn("before", before).withColumn("after", after).filter(~F.col("known") & ~near).select("k", "side", "t")


def overlap(a: DataFrame, b: DataFrame, key: str = "k") -> DataFrame:
    """Members of both cohorts; empty when they are disjoint."""
    return a.select(key).intersect(b.select(key))


def split_recent_history(df: DataFrame, years: int = 11) -> DataFrame:
    """The rows with their segment: recent from the key's latest date less some years on."""
    last = F.max("t").over(Window.partitionBy("k"))
    return df.withColumn("segment", F.when(F.col("t") >= F.add_months(last, -12 * years), "recent").otherwise("history"))


def incremental_start(df: DataFrame, keys: DataFrame, fallback: str, overlap_days: int) -> DataFrame:
    """Where the next read of each key begins: its latest date less the overlap, not before the fallback."""
    last = df.groupBy("k").agg(F.max("t").alias("latest"))
    start = F.greatest(F.date_sub("latest", overlap_days), F.lit(fallback).cast("date"))
    return keys.join(last, "k", "left").select("k", F.coalesce(start, F.lit(fallback).cast("date")).alias("start"))


def project_since(df: DataFrame, since: str, overlap_days: int = 35) -> DataFrame:
    return df.filter(F.col("t") >= F.date_sub(F.lit(since).cast("date"), max(7, overlap_days)))


def partition_manifest(df: DataFrame) -> DataFrame:
    return df.groupBy("k").agg(F.count("*").alias("n"), F.max("t").alias("latest"))


def latest_snapshot(df: DataFrame, by: str = "market") -> DataFrame:
    """Only rows on the latest date that their market has."""
    return df.withColumn("_last", F.max("t").over(Window.partitionBy(by))).filter("t = _last").drop("_last")
