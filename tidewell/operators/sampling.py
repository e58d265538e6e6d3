"""Top lists, retention, deterministic splits, anchors and purged folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_universe(df: DataFrame, n: int) -> DataFrame:
    """The n largest of each market; a code that comes twice counts with its largest value. df: market, code, cap."""
    one = df.groupBy("market", "code").agg(F.max("cap").alias("cap"))
    w = Window.partitionBy("market").orderBy(F.desc("cap"), "code")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def retain_tiered(df: DataFrame, dense: int, weekly: int, monthly: int, limit: int) -> DataFrame:
    """Rows that stay, with their tier: the latest ones, then one a week, then one a month, then the latest of the rest up to the limit."""
    new = Window.partitionBy("k").orderBy(F.desc("t"))
    rows = df.withColumn("i", F.row_number().over(new))
    week = F.floor(F.datediff("t", F.lit("1970-01-01")) / 7)
    late = F.col("i") > dense
    first_of_week = F.row_number().over(Window.partitionBy("k", late, week).orderBy(F.desc("t"))) == 1
    rows = rows.withColumn("late", late).withColumn("w", F.when(late & first_of_week, 1).otherwise(0))
    rows = rows.withColumn("wn", F.sum("w").over(new.rowsBetween(Window.unboundedPreceding, 0)))
    in_week = (F.col("w") == 1) & (F.col("wn") <= weekly)
    rows = rows.withColumn("in_week", in_week)
    cursor = F.min(F.when(F.col("in_week"), F.col("t"))).over(Window.partitionBy("k"))
    rows = rows.withColumn("old", F.col("late") & (F.col("t") < cursor))
    first_of_month = F.row_number().over(Window.partitionBy("k", "old", F.trunc("t", "month")).orderBy(F.desc("t"))) == 1
    rows = rows.withColumn("m", F.when(F.col("old") & first_of_month, 1).otherwise(0))
    rows = rows.withColumn("mn", F.sum("m").over(new.rowsBetween(Window.unboundedPreceding, 0)))
    tier = F.when(~F.col("late"), "dense").when(F.col("in_week"), "weekly").when((F.col("m") == 1) & (F.col("mn") <= monthly), "monthly")
    rows = rows.withColumn("tier", tier)
    rest = F.row_number().over(Window.partitionBy("k").orderBy(F.col("tier").isNull(), F.desc("t")))
    return rows.withColumn("place", rest).filter((F.col("place") <= limit)).select("k", "t", F.coalesce("tier", F.lit("backfill")).alias("tier"))


def hash_holdout(df: DataFrame, strata: str, key: str, share: float, seed: str) -> DataFrame:
    """A deterministic split: in each stratum, by the order of hashes, a rounded share (half to even) is held out; at least one is, and one isn't."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(strata).cast("string"), F.col(key).cast("string")), 256)
    n = F.count("*").over(Window.partitionBy(strata))
    size = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * share, 0).cast("int")))
    rows = df.select(strata, key).distinct().withColumn("n", n).withColumn("rn", F.row_number().over(Window.partitionBy(strata).orderBy(h, key)))
    return rows.select(strata, key, (F.col("rn") <= size).alias("held_out"))


def fnv_bucket(s: Column, n: int) -> Column:
    """FNV-1a of the characters' codes (32 bits) modulo n."""
    steps = F.transform(F.split(s, ""), F.ascii)
    return F.aggregate(steps, F.lit(2166136261).cast("bigint"), lambda h, c: F.pmod(h.bitwiseXOR(c.cast("bigint")) * F.lit(16777619).cast("bigint"), F.lit(1 << 32))) % n


def sample_anchors(df: DataFrame, step: int) -> DataFrame:
    """Every step-th row of each series."""
    i = F.row_number().over(Window.partitionBy("k").orderBy("t")) - 1
    return df.withColumn("i", i).filter(F.col("i") % step == 0)


def purged_folds(samples: DataFrame, folds: int, least_share: float = 0.5) -> DataFrame:
    """(fold, role, k, t): validation blocks are the later dates in equal blocks; training rows' targets (target_t) end strictly before the block."""
    days = samples.select("t").distinct()
    # The calendar of all samples is a dimension of dates, not the panel.
    n = days.withColumn("share", F.percent_rank().over(Window.orderBy("t")))
    blocks = n.filter(F.col("share") >= least_share).withColumn("fold", F.ntile(folds).over(Window.orderBy("t")))
    bounds = F.broadcast(blocks.groupBy("fold").agg(F.min("t").alias("a"), F.max("t").alias("b")))
    rows = samples.join(bounds, (F.col("t").between(F.col("a"), F.col("b"))) | (F.col("target_t") < F.col("a")))
    return rows.select("fold", F.when(F.col("t") >= F.col("a"), "validate").otherwise("train").alias("role"), "k", "t")


def assign_archetypes(df: DataFrame, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """Profiles (market, k, x) tagged by their market's quantiles."""
    cut = df.groupBy("market").agg(F.percentile("x", F.lit(low)).alias("lo"), F.percentile("x", F.lit(high)).alias("hi"))
    tag = F.when(F.col("x") <= F.col("lo"), "low").when(F.col("x") >= F.col("hi"), "high").otherwise("middle")
    return df.join(cut, "market").select("market", "k", tag.alias("tag"))


def balanced_quota(df: DataFrame, quota: int, seed: str) -> DataFrame:
    """Up to a quota of each market and tag, in hash order: a deterministic rule in place of a greedy search."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col("k").cast("string")), 256)
    return df.withColumn("rn", F.row_number().over(Window.partitionBy("market", "tag").orderBy(h, "k"))).filter(F.col("rn") <= quota).drop("rn")
