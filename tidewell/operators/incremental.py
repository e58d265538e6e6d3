"""Incremental merges of a provider on another base, and cohorts by tiers for forecasts as they were made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merge import merge_prefer_incoming
from .quality import accept_tail

# Overlaps that say something about the base, and the factors that count.
LEAST_OVERLAPS, LAST_OVERLAPS, LOWEST, HIGHEST, IGNORED = 5, 20, 0.5, 2.0, 0.02


def base_factors(seed: DataFrame, live: DataFrame) -> DataFrame:
    """(k, factor): what brings the live values to the seed's base: the median ratio of the last common dates; 1 with few of them, or where it is about 1 or out of bounds."""
    both = seed.select("k", "t", F.col("v").alias("a")).join(live.select("k", "t", F.col("v").alias("b")), ["k", "t"]).filter("a > 0 AND b > 0")
    w = Window.partitionBy("k")
    last = both.withColumn("n", F.count("*").over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("t")))).filter(F.col("back") <= LAST_OVERLAPS)
    found = last.groupBy("k").agg(F.percentile(F.col("a") / F.col("b"), F.lit(0.5)).alias("m"), F.max("n").alias("n"))
    counts = (F.col("n") >= LEAST_OVERLAPS) & F.col("m").between(LOWEST, HIGHEST) & ((F.col("m") > 1 + IGNORED) | (F.col("m") < 1 - IGNORED))
    return found.select("k", F.when(counts, F.col("m")).otherwise(1.0).alias("factor"))


def merge_incremental(seed: DataFrame, live: DataFrame, rel: float) -> DataFrame:
    """The seed with what follows of the live rows, brought to its base, as far as they follow from its last value. Keys without a seed take the live rows as they are."""
    moved = live.join(base_factors(seed, live), "k", "left").select("k", "t", (F.col("v") * F.coalesce("factor", F.lit(1.0))).alias("v"))
    new = live.filter("v IS NOT NULL").join(seed.filter("v IS NOT NULL").select("k").distinct(), "k", "left_anti").select("k", "t", "v")
    return merge_prefer_incoming(seed.select("k", "t", "v"), accept_tail(seed, moved, rel).unionByName(new))


Tiers = list[tuple[str, int, list[str]]]


def _keys(tiers: Tiers) -> Column:
    """A struct for each tier whose columns are all known: its number and its key."""
    made = []
    for i, (_, _, columns) in enumerate(tiers):
        known = F.lit(True)
        for c in columns:
            known = known & F.col(c).isNotNull()
        made.append(F.when(known, F.struct(F.lit(i).alias("tier"), F.to_json(F.struct(*columns) if columns else F.struct(F.lit(0).alias("all"))).alias("key"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def choose_tiers(forecasts: DataFrame, records: DataFrame, tiers: Tiers) -> DataFrame:
    """(id, tier, n, bias) of each forecast: the first tier that has enough records which were known when it was made, and their weighted mean error.

    forecasts: id, as_of and the tiers' columns. records: actual_t, error, weight and the same columns. A tier is (name, least records, columns that must be equal).
    Records are summed up by tier, key and day before anything is ordered, so that a tier of all records has a row for each day, not for each record.
    """
    days = records.withColumn("x", F.explode(_keys(tiers))).groupBy("x.tier", "x.key", F.col("actual_t").alias("t")).agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("error")).alias("we"))
    asked = forecasts.withColumn("x", F.explode(_keys(tiers))).select("id", F.col("as_of").alias("t"), "x.tier", "x.key")
    points = days.unionByName(asked.select("tier", "key", "t").distinct().selectExpr("tier", "key", "t", "0L AS n", "0D AS w", "0D AS we"))
    so_far = Window.partitionBy("tier", "key").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    known = points.select("tier", "key", "t", *[F.sum(c).over(so_far).alias(c) for c in ("n", "w", "we")]).distinct()
    least = F.get(F.array(*[F.lit(m) for _, m, _ in tiers]), F.col("tier"))
    enough = asked.join(known, ["tier", "key", "t"]).filter(F.col("n") >= least)
    best = enough.groupBy("id").agg(F.min(F.struct("tier", "n", "w", "we")).alias("b"))
    names = F.when(F.col("b").isNotNull(), F.get(F.array(*[F.lit(n) for n, _, _ in tiers]), F.col("b.tier")))
    bias = F.col("b.we") / F.nullif("b.w", F.lit(0.0))
    return forecasts.select("id").join(best, "id", "left").select("id", F.coalesce(names, F.lit("none")).alias("tier"), F.coalesce("b.n", F.lit(0)).alias("n"), F.coalesce(bias, F.lit(0.0)).alias("bias"))
