"""Signals on features: regimes, runs, episodes, calibration by matured outcomes, news clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_time():
    """Rows of one series in order of time."""
    return Window.partitionBy("k").orderBy("t")


def classify_regime() -> Column:
    """Ladder of market regimes over the columns adr_min, fear_min, crisis, vkospi_pct, vix_pct, drawdown60, macd_slope, leading_change, change20, news.

    Two signs of stress are stress. A missing operand counts as each step says: no drawdown, no change of the leading index, and
    for the others a value that fails the step.
    """
    c = lambda x, d: F.coalesce(F.col(x), F.lit(d))
    signs = [F.col("adr_min") <= 80, F.col("fear_min") <= 25, F.col("crisis") >= 50, F.col("vkospi_pct") >= 0.8, F.col("vix_pct") >= 0.8]
    low, high = float("-inf"), float("inf")
    return (
        F.when(sum(F.coalesce(x.cast("int"), F.lit(0)) for x in signs) >= 2, "stress")
        .when((c("drawdown60", 0.0) <= -10) & (c("macd_slope", low) > 0) & ((c("adr_min", high) <= 85) | (c("fear_min", high) <= 35)), "recovery")
        .when((c("leading_change", 0.0) < -0.05) & (c("change20", low) >= 0), "slowdown")
        .when((c("change20", low) >= 3) & ((c("leading_change", 0.0) >= 0) | (c("news", low) >= 100)), "expansion")
        .otherwise("range")
    )


def signal_runs(df: DataFrame) -> DataFrame:
    """Consecutive signals of one side in a series: (k, run, side, from, to, n)."""
    flip = F.coalesce((F.col("side") != F.lag("side").over(by_time())).cast("int"), F.lit(1))
    rows = df.withColumn("flip", flip).withColumn("run", F.sum("flip").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("k", "run").agg(F.min("side").alias("side"), F.min("t").alias("from_t"), F.max("t").alias("to_t"), F.count("*").alias("n"))


def collapse_episodes(df: DataFrame, rows: int = 10) -> DataFrame:
    """Signals (k, side, t, i) merged while within some rows of the episode's first one, which doesn't slide. One side of a series is read once, in order."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        heads, counts, first = [], [], None
        for n, i in enumerate(group["i"].tolist()):
            if first is None or i - first > rows:
                first = i
                heads.append(n)
                counts.append(0)
            counts[-1] += 1
        return group.iloc[heads][["k", "side", "t"]].assign(n=counts)

    kinds = dict(df.dtypes)
    return df.select("k", "side", "t", "i").groupBy("k", "side").applyInPandas(fold, f"k {kinds['k']}, side string, t date, n int")


def calibrate_signals(df: DataFrame, horizon: int = 20, least: int = 4, last: int = 24) -> DataFrame:
    """Each signal (k, side, i, ret) with the smoothed hit rate of the series' latest signals of its side that had matured strictly before it.

    Hits are counted up once; a signal's are those at its last matured signal less those ``last`` earlier.
    """
    hit = F.when(F.col("side") == "buy", F.col("ret") > 0).otherwise(F.col("ret") < 0).cast("int")
    side = Window.partitionBy("k", "side").orderBy("i")
    matured = side.rangeBetween(Window.unboundedPreceding, -horizon - 1)
    rows = df.withColumn("n", F.count("ret").over(matured)).withColumn("hits", F.coalesce(F.sum(F.when(F.col("ret").isNotNull(), hit)).over(matured), F.lit(0)))
    known = df.filter("ret IS NOT NULL").select("k", "side", F.row_number().over(side).alias("rank"), F.sum(hit).over(side.rowsBetween(Window.unboundedPreceding, 0)).alias("earlier"))
    out = rows.withColumn("rank", F.col("n") - last).join(known, ["k", "side", "rank"], "left")
    hits, n = F.col("hits") - F.coalesce("earlier", F.lit(0)), F.least("n", F.lit(last))
    return out.select("k", "side", "i", n.alias("n"), F.when(n >= least, (hits + 2) / (n + 4)).alias("hit_rate"))


def regime_probabilities(scores: dict[str, Column]) -> tuple[Column, Column]:
    """Softmax of scores as a map, and its confidence: one less the entropy over its largest."""
    import math

    names = list(scores)
    top = F.greatest(*scores.values())
    exps = {n: F.exp(s - top) for n, s in scores.items()}
    total = sum(exps.values())
    p = {n: e / total for n, e in exps.items()}
    entropy = -sum(x * F.ln(F.greatest(x, F.lit(1e-12))) for x in p.values())
    return F.create_map(*[y for n in names for y in (F.lit(n), p[n])]), 1 - entropy / math.log(len(names))


def threshold_segments(df: DataFrame, level: float) -> DataFrame:
    """Maximal runs above a level: (k, from_t, to_t, n, top)."""
    above = (F.col("v") > level).cast("int")
    rows = df.filter("v IS NOT NULL").withColumn("above", above)
    change = F.coalesce((F.col("above") != F.lag("above").over(by_time())).cast("int"), F.lit(1))
    rows = rows.withColumn("change", change).withColumn("run", F.sum("change").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("above = 1").groupBy("k", "run").agg(F.min("t").alias("from_t"), F.max("t").alias("to_t"), F.count("*").alias("n"), F.max("v").alias("top")).drop("run")
