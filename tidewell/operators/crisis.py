"""Crisis scores from rate curves, labour and credit: as-of over a union calendar, inversions as episodes, reports by the week.

All is windows over one key but the reports, whose weeks begin at the last report: they walk dates and stages only.
"""

from __future__ import annotations

import datetime
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The series, how many observations back each is compared (0: not), and whether its dates are report dates.
SERIES = {"curve2y": (63, True), "curve3m": (63, True), "unemployment": (0, False), "claims": (0, False), "spread": (63, True), "sahm": (0, False), "funds": (6, False), "vix": (20, True), "fx": (20, True)}
UNINVERTED_DAYS, INVERTED_DAYS, REPORT_DAYS = 365, 548, 7


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _round(x: Column) -> Column:
    """Halves up, as scores are rounded."""
    return F.floor(x + 0.5).cast("int")


def _aligned(df: DataFrame) -> DataFrame:
    """(k, t) with each series' last observation so far, and the one some observations before it. df: k, name, t, v."""
    own = Window.partitionBy("k", "name").orderBy("t")
    rows = df.filter(F.col("v").isNotNull() & F.col("name").isin(*SERIES))
    before = F.coalesce(*[F.when(F.col("name") == name, F.lag("v", n).over(own)) for name, (n, _) in SERIES.items() if n])
    mean4 = F.avg("v").over(own.rowsBetween(-3, 0))
    low = F.coalesce(F.min("v").over(own.rowsBetween(-52, -1)), F.col("v"))
    rows = rows.select("k", "t", "name", F.struct("v", before.alias("before"), mean4.alias("mean4"), F.when(low > 0, mean4 / low - 1).otherwise(0.0).alias("rise")).alias("x"))
    daily = F.max(F.col("name").isin(*[n for n, (_, d) in SERIES.items() if d])).alias("report")
    wide = rows.groupBy("k", "t").agg(daily, *[F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in SERIES])
    so_far = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    filled = wide.select("k", "t", "report", *[F.last(n, True).over(so_far).alias(n) for n in SERIES])
    return filled.filter("report AND (curve2y IS NOT NULL OR curve3m IS NOT NULL)").drop("report")


def crisis_scores(df: DataFrame) -> DataFrame:
    """A score for each date of the union calendar, its parts, its stage, and the readings behind it. df: k, name (of SERIES), t, v; dates are unique by name."""
    rows = _aligned(df)
    w = Window.partitionBy("k").orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    active = F.coalesce(F.col("curve2y.v") < 0, F.lit(False)) | F.coalesce(F.col("curve3m.v") < 0, F.lit(False))
    rows = rows.withColumn("active", active).withColumn("was", F.coalesce(F.lag("active").over(w), F.lit(False)))
    began = F.last(F.when(F.col("active") & ~F.col("was"), F.col("t")), True).over(so_far)
    inverted = F.last(F.when(F.col("active"), F.col("t")), True).over(so_far)
    ended = F.last(F.when(~F.col("active") & F.col("was"), F.col("t")), True).over(so_far)
    rows = rows.withColumn("days", F.when(F.col("active"), F.datediff("t", began)).otherwise(0)).withColumn("since", F.datediff("t", inverted)).withColumn("since_end", F.datediff("t", ended))
    move = lambda c: F.col(f"{c}.v") - F.col(f"{c}.before")
    both = F.coalesce((F.col("curve2y.v") < 0) & (F.col("curve3m.v") < 0), F.lit(False))
    speed = F.coalesce(F.greatest(move("curve2y"), move("curve3m")), F.lit(0.0))
    recent = F.coalesce(F.col("since_end") <= UNINVERTED_DAYS, F.lit(False))
    curve = (
        F.when(F.col("active"), 12 + F.least(F.lit(12.0), F.col("days") / 30) + F.when(both, 4).otherwise(0))
        .when(recent, 24 + _unit(speed / 0.8) * 10 + _unit(1 - F.col("since_end") / UNINVERTED_DAYS) * 6)
        .when(F.col("since") <= INVERTED_DAYS, 8 + _unit(1 - F.col("since") / INVERTED_DAYS) * 8)
        .otherwise(0.0)
    )
    sahm, rise, spread = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("sahm.v", "claims.rise", "spread.v"))
    labor = _unit((sahm - 0.1) / 0.65) * 20 + _unit((rise - 0.05) / 0.25) * 10
    credit = _unit((spread - 1.5) / 2.5) * 20 + _unit(F.coalesce(move("spread"), F.lit(0.0)) - 0.1) * 10
    rows = rows.withColumn("c", F.least(F.lit(40.0), curve)).withColumn("l", labor).withColumn("d", credit).withColumn("uninversion", ~F.col("active") & recent)
    # Curves alone don't warn, and no crisis goes without labour and credit.
    total = F.least(F.lit(100.0), F.col("c") + F.col("l") + F.col("d"))
    total = F.when(F.col("uninversion") & (F.col("l") < 8) & (F.col("d") < 8), F.least(total, F.lit(49.0))).otherwise(total)
    total = F.when((total >= 75) & ((F.col("l") < 12) | (F.col("d") < 10)), 74.0).otherwise(total)
    change = lambda c: F.when(F.col(f"{c}.before") > 0, F.col(f"{c}.v") / F.col(f"{c}.before") - 1)
    out = rows.select(
        "k", "t", _round(total).alias("score"), _round(F.col("c")).alias("curve"), _round(F.col("l")).alias("labor"), _round(F.col("d")).alias("credit"), "uninversion", "curve2y.v", F.col("curve3m.v").alias("curve3m"), F.col("unemployment.v").alias("unemployment"),
        _round(F.col("claims.mean4")).alias("claims4"), F.col("spread.v").alias("spread"), F.col("sahm.v").alias("sahm"), F.col("funds.v").alias("funds"), move("funds").alias("funds_change"), F.col("vix.v").alias("vix"), change("vix").alias("vix_change"), F.col("fx.v").alias("fx"), change("fx").alias("fx_change"),
    ).withColumnRenamed("v", "curve2y")
    return out.withColumn("stage", F.when(F.col("score") >= 75, "crisis").when(F.col("score") >= 50, "warning").when(F.col("score") >= 25, "caution").otherwise("stable"))


def reported(scores: DataFrame, days: int = REPORT_DAYS) -> DataFrame:
    """The scores that are reported: a week after the last report, at changes of stage, and the last one."""
    kind = dict(scores.dtypes)["k"]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        kept: list[datetime.date] = []
        stage = None
        rows = list(group.sort_values("t")[["t", "stage"]].itertuples(index=False, name=None))
        for i, (t, now) in enumerate(rows):
            if not kept or t - kept[-1] >= datetime.timedelta(days) or now != stage or i == len(rows) - 1:
                kept.append(t)
                stage = now
        return pd.DataFrame({"k": [key[0]] * len(kept), "t": kept})

    return scores.join(scores.select("k", "t", "stage").groupBy("k").applyInPandas(run, f"k {kind}, t date"), ["k", "t"])
