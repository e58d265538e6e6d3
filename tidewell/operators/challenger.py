"""A cross-sectional challenger: boosted trees on each day's ranks, refitted every few months on what was known then, and judged rung by rung.

Each refit is a distributed fit over rows whose targets lie before its period; periods are few, and one is fitted after the other. Later rungs are read only if the one
before passed.
"""

from __future__ import annotations

import datetime

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versioned import stored
from .aggregates import rank_average

# Months between refits, the least rows of a day, of a fit and of a judgement, and the shares of series by cohort.
REFIT_MONTHS, LEAST_DAY, LEAST_FIT, LEAST_JUDGED = 3, 5, 200, 100
COHORTS = (("development", 60), ("holdout", 80), ("audit", 100))


def day_rank(c: str) -> Column:
    """Rank of a day's values, ties averaged, centred at 0; null on days with few rows."""
    w = Window.partitionBy("t")
    return F.when((F.count(c).over(w) >= LEAST_DAY) & F.col(c).isNotNull(), rank_average(c, w) / F.count(c).over(w) - 0.5)


def cohort(k: Column) -> Column:
    """Development, holdout or audit, by the series alone."""
    bucket = F.pmod(F.xxhash64(k.cast("string")), F.lit(100))
    out = None
    for name, until in COHORTS:
        out = F.when(bucket < until, name) if out is None else out.when(bucket < until, name)
    return out


def ranked_samples(samples: DataFrame, features: list[str]) -> DataFrame:
    """(k, t, target_t, y, label, x): the features' and the outcome's ranks of the day; a feature that is missing is in the middle."""
    rows = samples.select("k", "t", "target_t", "y", day_rank("y").alias("label"), *[F.coalesce(day_rank(c), F.lit(0.0)).alias(c) for c in features]).filter("label IS NOT NULL")
    return VectorAssembler(inputCols=features, outputCol="x").transform(rows).select("k", "t", "target_t", "y", "label", "x")


def periods(first: datetime.date, last: datetime.date, months: int = REFIT_MONTHS) -> list[tuple[datetime.date, datetime.date]]:
    """Spans of some months from ``first`` on that cover the dates until ``last``; the end of each is the beginning of the next."""
    out, start = [], first
    while start <= last:
        month = start.year * 12 + start.month - 1 + months
        end = datetime.date(month // 12, month % 12 + 1, 1)
        out.append((start, end))
        start = end
    return out


def rolling_predictions(rows: DataFrame, train: DataFrame, first: datetime.date, last: datetime.date, months: int = REFIT_MONTHS, trees: int = 10, depth: int = 3, seed: int = 17) -> DataFrame:
    """The rows from ``first`` to ``last`` with predictions of models that were fitted on ``train``'s rows whose targets lie before each period. Periods with too few of these have none."""
    out = None
    for start, end in periods(first, last, months):
        known = train.filter(F.col("target_t") < F.lit(start))
        if known.count() < LEAST_FIT:
            continue
        # The same rows in the same order give the same trees; sums may still differ in their last digits, which are rounded off.
        ordered = known.repartitionByRange(8, "t", "k").sortWithinPartitions("t", "k")
        model = GBTRegressor(featuresCol="x", labelCol="label", predictionCol="predicted", maxIter=trees, maxDepth=depth, seed=seed).fit(ordered)
        inside = rows.filter((F.col("t") >= F.lit(start)) & (F.col("t") < F.lit(end)) & (F.col("t") <= F.lit(last)))
        told = model.transform(inside).select("k", "t", "target_t", "y", "label", F.round("predicted", 12).alias("predicted"), F.lit(start).alias("cutoff"))
        out = told if out is None else out.unionByName(told)
    return out if out is not None else rows.select("k", "t", "target_t", "y", "label", F.lit(None).cast("double").alias("predicted"), F.lit(None).cast("date").alias("cutoff")).limit(0)


def judged(predictions: DataFrame) -> DataFrame:
    """One row: days, rows, the mean rank correlation of predictions and outcomes by day and how often it is positive, and the highest fifth's outcome less the lowest's."""
    w = Window.partitionBy("t")
    rows = predictions.withColumn("p", day_rank("predicted")).filter("p IS NOT NULL")
    spread = F.nullif(F.sqrt(F.var_pop("p") * F.var_pop("label")), F.lit(0.0))
    fifth = F.ceil((F.row_number().over(w.orderBy("predicted", "k")) / F.count("*").over(w)) * 5)
    days = rows.withColumn("fifth", fifth).groupBy("t").agg(F.count("*").alias("n"), (F.covar_pop("p", "label") / spread).alias("ic"), (F.avg(F.when(F.col("fifth") == 5, F.col("y"))) - F.avg(F.when(F.col("fifth") == 1, F.col("y")))).alias("gap"))
    return days.agg(F.count("*").alias("days"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.avg("ic").alias("ic"), F.avg((F.col("ic") > 0).cast("double")).alias("ic_positive"), F.avg("gap").alias("gap"))


def passes(row) -> bool:
    return row.n >= LEAST_JUDGED and row.ic is not None and row.ic > 0 and row.gap is not None and row.gap > 0


def run_challenger(samples: DataFrame, features: list[str], first: datetime.date, last: datetime.date, months: int = REFIT_MONTHS, **trees) -> DataFrame:
    """(rung, status, days, n, ic, ic_positive, gap): later dates of the series that the models know, then of the held-out ones, then of the audited ones.

    All models are fitted on the development series. A rung is read only if the one before it passed; else it stays locked.
    """
    rows = stored(ranked_samples(samples, features).withColumn("cohort", cohort(F.col("k"))).withColumn("x", vector_to_array("x")), "challenger")
    width = len(features)
    rows = VectorAssembler(inputCols=[f"x{i}" for i in range(width)], outputCol="x").transform(rows.select("k", "t", "target_t", "y", "label", "cohort", *[F.col("x")[i].alias(f"x{i}") for i in range(width)]))
    train = rows.filter("cohort = 'development'")
    out, open_ = None, True
    for rung, _ in COHORTS:
        if open_:
            found = judged(rolling_predictions(rows.filter(F.col("cohort") == rung), train, first, last, months, **trees)).first()
            open_ = passes(found)
            one = samples.sparkSession.createDataFrame([(rung, "passed" if open_ else "failed", *found)], "rung string, status string, days long, n long, ic double, ic_positive double, gap double")
        else:
            one = samples.sparkSession.createDataFrame([(rung, "locked", None, None, None, None, None)], "rung string, status string, days long, n long, ic double, ic_positive double, gap double")
        out = one if out is None else out.unionByName(one)
    return out
