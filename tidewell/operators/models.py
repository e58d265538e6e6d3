"""Features, samples, ridge regression by Gram matrices, calibration and scoring of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import asof, indicators
from .selection_of_models import ridge_models

FEATURES = ("r5", "r20", "r60", "vol20", "vol60", "draw60", "pos60", "mean20")


def forecast_features(df: DataFrame) -> DataFrame:
    """Features of every row, from earlier rows alone. df: k, t, v."""
    by = indicators.by_time()
    r = F.ln(F.col("v") / F.lag("v").over(by))
    rows = df.withColumn("r1", r)
    w20, w60 = indicators.trailing(20), indicators.trailing(60)
    high, low = F.max("v").over(w60), F.min("v").over(w60)
    return rows.select(
        "k", "t", "v",
        *[F.ln(F.col("v") / F.lag("v", n).over(by)).alias(f"r{n}") for n in (5, 20, 60)],
        F.stddev("r1").over(w20).alias("vol20"), F.stddev("r1").over(w60).alias("vol60"),
        (F.col("v") / high - 1).alias("draw60"), F.when(high > low, (F.col("v") - low) / (high - low)).alias("pos60"), F.ln(F.col("v") / F.avg("v").over(w20)).alias("mean20"),
    )


def build_samples(df: DataFrame, horizon: int = 20, step: int = 21, least: int = 60) -> DataFrame:
    """Every step-th row with all its features and its log return some rows ahead."""
    by = indicators.by_time()
    rows = forecast_features(df).withColumn("y", F.ln(F.lead("v", horizon).over(by) / F.col("v"))).withColumn("target_t", F.lead("t", horizon).over(by))
    rows = rows.withColumn("i", F.row_number().over(by) - 1)
    return rows.filter((F.col("i") >= least) & (F.col("i") % step == 0) & F.col("y").isNotNull() & F.col("r60").isNotNull() & F.col("vol60").isNotNull() & F.col("pos60").isNotNull()).drop("i", "v")


def fit_ridge(samples: DataFrame, by: str, features: tuple[str, ...] = FEATURES, penalty: float = 10.0) -> DataFrame:
    """(by, n, intercept, coefficients): standardised features, targets held between their 1st and 99th percentile, an unpenalised intercept."""
    return ridge_models(samples, [by], list(features), (penalty,), 1).drop("penalty")


def predict(samples: DataFrame, model: DataFrame, by: str, features: tuple[str, ...] = FEATURES) -> DataFrame:
    rows = samples.join(model.select(by, "intercept", "coefficients"), by)
    return rows.withColumn("predicted", F.col("intercept") + sum(F.col(c) * F.col("coefficients")[i] for i, c in enumerate(features)))


def score_journal(journal: DataFrame, prices: DataFrame, late: int = 14) -> DataFrame:
    """Forecasts (k, as_of, target_t, base, predicted) with the first price on or after their target date, and their log error."""
    found = asof.asof_forward(journal.withColumn("t", F.col("target_t")), prices.select("k", "t", "v"), late)
    error = F.ln(F.col("v_right") / F.col("predicted"))
    right = F.signum(F.col("v_right") - F.col("base")) == F.signum(F.col("predicted") - F.col("base"))
    return found.select("k", "as_of", "target_t", F.col("t_right").alias("actual_t"), F.col("v_right").alias("actual"), error.alias("log_error"), right.alias("direction_right"))


def calibrate_predictions(df: DataFrame, by: str, scales: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """By group: the scale of predictions with the least mean absolute error, after a bounded median offset."""
    grid = df.withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    offset = F.greatest(F.least(F.percentile(F.col("y") - F.col("p") * F.col("scale"), F.lit(0.5)), F.lit(0.03)), F.lit(-0.03))
    shifts = grid.groupBy(by, "scale").agg(offset.alias("offset"))
    each = grid.join(shifts, [by, "scale"]).groupBy(by, "scale").agg(F.first("offset").alias("offset"), F.avg(F.abs(F.col("y") - F.col("p") * F.col("scale") - F.col("offset"))).alias("mae"))
    return each.groupBy(by).agg(F.min_by("scale", F.struct("mae", "scale")).alias("scale"), F.min("mae").alias("mae"))


def financial_snapshots(fin: DataFrame) -> DataFrame:
    """At each report date of a series: the periods known by then, each in its latest version. fin: k, period, report_date, v."""
    # A version changes the total by what it differs from the one before it, and the number of periods where it is the first; both add up along the report dates.
    own, known = Window.partitionBy("k", "period").orderBy("report_date"), Window.partitionBy("k").orderBy("report_date").rangeBetween(Window.unboundedPreceding, 0)
    before = F.lag("v").over(own)
    rows = fin.withColumn("first", (F.row_number().over(own) == 1).cast("int")).withColumn("change", F.coalesce("v", F.lit(0.0)) - F.coalesce(before, F.lit(0.0)))
    sums = rows.select("k", F.col("report_date").alias("as_of"), F.sum("first").over(known).alias("periods"), F.sum("change").over(known).alias("total"), F.max("period").over(known).alias("latest_period"))
    return sums.groupBy("k", "as_of").agg(F.max("periods").alias("periods"), F.first("total").alias("total"), F.first("latest_period").alias("latest_period"))


def candidate_profile(df: DataFrame) -> DataFrame:
    """By key: volatility, trend of the log price by year with its fit, largest fall, share of the range."""
    by = indicators.by_time()
    peak = F.max("v").over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("r", F.ln(F.col("v") / F.lag("v").over(by))).withColumn("x", F.datediff("t", F.lit("1995-01-01")) / 365.25).withColumn("dd", F.col("v") / peak - 1).withColumn("l", F.ln("v"))
    return rows.groupBy("k").agg(F.stddev("r").alias("vol"), F.regr_slope("l", "x").alias("trend"), F.regr_r2("l", "x").alias("fit"), F.min("dd").alias("max_drawdown"))
