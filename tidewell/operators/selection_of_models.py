"""Choice of a ridge model by purged walk-forward folds: penalty, random features, blend with a baseline, and length of history.

Training sets are never gathered. For each fold and length of history one grouping makes the sums of products of its samples; every penalty is solved from
these few numbers. The models, which are small, then meet the samples of their validation block, and all choices are measured in one more grouping.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versioned import stored

# The grid, the years of validation, the random features, and what reliability is measured by.
LOOKBACKS, PENALTIES, BLENDS, HIDDEN = (5, 10, 15, 25), (16.0, 64.0, 256.0, 1024.0, 4096.0), (0.6, 0.8, 1.0), (0, 8, 16)
FOLDS, VALIDATION_MONTHS, LEAST_DATES, LEAST_SAMPLES = 3, 36, 12, 200
SCALE, BIAS = 0.32, 0.8
GAIN, EDGE, FULL_SAMPLE = 0.12, 0.08, 3000.0


def bound(vol: Column, horizon: int) -> Column:
    """How far a forecast may go: by volatility, between a floor of its horizon and 0.75."""
    floor = 0.12 if horizon <= 20 else 0.25 if horizon <= 63 else 0.45
    return F.least(F.lit(0.75), F.greatest(F.lit(floor), vol * math.sqrt(horizon) * 2.5))


def hidden_features(features: list[str], size: int, seed: int = 7) -> dict[str, Column]:
    """Hyperbolic tangents of fixed random sums of the features."""
    r = np.random.default_rng(seed)
    weights, biases = r.uniform(-SCALE, SCALE, (size, len(features))), r.uniform(-BIAS, BIAS, size)
    return {f"h{i}": F.tanh(sum((F.col(c) * float(w) for c, w in zip(features, row, strict=True)), F.lit(float(b)))) for i, (row, b) in enumerate(zip(weights, biases, strict=True))}


def validation_blocks(samples: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(g, fold, start, end): blocks of the recent anchor dates of each group; of the last two fifths where these are too few."""
    w = Window.partitionBy("g")
    dates = samples.select("g", "t").distinct().withColumn("last", F.max("t").over(w)).withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("t")) - 1)
    dates = dates.withColumn("recent", F.col("t") >= F.add_months("last", -VALIDATION_MONTHS)).withColumn("n_recent", F.count_if("recent").over(w))
    chosen = dates.filter(F.when(F.col("n_recent") >= LEAST_DATES, F.col("recent")).otherwise(F.col("i") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.6))))
    return chosen.withColumn("fold", F.ntile(folds).over(w.orderBy("t")) - 1).groupBy("g", "fold").agg(F.min("t").alias("start"), F.max("t").alias("end"))


def ridge_models(rows: DataFrame, by: list[str], features: list[str], penalties: tuple[float, ...], least: int) -> DataFrame:
    """(by, penalty, n, intercept, coefficients) of each group: features standardised, targets held between their 1st and 99th percentile, the intercept free.

    A group comes to its task as one row of sums, whatever its number of samples.
    """
    limits = rows.groupBy(*by).agg(F.percentile("y", F.array(F.lit(0.01), F.lit(0.99))).alias("q"), F.count("*").alias("n_limits"))
    held = rows.join(limits, by).withColumn("y", F.when(F.col("n_limits") >= 20, F.greatest(F.least("y", F.col("q")[1]), F.col("q")[0])).otherwise(F.col("y")))
    x = [*features, "y"]
    pairs = list(itertools.combinations_with_replacement(range(len(x)), 2))
    sums = held.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(F.col(x[i]) * F.col(x[j])) for i, j in pairs]).alias("p")).filter(F.col("n") >= least)
    p, kinds = len(features), dict(rows.dtypes)

    def solve(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                n, mean = row["n"], np.array(row["s"]) / row["n"]
                second = np.zeros((p + 1, p + 1))
                for (i, j), v in zip(pairs, row["p"], strict=True):
                    second[i, j] = second[j, i] = v
                spread = second - n * np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(spread)[:p], 0) / max(n - 1, 1))
                sd = np.where(sd > 1e-9, sd, 1.0)
                for penalty in penalties:
                    beta = np.linalg.solve(spread[:p, :p] / np.outer(sd, sd) + penalty * np.eye(p), spread[:p, p] / sd) / sd
                    out.append([*(row[c] for c in by), penalty, n, float(mean[p] - mean[:p] @ beta), beta.tolist()])
            yield pd.DataFrame(out, columns=[*by, "penalty", "n", "intercept", "coefficients"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", penalty double, n long, intercept double, coefficients array<double>"
    return sums.mapInPandas(solve, schema)


def _raw(features: list[str]) -> Column:
    return sum((F.col(c) * F.col("coefficients")[i] for i, c in enumerate(features)), F.col("intercept"))


def reliability(improvement: Column, direction: Column, wins: Column, folds: Column, n: Column) -> Column:
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    score = unit((0.5 * unit(improvement / GAIN) + 0.25 * unit((direction - 0.5) / EDGE) + 0.25 * unit(wins / folds)) * unit(n / FULL_SAMPLE))
    return F.when((improvement > 0) & (direction >= 0.5) & (folds > 0), score).otherwise(0.0)


def select_models(
    samples: DataFrame, features: list[str], horizon: int, lookbacks: tuple[int, ...] = LOOKBACKS, penalties: tuple[float, ...] = PENALTIES, blends: tuple[float, ...] = BLENDS, hidden: tuple[int, ...] = HIDDEN, folds: int = FOLDS, least: int = LEAST_SAMPLES
) -> DataFrame:
    """By group g the choice with the least mean absolute error over its validation blocks, its measures, and its model of the whole history.

    samples: g, t, target_t, y, baseline, vol and features, without nulls. A block's training samples have their targets before it. Of equal errors the
    better direction counts, then fewer random features, the smaller penalty and blend, the shorter history. Groups with fewer than two blocks go.
    """
    samples = stored(samples, "selection")
    blocks = stored(validation_blocks(samples, folds), "selection")
    ranges = blocks.withColumn("years", F.explode(F.array(*map(F.lit, lookbacks)))).withColumn("since", F.add_months("start", -12 * F.col("years")))
    measured, expanded = None, {}
    for size in hidden:
        extra = hidden_features(features, size)
        names = [*features, *extra]
        expanded[size] = names, samples.withColumns(extra) if extra else samples
        rows = expanded[size][1]
        training = rows.join(ranges, "g").filter((F.col("target_t") < F.col("start")) & (F.col("t") >= F.col("since")))
        models = stored(ridge_models(training, ["g", "fold", "years"], names, penalties, least).withColumnRenamed("n", "n_training"), "selection")
        validation = rows.join(blocks, "g").filter(F.col("t").between(F.col("start"), F.col("end"))).join(models, ["g", "fold"])
        tried = validation.withColumn("raw", _raw(names)).select("g", "fold", "years", "penalty", F.lit(size).alias("hidden"), "y", "baseline", "vol", "raw").withColumn("blend", F.explode(F.array(*map(F.lit, blends))))
        limit = bound(F.col("vol"), horizon)
        tried = tried.withColumn("predicted", F.greatest(F.least(F.col("baseline") + (F.col("raw") - F.col("baseline")) * F.col("blend"), limit), -limit))
        measured = tried if measured is None else measured.unionByName(tried)
    same = lambda c: (F.signum("y") == F.signum(c)).cast("int")
    choice = ["g", "years", "hidden", "penalty", "blend"]
    by_fold = measured.groupBy(*choice, "fold").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("y") - F.col("predicted"))).alias("e"), F.sum(F.abs(F.col("y") - F.col("baseline"))).alias("b"), F.sum(same("predicted")).alias("d"), F.sum(same("baseline")).alias("db"))
    n = F.sum("n")
    all_folds = by_fold.groupBy(*choice).agg(n.alias("n_validation"), (F.sum("e") / n).alias("mae"), (F.sum("b") / n).alias("baseline_mae"), (F.sum("d") / n).alias("direction"), (F.sum("db") / n).alias("baseline_direction"), F.count("*").alias("folds"), F.count_if(F.col("e") < F.col("b")).alias("wins")).filter("folds >= 2")
    # Errors that differ by rounding alone are equal.
    error = F.round("mae", 12)
    own = Window.partitionBy("g", "years").orderBy(error, F.desc("direction"), "hidden", "penalty", "blend")
    best = all_folds.withColumn("_r", F.row_number().over(own)).filter("_r = 1").withColumn("_r", F.row_number().over(Window.partitionBy("g").orderBy(error, F.desc("direction"), "years"))).filter("_r = 1").drop("_r")
    best = stored(best, "selection")
    residual = F.col("y") - F.col("predicted")
    spread = measured.join(best.select(*choice), choice).groupBy("g").agg(F.percentile(residual, F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    improvement = F.when(F.col("baseline_mae") > 1e-9, (F.col("baseline_mae") - F.col("mae")) / F.col("baseline_mae")).otherwise(0.0)
    best = best.join(spread, "g").select(*choice, "n_validation", "folds", "wins", "mae", "baseline_mae", improvement.alias("improvement"), "direction", "baseline_direction", F.col("q")[0].alias("residual_low"), F.col("q")[1].alias("residual_high"))
    best = best.withColumn("reliability", reliability(F.col("improvement"), F.col("direction"), F.col("wins"), F.col("folds"), F.col("n_validation")))
    last = samples.groupBy("g").agg(F.max("t").alias("last"))
    final = None
    for size, (names, rows) in expanded.items():
        kept = rows.join(best.filter(F.col("hidden") == size).select("g", "years", F.col("penalty").alias("own")), "g").join(last, "g").filter(F.col("t") >= F.add_months("last", -12 * F.col("years")))
        fitted = ridge_models(kept, ["g", "own"], names, penalties, 1).filter("penalty = own").select("g", F.col("n").alias("n_training"), "intercept", "coefficients")
        final = fitted if final is None else final.unionByName(fitted)
    return best.join(final, "g")
