"""Scores of report evidence, fingerprints of evidence, random features."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights and scales of the evidence score.
POLICY = {
    "eps_weight": 0.58,
    "eps_scale": 0.25,
    "roe_weight": 0.30,
    "roe_scale": 5.0,
    "cut_weight": 0.24,
    "raise_weight": 0.12,
    "neutral_weight": 0.08,
    "cut_scale": 0.12,
    "raise_scale": 0.24,
    "down_scale": 0.024,
    "up_scale": 0.016,
}


def _finite(c: str) -> Column:
    return F.when(F.abs(F.col(c)) < float("inf"), F.col(c))


def _clamp(x: Column, low: float, high: float) -> Column:
    """Between both; null counts as zero."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x, F.lit(0.0))))


def score_evidence(df: DataFrame, policy: Mapping[str, float] = POLICY) -> DataFrame:
    """The rows with signal, confidence and adjustment of a report.

    df: eps_change, roe_change, target_change, cut_breadth, cut_streak, target_deviation, parser_confidence, coverage,
    primary_coverage. Cuts of targets weigh more than raises; what is null or not finite is no evidence. One projection.
    """
    p = policy
    eps, roe, target = _finite("eps_change"), _finite("roe_change"), _finite("target_change")
    rows = df.withColumn(
        "target_signal", F.when(target < 0, _clamp(target / p["cut_scale"], -1, 0)).when(target >= 0, _clamp(target / p["raise_scale"], 0, 1)).otherwise(0.0)
    ).withColumns({"eps_direction": F.when(F.abs(eps) >= 0.02, F.signum(eps)).otherwise(0.0), "roe_direction": F.when(F.abs(roe) >= 0.5, F.signum(roe)).otherwise(0.0)})
    t, e, r = F.col("target_signal"), F.col("eps_direction"), F.col("roe_direction")
    weight = F.when(t < 0, p["cut_weight"]).when(t > 0, p["raise_weight"]).otherwise(p["neutral_weight"])
    parts = [(eps, F.lit(p["eps_weight"]), p["eps_scale"]), (roe, F.lit(p["roe_weight"]), p["roe_scale"]), (F.when(target.isNotNull(), t), weight, 1.0)]
    total = sum(F.when(x.isNotNull(), w).otherwise(0.0) for x, w, _ in parts)
    mean = F.when(total > 0, sum(F.when(x.isNotNull(), _clamp(x / scale, -1, 1) * w).otherwise(0.0) for x, w, scale in parts) / total).otherwise(0.0)
    rows = rows.withColumns({
        "earnings": mean, "conflict": (e != 0) & (r != 0) & (e != r), "down_agrees": (t < 0) & ((e < 0) | (r < 0)), "up_agrees": (t > 0) & ((e > 0) | (r > 0)),
    })
    penalty = F.when(t < 0, 0.05 * _clamp(_finite("cut_breadth"), 0, 1) + F.when(F.floor(_finite("cut_streak") + 0.5) >= 2, 0.04).otherwise(0.0)).otherwise(0.0)
    signal = F.col("earnings") - penalty - F.when(F.col("down_agrees"), 0.08).otherwise(0.0) + F.when(F.col("up_agrees"), 0.025).otherwise(0.0)
    spread = F.when(_finite("target_deviation").isNull(), 0.12).otherwise(_clamp(_finite("target_deviation") / 0.35, 0, 0.45))
    sure = _clamp(_finite("parser_confidence"), 0, 1) * 0.45 + _clamp(_finite("coverage"), 0, 1) * 0.25 + _clamp(_finite("primary_coverage"), 0, 1) * 0.3 - spread
    sure = sure - F.when(F.col("conflict"), 0.15).otherwise(0.0) + F.when(F.col("down_agrees"), 0.05).otherwise(0.0)
    rows = rows.withColumns({"signal": _clamp(signal, -1, 1), "confidence": _clamp(sure, 0.1, 0.92)})
    return rows.withColumn("adjustment", F.col("signal") * F.col("confidence") * F.when(F.col("signal") < 0, p["down_scale"]).otherwise(p["up_scale"]))


def fingerprint(df: DataFrame, by: str, date: str, title: str) -> DataFrame:
    """(by, n, fingerprint): SHA-256 of a key's evidence as canonical JSON: white space squeezed, rows without date or title left out, sorted by both."""
    clean = df.select(by, F.date_format(date, "yyyy-MM-dd").alias("date"), F.trim(F.regexp_replace(title, r"\s+", " ")).alias("title")).filter("date IS NOT NULL AND title <> ''")
    return clean.groupBy(by).agg(F.count("*").alias("n"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("date", "title")))), 256).alias("fingerprint"))


def random_weights(inputs: int, hidden: int, seed: int = 20_000, scale: float = 0.7, bias: float = 1.0) -> tuple[list[list[float]], list[float]]:
    """Weights by hidden unit and input, and biases, of a seeded generator: small whatever the data."""
    generator = np.random.default_rng(seed + hidden)
    weights = generator.normal(0.0, scale, (inputs, hidden))
    return weights.T.tolist(), generator.uniform(-bias, bias, hidden).tolist()


def random_features(df: DataFrame, features: list[str], hidden: int = 8, **options) -> DataFrame:
    """The rows with h0, h1, ...: tanh of seeded random combinations of the features; null where a feature is."""
    weights, biases = random_weights(len(features), hidden, **options)
    units = [F.tanh(sum((F.col(c) * w for c, w in zip(features, row, strict=True)), F.lit(b))).alias(f"h{k}") for k, (row, b) in enumerate(zip(weights, biases, strict=True))]
    return df.select("*", *units)
