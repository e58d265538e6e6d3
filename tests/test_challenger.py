"""The rolling challenger: same seed, same rows; nothing after a cutoff is read; rungs lock."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import challenger

D = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(4)
    rows = []
    for i in range(0, 500, 4):
        for k in range(30):
            a, b = r.gauss(0, 1), r.gauss(0, 1)
            rows.append((k, D + dt.timedelta(days=i), D + dt.timedelta(days=i + 28), 0.05 * a + r.gauss(0, 0.05), a, b if k % 7 else None))
    return spark.createDataFrame(rows, "k int, t date, target_t date, y double, a double, b double").repartition(3)


def predictions(samples, **more):
    rows = challenger.ranked_samples(samples, ["a", "b"])
    out = challenger.rolling_predictions(rows, rows, dt.date(2021, 1, 1), dt.date(2021, 4, 30), trees=4, depth=2, **more)
    return {(r.k, r.t): (r.predicted, r.cutoff) for r in out.collect()}


def test_predictions_repeat_and_never_read_ahead(samples):
    got = predictions(samples)
    assert got == predictions(samples.repartition(5)) and len(got) > 500
    assert {c for _, c in got.values()} == {dt.date(2021, 1, 1), dt.date(2021, 4, 1)}
    assert all(t >= c for (_, t), (_, c) in got.items())
    # Outcomes that are known only after the first cutoff don't move its predictions.
    late = F.col("target_t") >= "2021-01-01"
    changed = predictions(samples.withColumn("y", F.when(late, -F.col("y")).otherwise(F.col("y"))))
    first = {x: p for x, p in got.items() if p[1] == dt.date(2021, 1, 1)}
    assert first == {x: changed[x] for x in first} and any(got[x] != changed[x] for x in got)


def test_judgement_and_rungs(spark, samples):
    told = challenger.run_challenger(samples, ["a", "b"], dt.date(2021, 1, 1), dt.date(2021, 4, 30), trees=4, depth=2).collect()
    assert [r.rung for r in told] == ["development", "holdout", "audit"] and told[0].status == "passed" and told[0].ic > 0.4 and told[0].gap > 0
    noise = samples.withColumn("y", -F.col("y") * F.when(F.col("t") >= "2021-01-01", 1).otherwise(-1))
    told = challenger.run_challenger(noise, ["a", "b"], dt.date(2021, 1, 1), dt.date(2021, 4, 30), trees=4, depth=2).collect()
    assert [r.status for r in told] == ["failed", "locked", "locked"] and told[2].n is None


def test_periods_cover_their_span():
    spans = challenger.periods(dt.date(2020, 11, 15), dt.date(2021, 3, 2))
    assert spans == [(dt.date(2020, 11, 15), dt.date(2021, 2, 1)), (dt.date(2021, 2, 1), dt.date(2021, 5, 1))]
