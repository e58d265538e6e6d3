"""Goldens for order-dependent operators, and: later rows never change what a trailing window gave before."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.operators import asof, indicators, oscillators, quality, sampling, signals

D = dt.date(2020, 1, 1)


def panel(spark, values, k=1):
    return spark.createDataFrame([(k, D + dt.timedelta(days=i), v) for i, v in enumerate(values)], "k int, t date, v double")


WAVE = [100 + (i * 37 % 23) - (i * 11 % 7) * 1.5 for i in range(90)]


@pytest.mark.parametrize(
    "f",
    [
        lambda d: d.withColumn("x", indicators.change_rate(5)),
        lambda d: d.withColumn("x", indicators.trailing_mean(20)),
        lambda d: d.withColumn("x", indicators.rolling_z(30, 10)),
        lambda d: d.withColumn("x", indicators.rolling_pct_rank(30, 10)),
        lambda d: indicators.rsi(d).withColumn("x", F.col("rsi")),
        lambda d: indicators.path_efficiency(d, 10).withColumn("x", F.col("efficiency")),
        lambda d: oscillators.ema(d, 12).withColumn("x", F.col("ema")),
    ],
)
def test_future_rows_change_nothing(spark, f):
    a = {r.t: r.x for r in f(panel(spark, WAVE[:70])).collect()}
    b = {r.t: r.x for r in f(panel(spark, WAVE)).collect()}
    assert all(b[t] == x for t, x in a.items())


def test_asof_takes_the_last_known_row(spark):
    left = panel(spark, [1.0] * 10)
    right = spark.createDataFrame([(1, D + dt.timedelta(days=i), float(i)) for i in (0, 3, 4)], "k int, t date, v double")
    got = {(r.t - D).days: r.v_right for r in asof.asof_backward(left, right, 2).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 3: 3.0, 4: 4.0, 5: 4.0, 6: 4.0, 7: None, 8: None, 9: None}
    lagged = {(r.t - D).days: r.v_right for r in asof.asof_available(left, right, 2).collect()}
    assert lagged[1] is None and lagged[2] == 0.0 and lagged[6] == 4.0


def test_tail_skips_one_break_and_stops_at_two(spark):
    seed = panel(spark, [100.0])
    live = panel(spark, [100.0, 101.0, 500.0, 102.0, 500.0, 501.0, 103.0])
    assert [r.v for r in quality.accept_tail(seed, live, 0.1).orderBy("t").collect()] == [101.0, 102.0]


def test_episodes_hang_on_their_first_signal(spark):
    rows = spark.createDataFrame([(1, "buy", D + dt.timedelta(days=i), i) for i in (1, 6, 11, 16, 30)], "k int, side string, t date, i int")
    got = [((r.t - D).days, r.n) for r in signals.collapse_episodes(rows).orderBy("t").collect()]
    assert got == [(1, 3), (16, 1), (30, 1)]


def test_fnv_matches_known_values(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) % (1 << 32)
        return h % 5

    rows = spark.createDataFrame([("005930.KS",), ("^KQ11",), ("a",)], "s string")
    assert {r.s: r.b for r in rows.select("s", sampling.fnv_bucket(F.col("s"), 5).alias("b")).collect()} == {s: fnv(s) for s in ("005930.KS", "^KQ11", "a")}


def test_retention_keeps_dense_then_weeks(spark):
    got = sampling.retain_tiered(panel(spark, [1.0] * 90).select("k", "t"), 10, 3, 2, 14).collect()
    tiers = [r.tier for r in got]
    assert len(got) == 14 and tiers.count("dense") == 10 and tiers.count("weekly") == 3


def test_episodes_hold_all_signals(spark):
    from tidewell import queries

    episodes = queries.QUERIES["m7_collapse_episodes"](spark, "/root/testdata/sf0.001")
    assert episodes.agg(F.sum("n")).first()[0] == queries.signals(spark, "/root/testdata/sf0.001").filter("side IS NOT NULL").count() > 0
