"""Incremental merges and tiers by worked cases."""

import datetime as dt

from tidewell.operators import incremental
from tidewell.operators.quality import accept_tail

D = dt.date(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(k, D + dt.timedelta(days=i), v) for k, i, v in rows], "k int, t date, v double")


def rows(df):
    return sorted((r.k, (r.t - D).days, round(r.v, 6)) for r in df.collect())


def test_one_break_is_skipped_and_two_end_the_tail(spark):
    seed = frame(spark, [(1, 0, 10.0), (2, 0, 10.0), (3, 0, 10.0)])
    live = frame(spark, [(1, 1, 11.0), (1, 2, 99.0), (1, 3, 12.0), (2, 1, 99.0), (2, 2, 98.0), (2, 3, 10.0), (3, 1, 11.0), (3, 2, 50.0), (3, 3, 12.0), (3, 4, 60.0), (3, 5, 13.0), (3, 0, 1.0)])
    assert rows(accept_tail(seed, live, 0.2)) == [(1, 1, 11.0), (1, 3, 12.0), (3, 1, 11.0), (3, 3, 12.0), (3, 5, 13.0)]


def test_another_base_is_brought_to_the_seeds(spark):
    seed = frame(spark, [(k, i, 100.0 + i) for k in (1, 2, 3) for i in range(30)])
    live = frame(spark, [(1, i, (100.0 + i) * 0.8) for i in range(20, 33)] + [(2, i, (100.0 + i) * 0.8) for i in range(27, 33)] + [(3, i, (100.0 + i) * 4) for i in range(20, 33)] + [(4, 0, 5.0)])
    got = {(k, i): v for k, i, v in rows(incremental.merge_incremental(seed, live, 0.1))}
    assert got[1, 32] == 132.0 and got[1, 25] == 125.0
    # Three common dates say too little about the base, and a factor of four is none; their rows don't follow from the seed.
    assert (2, 31) not in got and (3, 31) not in got and got[4, 0] == 5.0


def test_tiers_count_only_what_was_known(spark):
    tiers = [("own", 2, ["k"]), ("group", 3, ["g"]), ("all", 4, [])]
    day = lambda i: D + dt.timedelta(days=i)
    records = spark.createDataFrame([(1, "a", day(10), 0.1, 1.0), (1, "a", day(20), 0.3, 1.0), (2, "a", day(20), 0.5, 2.0), (3, None, day(5), 0.7, 1.0)], "k int, g string, actual_t date, error double, weight double")
    asked = spark.createDataFrame([(1, 1, "a", day(9)), (2, 1, "a", day(20)), (3, 2, "a", day(20)), (4, 3, None, day(20)), (5, 2, "a", day(19))], "id int, k int, g string, as_of date")
    got = {r.id: (r.tier, r.n, round(r.bias, 6)) for r in incremental.choose_tiers(asked, records, tiers).collect()}
    assert got == {1: ("none", 0, 0.0), 2: ("own", 2, 0.2), 3: ("group", 3, 0.35), 4: ("all", 4, 0.42), 5: ("none", 0, 0.0)}
