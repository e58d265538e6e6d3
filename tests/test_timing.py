"""Timing features, arms and episodes: worked cases, and the stream against the batch."""

import datetime
import json
import math
import random

import pandas as pd
import pytest

from tidewell.operators import episodes, timing
from tidewell.streaming import stateful


def row(i, price, **flags):
    known = dict.fromkeys(episodes.BOOLEANS, False) | {"stock": True} | {"f": 1.0, "crowding": 0.0, "drawdown60": 0.0, "change20": 0.0, "spike_row": float("nan")}
    return known | {"i": i, "t": str(datetime.date(2024, 1, 1) + datetime.timedelta(days=i)), "v": price} | flags


def run(rows):
    walk = episodes.Walk()
    return [c for x in rows for c in walk.row(x)]


def day(i):
    return str(datetime.date(2024, 1, 1) + datetime.timedelta(days=i))


MODERATE = {"buy_arm": True, "moderate_arm": True, "moderate_fall": True}


def test_a_correction_is_dated_at_its_low_and_replaced_while_unlocked():
    got = run([row(0, 100, **MODERATE), row(1, 95), row(2, 96, turned_up=True), row(3, 90), row(4, 91, turned_up=True), row(10, 92, turned_up=True)])
    # The low of row 1, then that of row 3 into the same slot; row 10 is too late for the low of row 3.
    assert [(c[1], c[2], c[3], c[5], c[6]) for c in got] == [(0, 0, day(1), day(2), "turning-point"), (0, 1, day(3), day(4), "turning-point")]
    assert {c[7] for c in got} == {"correction-reversal"}


def test_relative_washouts_are_dated_at_confirmation_and_lock():
    arm = {"buy_arm": True, "moderate_arm": True, "relative_washout": True}
    got = run([row(0, 100, **arm), row(3, 101, turned_up=True), row(4, 102, turned_up=True), row(7, 95), row(8, 94, **arm), row(9, 95, turned_up=True)])
    # Locked after the first; the fall of 4 % from the signal's low ends that episode, and a new arm opens the next one.
    assert [(c[1], c[3], c[6], c[7]) for c in got] == [(0, day(3), "confirmation", "relative-washout"), (1, day(9), "confirmation", "relative-washout")]


def test_recovery_and_staleness_end_a_buying_episode():
    recovered = run([row(0, 100, **MODERATE), row(1, 113, recovered=True), row(2, 112, turned_up=True)])
    stale = run([row(0, 100, **MODERATE), row(41, 100, turned_up=True)])
    assert recovered == stale == []
    longer = episodes.Walk()
    list(longer.row(row(0, 100, **MODERATE)))
    list(longer.row(row(41, 101, moderate_fall=True)))
    assert longer.buy is not None
    list(longer.row(row(42, 101)))
    assert longer.buy is None


def test_extreme_days_give_signals_at_once_and_keep_their_date():
    got = run([row(0, 100, **MODERATE), row(1, 70, extreme_buy=True), row(2, 60, turned_up=True)])
    assert [(c[0], c[3], c[6], c[7]) for c in got] == [("buy", day(1), "extreme-daily", "shock-reversal")]
    got = run([row(0, 100, sell_arm=True, distribution=True, near_high=True, extreme_sell=True), row(1, 96, slope_down=True, osc_recent_positive=True)])
    assert [(c[3], c[6]) for c in got] == [(day(0), "extreme-daily")]


def test_selling_confirms_in_its_window_and_cools_down():
    top = {"sell_arm": True, "distribution": True, "near_high": True}
    left = {"slope_down": True, "osc_recent_positive": True}
    got = run([row(0, 100, **top), row(1, 104, **top), row(2, 101, **left), row(4, 106, **top), row(6, 103, **left), row(13, 110, **top), row(15, 107, **left)])
    # Row 4 lies within the cooldown, but its higher peak counts; row 13 may be armed again.
    assert [(c[1], c[2], c[3], c[5], c[7]) for c in got] == [(0, 0, day(1), day(2), "distribution-rollover"), (0, 1, day(4), day(6), "distribution-rollover")] + [(0, 2, day(13), day(15), "distribution-rollover")]
    assert run([row(0, 100, **top), row(9, 96, **left)]) == []
    ended = run([row(0, 100, **top), row(1, 97, **left), row(2, 87, corrected=True), row(12, 120, **top), row(13, 116, **left)])
    assert [c[1] for c in ended] == [0, 1]


def test_parabolic_moves_need_no_turn():
    got = run([row(0, 100, sell_arm=True, parabolic=True, near_high=True)])
    assert [(c[3], c[7]) for c in got] == [(day(0), "blowoff-exhaustion")]


def test_continued_overheating_counts_each_spike_once():
    got = run([row(5, 100, continued=True, spike_row=4.0), row(6, 111, continued=True, spike_row=4.0), row(8, 130, continued=True, spike_row=7.0)])
    assert [(c[3], c[6]) for c in got] == [(day(5), "overheat-continuation"), (day(8), "overheat-continuation")]


def random_rows(seed, n=400):
    r = random.Random(seed)
    out, price = [], 100.0
    for i in range(n):
        price *= math.exp(r.gauss(0, 0.04))
        flags = {c: r.random() < 0.12 for c in episodes.BOOLEANS if c != "stock"}
        out.append(row(i, price, **flags, **{"spike_row": float(i - 1) if r.random() < 0.1 else float("nan"), "crowding": r.random(), "change20": r.gauss(0, 20)}))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_a_walk_goes_on_from_its_text(seed):
    rows = random_rows(seed)
    whole, walk, parts = run(rows), episodes.Walk(), []
    for x in rows:
        walk = episodes.Walk(json.loads(json.dumps(walk.dump())))
        parts += list(walk.row(x))
    assert parts == whole and len({c[0] for c in whole}) == 2
    assert len(walk.dump()) < 20_000


def test_the_stream_equals_the_batch_and_ignores_repeats(spark):
    frames = []
    for k in range(3):
        frame = pd.DataFrame(random_rows(10 + k))
        frame["k"], frame["t"] = k, pd.to_datetime(frame["t"]).dt.date
        frames.append(frame[["k", "t", "i", *episodes.BOOLEANS, *episodes.NUMBERS]])
    rows = spark.createDataFrame(pd.concat(frames))
    batch = sorted(map(tuple, episodes.standing(episodes.signal_changes(rows)).collect()))
    # The middle part lands with the last rows of the first one again.
    repeated = rows.unionByName(rows.filter("i BETWEEN 90 AND 99").withColumn("t", rows["t"] + 12))
    stream = stateful.in_landings(repeated, [day(100), day(220)], stateful.episode_changes)
    assert sorted(map(tuple, episodes.standing(stream).collect())) == batch and len(batch) > 20


def panel(spark, prices, stock=True, **context):
    rows = [(1, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), float(v), 100.0, 100.0 + i % 3, stock) for i, v in enumerate(prices)]
    df = spark.createDataFrame(rows, "k int, t date, v double, volume double, bench double, stock boolean")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(v) for c, v in context.items()})


def signals(df):
    return episodes.detect_episodes(timing.signal_arms(timing.behavior_profile(timing.timing_features(df)))).collect()


def test_limit_days_and_splits(spark):
    flat = [100 + i % 2 * 0.1 for i in range(60)]
    up = signals(panel(spark, [*flat, 129, 128, 128]))
    assert [(r.side, r.mode, r.family, r.price) for r in up] == [("sell", "extreme-daily", "blowoff-exhaustion", 129.0)]
    assert [(r.side, r.mode) for r in signals(panel(spark, [*flat, 72, 72]))] == [("buy", "extreme-daily")]
    assert [(r.side, r.mode) for r in signals(panel(spark, [*flat, 91, 91], stock=False))] == [("buy", "extreme-daily")]
    # A split or a capital change is beyond any price limit.
    assert [r for r in signals(panel(spark, [*flat, 50, 50])) if r.mode == "extreme-daily"] == []


def test_features_never_read_ahead(spark):
    r = random.Random(1)
    prices = [100 * math.exp(sum(r.gauss(0, 0.02) for _ in range(3))) for _ in range(300)]
    names = ["change60", "z20", "drawdown120", "efficiency60", "corr", "vol_scale", "regime", "volume_trend"]
    part = timing.timing_features(panel(spark, prices[:200])).orderBy("i").select(*names).collect()
    whole = timing.timing_features(panel(spark, prices)).orderBy("i").select(*names).limit(200).collect()
    assert part == whole
    assert all(x.change60 is None for x in part[:60]) and part[60].change60 == pytest.approx((prices[60] / prices[0] - 1) * 100)


def test_arms_hold_only_with_their_operands(spark):
    fallen = [100 - i * 0.2 for i in range(100)] + [80 - i * 1.2 for i in range(25)]
    arms = lambda **c: timing.signal_arms(timing.behavior_profile(timing.timing_features(panel(spark, fallen, **c)))).orderBy("i").collect()[-1]
    armed = arms(adr=70.0, fear=20.0, news=90.0)
    assert armed.buy_arm and armed.strong_arm and armed.medium_correction and not armed.sell_arm and armed.regime == "stress"
    # Without context nothing supports the fall.
    assert not arms().buy_arm


def test_behavior_of_trends_and_ranges(spark):
    up = timing.behavior_profile(timing.timing_features(panel(spark, [100 * 1.004**i for i in range(300)]))).orderBy("i").collect()[-1]
    assert up.trend_following > 0.9 and up.trend_up > 0.9 and up.trend_down == 0 and up.long_direction == "up" and up.consistency == 1
    flat = timing.behavior_profile(timing.timing_features(panel(spark, [100 + math.sin(i) for i in range(300)]))).orderBy("i").collect()[-1]
    assert flat.long_direction == "range" and flat.range_bound > 0.8
    young = timing.behavior_profile(timing.timing_features(panel(spark, [100 + i for i in range(80)]))).orderBy("i").collect()[-1]
    assert young.behavior == "insufficient-history"
