"""Structural profiles against the rules step by step."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from tidewell.operators import profiles

YEAR = 252


def correlation(a, b):
    if len(a) < 3:
        return 0.0
    a, b = np.array(a) - np.mean(a), np.array(b) - np.mean(b)
    d = math.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / d) if d > 0 else 0.0


def unit(x):
    return max(0.0, min(1.0, x))


def rank(values, at):
    return sum(1.0 if v < at - 1e-12 else 0.5 if abs(v - at) < 1e-12 else 0.0 for v in values) / len(values) if values else 0.5


def expected(points):
    last = points[-1][0].replace(day=1)
    done = [p for p in points if p[0] < last]
    points = done if len(done) >= YEAR else points
    months = {}
    for t, v in points:
        months[t.replace(day=1)] = v
    prices = [months[m] for m in sorted(months)]
    x = np.log(prices)
    n = len(x)
    slope, intercept = np.polyfit(np.arange(n), x, 1)
    e = x - intercept - slope * np.arange(n)
    most, best = min(60, (n - 8) // 2), None
    for lag in range(12, most + 1):
        own = lambda v, lag=lag: correlation(v[lag:], v[:-lag]) if len(v) >= lag + 8 else 0.0
        whole, one, two = own(e), own(e[: math.ceil(n * 0.65)]), own(e[math.floor(n * 0.35) :])
        stable = min(max(0, one), max(0, two))
        cover = unit((n / lag - 1.5) / 2.5)
        c = unit(max(0, whole) * 0.45 + stable * 0.4 + cover * 0.15) * cover
        if best is None or c > best[0] + 1e-12:
            best = c, lag, whole, stable
    cyclical = best[0] if best and best[2] >= 0.2 and best[3] >= 0.08 else 0.0
    least = max(0.025, np.std(np.diff(x), ddof=1) * math.sqrt(6) * 0.3)
    runs = []
    for i in range(n):
        change = x[i] - x[i - min(6, i)] if i >= 3 else 0
        s = 1 if change > least else -1 if change < -least else 0
        if s and (not runs or runs[-1][0] != s):
            runs.append([s, 1])
        elif runs:
            runs[-1][1] += 1
    peak, start, depth, ended, at = prices[0], None, 0.0, [], 0
    for i, v in enumerate(prices):
        if v >= peak:
            if start is not None:
                ended.append((i - start, depth))
                start, depth = None, 0.0
            peak, at = v, i
        else:
            start = i if start is None else start
            depth = max(depth, 1 - v / peak)
    down = prices[-1] / peak - 1
    return {"period": best[1] if best else 0, "cyclical": cyclical, "run_state": runs[-1][0], "run_months": runs[-1][1], "up_median": float(np.median([r[1] for r in runs if r[0] == 1])), "down_upper": float(np.quantile([r[1] for r in runs if r[0] == -1], 0.75)),
            "drawdown": down, "months_down": n - 1 - at, "ended": len(ended), "duration_rank": rank([d for d, _ in ended], n - 1 - at), "depth_rank": rank([d for _, d in ended], -down), "yearly_slope": slope * 12}


def series(seed):
    r = random.Random(seed)
    out, level = [], 0.0
    for i in range(2600):
        level += r.gauss(0.0001, 0.01)
        out.append((dt.date(2012, 1, 3) + dt.timedelta(days=i), 100 * math.exp(level + 0.25 * math.sin(i / 365.25 * 2 * math.pi / 1.5))))
    return out


def test_profiles_equal_the_rules(spark):
    data = {k: series(k) for k in (1, 2, 3)}
    rows = [(k, t, v, 50.0 + (t.day % 7)) for k, points in data.items() for t, v in points]
    rows += [(9, t, v, 1.0) for t, v in data[1][:100]]
    got = {r.k: r for r in profiles.structural_profile(spark.createDataFrame(rows, "k int, t date, v double, bench double").repartition(4)).collect()}
    assert set(got) == {1, 2, 3}
    for k, points in data.items():
        for name, value in expected(points).items():
            assert got[k][name] == pytest.approx(value, abs=1e-9), (k, name)
        assert len(got[k].dominant) == 3 and got[k].dominant[0] == max(profiles.SCORES, key=lambda c: got[k][c])
        assert all(0 <= got[k][c] <= 1 for c in profiles.SCORES)
    assert any(r.cyclical > 0.3 for r in got.values())


def test_a_steady_rise_has_neither_cycle_nor_drawdown(spark):
    rows = [(1, dt.date(2015, 1, 1) + dt.timedelta(days=i), 100 * 1.0005**i, 100.0) for i in range(1500)]
    got = profiles.structural_profile(spark.createDataFrame(rows, "k int, t date, v double, bench double")).first()
    assert got.trend_up > 0.9 and got.drawdown == 0 and got.months_down == 0 and got.ended == 0 and got.correlation == 0
