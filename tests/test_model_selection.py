"""Model selection against refitting every training set."""

import datetime as dt

import numpy as np
import pytest

from tidewell.operators import selection_of_models as S

FEATURES = ["a", "b"]


def samples(seed, dates=60):
    r = np.random.default_rng(seed)
    out = []
    for g in (1, 2):
        for i in range(dates):
            t = dt.date(2015, 1, 1) + dt.timedelta(days=40 * i)
            for _ in range(6):
                a, b = r.normal(size=2)
                y = 0.02 * a - 0.01 * b * (g == 1) + r.normal() * 0.03
                out.append((g, t, t + dt.timedelta(days=28), float(y), float(0.3 * y + r.normal() * 0.05), float(abs(r.normal()) * 0.01), float(a), float(b)))
    return out


def months_before(t, n):
    y, m = divmod(t.year * 12 + t.month - 1 - n, 12)
    last = [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]
    return dt.date(y, m + 1, min(t.day, last))


def ridge(x, y, penalty):
    mean, sd = x.mean(0), x.std(0, ddof=1)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    low, high = np.quantile(y, [0.01, 0.99])
    fence = penalty * np.eye(z.shape[1])
    fence[0, 0] = 0
    c = np.linalg.solve(z.T @ z + fence, z.T @ np.clip(y, low, high))
    return lambda q: c[0] + ((q - mean) / sd) @ c[1:]


def expand(x, size):
    if not size:
        return x
    r = np.random.default_rng(7)
    w, b = r.uniform(-S.SCALE, S.SCALE, (size, 2)), r.uniform(-S.BIAS, S.BIAS, size)
    return np.column_stack([x, np.tanh(x @ w.T + b)])


def chosen(rows, lookbacks, penalties, blends, hidden, horizon, least):
    dates = sorted({r[1] for r in rows})
    recent = [d for d in dates if d >= months_before(dates[-1], 36)]
    recent = recent if len(recent) >= 12 else dates[max(1, int(len(dates) * 0.6)) :]
    best = None
    floor = 0.12
    for years in lookbacks:
        own = None
        for size in hidden:
            for penalty in penalties:
                folds = []
                for block in np.array_split(np.array(recent), 3):
                    train = [r for r in rows if r[2] < block[0] and r[1] >= months_before(block[0], 12 * years)]
                    test = [r for r in rows if block[0] <= r[1] <= block[-1]]
                    if len(train) < least:
                        continue
                    model = ridge(expand(np.array([r[6:] for r in train]), size), np.array([r[3] for r in train]), penalty)
                    folds.append((test, model(expand(np.array([r[6:] for r in test]), size))))
                for blend in blends:
                    e, b, d, wins = [], [], [], 0
                    for test, raw in folds:
                        y, base, vol = (np.array([r[k] for r in test]) for k in (3, 4, 5))
                        limit = np.minimum(0.75, np.maximum(floor, vol * horizon**0.5 * 2.5))
                        p = np.clip(base + (raw - base) * blend, -limit, limit)
                        e += abs(y - p).tolist()
                        b += abs(y - base).tolist()
                        d += (np.sign(y) == np.sign(p)).tolist()
                        wins += abs(y - p).mean() < abs(y - base).mean()
                    key = (round(float(np.mean(e)), 12), -float(np.mean(d)), size, penalty, blend)
                    if own is None or key < own[0]:
                        own = key, float(np.mean(e)), float(np.mean(b)), len(e), wins
        key = (own[0][0], own[0][1], years)
        if best is None or key < best[0]:
            best = key, own
    (_, _, years), ((_, direction, size, penalty, blend), mae, base, n, wins) = best
    return years, size, penalty, blend, mae, base, -direction, n, wins


@pytest.mark.parametrize("seed", [1, 2])
def test_choices_equal_refits(spark, seed):
    rows = samples(seed)
    df = spark.createDataFrame(rows, "g int, t date, target_t date, y double, baseline double, vol double, a double, b double").repartition(5)
    grid = {"lookbacks": (1, 2, 3), "penalties": (4.0, 64.0), "blends": (0.6, 1.0), "hidden": (0, 3)}
    got = {r.g: r for r in S.select_models(df, FEATURES, 20, **grid, least=20).collect()}
    for g in (1, 2):
        own = [r for r in rows if r[0] == g]
        years, size, penalty, blend, mae, base, direction, n, wins = chosen(own, horizon=20, least=20, **grid)
        r = got[g]
        assert (r.years, r.hidden, r.penalty, r.blend, r.n_validation, r.wins) == (years, size, penalty, blend, n, wins)
        assert (r.mae, r.baseline_mae, r.direction) == pytest.approx((mae, base, direction))
        last = max(x[1] for x in own)
        kept = [x for x in own if x[1] >= months_before(last, 12 * years)]
        model = ridge(expand(np.array([x[6:] for x in kept]), size), np.array([x[3] for x in kept]), penalty)
        q = expand(np.array([[0.3, -0.2]]), size)
        assert r.n_training == len(kept) and r.intercept + q[0] @ np.array(r.coefficients) == pytest.approx(model(q)[0])
        assert 0 <= r.reliability <= 1 and r.residual_low < r.residual_high


def test_no_target_reaches_its_block(spark):
    df = spark.createDataFrame(samples(3), "g int, t date, target_t date, y double, baseline double, vol double, a double, b double")
    blocks = {(r.g, r.fold): r for r in S.validation_blocks(df).collect()}
    assert len(blocks) == 6 and all(blocks[g, f].end < blocks[g, f + 1].start for g in (1, 2) for f in (0, 1))
