"""Recursive averages and what is read off them, point-in-time signals, shocks, zones, labels and scales of single series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_time, change_rate, trailing


def _ema(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).ewm(alpha=2 / (n + 1), adjust=False).mean().to_numpy()


def _seeded(x: np.ndarray, n: int) -> np.ndarray:
    """Recursive average begun with the mean of the first n values, which have none."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = _ema(np.concatenate([[x[:n].mean()], x[n:]]), n)
    return out


def _by_series(df: DataFrame, columns: tuple[str, ...], least: int, compute) -> DataFrame:
    """(k, t, columns) computed from each series' positive values in order. One series is one group: thirty years of days are 7,500 rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        if len(group) < least:
            return pd.DataFrame({c: pd.Series(dtype=group["k"].dtype if c == "k" else "object" if c == "t" else "float64") for c in ("k", "t", *columns)})
        return pd.DataFrame({"k": group["k"].to_numpy(), "t": group["t"].to_numpy(), **dict(zip(columns, compute(group["v"].to_numpy(float)), strict=True))})

    kind = dict(df.dtypes)["k"]
    rows = df.filter("v > 0").select("k", "t", F.col("v").cast("double").alias("v")).groupBy("k").applyInPandas(run, f"k {kind}, t date, " + ", ".join(f"{c} double" for c in columns))
    return rows.select("k", "t", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])


def ema(df: DataFrame, n: int, log: bool = False) -> DataFrame:
    """Recursive average by key, begun with the first value."""
    return _by_series(df, ("ema",), 1, lambda v: (_ema(np.log(v) if log else v, n),))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(k, t, macd, signal_line, oscillator, normalized): averages begun with means; normalized is in percent of the value. Series that are too short for one point have no rows."""

    def compute(v: np.ndarray):
        line = _seeded(v, fast) - _seeded(v, slow)
        smooth = np.full(len(v), np.nan)
        smooth[slow - 1 :] = _seeded(line[slow - 1 :], signal)
        return line, smooth, line - smooth, (line - smooth) / v * 100

    return _by_series(df, ("macd", "signal_line", "oscillator", "normalized"), slow + signal - 1, compute)


def macd_log(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(k, t, oscillator) on log values, averages begun with the first value."""

    def compute(v: np.ndarray):
        line = _ema(np.log(v), fast) - _ema(np.log(v), slow)
        return (line - _ema(line, signal),)

    return _by_series(df, ("oscillator",), 1, compute)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def oscillator_signal(df: DataFrame, v: str = "normalized") -> DataFrame:
    """(k, score): position, slope and persistence of the last 40 values of an oscillator; 0 with fewer than 8."""
    rows = df.filter(F.col(v).isNotNull()).select("k", F.col(v).alias("x"), F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t"))).alias("back")).filter("back <= 40")
    g = rows.groupBy("k").agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sd"), F.max(F.when(F.col("back") == 1, F.col("x"))).alias("last"), F.avg(F.when(F.col("back").between(2, 5), F.col("x"))).alias("before"), F.sum(F.when(F.col("back") <= 5, F.signum("x"))).alias("signs"))
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(0.0001)
    score = clamp(F.col("last") / (sd * 1.8), -1, 1) * 0.45 + clamp((F.col("last") - F.col("before")) / sd, -1, 1) * 0.35 + F.col("signs") / 5 * 0.2
    return g.select("k", F.when(F.col("n") >= 8, clamp(score, -1, 1)).otherwise(0.0).alias("score"))


def pit_signal(df: DataFrame, window: int = 252, back: int = 21, least: int = 8, direction: int = 1) -> DataFrame:
    """Level and trend of a series as known on each row: the last value against the window's mean, and against ``back`` observations before, in deviations."""
    w = trailing(window)
    held = F.filter(F.collect_list("v").over(w), lambda x: x.isNotNull())
    n = F.count("v").over(w)
    rows = df.withColumn("_n", n).withColumn("_mean", F.avg("v").over(w)).withColumn("_sd", F.stddev("v").over(w)).withColumn("_last", F.last("v", True).over(w))
    rows = rows.withColumn("_old", F.when(F.size(held) > back, F.element_at(held, -(back + 1))).otherwise(F.get(held, F.lit(0))))
    sd = F.greatest(F.col("_sd"), F.lit(1e-9))
    known = F.col("_n") >= least
    level, trend = (F.when(known, clamp(direction * (F.col("_last") - F.col(c)) / sd, -3, 3)).otherwise(0.0) for c in ("_mean", "_old"))
    return rows.select("k", "t", level.alias("level"), trend.alias("trend"), known.cast("int").alias("available"))


def volatility_timing(df: DataFrame, lookback: int = 252, least: int = 60) -> DataFrame:
    """Percentile and z of a volatility index against the rows before, its changes, and its distance from the last 20 rows' ends."""
    before = by_time().rowsBetween(-lookback, -1)
    n, sd = F.count("v").over(before), F.stddev("v").over(before)
    known = n >= least
    below = F.size(F.filter(F.collect_list("v").over(before), lambda x: x <= F.col("v")))
    high, low = F.max("v").over(trailing(20)), F.min("v").over(trailing(20))
    columns = {
        "percentile": below / n,
        "z": F.when(sd > 1e-9, (F.col("v") - F.avg("v").over(before)) / sd).otherwise(0.0),
        "change5": change_rate(5) * 100, "change20": change_rate(20) * 100,
        "drawdown20": F.when(high > 0, (F.col("v") / high - 1) * 100), "rebound20": F.when(low > 0, (F.col("v") / low - 1) * 100),
    }
    return df.select("k", "t", *[F.when(known, c).alias(name) for name, c in columns.items()])


def overheat_memory(df: DataFrame, rows: int = 8, low: float = 25.0, high: float = 31.5) -> DataFrame:
    """Rows with two or more limit-up moves in the rows before: how many, over which span, how long ago, the gain since, the fall from the cluster's high."""
    i = F.row_number().over(by_time())
    move = (F.col("v") / F.lag("v").over(by_time()) - 1) * 100
    x = df.withColumn("i", i).withColumn("base", F.lag("v").over(by_time())).withColumn("hot", F.coalesce(move.between(low, high), F.lit(False)))
    before = by_time().rowsBetween(-rows, -1)
    hot = F.when(F.col("hot"), F.struct("i", "base"))
    x = x.withColumn("n", F.sum(F.col("hot").cast("int")).over(before)).withColumn("first", F.min(hot).over(before)).withColumn("last", F.max(hot).over(before))
    x = x.withColumn("near", F.collect_list(F.struct("i", "v")).over(by_time().rowsBetween(-rows, 0)))
    x = x.filter("n >= 2")
    top = F.array_max(F.transform(F.filter("near", lambda p: p["i"] >= F.col("first.i")), lambda p: p["v"]))
    return x.select(
        "k", "t", F.col("n").alias("count"), (F.col("last.i") - F.col("first.i")).alias("span"), (F.col("i") - F.col("last.i")).alias("age"),
        ((F.col("v") / F.col("first.base") - 1) * 100).alias("gain"), ((F.col("v") / top - 1) * 100).alias("drawdown"),
    )


def threshold_zones(df: DataFrame, low: float, high: float) -> DataFrame:
    """Values by zone, with the point at each crossing in both zones, and the baselines where they are drawn."""
    v, before = F.col("v"), F.lag("v").over(by_time())
    is_low, is_high = v < low, v > high
    into_low, out_of_low = is_low & (before >= low), ~is_low & (before < low)
    into_high, out_of_high = is_high & (before <= high), ~is_high & (before > high)
    on = lambda *cs: F.coalesce(F.greatest(*[F.coalesce(c, F.lit(False)) for c in cs]), F.lit(False))
    return df.select(
        "k", "t", F.when(on(is_low, out_of_low), v).alias("low"), F.when(on(~is_low & ~is_high, into_low, into_high), v).alias("middle"), F.when(on(is_high, out_of_high), v).alias("high"),
        F.when(on(is_low, out_of_low), low).alias("low_base"), F.when(on(is_high, out_of_high), high).alias("high_base"),
    )


def range_extrema(df: DataFrame, start: str, end: str) -> DataFrame:
    """By key: lowest and highest value of a range of dates, their first dates, and the number of values."""
    rows = df.filter(F.col("t").between(start, end) & F.col("v").isNotNull())
    return rows.groupBy("k").agg(F.min("v").alias("low"), F.min_by("t", F.struct("v", "t")).alias("low_t"), F.max("v").alias("high"), F.max_by("t", F.struct("v", F.datediff(F.lit("2100-01-01"), "t"))).alias("high_t"), F.count("*").alias("n"))


def autofit_scale(df: DataFrame) -> DataFrame:
    """(k, scale): percent by which a series, in percent of its first value, is stretched so that its range is the upper median of all ranges; 5 to 5000."""
    first = df.filter("v > 0").groupBy("k").agg(F.min_by("v", "t").alias("base"), F.max("v").alias("hi"), F.min("v").alias("lo"))
    ranges = first.select("k", F.greatest((F.col("hi") - F.col("lo")) / F.col("base") * 100, F.lit(1.0)).alias("range"))
    # A row for each series.
    target = ranges.withColumn("i", F.row_number().over(Window.orderBy("range", "k")) - 1).withColumn("n", F.count("*").over(Window.partitionBy())).filter(F.col("i") == F.floor(F.col("n") / 2)).select(F.col("range").alias("target"))
    return ranges.join(F.broadcast(target)).select("k", clamp(F.floor(F.col("target") / F.col("range") * 100 + 0.5).cast("double"), 5, 5000).alias("scale"))


def forward_labels(df: DataFrame, horizon: int, jump: float = 1.5) -> DataFrame:
    """Log returns some rows ahead: own, of the market (mean of its series), and relative; none where a jump lies on the way. Labels: they look ahead."""
    own = F.lead(F.ln("v"), horizon).over(by_time()) - F.ln("v")
    bad = (F.abs(F.ln(F.col("v") / F.lag("v").over(by_time()))) > float(np.log(jump))).cast("int")
    rows = df.withColumn("bad", bad).withColumn("absolute", own)
    rows = rows.withColumn("absolute", F.when(F.coalesce(F.sum("bad").over(by_time().rowsBetween(1, horizon)), F.lit(0)) == 0, F.col("absolute")))
    market = F.avg("absolute").over(Window.partitionBy("market", "t"))
    return rows.select("k", "t", "absolute", market.alias("market_return"), (F.col("absolute") - market).alias("relative")).filter("absolute IS NOT NULL")


def densify(df: DataFrame, calendar: DataFrame, single: tuple[str, ...] = ("leading_cycle", "news_sentiment")) -> DataFrame:
    """Slow series (k, t, v) on market days (t): linear between observations, and the last one carried to where a series ends.

    A series whose last date begins a month ends with that month; of the series in ``single``, one that ends off the calendar
    ends on the next market day (the first named never follows the month's rule). Nothing is made outside a series' own dates.
    """
    from .indicators import interpolate_time

    days = calendar.select("t").distinct()
    ends = df.filter("v IS NOT NULL").groupBy("k").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    # The calendar day after each last date: one window over the dates, whatever the number of series.
    marks = days.withColumn("day", F.col("t")).unionByName(ends.select(F.col("z").alias("t"), F.lit(None).cast("date").alias("day")).distinct())
    dates = marks.groupBy("t").agg(F.max("day").alias("day")).withColumn("following", F.min("day").over(Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)))
    later = ends.join(dates.select(F.col("t").alias("z"), "following", F.col("day").isNotNull().cast("int").alias("on")), "z", "left")
    named = F.col("k").isin(*single)
    end = F.when((F.dayofmonth("z") == 1) & (F.col("k") != single[0]), F.last_day("z")).when(named & (F.coalesce("on", F.lit(0)) == 0), F.coalesce("following", "z")).otherwise(F.col("z"))
    targets = later.withColumn("end", end).filter(F.col("end") >= F.col("a")).select("k", F.explode(F.sequence("a", "end")).alias("t")).join(days, "t", "left_semi").select("k", "t")
    return interpolate_time(df.select("k", "t", "v"), targets, carry=True)


def relationship_lagged(df: DataFrame, n: int = 60, least: int = 30, lag: int = 1) -> DataFrame:
    """Correlation and beta of log changes r to the benchmark's b over rows, as available some rows later, with the number of observations. df: k, t, r, b."""
    both = F.col("r").isNotNull() & F.col("b").isNotNull()
    x, y = F.when(both, F.col("b")), F.when(both, F.col("r"))
    w = trailing(n)
    count, sd = F.count(x).over(w), F.stddev(x).over(w)
    cov = F.covar_samp(y, x).over(w)
    rows = df.withColumn("n", count).withColumn("corr", F.when((count >= least) & (sd > 1e-12), F.corr(y, x).over(w))).withColumn("beta", F.when((count >= least) & (sd > 1e-12), cov / (sd * sd)))
    late = lambda c: F.lag(c, lag).over(by_time()).alias(c)
    return rows.select("k", "t", late("n"), late("corr"), late("beta"))
