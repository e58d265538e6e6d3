"""Data quality of series: issues, gaps, discontinuities, freshness, regression against an earlier run, tail acceptance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def by_time():
    """Rows of one series in order of time."""
    return Window.partitionBy("k").orderBy("t")


def inspect_series(df: DataFrame, low: float, high: float, rel: float, absolute: float) -> DataFrame:
    """Issues (k, t, issue): zeros, values out of range, jumps that are large both relatively and absolutely."""
    last = F.last(F.when(F.col("v") > 0, F.col("v")), True).over(by_time().rowsBetween(Window.unboundedPreceding, -1))
    change = F.abs(F.col("v") - last)
    found = F.filter(
        F.array(
            F.when(F.col("v") == 0, "zero"),
            F.when((F.col("v") < low) | (F.col("v") > high), "range"),
            F.when((F.col("v") > 0) & (change > absolute) & (change / last > rel), "jump"),
        ),
        lambda x: x.isNotNull(),
    )
    return df.withColumn("issues", found).select("k", "t", F.explode("issues").alias("issue"))


def recent_changes(df: DataFrame, points: int, rel: float | None, absolute: float | None, max_gap: int) -> DataFrame:
    """Anomalous changes among the latest points of each key; with one limit it alone counts, with two both must be broken. Wide gaps are skipped."""
    rows = df.filter("v IS NOT NULL").withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t")))).filter(F.col("rn") <= points)
    before, then = F.lag("v").over(by_time()), F.lag("t").over(by_time())
    rows = rows.withColumn("before", before).withColumn("gap", F.datediff("t", then)).filter(F.col("gap") <= max_gap)
    change = F.abs(F.col("v") - F.col("before"))
    tests = [change / F.abs(F.col("before")) > rel] if rel is not None else []
    tests += [change > absolute] if absolute is not None else []
    wrong = tests[0] if len(tests) == 1 else tests[0] & tests[1]
    return rows.filter((F.abs("before") > 1e-9) & wrong).select("k", "t", "before", "v")


def missing_days(df: DataFrame, calendar: DataFrame, tail: int | None = None) -> DataFrame:
    """Calendar days (market, t) inside each series' span without a row; with ``tail``, the latest ones only."""
    span = df.filter("v IS NOT NULL").groupBy("k", "market").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    expected = span.join(calendar, "market").filter("t BETWEEN a AND b").select("k", "t")
    gone = expected.join(df.filter("v IS NOT NULL").select("k", "t"), ["k", "t"], "left_anti")
    if tail is None:
        return gone
    return gone.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t")))).filter(F.col("rn") <= tail).drop("rn")


def first_discontinuity(df: DataFrame, rate: float, absolute: float) -> DataFrame:
    """By key: the first date whose change a day is beyond both limits."""
    rows = df.filter("v IS NOT NULL")
    before, days = F.lag("v").over(by_time()), F.datediff("t", F.lag("t").over(by_time()))
    rows = rows.withColumn("rate", F.abs(F.col("v") / before - 1) / days).withColumn("step", F.abs(F.col("v") - before) / days)
    return rows.filter((F.col("rate") > rate) & (F.col("step") > absolute)).groupBy("k").agg(F.min("t").alias("t"), F.min_by("rate", "t").alias("rate"))


def accept_tail(seed: DataFrame, live: DataFrame, rel: float) -> DataFrame:
    """Live rows after the seed that follow from the last accepted value: one isolated break is skipped, two in a row end the tail.

    The order matters, so each key's new rows are walked once; they are the few since the last run.
    """
    last = seed.filter("v IS NOT NULL").groupBy("k").agg(F.max("t").alias("last_t"), F.max_by("v", "t").alias("last_v"))
    rows = live.filter("v IS NOT NULL").join(last, "k").filter("t > last_t").select("k", "t", F.col("v").cast("double").alias("v"), "last_v")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        at, breaks, kept = group["last_v"].iloc[0], 0, []
        for v in group["v"]:
            good = breaks < 2 and abs(v - at) <= abs(at) * rel
            kept.append(good)
            at, breaks = (v, 0) if good else (at, breaks + 1)
            if breaks == 2:
                break
        return group[["k", "t", "v"]].iloc[: len(kept)][kept]

    return rows.groupBy("k").applyInPandas(walk, f"k {dict(rows.dtypes)['k']}, t date, v double")


def price_integrity(df: DataFrame, ratio: float, max_gap: int) -> DataFrame:
    """Split-like steps: a ratio of neighbours beyond the threshold within some days."""
    before = F.lag("v").over(by_time())
    rows = df.filter("v > 0").withColumn("before", before).withColumn("gap", F.datediff("t", F.lag("t").over(by_time())))
    rows = rows.withColumn("ratio", F.greatest(F.col("v") / F.col("before"), F.col("before") / F.col("v")))
    return rows.filter((F.col("ratio") >= ratio) & (F.col("gap") <= max_gap)).select("k", "t", "ratio")


def freshness(df: DataFrame, today: str, policy: DataFrame) -> DataFrame:
    """By key: age of the latest value, and whether it is stale by the policy (k, max_age_days)."""
    last = df.filter("v IS NOT NULL").groupBy("k").agg(F.max("t").alias("latest"))
    rows = policy.join(last, "k", "left").withColumn("age", F.datediff(F.lit(today).cast("date"), "latest"))
    return rows.select("k", "latest", "age", F.when(F.col("latest").isNull(), "missing").when(F.col("age") > F.col("max_age_days"), "stale").otherwise("fresh").alias("status"))


def output_regression(before: DataFrame, after: DataFrame, share: float = 0.8) -> DataFrame:
    """By key: what got worse since the earlier output: latest date, or number of values."""
    stats = lambda df, x: df.filter("v IS NOT NULL").groupBy("k").agg(F.max("t").alias(f"{x}_latest"), F.count("*").alias(f"{x}_n"))
    rows = stats(before, "a").join(stats(after, "b"), "k", "full")
    problem = F.when(F.col("b_n").isNull(), "lost").when(F.col("b_latest") < F.col("a_latest"), "latest regressed").when(F.col("b_n") < F.col("a_n") * share, "rows lost")
    return rows.withColumn("problem", problem).filter("problem IS NOT NULL").select("k", "problem", "a_n", "b_n")


def validate_rows(df: DataFrame) -> DataFrame:
    """By key: rows, dates that don't increase, values that aren't finite."""
    repeat = F.count("*").over(Window.partitionBy("k", "t"))
    return df.withColumn("_r", repeat).groupBy("k").agg(F.count("*").alias("n"), F.sum((F.col("_r") > 1).cast("int")).alias("repeated_dates"), F.sum(F.col("v").isNull().cast("int")).alias("empty"))


def classify_mutability(df: DataFrame, tail_days: int) -> DataFrame:
    """Rows as settled or mutable, by the days before their key's latest date."""
    last = F.max("t").over(Window.partitionBy("k"))
    return df.withColumn("state", F.when(F.col("t") >= F.date_sub(last, tail_days), "mutable").otherwise("settled"))


def fingerprint(df: DataFrame, rows: int = 64) -> DataFrame:
    """By key: a hash of the latest rows, to skip what hasn't changed."""
    tail = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t")))).filter(F.col("rn") <= rows)
    return tail.groupBy("k").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("t", "v")))), 256).alias("fingerprint"))


def is_trading_day(calendar: DataFrame, closed: DataFrame, fixed: tuple[str, ...] = ("01-01", "12-25")) -> DataFrame:
    """Days (t) that are weekdays, neither closed nor a fixed holiday, nor the year's last weekday."""
    weekday = F.dayofweek("t").between(2, 6)
    end = F.make_date(F.year("t"), F.lit(12), F.lit(31))
    last = F.when(F.dayofweek(end) == 1, F.date_sub(end, 2)).when(F.dayofweek(end) == 7, F.date_sub(end, 1)).otherwise(end)
    open_ = weekday & ~F.date_format("t", "MM-dd").isin(*fixed) & (F.col("t") != last)
    return calendar.filter(open_).join(closed, "t", "left_anti")


def eligible_series(df: DataFrame, least: int, today: str, days: int = 45) -> DataFrame:
    out = df.filter("v > 0").groupBy("k").agg(F.count("*").alias("n"), F.max("t").alias("latest"), F.sum((F.coalesce("volume", F.lit(0.0)) <= 0).cast("int")).alias("no_volume"))
    return out.filter((F.col("n") >= least) & (F.datediff(F.lit(today).cast("date"), "latest") <= days))
