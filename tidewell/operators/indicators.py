"""Windows over series: changes, rolling statistics, ranges, interpolation, recursive averages.

Trailing windows only look back, so later rows never change earlier results. Null values occupy their row and are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_time():
    """Rows of one series in order of time."""
    return Window.partitionBy("k").orderBy("t")


def trailing(n: int, until: int = 0):
    return by_time().rowsBetween(-(n - 1) + until, until)


def change_rate(n: int, v: str = "v", log: bool = False) -> Column:
    """Change over n rows; null where the earlier value is about zero."""
    before = F.lag(v, n).over(by_time())
    if log:
        return F.when((before > 1e-9) & (F.col(v) > 1e-9), F.ln(F.col(v) / before))
    return F.when(F.abs(before) > 1e-9, (F.col(v) - before) / F.abs(before))


def change_with_gap(n: int, max_days: int) -> Column:
    before, then = F.lag("v", n).over(by_time()), F.lag("t", n).over(by_time())
    return F.when(F.datediff("t", then) <= max_days, F.when(F.abs(before) > 1e-9, F.col("v") / before - 1))


def trailing_mean(n: int, v: str = "v") -> Column:
    return F.avg(v).over(trailing(n))


def rolling_z(n: int = 252, least: int = 60, v: str = "v") -> Column:
    w = trailing(n)
    sd = F.stddev(v).over(w)
    return F.when((F.count(v).over(w) >= least) & (sd > 1e-12), (F.col(v) - F.avg(v).over(w)) / sd)


def rolling_vol(n: int, v: str = "r", least: int = 2, downside: bool = False) -> Column:
    x = F.when(F.col(v) < 0, F.col(v)) if downside else F.col(v)
    w = trailing(n)
    return F.when(F.count(x).over(w) >= least, F.stddev(x).over(w))


def volatility_profile(df: DataFrame, long: int = 3780, recent: int = 252, least: int = 60, clip: float = 0.12) -> DataFrame:
    """Long and recent deviation of clipped log changes, and their weighted mean. df: k, t, v."""
    rows = df.withColumn("r", change_rate(1, log=True)).withColumn("c", F.greatest(F.least("r", F.lit(clip)), F.lit(-clip)))
    out = rows.withColumn("long_vol", rolling_vol(long, "c", least)).withColumn("recent_vol", rolling_vol(recent, "c", least))
    return out.withColumn("effective", F.coalesce("recent_vol", "long_vol") * 0.75 + F.coalesce("long_vol", "recent_vol") * 0.25).drop("r", "c")


def standardized_return(df: DataFrame, n: int, window: int = 252, floor: float = 0.002, least: int = 20) -> DataFrame:
    rows = df.withColumn("r", change_rate(1, log=True))
    sd = F.greatest(rolling_vol(window, "r", least), F.lit(floor))
    return rows.withColumn("z", change_rate(n, log=True) / (sd * n**0.5)).drop("r")


def rolling_relationship(df: DataFrame, n: int = 60, least: int = 30, least_down: int = 10) -> DataFrame:
    """Rolling correlation, beta and downside beta of changes r against the market's m."""
    w = trailing(n)
    both = F.col("r").isNotNull() & F.col("m").isNotNull()
    a, b = F.when(both, F.col("r")), F.when(both, F.col("m"))
    down = both & (F.col("m") < 0)
    da, db = F.when(down, F.col("r")), F.when(down, F.col("m"))
    count, count_down = F.count(a).over(w), F.count(da).over(w)
    # Sides that don't move have no relation.
    moved = (F.var_pop(a).over(w) * count > 1e-12) & (F.var_pop(b).over(w) * count > 1e-12)
    spread, spread_down = F.nullif(F.var_samp(b).over(w), F.lit(0.0)), F.nullif(F.var_samp(db).over(w), F.lit(0.0))
    return df.select(
        "*",
        F.when((count >= least) & moved, F.covar_pop(a, b).over(w) / F.nullif(F.sqrt(F.var_pop(a).over(w) * F.var_pop(b).over(w)), F.lit(0.0))).alias("corr"),
        F.when((count >= least) & moved, F.covar_samp(a, b).over(w) / spread).alias("beta"),
        F.when(count_down >= least_down, F.covar_samp(da, db).over(w) / spread_down).alias("downside_beta"),
    )


def rolling_pct_rank(n: int, least: int, v: str = "v") -> Column:
    """Share of the previous n values that are at most the current one, which isn't among them."""
    past = F.collect_list(v).over(by_time().rowsBetween(-n, -1))
    return F.when((F.size(past) >= least) & F.col(v).isNotNull(), F.size(F.filter(past, lambda e: e <= F.col(v))) / F.size(past))


def volume_profile(df: DataFrame, n: int = 20, least: int = 10) -> DataFrame:
    """Volume over the mean of the previous n rows, and that mean over the one of the n rows before."""
    one, two = by_time().rowsBetween(-n, -1), by_time().rowsBetween(-2 * n, -n - 1)
    first, second = F.avg("volume").over(one), F.avg("volume").over(two)
    ratio = F.when(F.count("volume").over(one) >= least, F.col("volume") / first)
    return df.withColumn("volume_ratio", ratio).withColumn("volume_trend", F.when(F.count("volume").over(two) >= least, first / second))


def path_efficiency(df: DataFrame, n: int) -> DataFrame:
    """Net log move over the path walked, of the last n steps."""
    rows = df.withColumn("step", F.abs(F.ln(F.col("v") / F.lag("v").over(by_time()))))
    walked = F.sum("step").over(trailing(n))
    return rows.withColumn("efficiency", F.when((F.count("step").over(trailing(n)) >= n) & (walked > 1e-12), F.abs(F.ln(F.col("v") / F.lag("v", n).over(by_time()))) / walked)).drop("step")


def range_features(df: DataFrame, n: int) -> DataFrame:
    w = trailing(n)
    high, low = F.max("v").over(w), F.min("v").over(w)
    return df.select("*", high.alias("hi"), low.alias("lo"), ((F.col("v") / high - 1) * 100).alias("drawdown_pct"), F.when(high > low, (F.col("v") - low) / (high - low)).alias("position"))


def max_drawdown(df: DataFrame) -> DataFrame:
    """By key: the largest fall from a running high."""
    peak = F.max("v").over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("dd", F.col("v") / peak - 1).groupBy("k").agg(F.min("dd").alias("max_drawdown"))


def interpolate_time(df: DataFrame, targets: DataFrame, carry: bool = False) -> DataFrame:
    """Values at the targets' dates, linear in time between the observations around them; none outside, or the last one carried. Looks ahead by nature: never a feature."""
    obs = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    rows = df.select("k", "t", "v", F.lit(False).alias("wanted")).unionByName(targets.select("k", "t", F.lit(None).cast("double").alias("v"), F.lit(True).alias("wanted")))
    # Both frames grow row by row from their end, so a series costs as many steps as it has rows.
    before = F.last(obs, True).over(Window.partitionBy("k").orderBy("t").rangeBetween(Window.unboundedPreceding, 0))
    after = F.last(obs, True).over(Window.partitionBy("k").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("a", before).withColumn("b", after).filter("wanted")
    days = F.datediff("b.t", "a.t")
    value = F.when(F.col("a.t") == F.col("b.t"), F.col("a.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * F.datediff("t", "a.t") / days)
    return rows.select("k", "t", (F.coalesce(value, F.col("a.v")) if carry else value).alias("v"))


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Balance of gains and losses of the last n changes, from -1 to 1, and the usual index."""
    rows = df.withColumn("d", F.col("v") - F.lag("v").over(by_time()))
    w = trailing(n)
    up, down = F.sum(F.when(F.col("d") > 0, F.col("d")).otherwise(0.0)).over(w), F.sum(F.when(F.col("d") < 0, -F.col("d")).otherwise(0.0)).over(w)
    full = (F.count("d").over(w) >= n) & (up + down > 1e-12)
    return rows.withColumn("balance", F.when(full, (up - down) / (up + down))).withColumn("rsi", F.when(full, 100 * up / (up + down))).drop("d")


def lag_observations(df: DataFrame, n: int) -> DataFrame:
    """The value n observations of the source back, on its own dates; to be joined as-of afterwards."""
    return df.filter("v IS NOT NULL").withColumn("v", F.lag("v", n).over(by_time())).filter("v IS NOT NULL")


def claims_signal(df: DataFrame, mean: int = 4, low: int = 52) -> DataFrame:
    """Mean of the last observations, and its rise from the lowest of the previous ones."""
    rows = df.withColumn("m", F.when(F.count("v").over(trailing(mean)) >= mean, F.avg("v").over(trailing(mean))))
    floor = F.min("m").over(by_time().rowsBetween(-low, -1))
    return rows.withColumn("rise", F.when(floor > 0, F.col("m") / floor - 1))


def rolling_median(n: int, v: str = "v") -> Column:
    return F.percentile(v, F.lit(0.5)).over(trailing(n))


def cs_rank(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Percentile rank in each cross-section, ties averaged, centred at 0.5; null where too few have values."""
    from .aggregates import rank_average

    w = Window.partitionBy(*by)
    return df.withColumn("rank", F.when(F.count("v").over(w) >= least, rank_average("v", w) / F.count("v").over(w) - 0.5))


def insert_gap_breaks(df: DataFrame, days: int = 20) -> DataFrame:
    """A null row on the day after a row that is followed by a gap."""
    following = F.lead("t").over(by_time())
    own = F.struct(F.col("t").alias("t"), F.col("v").alias("v"))
    gap = F.struct(F.date_add("t", 1).alias("t"), F.lit(None).cast("double").alias("v"))
    rows = df.withColumn("x", F.when(F.datediff(following, "t") > days, F.array(own, gap)).otherwise(F.array(own)))
    return rows.select("k", F.explode("x").alias("x")).select("k", "x.t", "x.v")


def normalize_to_base(df: DataFrame) -> DataFrame:
    """Values in percent of each key's first value from the date on which all keys have begun."""
    first = df.filter("v IS NOT NULL").groupBy("k").agg(F.min("t").alias("first"))
    base = first.agg(F.max("first").alias("base"))
    at = df.filter("v IS NOT NULL").join(F.broadcast(base), F.col("t") >= F.col("base")).groupBy("k").agg(F.min_by("v", "t").alias("base_v"))
    return df.join(at, "k").select("k", "t", (F.col("v") / F.col("base_v") * 100).alias("v"))


def drop_consecutive_duplicates(df: DataFrame) -> DataFrame:
    before = F.lag("v").over(by_time())
    return df.withColumn("_same", before.eqNullSafe(F.col("v")) & F.lag("t").over(by_time()).isNotNull()).filter("NOT _same").drop("_same")


def stage_transitions(df: DataFrame, stage: str = "stage", least: int = 2) -> DataFrame:
    """Rows on which the stage rises to at least some rank."""
    before = F.coalesce(F.lag(stage).over(by_time()), F.lit(0))
    return df.withColumn("_before", before).filter((F.col(stage) >= least) & (F.col(stage) > F.col("_before"))).drop("_before")


def downsample_minmax(df: DataFrame, budget: int) -> DataFrame:
    """At most about ``budget`` rows by key: the lowest and highest of each bucket of rows, and the first and last row."""
    w = Window.partitionBy("k")
    rows = df.withColumn("rn", F.row_number().over(by_time()) - 1).withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("bucket", F.floor(F.col("rn") / F.greatest(F.lit(1), F.ceil(F.col("n") * 2 / budget))))
    b = Window.partitionBy("k", "bucket")
    rows = rows.withColumn("lo", F.row_number().over(b.orderBy(F.asc_nulls_last("v"), "t"))).withColumn("hi", F.row_number().over(b.orderBy(F.desc_nulls_last("v"), "t")))
    return rows.filter("lo = 1 OR hi = 1 OR rn = 0 OR rn = n - 1").select("k", "t", "v")


def forward_outcomes(df: DataFrame, horizons: tuple[int, ...] = (5, 10, 20, 63), excursion: int = 20) -> DataFrame:
    """Returns some rows ahead, and the best and worst on the way. Labels: they look ahead."""
    w = by_time().rowsBetween(1, excursion)
    out = [(F.lead("v", h).over(by_time()) / F.col("v") - 1).alias(f"return{h}") for h in horizons]
    return df.select("*", *out, (F.max("v").over(w) / F.col("v") - 1).alias("favorable"), (F.min("v").over(w) / F.col("v") - 1).alias("adverse"), F.count("v").over(w).cast("int").alias("path"))


def exclude_actions(df: DataFrame, back: int = 251, ahead: int = 20, jump: float = 1.5) -> DataFrame:
    """Rows without a jump from about a year before to the horizon's end."""
    import math

    rows = df.withColumn("j", (F.abs(change_rate(1, log=True)) > math.log(jump)).cast("int"))
    return rows.withColumn("jumps", F.coalesce(F.sum("j").over(by_time().rowsBetween(-back, ahead)), F.lit(0))).filter("jumps = 0").drop("j", "jumps")
