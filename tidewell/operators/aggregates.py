"""Aggregations over panels: statistics, agreement, gaps, evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_time():
    """Rows of one series in order of time."""
    return Window.partitionBy("k").orderBy("t")


def series_stats(df: DataFrame) -> DataFrame:
    finite = F.col("v").isNotNull()
    return df.groupBy("k").agg(
        F.min(F.when(finite, F.col("t"))).alias("first_t"), F.max(F.when(finite, F.col("t"))).alias("latest_t"), F.sum(finite.cast("int")).alias("n"), F.max_by("v", F.when(finite, F.col("t"))).alias("latest_v")
    )


def quantile(v: str, p: float) -> Column:
    """Quantile with linear interpolation, exact."""
    return F.percentile(v, F.lit(p))


def lower_tail_mean(df: DataFrame, by: str, p: float = 0.1) -> DataFrame:
    """Mean of the max(1, ceil(n * p)) smallest values of each group."""
    w = Window.partitionBy(by)
    rows = df.filter("v IS NOT NULL").withColumn("rn", F.row_number().over(w.orderBy("v", "t"))).withColumn("n", F.count("*").over(w))
    return rows.filter(F.col("rn") <= F.greatest(F.lit(1), F.ceil(F.col("n") * p))).groupBy(by).agg(F.avg("v").alias("tail_mean"), F.count("*").alias("n"))


def weighted_median(df: DataFrame, by: str, v: str, weight: str) -> DataFrame:
    """The smallest value up to which at least half of the weight lies."""
    w = Window.partitionBy(by)
    running = F.sum(weight).over(w.orderBy(v).rangeBetween(Window.unboundedPreceding, 0))
    rows = df.filter(F.col(v).isNotNull() & (F.col(weight) > 0)).withColumn("_c", running).withColumn("_all", F.sum(weight).over(w))
    return rows.filter(F.col("_c") * 2 >= F.col("_all")).groupBy(by).agg(F.min(v).alias("weighted_median"))


def wilson_low(hits: Column, n: Column, z: float = 1.96) -> Column:
    p = hits / n
    middle = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (middle - spread) / (1 + z * z / n))


def median_scale(a: DataFrame, b: DataFrame) -> DataFrame:
    """By key: the median ratio a / b over common dates with positive values; 1 without any."""
    rows = a.select("k", "t", F.col("v").alias("va")).join(b.select("k", "t", F.col("v").alias("vb")), ["k", "t"])
    ratio = F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("va") / F.col("vb"))
    return rows.groupBy("k").agg(F.coalesce(F.percentile(ratio, F.lit(0.5)), F.lit(1.0)).alias("scale"), F.count(ratio).alias("n_overlaps"))


def detect_rebase(old: DataFrame, new: DataFrame, band: float = 1.8, least: int = 3) -> DataFrame:
    """Keys whose new provider's history has another base: median ratio outside the band over enough dates."""
    rows = median_scale(new, old)
    return rows.filter((F.col("n_overlaps") >= least) & ((F.col("scale") > band) | (F.col("scale") < 1 / band)))


def directional_agreement(df: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Share (whole percent) of joint changes of v and v_right in one direction, where neither is flat. df: k, t, v, v_right and grouping columns of the key."""
    w = Window.partitionBy("k").orderBy("t")
    rows = df.filter("v IS NOT NULL AND v_right IS NOT NULL")
    rows = rows.withColumn("a", F.signum(F.col("v") - F.lag("v").over(w))).withColumn("b", F.signum(F.col("v_right") - F.lag("v_right").over(w)))
    rows = rows.filter("a <> 0 AND b <> 0")
    out = rows.groupBy(*by).agg(F.count("*").alias("samples"), F.sum((F.col("a") == F.col("b")).cast("int")).alias("agreed"))
    return out.withColumn("rate", F.when(F.col("samples") >= least, F.floor(F.col("agreed") * 100 / F.col("samples") + 0.5)).cast("long"))


def history_density(df: DataFrame) -> DataFrame:
    """By key: rows, span, median gap in days, and whether the history is dense: too short to tell, small gaps, or many rows a year."""
    gaps = df.withColumn("gap", F.datediff("t", F.lag("t").over(by_time())))
    out = gaps.groupBy("k").agg(F.count("*").alias("n"), F.datediff(F.max("t"), F.min("t")).alias("span"), F.percentile("gap", F.lit(0.5)).alias("median_gap"))
    a_year = F.col("n") * 365.25 / F.greatest("span", F.lit(1))
    return out.withColumn("dense", (F.col("n") < 24) | (F.col("span") < 180) | (F.col("median_gap") <= 4) | (a_year >= 120))


def audit_gaps(df: DataFrame, calendar: DataFrame, days: int = 10) -> DataFrame:
    """Gaps of over some days in each series, with the sessions of its market's own calendar strictly inside, and the change over it. calendar: market, t."""
    ordinal = calendar.select("market", F.col("t").alias("ct"), F.row_number().over(Window.partitionBy("market").orderBy("t")).alias("ordinal"))
    w = Window.partitionBy("k").orderBy("t")
    rows = df.select("k", "market", "t", "v").join(ordinal.withColumnRenamed("ct", "t"), ["market", "t"])
    rows = rows.select("k", "market", F.lag("t").over(w).alias("from_t"), F.col("t").alias("to_t"), (F.col("ordinal") - F.lag("ordinal").over(w) - 1).alias("sessions"), ((F.col("v") / F.lag("v").over(w) - 1) * 100).alias("change_pct"))
    return rows.filter(F.datediff("to_t", "from_t") > days)


def temporal_coverage(df: DataFrame) -> DataFrame:
    """By key: years with rows, and the largest share that one year has."""
    years = df.groupBy("k", F.year("t").alias("y")).agg(F.count("*").alias("n"))
    return years.groupBy("k").agg(F.count("*").alias("years"), (F.max("n") / F.sum("n")).alias("max_share"))


def net_trades(df: DataFrame) -> DataFrame:
    """Trades of one reporter and day are netted where there are both directions (a zero net goes); others stay as they are."""
    rows = df.groupBy("k", "reporter", "t").agg(F.sum("changed").alias("net"), F.sum((F.col("changed") > 0).cast("int")).alias("buys"), F.sum((F.col("changed") < 0).cast("int")).alias("sells"))
    both = rows.filter("buys > 0 AND sells > 0 AND abs(net) > 1e-9").select("k", "reporter", "t", "net", F.lit(True).alias("netted"))
    one = df.join(rows.filter("buys > 0 AND sells > 0").select("k", "reporter", "t"), ["k", "reporter", "t"], "left_anti").select("k", "reporter", "t", F.col("changed").alias("net"), F.lit(False).alias("netted"))
    return both.unionByName(one)


def latest_per_group(df: DataFrame, by: list[str], inner: str, order: list[str], n: int) -> DataFrame:
    """The latest row of each inner group, and of those the latest n of each outer group."""
    one = Window.partitionBy(*by, inner).orderBy(*[F.desc(c) for c in order])
    top = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    rows = df.withColumn("_one", F.row_number().over(one)).filter("_one = 1").drop("_one")
    return rows.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= n)


def rank_average(v: str, over) -> Column:
    """Rank among the values that aren't null, ties sharing their mean rank. over: a window without an order."""
    return F.when(F.col(v).isNotNull(), F.rank().over(over.orderBy(F.asc_nulls_last(v))) + (F.count("*").over(over.orderBy(F.asc_nulls_last(v)).rangeBetween(0, 0)) - 1) / 2.0)


def daily_rank_ic(df: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Spearman correlation of prediction and outcome in each cross-section, its mean and its mean over its deviation."""
    w = Window.partitionBy(*by)
    rows = df.filter("p IS NOT NULL AND y IS NOT NULL")
    rows = rows.withColumn("rp", rank_average("p", w)).withColumn("ry", rank_average("y", w))
    each = rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("p").alias("np"), F.countDistinct("y").alias("ny"), F.corr("rp", "ry").alias("ic"))
    each = each.filter(f"n >= {least} AND np >= 2 AND ny >= 2")
    return each.groupBy(by[0]).agg(F.count("*").alias("days"), F.avg("ic").alias("mean_ic"), (F.avg("ic") / F.stddev("ic")).alias("information_ratio"))


def top_bottom_spread(df: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """Mean outcome of the highest fifth of predictions less that of the lowest, by cross-section."""
    w = Window.partitionBy(*by)
    rows = df.filter("p IS NOT NULL AND y IS NOT NULL").withColumn("n", F.count("*").over(w)).filter(F.col("n") >= least)
    rows = rows.withColumn("rn", F.row_number().over(w.orderBy("p", "k"))).withColumn("q", F.floor(F.col("n") / 5))
    return rows.groupBy(*by).agg((F.avg(F.when(F.col("rn") > F.col("n") - F.col("q"), F.col("y"))) - F.avg(F.when(F.col("rn") <= F.col("q"), F.col("y")))).alias("spread"))


def feature_diagnostics(df: DataFrame) -> DataFrame:
    """Each feature of a map column with its correlation to the target and mean target where it is and isn't positive."""
    rows = df.select(F.explode("features").alias("feature", "x"), "y").filter("x IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy("feature").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr"), F.avg(F.when(F.col("x") > 0, F.col("y"))).alias("mean_active"), F.avg(F.when(F.col("x") <= 0, F.col("y"))).alias("mean_inactive"))


def summarize_forecast(df: DataFrame, by: list[str]) -> DataFrame:
    """Errors of predicted against actual: MAE, signed, RMSE, median, skill over no change, direction accuracy."""
    e = F.col("predicted") - F.col("actual")
    mae = F.avg(F.abs(e))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), mae.alias("mae"), F.avg(e).alias("signed"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_ae"),
        (1 - mae / F.avg(F.abs("actual"))).alias("skill"), F.avg((F.signum("predicted") == F.signum("actual")).cast("double")).alias("direction"),
    )


def summarize_timing(df: DataFrame, by: list[str]) -> DataFrame:
    """Outcome summary of signals: hit rate with its Wilson bound, mean, median, lower decile, payoff ratio. df: a return by row."""
    r = F.col("ret")
    hits, n = F.sum((r > 0).cast("int")), F.count(r)
    return df.filter("ret IS NOT NULL").groupBy(*by).agg(
        n.alias("n"), (hits / n).alias("hit_rate"), wilson_low(hits, n).alias("hit_low"), F.avg(r).alias("mean"), F.percentile(r, F.lit(0.5)).alias("median"), F.percentile(r, F.lit(0.1)).alias("lower_decile"),
        (F.avg(F.when(r > 0, r)) / F.abs(F.avg(F.when(r < 0, r)))).alias("payoff"),
    )


def summarize_segments(df: DataFrame) -> DataFrame:
    """Mean return by side, market and year, each alone and all together, in one pass."""
    return df.filter("ret IS NOT NULL").cube("side", "market", "year").agg(F.count("*").alias("n"), F.avg("ret").alias("mean")).filter(
        (F.col("side").isNotNull().cast("int") + F.col("market").isNotNull().cast("int") + F.col("year").isNotNull().cast("int")) != 2
    )


def effective_period(df: DataFrame, start: str, end: str, slack: int = 10) -> DataFrame:
    """By key: the window that its rows cover: full when it starts within some days of the window, else whole months."""
    rows = df.filter(F.col("t").between(start, end) & F.col("v").isNotNull()).groupBy("k").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    full = F.datediff("a", F.lit(start).cast("date")) <= slack
    return rows.select("k", full.alias("full"), F.when(~full, F.floor(F.datediff("b", "a") / 30.4375)).cast("long").alias("months"))


def stability(df: DataFrame, cohort: str, least: int) -> DataFrame:
    """By side: cohorts with enough outcomes, how many have a positive mean, their mean and worst."""
    each = df.filter("ret IS NOT NULL").groupBy("side", cohort).agg(F.count("*").alias("n"), F.avg("ret").alias("mean")).filter(F.col("n") >= least)
    return each.groupBy("side").agg(F.count("*").alias("cohorts"), F.sum((F.col("mean") > 0).cast("int")).alias("positive"), F.avg("mean").alias("mean"), F.min("mean").alias("worst"))


def evaluate_events(events: DataFrame, prices: DataFrame, horizon: int, least: float = 0.05) -> DataFrame:
    """By group: how often a signal of some strength had the direction of the return from the first row on or after it. events: k, t, grp, signal."""
    from . import asof, indicators

    ahead = prices.select("k", "t", (F.lead("v", horizon).over(indicators.by_time()) / F.col("v") - 1).alias("v"))
    rows = asof.asof_forward(events.filter(F.abs("signal") >= least), ahead, 14).filter("v_right IS NOT NULL")
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg((F.signum("signal") == F.signum("v_right")).cast("double")).alias("accuracy"))


def tail_failures(df: DataFrame, n: int) -> DataFrame:
    """The worst outcomes of each side, ranked."""
    worst = F.when(F.col("side") == "buy", F.col("ret")).otherwise(-F.col("ret"))
    rows = df.filter("ret IS NOT NULL").withColumn("worst", worst)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy("worst", "k", "t"))).filter(F.col("rank") <= n).select("side", "rank", "k", "t", "ret")


def envelope(df: DataFrame) -> DataFrame:
    return df.groupBy("t").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"))
