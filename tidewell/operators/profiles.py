"""Structural profiles of series: trend, range, cycle, runs and drawdowns of their month ends, and how they move with their market.

Only completed months count. Episodes are gaps and islands, cycles are correlations of the months' residuals with themselves some months before, by a
join on the month's number; so a profile is a few groupings by key over a few hundred months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versioned import stored

# Days of a year and of the recent past, shortest and longest cycle in months, and the parts of the history that must agree on it.
YEAR, RECENT, RELATED, LEAST_RELATED, MOST = 252, 756, 756, 60, 3780
SHORTEST, LONGEST, FIRST_PART, SECOND_PART = 12, 60, 0.65, 0.35


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _by(*order: str):
    return Window.partitionBy("k").orderBy(*order)


def _correlation(a: Column, b: Column) -> Column:
    """0 where there are fewer than three pairs, or a side doesn't move."""
    spread = F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0))
    return F.coalesce(F.when(F.count(a) >= 3, F.covar_pop(a, b) / spread), F.lit(0.0))


def completed(df: DataFrame) -> DataFrame:
    """(k, t, v, bench, back): positive points of months before the last one, if these are a year at least; back counts from the last point."""
    whole = Window.partitionBy("k")
    rows = df.filter("v > 0").withColumn("age", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t")))).filter(F.col("age") <= MOST).withColumn("month", F.trunc("t", "month")).withColumn("before", F.col("month") < F.max("month").over(whole)).withColumn("n", F.count_if("before").over(whole))
    rows = rows.filter(F.col("before") | (F.col("n") < YEAR))
    return rows.select("k", "t", "v", "bench", "month", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t"))).alias("back"))


def month_ends(points: DataFrame) -> DataFrame:
    """(k, month, i, v, x): the last price of each month, its number and logarithm."""
    ends = points.groupBy("k", "month").agg(F.max_by("v", "t").alias("v"))
    return ends.select("k", "month", (F.row_number().over(_by("month")) - 1).alias("i"), "v", F.ln("v").alias("x"))


def trends(points: DataFrame) -> DataFrame:
    """By key: slope, fit, efficiency, crossings of the median and the scores of rising, falling and ranging."""
    months = month_ends(points)
    step = F.abs(F.col("x") - F.lag("x").over(_by("i")))
    fit = months.withColumn("step", step).groupBy("k").agg(
        F.count("*").alias("months"), F.regr_slope("x", "i").alias("slope"), F.regr_intercept("x", "i").alias("intercept"), F.var_pop("x").alias("spread"), F.covar_pop("x", F.col("i").cast("double")).alias("co"), F.var_pop("i").alias("of_i"),
        F.sum("step").alias("walked"), F.min_by("x", "i").alias("first_x"), F.max_by("x", "i").alias("last_x"), F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"),
    )
    fit = fit.withColumn("slope", F.when(F.col("months") >= 3, F.col("slope")).otherwise(0.0)).withColumn("fit", F.when((F.col("months") >= 3) & (F.col("spread") > 0), _unit(F.col("co") ** 2 / F.nullif(F.col("of_i") * F.col("spread"), F.lit(0.0)))).otherwise(0.0))
    side = F.col("x") - F.col("q")[1]
    width = F.greatest(F.lit(0.0001), F.col("q")[2] - F.col("q")[0])
    sides = months.join(fit.select("k", "q"), "k").withColumn("side", F.when(F.abs(side) > width * 0.03, F.signum(side))).filter("side IS NOT NULL")
    crossed = sides.withColumn("c", (F.lag("side").over(_by("i")) != F.col("side")).cast("int")).groupBy("k").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("crossings"))
    daily = points.withColumn("r", F.ln(F.col("v") / F.lag("v").over(_by("t")))).groupBy("k").agg((F.coalesce(F.stddev("r"), F.lit(0.0)) * YEAR**0.5).alias("volatility"), (F.datediff(F.max("t"), F.min("t")) / 365.25).alias("history"))
    rows = fit.join(crossed, "k", "left").join(daily, "k").withColumn("years", F.greatest(F.lit(0.25), F.col("history"))).withColumn("rate", F.coalesce("crossings", F.lit(0)) / F.col("years"))
    rows = rows.withColumn("yearly", (F.col("last_x") - F.col("first_x")) / F.col("years")).withColumn("yearly_slope", F.col("slope") * 12).withColumn("efficiency", F.coalesce(F.abs(F.col("last_x") - F.col("first_x")) / F.nullif("walked", F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("strength", _unit(F.abs("yearly_slope") / F.greatest(F.lit(0.08), F.col("volatility") * 0.65)))
    score = F.col("strength") * (0.35 + F.col("fit") * 0.35 + F.col("efficiency") * 0.3)
    ranging = _unit((1 - F.col("strength")) * 0.28 + (1 - F.col("fit")) * 0.2 + (1 - F.col("efficiency")) * 0.22 + _unit(F.col("rate") / 1.5) * 0.3)
    return rows.select("k", "months", "slope", "intercept", "fit", "efficiency", "volatility", "history", "years", "rate", "yearly", "yearly_slope", F.when(F.col("yearly_slope") > 0, score).otherwise(0.0).alias("up"), F.when(F.col("yearly_slope") < 0, score).otherwise(0.0).alias("down"), ranging.alias("ranging"))


def cycles(months: DataFrame, trend: DataFrame) -> DataFrame:
    """By key: the lag at which the residuals of the trend resemble themselves most, in the whole history and in both of its overlapping parts."""
    rows = months.join(trend.select("k", F.col("months").alias("n"), "slope", "intercept"), "k").select("k", "i", "n", F.when(F.col("n") >= 3, F.col("x") - F.col("intercept") - F.col("slope") * F.col("i")).otherwise(0.0).alias("e"))
    most = F.least(F.lit(LONGEST), F.floor((F.col("n") - 8) / 2))
    later = rows.filter(most >= SHORTEST).withColumn("lag", F.explode(F.sequence(F.lit(SHORTEST), most.cast("int")))).withColumn("j", F.col("i") - F.col("lag"))
    pairs = later.join(rows.select("k", F.col("i").alias("j"), F.col("e").alias("before")), ["k", "j"])
    first, second = F.ceil(F.col("n") * FIRST_PART), F.floor(F.col("n") * SECOND_PART)
    part = lambda on: _correlation(F.when(on, F.col("e")), F.when(on, F.col("before")))
    full = pairs.groupBy("k", "n", "lag").agg(_correlation(F.col("e"), F.col("before")).alias("whole"), F.when(F.max(first) >= F.max("lag") + 8, part(F.col("i") < first)).otherwise(0.0).alias("one"), F.when(F.max(F.col("n") - second) >= F.max("lag") + 8, part(F.col("j") >= second)).otherwise(0.0).alias("two"))
    stable = F.least(F.greatest(F.lit(0.0), F.col("one")), F.greatest(F.lit(0.0), F.col("two")))
    cover = _unit((F.col("n") / F.col("lag") - 1.5) / 2.5)
    rated = full.withColumn("stable", stable).withColumn("seen", F.col("n") / F.col("lag")).withColumn("confidence", _unit(F.greatest(F.lit(0.0), F.col("whole")) * 0.45 + F.col("stable") * 0.4 + cover * 0.15) * cover)
    best = rated.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("confidence"), "lag"))).filter("_n = 1")
    real = (F.col("whole") >= 0.2) & (F.col("stable") >= 0.08)
    return best.select("k", F.col("lag").alias("period"), F.when(real, F.col("confidence")).otherwise(0.0).alias("cyclical"), (real & (F.col("confidence") >= 0.35)).alias("stable_cycle"), F.col("seen").alias("cycles_seen"))


def runs(months: DataFrame) -> DataFrame:
    """By key: the direction that the last half year took and since when, and how long such runs last. A run goes on through months without direction."""
    w = _by("i")
    sd = months.withColumn("d", F.col("x") - F.lag("x").over(w)).groupBy("k").agg(F.greatest(F.lit(0.025), F.coalesce(F.stddev("d"), F.lit(0.0)) * 6**0.5 * 0.3).alias("least"))
    earlier = F.coalesce(F.lag("x", 6).over(w), F.first("x").over(w))
    rows = months.withColumn("change", F.when(F.col("i") >= 3, F.col("x") - earlier)).join(sd, "k")
    rows = rows.withColumn("s", F.when(F.col("change") > F.col("least"), 1).when(F.col("change") < -F.col("least"), -1))
    rows = rows.withColumn("s", F.last("s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("s IS NOT NULL")
    rows = rows.withColumn("new", F.coalesce((F.lag("s").over(w) != F.col("s")).cast("int"), F.lit(1)))
    each = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("k", "run", "s").agg(F.count("*").alias("n"))
    length = lambda s, q: F.coalesce(F.percentile(F.when(F.col("s") == s, F.col("n")), F.lit(q)), F.lit(0.0))
    return each.groupBy("k").agg(F.max_by("s", "run").alias("run_state"), F.max_by("n", "run").alias("run_months"), length(1, 0.5).alias("up_median"), length(1, 0.75).alias("up_upper"), length(-1, 0.5).alias("down_median"), length(-1, 0.75).alias("down_upper"))


def drawdowns(months: DataFrame) -> DataFrame:
    """By key: the present drawdown, how it ranks among those that ended, and whether the last months speak for its end."""
    w = _by("i")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = months.withColumn("peak", F.max("v").over(so_far)).withColumn("top", (F.col("v") >= F.col("peak")).cast("int"))
    rows = rows.withColumn("episode", F.sum("top").over(so_far)).withColumn("tops", F.sum("top").over(Window.partitionBy("k")))
    ended = rows.filter("top = 0 AND episode < tops").groupBy("k", "episode").agg(F.count("*").alias("n"), F.max(1 - F.col("v") / F.col("peak")).alias("depth"))
    now = rows.groupBy("k").agg(F.max_by(F.struct((F.col("v") / F.col("peak") - 1).alias("down"), "x"), "i").alias("last"), F.sum(((F.col("episode") == F.col("tops")) & (F.col("top") == 0)).cast("int")).alias("months_down"), F.max("i").alias("at"))
    moves = months.join(now.select("k", "at"), "k").groupBy("k").agg(F.max(F.when(F.col("i") == F.col("at") - 1, F.col("x"))).alias("x1"), F.max(F.when(F.col("i") == F.col("at") - 3, F.col("x"))).alias("x3"))
    both = now.join(moves, "k").join(ended, "k", "left").withColumn("down", F.col("last.down"))
    rank = lambda x, at: (F.coalesce(F.avg(F.when(x < at, 1.0).when(x == at, 0.5).when(x > at, 0.0)), F.lit(0.5)))
    out = both.groupBy("k", "down", "months_down", "last", "x1", "x3").agg(rank(F.col("n"), F.col("months_down")).alias("duration_rank"), rank(F.col("depth"), -F.col("down")).alias("depth_rank"), F.count("n").alias("ended"))
    one = F.coalesce(F.col("last.x") - F.col("x1"), F.lit(0.0))
    three = F.coalesce(F.col("last.x") - F.col("x3"), one)
    confirmed = _unit(F.greatest(F.lit(0.0), one) / 0.08 * 0.45 + F.greatest(F.lit(0.0), three) / 0.18 * 0.55)
    pressure = F.when(F.col("down") < -0.08, _unit(F.col("duration_rank") * 0.45 + F.col("depth_rank") * 0.55)).otherwise(0.0)
    return out.select("k", F.col("down").alias("drawdown"), "months_down", "duration_rank", "depth_rank", "ended", confirmed.alias("confirmed"), (pressure * (0.15 + confirmed * 0.85)).alias("readiness"), (pressure * (1 - confirmed)).alias("unconfirmed"))


def relations(points: DataFrame) -> DataFrame:
    """By key: correlation and betas of the last changes with the market's, whose value is the last known."""
    w = _by("t")
    rows = points.withColumn("b", F.last("bench", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("b > 0")
    rows = rows.withColumn("r", F.ln(F.col("v") / F.lag("v").over(w))).withColumn("m", F.ln(F.col("b") / F.lag("b").over(w))).filter(F.col("r").isNotNull() & (F.col("back") <= RELATED))
    a, b = F.when(F.col("m") < 0, F.col("r")), F.when(F.col("m") < 0, F.col("m"))
    beta = lambda x, y: F.coalesce(F.covar_pop(x, y) / F.nullif(F.var_pop(y), F.lit(0.0)), F.lit(0.0))
    return rows.groupBy("k").agg(_correlation(F.col("r"), F.col("m")).alias("correlation"), beta(F.col("r"), F.col("m")).alias("beta"), beta(a, b).alias("downside_beta"), F.count("*").alias("related")).filter(F.col("related") >= LEAST_RELATED)


SCORES = ("trend_up", "trend_down", "range_bound", "cyclical", "low_volatility", "high_volatility", "defensive", "index_independent", "persistent_decline")


def structural_profile(df: DataFrame) -> DataFrame:
    """One row by key with a year of history: nine scores, the three highest, and what they come from. df: k, t, v, bench."""
    points = stored(completed(df), "profile")
    months = stored(month_ends(points), "profile")
    long = stored(trends(points), "profile")
    recent = trends(points.filter(F.col("back") <= RECENT)).select("k", *[F.col(c).alias(f"recent_{c}") for c in ("up", "down", "ranging", "volatility", "years")])
    enough = points.groupBy("k").count().filter(F.col("count") >= YEAR).select("k")
    rows = enough.join(long, "k").join(recent, "k").join(cycles(months, long), "k", "left").join(runs(months), "k", "left").join(drawdowns(months), "k").join(relations(points), "k", "left")
    rows = rows.fillna(0.0, ["cyclical", "cycles_seen", "correlation", "beta", "downside_beta"]).fillna(0, ["period", "related", "run_state", "run_months"]).fillna(False, ["stable_cycle"])
    mixed = F.col("volatility") * 0.55 + F.col("recent_volatility") * 0.45
    rows = rows.withColumn("low_volatility", _unit((0.5 - mixed) / 0.35)).withColumn("high_volatility", _unit((mixed - 0.35) / 0.45)).withColumn("index_independent", _unit(1 - F.abs("correlation")))
    rows = rows.withColumn("trend_up", _unit(F.col("up") * 0.55 + F.col("recent_up") * 0.45)).withColumn("trend_down", _unit(F.col("down") * 0.55 + F.col("recent_down") * 0.45)).withColumn("range_bound", _unit(F.col("ranging") * 0.65 + F.col("recent_ranging") * 0.35))
    rows = rows.withColumn("defensive", _unit(F.col("low_volatility") * 0.35 + _unit((1 - F.col("downside_beta")) / 1.5) * 0.4 + F.col("index_independent") * 0.25)).withColumn("persistent_decline", _unit(F.col("down") * 0.35 + F.col("recent_down") * 0.4 + F.col("unconfirmed") * 0.25))
    # The highest first, of equals the first named.
    ranked = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(SCORES)]))
    quality = _unit(F.least(F.lit(1.0), F.col("history") / 10) * 0.65 + F.least(F.lit(1.0), F.col("related") / (3 * YEAR)) * 0.35)
    return rows.withColumn("dominant", F.transform(F.slice(ranked, 1, 3), lambda x: x["name"])).withColumn("quality", quality).drop("slope", "intercept")
