"""What became of signals and forecasts: outcomes by path, and their summaries in one grouping; liquidity; trading days with exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import wilson_low
from .indicators import by_time, trailing

# How far a move must go to count, by kind of series, and how full a path must be.
STOCK_MOVE, INDEX_MOVE, TOLERANCE = 0.07, 0.04, 1e-10
PATHS = {20: 15, 63: 45}
CLASSES = ("upside", "sideways", "downside")


def signal_outcomes(rows: DataFrame) -> DataFrame:
    """Outcomes of the rows with a side: returns after 5, 10, 20 and 63 rows, the best and worst on the way, the rows until a move that counts, and how far the
    marked row was from the turning point within four rows of it.

    rows: k, t, v, side (null where there is no signal), stock. Signals without a whole path are left out. These look ahead: labels, never features.
    """
    w = by_time()
    ahead = lambda n: w.rowsBetween(1, n)
    near = w.rowsBetween(-4, 4)
    good = F.when(F.col("v") > 0, F.col("v"))
    path = F.collect_list(good).over(ahead(20))
    found = rows.select(
        "k", "t", "v", "side", "stock", *[F.lead("v", n).over(w).alias(f"v{n}") for n in (5, 10, 20, 63)], *[F.count(good).over(ahead(n)).alias(f"n{n}") for n in PATHS],
        *[f(good).over(ahead(n)).alias(f"{name}{n}") for n in (10, 20) for name, f in (("hi", F.max), ("lo", F.min))], F.min(good).over(near).alias("near_low"), F.max(good).over(near).alias("near_high"), path.alias("path"),
    ).filter("side IS NOT NULL AND v > 0 AND v5 > 0 AND v10 > 0 AND v20 > 0 AND v63 > 0 AND " + " AND ".join(f"n{n} >= {least}" for n, least in PATHS.items()))
    buy, price = F.col("side") == "buy", F.col("v")
    move = F.when(F.col("stock"), STOCK_MOVE).otherwise(INDEX_MOVE) - TOLERANCE
    change = {n: F.col(f"v{n}") / price - 1 for n in (5, 10, 20, 63)}
    up = {n: F.col(f"hi{n}") / price - 1 for n in (10, 20)}
    down = {n: F.col(f"lo{n}") / price - 1 for n in (10, 20)}
    reaches = lambda x: F.when(buy, x / price - 1 >= move).otherwise(x / price - 1 <= -move)
    first = F.filter(F.transform("path", lambda x, i: F.when(reaches(x), i + 1)), lambda x: x.isNotNull())
    sign = F.when(buy, 1).otherwise(-1)
    return found.select(
        "k", "t", "side", "stock", *[c.alias(f"return{n}") for n, c in change.items()], *[(c * sign).alias(f"directional{n}") for n, c in change.items()], *[(F.when(buy, c > 0).otherwise(c < 0)).alias(f"direction{n}") for n, c in change.items()],
        F.when(buy, F.least(F.lit(0.0), down[20])).otherwise(F.least(F.lit(0.0), -up[20])).alias("adverse20"), F.when(buy, F.greatest(F.lit(0.0), up[20])).otherwise(F.greatest(F.lit(0.0), -down[20])).alias("favorable20"),
        F.when(buy, price / F.col("near_low") - 1).otherwise(1 - price / F.col("near_high")).alias("turning_distance"),
        *[F.when(buy, up[n] >= move).otherwise(down[n] <= -move).alias(f"hit{n}") for n in (10, 20)], F.get(first, F.lit(0)).alias("days_to_hit"),
    )


def timing_summary(outcomes: DataFrame, by: list[str], covered: str | None = None) -> DataFrame:
    """Summary of outcomes: directions, excursions, returns in the signal's direction, payoff, best over worst, turning distance, and the share with a context."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    gain, loss = F.avg(F.when(F.col("directional20") > 0, F.col("directional20"))), F.avg(F.when(F.col("directional20") < 0, F.col("directional20")))
    best, worst = F.avg("favorable20"), F.avg("adverse20")
    share = F.avg(F.col(covered).isNotNull().cast("double")) if covered else F.lit(None).cast("double")
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("n"), rate("direction20").alias("direction20"), rate("direction63").alias("direction63"), rate("hit20").alias("excursion20"), F.avg("directional20").alias("mean20"), F.avg("directional63").alias("mean63"),
        F.percentile("directional20", F.lit(0.5)).alias("median20"), F.percentile("directional63", F.lit(0.5)).alias("median63"), F.percentile("directional20", F.lit(0.1)).alias("lower_decile20"), worst.alias("adverse"), best.alias("favorable"),
        F.when(loss < 0, gain / F.abs(loss)).alias("payoff"), F.when(worst < 0, best / F.abs(worst)).alias("favorable_adverse"), F.avg("turning_distance").alias("turning_distance"), F.avg("days_to_hit").alias("days_to_hit"), share.alias("coverage"),
    )


def _majority(counts: dict[str, Column]) -> Column:
    """The most frequent class, the first of equals."""
    top = F.greatest(*counts.values())
    out = F.when(F.lit(False), F.lit(""))
    for name, n in counts.items():
        out = out.when(n == top, name)
    return out


def forecast_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy of forecasts: errors, skill over no change and momentum, direction and classes with bounds, Brier score, and interval coverage.

    df: predicted, actual, momentum (log returns), low, high, actual_class, top (null where no class was told), and p_upside, p_sideways, p_downside.
    """
    e = F.col("predicted") - F.col("actual")
    n, told = F.count("*"), F.count("top")
    mae, still, momentum = F.avg(F.abs(e)), F.avg(F.abs("actual")), F.avg(F.abs(F.col("momentum") - F.col("actual")))
    right = F.sum((F.signum("predicted") == F.signum("actual")).cast("int"))
    hits = F.count_if(F.col("top") == F.col("actual_class"))
    brier = sum((F.col(f"p_{c}") - (F.col("actual_class") == c).cast("int")) ** 2 for c in CLASSES)
    actual = {c: F.count_if(F.col("actual_class") == c) for c in CLASSES}
    skill = lambda base: F.when(base > 0, (base - mae) / base).otherwise(0.0)
    return df.groupBy(*by).agg(
        n.alias("n"), mae.alias("mae"), F.avg(e).alias("signed"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_ae"), still.alias("no_change_mae"), momentum.alias("momentum_mae"), skill(still).alias("skill"), skill(momentum).alias("momentum_skill"),
        (right / n).alias("direction"), wilson_low(right, n).alias("direction_low"), F.avg((F.col("actual") > 0).cast("double")).alias("always_up"), told.alias("told"), F.when(told > 0, hits / told).alias("class_accuracy"),
        F.avg(F.when(F.col("top").isNotNull(), brier)).alias("brier"), F.avg(F.col("actual").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"),
        *[x.alias(f"actual_{c}") for c, x in actual.items()], *[F.count_if(F.col("top") == c).alias(f"told_{c}") for c in CLASSES], _majority(actual).alias("majority"), (F.greatest(*actual.values()) / n).alias("majority_accuracy"),
    )


def liquidity_features(df: DataFrame) -> DataFrame:
    """Volume and turnover against their own past, the level of turnover, price moves per turnover (times a billion), and how much of the volume is known. df: k, t, v, volume."""
    rows = df.withColumn("log_volume", F.when(F.col("volume") >= 0, F.log1p("volume"))).withColumn("log_turnover", F.when(F.col("volume") >= 0, F.log1p(F.col("v") * F.col("volume"))))
    before = F.lag("v").over(by_time())
    turnover = F.nullif(F.col("v") * F.col("volume"), F.lit(0.0))
    rows = rows.withColumn("move", F.when(before > 0, F.abs(F.col("v") / before - 1)) / turnover)

    def over(f, c: str, n: int, least: int) -> Column:
        return F.when(F.count(c).over(trailing(n)) >= least, f(c).over(trailing(n)))

    median = lambda c: F.percentile(c, F.lit(0.5))
    return rows.select(
        "k", "t", "log_volume", "log_turnover", (F.col("log_volume") - over(F.avg, "log_volume", 20, 10)).alias("volume_surprise20"), (F.col("log_turnover") - over(F.avg, "log_turnover", 20, 10)).alias("turnover_surprise20"),
        (F.col("log_turnover") - over(F.avg, "log_turnover", 63, 30)).alias("turnover_trend63"), over(median, "log_turnover", 63, 30).alias("turnover_level63"), (over(F.avg, "move", 20, 10) * 1e9).alias("amihud20"),
        F.avg(F.col("volume").isNotNull().cast("double")).over(trailing(63)).alias("coverage63"),
    )


def trading_days(calendar: DataFrame, closed: DataFrame, opened: DataFrame, reference: DataFrame, fixed: tuple[str, ...] = ("01-01", "12-25")) -> DataFrame:
    """Weekdays (t) on which the market trades. An opened day trades whatever else is said; within the span of the reference dates these alone do; elsewhere days
    that are neither closed, nor fixed holidays, nor the year's last weekday."""
    day = F.dayofweek("t")
    end = F.make_date(F.year("t"), F.lit(12), F.lit(31))
    last = F.when(F.dayofweek(end) == 1, F.date_sub(end, 2)).when(F.dayofweek(end) == 7, F.date_sub(end, 1)).otherwise(end)
    known = reference.agg(F.min("t").alias("since"), F.max("t").alias("until"))
    marked = lambda df, name: df.select("t").distinct().withColumn(name, F.lit(True))
    rows = calendar.filter(day.between(2, 6)).join(marked(closed, "_closed"), "t", "left").join(marked(opened, "_open"), "t", "left").join(marked(reference, "_named"), "t", "left")
    # One row of two dates, whatever the calendar.
    rows = rows.join(known.hint("broadcast"), F.lit(True), "left")
    usual = F.col("_closed").isNull() & ~F.date_format("t", "MM-dd").isin(*fixed) & (F.col("t") != last)
    trades = F.coalesce(F.col("_open"), F.when(F.col("t").between(F.col("since"), F.col("until")), F.col("_named").isNotNull()), usual)
    return rows.filter(trades).select(*calendar.columns)


def score_journal(journal: DataFrame, prices: DataFrame, late: int = 14) -> DataFrame:
    """Forecasts (k, id, as_of, target_t, base, predicted, low, high, momentum: log returns) with the first price on or after their target, and what it says of them.

    Scoring again changes nothing: a forecast that has its actual date keeps its scores, and of rows with one (k, id) the scored, then the latest one stands.
    """
    from .asof import asof_forward

    one = F.row_number().over(Window.partitionBy("k", "id").orderBy(F.desc("as_of")))
    rows = journal.withColumn("_n", one).filter("_n = 1").drop("_n")
    found = asof_forward(rows.withColumn("t", F.col("target_t")), prices.select("k", "t", "v"), late)
    actual = F.ln(F.col("v_right") / F.col("base"))
    return found.select(
        "k", "id", "as_of", "target_t", F.col("t_right").alias("actual_t"), actual.alias("actual"), F.abs(F.col("predicted") - actual).alias("error"), (F.col("predicted") - actual).alias("signed"), (F.signum("predicted") == F.signum(actual)).alias("direction_right"),
        actual.between(F.col("low"), F.col("high")).alias("covered"), F.abs(F.col("momentum") - actual).alias("momentum_error"), F.abs(actual).alias("no_change_error"),
    )
