"""Filters of rows and series, ranking, retention and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def pick_columns(df: DataFrame, wanted: list[str], kind: str = "double") -> DataFrame:
    """The wanted columns in order; those that are missing are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c in wanted])


def valid_price_points(df: DataFrame) -> DataFrame:
    """Rows with a close; a volume of zero or less drops a row, an unknown volume doesn't."""
    return df.filter("t IS NOT NULL AND v IS NOT NULL AND (volume IS NULL OR volume > 0)")


def sanitize_market_series(df: DataFrame, trading_days: DataFrame) -> DataFrame:
    """Valid price points on trading days only."""
    return valid_price_points(df).join(trading_days.select("t").distinct(), "t", "left_semi")


def slice_range(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(F.col("t").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def rows_through(df: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The rows of a series that are visible at its cutoff (k, cutoff)."""
    return df.join(cutoffs, "k").filter("t <= cutoff").drop("cutoff")


def available_from(published: Column, historical: bool = True) -> Column:
    """When a report may be used: at once, or, looking back, on the weekday after its publication."""
    following = F.date_add(published, 1)
    return F.when(F.dayofweek(following) == 7, F.date_add(following, 2)).when(F.dayofweek(following) == 1, F.date_add(following, 1)).otherwise(following) if historical else published


def bounded_recent_rows(df: DataFrame, days: int, low: float, high: float, tail: int) -> DataFrame:
    """Rows of the last days before the series' latest date, values within limits, the last few of them."""
    last = F.max("t").over(Window.partitionBy("k"))
    rows = df.withColumn("_last", last).filter((F.datediff("_last", "t") <= days) & F.col("v").between(low, high))
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t")))).filter(F.col("_rn") <= tail).drop("_last", "_rn")


def candidate_filters(signals: DataFrame, least: float) -> DataFrame:
    """Signals (k, market, t, score) of some strength on the latest date that their market has."""
    last = F.max("t").over(Window.partitionBy("market"))
    return signals.withColumn("_last", last).filter((F.col("t") == F.col("_last")) & (F.abs("score") >= least)).drop("_last")


def forecast_eligibility(df: DataFrame, least: int, limit: int) -> DataFrame:
    """By key: rows of the cleaned history that a forecast uses, and why it has none."""
    rows = df.withColumn("ok", F.coalesce(F.col("v") > 0, F.lit(False)))
    out = rows.groupBy("k").agg(F.count("*").alias("rows"), F.sum(F.col("ok").cast("int")).alias("clean"))
    reason = F.when(F.col("clean") == 0, "no-history").when(F.col("clean") < least, "short-history")
    return out.select("k", F.least("clean", F.lit(limit)).alias("used"), reason.isNull().alias("eligible"), reason.alias("reason"))


def assign_cohorts(df: DataFrame, explicit: DataFrame) -> DataFrame:
    """(market, k, cohort): the explicit split where it names a key, else the first and second half of the market's list."""
    w = Window.partitionBy("market").orderBy("k")
    half = F.when(F.row_number().over(w) <= F.floor(F.count("*").over(Window.partitionBy("market")) / 2), "development").otherwise("holdout")
    return df.select("market", "k").distinct().withColumn("half", half).join(explicit.select("k", "cohort"), "k", "left").select("market", "k", F.coalesce("cohort", "half").alias("cohort"))


def normalize_scores(df: DataFrame) -> DataFrame:
    """Scores from 0 to 100, rounded, with their stage where the given one is none."""
    score = F.floor(F.col("score") + 0.5)
    stage = F.when(score >= 75, 3).when(score >= 50, 2).when(score >= 25, 1).otherwise(0)
    return df.filter("score BETWEEN 0 AND 100").select("k", "t", score.cast("long").alias("score"), F.when(F.col("stage").between(0, 3), F.col("stage")).otherwise(stage).cast("int").alias("stage"))


def search_universe(df: DataFrame, text: str, n: int = 12) -> DataFrame:
    """Members (code, name) that a text finds: names beginning with it, names with it, codes beginning with it, codes with it; names in code point order."""
    x = text.lower()
    name, code = F.lower("name"), F.lower("code")
    rank = F.when(name.startswith(x), 0).when(name.contains(x), 1).when(code.startswith(x), 2).when(code.contains(x), 3)
    return df.select(rank.alias("rank"), "name", "code").filter("rank IS NOT NULL").orderBy("rank", "name", "code").limit(n)


def restrict_to(df: DataFrame, allow: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows whose key is allowed, if there is a list, and not excluded."""
    out = df if allow is None else df.join(allow.select("k").distinct(), "k", "left_semi")
    return out if exclude is None else out.join(exclude.select("k").distinct(), "k", "left_anti")


def rank_candidates(df: DataFrame, n: int) -> DataFrame:
    """The best candidates (k, score, cap_rank) in order."""
    return df.orderBy(F.desc("score"), "cap_rank", "k").limit(n)


def largest_misses(df: DataFrame, n: int = 20) -> DataFrame:
    """The forecasts with the largest error."""
    return df.withColumn("miss", F.abs(F.col("predicted") - F.col("actual"))).filter("miss IS NOT NULL").orderBy(F.desc("miss"), "k", "t").limit(n)


def retain_snapshots(df: DataFrame, recent: int = 45, days: int = 120, months: int = 60) -> DataFrame:
    """Snapshots (k, saved_at, print) to keep: the last of each day, without one that repeats the one before; of the last days some, before that the last of each month."""
    day = F.to_date("saved_at")
    one = df.withColumn("t", day).withColumn("rn", F.row_number().over(Window.partitionBy("k", day).orderBy(F.desc("saved_at"), F.desc("print")))).filter("rn = 1")
    own = Window.partitionBy("k").orderBy("t")
    new = one.withColumn("same", F.lag("print").over(own).eqNullSafe(F.col("print")) & F.lag("t").over(own).isNotNull()).filter("NOT same")
    new = new.withColumn("last", F.max("t").over(Window.partitionBy("k"))).withColumn("old", F.datediff("last", "t") > days)
    newest = Window.partitionBy("k", "old").orderBy(F.desc("t"))
    of_month = Window.partitionBy("k", "old", F.date_trunc("month", "t")).orderBy(F.desc("t"))
    new = new.withColumn("place", F.row_number().over(newest)).withColumn("in_month", F.row_number().over(of_month)).filter("NOT old OR in_month = 1")
    new = new.withColumn("month_place", F.row_number().over(newest))
    return new.filter((~F.col("old") & (F.col("place") <= recent)) | (F.col("old") & (F.col("month_place") <= months))).select("k", "t", "print")


def validation_batches(df: DataFrame, size: int, seed: str) -> DataFrame:
    """(batch, place, issuer, code): one share for each issuer, the smallest code, dealt in hash order."""
    one = df.groupBy("issuer").agg(F.min("code").alias("code"))
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col("code").cast("string")), 256)
    # Hash order is a global order of issuers, which are a dimension.
    rn = F.row_number().over(Window.orderBy(h, "code")) - 1
    return one.withColumn("rn", rn).select(F.floor(F.col("rn") / size).alias("batch"), (F.col("rn") % size).alias("place"), "issuer", "code")


def purged_holdout(signals: DataFrame, calendar: DataFrame, start: str, purge: int) -> DataFrame:
    """Signals with their role: development ends some market days before the holdout begins, what lies between is purged."""
    days = calendar.select("t").distinct().withColumn("i", F.row_number().over(Window.orderBy("t")))
    first = days.filter(F.col("t") >= F.lit(start).cast("date")).agg(F.min("i").alias("first"))
    # The second side is one number.
    rows = signals.join(days, "t").join(F.broadcast(first))
    role = F.when(F.col("i") >= F.col("first"), "holdout").when(F.col("i") <= F.col("first") - purge - 1, "development").otherwise("purged")
    return rows.withColumn("role", role).drop("i", "first")


def retention_rank(df: DataFrame) -> DataFrame:
    """Order in which cached series (k, touched_at) would go: never touched first, then the longest untouched."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.col("touched_at").isNotNull(), "touched_at", "k")))


def reason_list(*reasons: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in reasons]))


