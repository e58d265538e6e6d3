"""Point-in-time joins: as-of in both directions, availability lags, exact lookups, provider comparison.

As-of joins are a union of both sides and one window by key, so that each side is shuffled once and no pair is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _stacked(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides under one key and date; each carries its own side as a struct."""
    l, r = F.struct(*left.columns), F.struct(*right.columns)
    kind_l, kind_r = left.select(l.alias("x")).schema["x"].dataType, right.select(r.alias("x")).schema["x"].dataType
    a = left.select("k", "t", F.lit(1).alias("side"), l.alias("l"), F.lit(None).cast(kind_r).alias("r"))
    return a.unionByName(right.select("k", "t", F.lit(0).alias("side"), F.lit(None).cast(kind_l).alias("l"), r.alias("r")))


def asof_backward(left: DataFrame, right: DataFrame, max_age: int | None = None) -> DataFrame:
    """Left rows with ``t_right`` and ``v_right`` of the last right row of their key on or before t, not older than max_age days. Right dates are unique by key."""
    w = Window.partitionBy("k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    rows = _stacked(left, right).withColumn("m", F.last("r", ignorenulls=True).over(w)).filter("side = 1")
    return _matched(rows, left, F.datediff("l.t", "m.t"), max_age)


def asof_forward(left: DataFrame, right: DataFrame, max_days: int | None = None) -> DataFrame:
    """As ``asof_backward``, with the first right row on or after t."""
    w = Window.partitionBy("k").orderBy(F.desc("t"), "side").rowsBetween(Window.unboundedPreceding, 0)
    rows = _stacked(left, right).withColumn("m", F.last("r", ignorenulls=True).over(w)).filter("side = 1")
    return _matched(rows, left, F.datediff("m.t", "l.t"), max_days)


def _matched(rows: DataFrame, left: DataFrame, age, limit: int | None) -> DataFrame:
    good = F.col("m").isNotNull() & ((age <= limit) if limit is not None else F.lit(True))
    return rows.select(*[F.col(f"l.{c}").alias(c) for c in left.columns], F.when(good, F.col("m.t")).alias("t_right"), F.when(good, F.col("m.v")).alias("v_right"))


def asof_available(left: DataFrame, right: DataFrame, lag: int, max_age: int | None = None) -> DataFrame:
    """As-of on the dates from which right rows are known: their own plus a lag."""
    return asof_backward(left, right.withColumn("t", F.date_add("t", lag)), max_age)


def asof_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows with ``v_right``: the number (from 1) of the last right row on or before t."""
    number = F.row_number().over(Window.partitionBy("k").orderBy("t")).cast("double")
    return asof_backward(left, right.select("k", "t", number.alias("v")))


def asof_global(left: DataFrame, context: DataFrame, max_age: int | None = None, lag: int = 0) -> DataFrame:
    """As-of with one series for all keys: worked out once for each distinct date, then an equi join on dates."""
    days = left.select("t").distinct().withColumn("k", F.lit(0))
    found = asof_available(days, context.select(F.lit(0).alias("k"), "t", "v"), lag, max_age)
    return left.join(found.select("t", "t_right", "v_right"), "t", "left")


def lookup_exact(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("k", "t", F.col("v").alias("v_right")), ["k", "t"], "left")


def value_before_days(df: DataFrame, days: int) -> DataFrame:
    """By key: the latest date, and the value as of some days before it."""
    last = df.groupBy("k").agg(F.max("t").alias("latest"))
    return asof_backward(last.select("k", F.date_sub("latest", days).alias("t"), "latest"), df.select("k", "t", "v")).select("k", "latest", "t_right", "v_right")


def yoy_as_known(fin: DataFrame) -> DataFrame:
    """Each report (k, period, report_date, v) with the same period a year before, in the version known at the report date."""
    prior = fin.select(F.col("k").alias("pk"), F.add_months("period", 12).alias("pp"), F.col("report_date").alias("pr"), F.col("v").alias("pv"))
    rows = fin.join(prior, (fin["k"] == prior["pk"]) & (fin["period"] == prior["pp"]) & (prior["pr"] <= fin["report_date"]), "left")
    return rows.groupBy("k", "period", "report_date").agg(F.max("v").alias("v"), F.max_by("pv", "pr").alias("prior_v"))


def compare_providers(a: DataFrame, b: DataFrame, absolute: float, relative: float) -> DataFrame:
    """By key: dates of both, mismatches (beyond both tolerances), and a status."""
    rows = a.select("k", "t", F.col("v").alias("va")).join(b.select("k", "t", F.col("v").alias("vb")), ["k", "t"])
    gap = F.abs(F.col("va") - F.col("vb"))
    wrong = (gap > absolute) & (gap > relative * F.greatest(F.abs("va"), F.abs("vb")))
    out = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.coalesce(wrong, F.lit(False)).cast("int")).alias("mismatches"))
    return out.withColumn("status", F.when(F.col("n") < 5, "insufficient").when(F.col("mismatches") == 0, "match").when(F.col("mismatches") * 10 <= F.col("n"), "mostly").otherwise("mismatch"))


def pair_positionally(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """By key: rows of both sides paired by position, and rows left over on either side."""
    w = Window.partitionBy(*keys).orderBy("v")
    x = a.select(*keys, F.row_number().over(w).alias("i"), F.col("v").alias("va"))
    y = b.select(*keys, F.row_number().over(w).alias("i"), F.col("v").alias("vb"))
    rows = x.join(y, [*keys, "i"], "full")
    flags = [F.sum((F.col("va").isNotNull() & F.col("vb").isNotNull()).cast("int")).alias("paired"), F.sum(F.col("vb").isNull().cast("int")).alias("only_a"), F.sum(F.col("va").isNull().cast("int")).alias("only_b")]
    return rows.groupBy(*keys).agg(*flags)


def knn_predict(train: DataFrame, query: DataFrame, k: int = 12, floor: float = 0.1) -> DataFrame:
    """Mean outcome of the nearest training rows of a query row's series, weighted by inverse distance. Features are arrays; a series' rows are few."""
    a = query.select("k", F.col("t").alias("qt"), F.col("f").alias("qf"))
    b = train.select("k", F.col("t").alias("tt"), F.col("f").alias("tf"), "y")
    rows = a.join(b, "k").filter("tt < qt")
    rows = rows.withColumn("d", F.sqrt(F.aggregate(F.zip_with("qf", "tf", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))
    near = rows.withColumn("rn", F.row_number().over(Window.partitionBy("k", "qt").orderBy("d", "tt"))).filter(F.col("rn") <= k)
    weight = 1 / F.greatest("d", F.lit(floor))
    return near.groupBy("k", F.col("qt").alias("t")).agg((F.sum(weight * F.col("y")) / F.sum(weight)).alias("prediction"), F.count("*").alias("n"))
