"""Panels of dated series, derived from the order tables: one grouping each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keeps halves of the fourth decimal, which are common here, from depending on the order of additions.
OFFSET = 0.0000013


def _four(x):
    return F.round(x + OFFSET, 4)


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, market, t, open, high, low, v, volume): a price series for each nation, in the market of its region."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ratio = F.col("l_extendedprice") / F.col("l_quantity")
    return rows.groupBy(F.col("s_nationkey").alias("k"), F.col("n_regionkey").alias("market"), F.to_date("l_shipdate").alias("t")).agg(
        F.min_by(ratio, F.struct("l_orderkey", "l_linenumber", ratio)).alias("open"),
        F.max(ratio).alias("high"),
        F.min(ratio).alias("low"),
        _four(F.avg(ratio)).alias("v"),
        F.sum("l_quantity").alias("volume"),
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market, t, v): a price series for each region."""
    return price(spark, sf_dir).groupBy("market", "t").agg(_four(F.sum(F.col("v") * F.col("volume")) / F.sum("volume")).alias("v"))


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, t, v): a second provider's series for each nation: mean order value by day."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("k"), F.to_date("o_orderdate").alias("t")).agg(_four(F.avg("o_totalprice") / 1000).alias("v"))


def credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, t, v): daily order value by priority, in thousands."""
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(F.col("o_orderpriority").alias("k"), F.to_date("o_orderdate").alias("t")).agg(_four(F.sum("o_totalprice") / 1000).alias("v"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, v): mean order value by month, dated at its start."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("t")).agg(_four(F.avg("o_totalprice") / 1000).alias("v"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, t, reporter, changed, record): signed trades of reporters."""
    rows = table(spark, sf_dir, "events")
    sign = F.when(F.col("event_type").isin("error", "view"), -1).otherwise(1)
    return rows.select(F.col("user_id").alias("k"), F.to_date("ts").alias("t"), (F.col("user_id") % 10).alias("reporter"), _four(F.col("value") * sign).alias("changed"), F.col("event_id").alias("record"))


def dirty(df: DataFrame) -> DataFrame:
    """The panel with derived faults by day number: nulls, zeros and tenfold spikes."""
    day = F.datediff("t", F.lit("1990-01-01"))
    return df.withColumn("v", F.when(day % 17 == 0, F.lit(None)).when(day % 23 == 0, 0.0).when(day % 97 == 0, F.round(F.col("v") * 10, 4)).otherwise(F.col("v")))


def mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, fear, news, credit_change, credit_pct): indexes of a whole market by day, from orders; one short series."""
    from ..operators.indicators import rolling_pct_rank

    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("t")).agg(
        _four(100 * F.avg(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0.0).otherwise(1.0))).alias("fear"), _four(F.sum("o_totalprice") / 1000).alias("credit"), _four(F.avg("o_totalprice")).alias("price")
    )
    rows = days.withColumn("k", F.lit(0))
    w = Window.partitionBy("k").orderBy("t")
    rows = rows.withColumn("news", _four(100 * F.col("price") / F.avg("price").over(w.rowsBetween(-19, 0)))).withColumn("credit_change", _four((F.col("credit") / F.lag("credit", 20).over(w) - 1) * 100))
    return rows.withColumn("credit_pct", rolling_pct_rank(252, 40, "credit_change")).select("t", "fear", "news", "credit_change", "credit_pct")


def breadth(prices: DataFrame) -> DataFrame:
    """(market, t, adr): rises over falls of a market's series in its last 20 days, in percent."""
    before = F.lag("v").over(Window.partitionBy("k").orderBy("t"))
    days = prices.withColumn("p", before).groupBy("market", "t").agg(F.count_if(F.col("v") > F.col("p")).alias("up"), F.count_if(F.col("v") < F.col("p")).alias("down"))
    w = Window.partitionBy("market").orderBy("t").rowsBetween(-19, 0)
    down = F.sum("down").over(w)
    return days.select("market", "t", _four(F.when(down > 0, 100 * F.sum("up").over(w) / down)).alias("adr"))


def timing_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price panel with its benchmark and the context that timing reads, as known on each day."""
    from ..operators.asof import asof_global
    from ..operators.oscillators import macd

    prices = price(spark, sf_dir).select("k", "market", "t", "v", "volume")
    rows = prices.join(benchmark(spark, sf_dir).withColumnRenamed("v", "bench"), ["market", "t"]).join(breadth(prices), ["market", "t"]).join(mood(spark, sf_dir), "t", "left")
    rows = rows.join(macd(prices).select("k", "t", F.round("normalized", 6).alias("oscillator")), ["k", "t"], "left")
    leading = macro(spark, sf_dir).select("t", _four(F.col("v") / 100).alias("v"))
    return asof_global(rows, leading, 75, 60).withColumnRenamed("v_right", "lead_index").drop("t_right").withColumn("growth", F.col("market") % 2 == 1)
