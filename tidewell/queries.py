"""Registry of the library's queries, each with the DuckDB SQL that it is compared with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as X
from .operators import aggregates as A
from .operators import asof as J
from .operators import indicators as W
from .operators import merge as U
from .operators import quality as Q
from .operators import sampling as K
from .operators import signals as M
from .plans import panels as P
from .plans.sql_panels import r6, with_panels
from .streaming import streams as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Fractions to some digits, since engines add in different orders; never a negative zero."""
    return df.select(*[(F.round(F.col(c) + 2.3e-10, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, panels: tuple[str, ...] = ()):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = with_panels(*panels, sql=sql) if panels else sql
        return f

    return add


KT = lambda df: df.select("k", "t", "v")

# ---- merges


@query("u1_merge_prefer_incoming", f"SELECT k, t, {r6('coalesce(o.v, p.v) AS v')} FROM (SELECT k, t, v FROM dirty) p FULL JOIN orders_panel o USING (k, t)", ("dirty", "orders_panel"))
def _(s, d):
    return U.merge_prefer_incoming(KT(U_dirty(s, d)), P.orders_panel(s, d))


def U_dirty(s, d):
    return P.dirty(P.price(s, d))


@query("u2_merge_preserve_existing", f"SELECT k, t, {r6('coalesce(p.v, o.v) AS v')} FROM (SELECT k, t, v FROM dirty) p FULL JOIN orders_panel o USING (k, t)", ("dirty", "orders_panel"))
def _(s, d):
    return U.merge_preserve_existing(KT(U_dirty(s, d)), P.orders_panel(s, d))


@query(
    "u3_merge_dated_series",
    f"""WITH good AS (SELECT k, t, v FROM orders_panel WHERE v IS NOT NULL AND NOT (k % 2 = 0 AND v = 0) AND v >= 10 AND (k % 3 <> 0 OR v <= 200))
    SELECT k, t, {r6('coalesce(g.v, p.v) AS v')} FROM (SELECT k, t, v FROM dirty) p FULL JOIN good g USING (k, t) WHERE coalesce(g.v, p.v) IS NOT NULL""",
    ("dirty", "orders_panel"),
)
def _(s, d):
    policy = P.table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit(10.0).alias("min_value"), F.expr("CASE WHEN n_nationkey % 3 = 0 THEN 200.0D END").alias("max_value"), (F.col("n_nationkey") % 2 == 0).alias("reject_zero"))
    return U.merge_dated_series(KT(U_dirty(s, d)), P.orders_panel(s, d), policy)


@query(
    "u4_combine_first",
    f"""SELECT k, t, {r6('arg_max(v, CASE WHEN v IS NOT NULL THEN p END) AS v')} FROM (SELECT k, t, v, 0 AS p FROM orders_panel UNION ALL SELECT k, t, v, 1 FROM dirty) GROUP BY 1, 2""",
    ("dirty", "orders_panel"),
)
def _(s, d):
    return U.combine_first(P.orders_panel(s, d), KT(U_dirty(s, d)))


@query(
    "u5_replace_tail",
    f"""WITH official AS (SELECT * FROM orders_panel WHERE t >= DATE '1998-01-01'), f AS (SELECT k, MIN(t) AS first FROM official GROUP BY 1)
    SELECT k, t, {r6('v')} FROM (SELECT p.k, p.t, p.v FROM price p LEFT JOIN f USING (k) WHERE first IS NULL OR t < first UNION ALL SELECT k, t, v FROM official)""",
    ("price", "orders_panel"),
)
def _(s, d):
    return U.replace_tail(KT(P.price(s, d)), P.orders_panel(s, d).filter("t >= DATE '1998-01-01'"))


@query(
    "u6_merge_bounded",
    f"""WITH l AS (SELECT k, MAX(t) AS last FROM orders_panel GROUP BY 1)
    SELECT k, t, {r6("CASE WHEN last IS NOT NULL AND t > last THEN NULL ELSE coalesce(o.v, p.v) END AS v")} FROM (SELECT k, t, v FROM price) p FULL JOIN orders_panel o USING (k, t) LEFT JOIN l USING (k)""",
    ("price", "orders_panel"),
)
def _(s, d):
    return U.merge_bounded(KT(P.price(s, d)), P.orders_panel(s, d))


@query(
    "u7_merge_changes",
    """SELECT k, CAST(SUM(CASE WHEN p.v IS NULL AND o.v IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS added,
    CAST(SUM(CASE WHEN abs(p.v - o.v) > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS updated, MAX(t) AS latest
    FROM (SELECT k, t, v FROM dirty) p FULL JOIN orders_panel o USING (k, t) GROUP BY 1""",
    ("dirty", "orders_panel"),
)
def _(s, d):
    return U.merge_changes(KT(U_dirty(s, d)), P.orders_panel(s, d))


@query(
    "u8_merge_fallback",
    f"SELECT k, t, {r6('v')} FROM (SELECT k, t, v FROM price UNION ALL SELECT k, t, v FROM orders_panel o WHERE NOT EXISTS (SELECT 1 FROM price p WHERE p.k = o.k AND p.t = o.t))",
    ("price", "orders_panel"),
)
def _(s, d):
    return U.merge_fallback(KT(P.price(s, d)), P.orders_panel(s, d))


@query(
    "u9_append_after",
    f"""WITH old AS (SELECT * FROM price WHERE t < DATE '1999-01-01'), l AS (SELECT k, MAX(t) AS last FROM old GROUP BY 1)
    SELECT k, t, {r6('v')} FROM (SELECT k, t, v FROM old UNION ALL SELECT o.k, o.t, o.v FROM orders_panel o LEFT JOIN l USING (k) WHERE last IS NULL OR t > last)""",
    ("price", "orders_panel"),
)
def _(s, d):
    return U.append_after(KT(P.price(s, d)).filter("t < DATE '1999-01-01'"), P.orders_panel(s, d))


@query(
    "u10_dedupe_events",
    "SELECT user_id AS k, CAST(ts AS DATE) AS t, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2, 3",
)
def _(s, d):
    rows = P.table(s, d, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("t"), "event_type", "event_id", "ts")
    return U.last_wins(rows, ["k", "t", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "u12_merge_ohlcv",
    f"""WITH a AS (SELECT k, t, open, high, low, v, volume FROM price WHERE market IN (0, 1, 2)), b AS (SELECT k, t, open * 2 AS open, NULL AS high, low, v + 1 AS v, volume FROM price WHERE market IN (1, 2, 3))
    SELECT k, t, {r6('coalesce(b.open, a.open) AS open', 'coalesce(b.high, a.high) AS high', 'coalesce(b.low, a.low) AS low', 'coalesce(b.v, a.v) AS v', 'coalesce(b.volume, a.volume) AS volume')} FROM a FULL JOIN b USING (k, t)""",
    ("price",),
)
def _(s, d):
    p = P.price(s, d)
    more = p.filter("market IN (1, 2, 3)").withColumns({"open": F.col("open") * 2, "high": F.lit(None).cast("double"), "v": F.col("v") + 1})
    return U.merge_ohlcv(p.filter("market IN (0, 1, 2)"), more)


@query("u15_union_dates", "SELECT t FROM price UNION SELECT t FROM orders_panel UNION SELECT t FROM credit", ("price", "orders_panel", "credit"))
def _(s, d):
    return U.union_dates(P.price(s, d), P.orders_panel(s, d), P.credit(s, d))


SIGNALS = """signals AS (SELECT k, market, t, v, CASE WHEN v / nullif(lag(v, 20) OVER w, 0) - 1 > 0.05 THEN 'buy' WHEN v / nullif(lag(v, 20) OVER w, 0) - 1 < -0.05 THEN 'sell' END AS side, row_number() OVER w AS i FROM price WINDOW w AS (PARTITION BY k ORDER BY t))"""


def signals(s, d):
    c = F.col("v") / F.nullif(F.lag("v", 20).over(W.by_time()), F.lit(0.0)) - 1
    return P.price(s, d).withColumn("side", F.when(c > 0.05, "buy").when(c < -0.05, "sell")).withColumn("i", F.row_number().over(W.by_time()))


ORDER_SIGNALS = "order_signals AS (SELECT k, t, CASE WHEN v / nullif(lag(v, 5) OVER w, 0) - 1 > 0.05 THEN 'buy' WHEN v / nullif(lag(v, 5) OVER w, 0) - 1 < -0.05 THEN 'sell' END AS side FROM orders_panel WINDOW w AS (PARTITION BY k ORDER BY t))"


def order_signals(s, d):
    c = F.col("v") / F.nullif(F.lag("v", 5).over(W.by_time()), F.lit(0.0)) - 1
    return P.orders_panel(s, d).select("k", "t", F.when(c > 0.05, "buy").when(c < -0.05, "sell").alias("side"))


@query(
    "u16_new_signal_rows",
    f"""WITH {SIGNALS}, {ORDER_SIGNALS}, c AS (SELECT k, side, t FROM signals WHERE side IS NOT NULL), b AS (SELECT k, side, t FROM order_signals WHERE side IS NOT NULL)
    SELECT k, side, t FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = c.k AND b.side = c.side AND abs(datediff('day', b.t, c.t)) <= 2)""",
    ("price", "orders_panel"),
)
def _(s, d):
    return U.new_signal_rows(signals(s, d).filter("side IS NOT NULL"), order_signals(s, d).filter("side IS NOT NULL"), 2)


@query("u17_overlap", "SELECT k FROM price WHERE market = 0 INTERSECT SELECT k FROM orders_panel", ("price", "orders_panel"))
def _(s, d):
    return U.overlap(P.price(s, d).filter("market = 0"), P.orders_panel(s, d))


# ---- sources


@query(
    "s2_normalize_rows",
    f"""WITH raw AS (SELECT user_id AS k, CASE WHEN event_id % 41 = 0 THEN '2024-02-30' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS d, CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 23 = 0 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS x, event_id AS seq FROM events),
    good AS (SELECT k, TRY_CAST(d AS DATE) AS t, TRY_CAST(x AS DOUBLE) AS v, seq FROM raw), one AS (SELECT *, row_number() OVER (PARTITION BY k, t ORDER BY seq DESC) AS rn FROM good WHERE t IS NOT NULL)
    SELECT k, t, {r6("CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END AS v")} FROM one WHERE rn = 1""",
)
def _(s, d):
    e = P.table(s, d, "events")
    raw = e.select(
        F.col("user_id").alias("k"), F.when(F.col("event_id") % 41 == 0, "2024-02-30").otherwise(F.to_date("ts").cast("string")).alias("d"),
        F.when(F.col("event_id") % 17 == 0, "").when(F.col("event_id") % 23 == 0, "NaN").otherwise(F.col("value").cast("string")).alias("x"), F.col("event_id").alias("seq"),
    )
    return U.normalize_rows(raw, "d", "x", "seq")


@query(
    "s5_split_recent_history",
    "SELECT segment, COUNT(*) AS n FROM (SELECT CASE WHEN t >= MAX(t) OVER (PARTITION BY k) - INTERVAL 24 MONTH THEN 'recent' ELSE 'history' END AS segment FROM price) GROUP BY 1",
    ("price",),
)
def _(s, d):
    return U.split_recent_history(P.price(s, d), 2).groupBy("segment").agg(F.count("*").alias("n"))


@query("s6_partition_manifest", "SELECT k, COUNT(*) AS n, MAX(t) AS latest FROM price GROUP BY 1", ("price",))
def _(s, d):
    return U.partition_manifest(P.price(s, d))


@query("s7_shard_lookup", "SELECT substr(s_name, 10, 2) || right(s_name, 1) AS prefix, COUNT(*) AS n, MIN(s_suppkey) AS low FROM supplier GROUP BY 1")
def _(s, d):
    rows = P.table(s, d, "supplier")
    return rows.groupBy(F.concat(F.substring("s_name", 10, 2), F.right(F.col("s_name"), F.lit(1))).alias("prefix")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("low"))


@query("s13_decode_universe", "SELECT DISTINCT right(lpad(regexp_replace(s_name, '[^0-9]', '', 'g'), 9, '0'), 6) || CASE WHEN s_nationkey % 2 = 0 THEN '.A' ELSE '.B' END AS ticker FROM supplier")
def _(s, d):
    code = F.right(F.lpad(F.regexp_replace("s_name", "[^0-9]", ""), 9, "0"), F.lit(6))
    return P.table(s, d, "supplier").select(F.concat(code, F.when(F.col("s_nationkey") % 2 == 0, ".A").otherwise(".B")).alias("ticker")).distinct()


@query("s14_latest_snapshot", f"SELECT k, market, t, {r6('v')} FROM price QUALIFY t = MAX(t) OVER (PARTITION BY market)", ("price",))
def _(s, d):
    return U.latest_snapshot(P.price(s, d)).select("k", "market", "t", "v")


@query(
    "s16_incremental_start",
    "SELECT n_nationkey AS k, coalesce(greatest(CAST(MAX(t) - INTERVAL 120 DAY AS DATE), DATE '2001-06-01'), DATE '2001-06-01') AS start FROM nation LEFT JOIN price ON k = n_nationkey GROUP BY 1",
    ("price",),
)
def _(s, d):
    return U.incremental_start(P.price(s, d), P.table(s, d, "nation").select(F.col("n_nationkey").alias("k")), "2001-06-01", 120)


@query("s17_project_since", f"SELECT k, t, {r6('v')} FROM price WHERE t >= DATE '2001-03-01' - INTERVAL 35 DAY", ("price",))
def _(s, d):
    return KT(U.project_since(P.price(s, d), "2001-03-01"))


# ---- as-of and other joins


def asof_sql(extra="", lag=0):
    return f"""SELECT p.k, p.t, {r6("p.v AS v")}, CASE WHEN datediff('day', o.t, p.t) <= 7 THEN o.t END AS t_right, {r6("CASE WHEN datediff('day', o.t, p.t) <= 7 THEN o.v END AS v_right")}
    FROM price p ASOF LEFT JOIN (SELECT k, CAST(t + INTERVAL {lag} DAY AS DATE) AS t, v FROM orders_panel) o ON p.k = o.k AND p.t >= o.t"""


@query("j1_asof_backward", asof_sql(), ("price", "orders_panel"))
def _(s, d):
    return J.asof_backward(KT(P.price(s, d)), P.orders_panel(s, d), 7)


@query("j2_asof_available", asof_sql(lag=5), ("price", "orders_panel"))
def _(s, d):
    return J.asof_available(KT(P.price(s, d)), P.orders_panel(s, d), 5, 7)


@query(
    "j2_asof_macro",
    f"""SELECT p.k, p.t, {r6('p.v AS v')}, CASE WHEN datediff('day', m.t, p.t) <= 75 THEN m.t END AS t_right, {r6("CASE WHEN datediff('day', m.t, p.t) <= 75 THEN m.v END AS v_right")}
    FROM price p ASOF LEFT JOIN (SELECT CAST(t + INTERVAL 60 DAY AS DATE) AS t, v FROM macro) m ON p.t >= m.t""",
    ("price", "macro"),
)
def _(s, d):
    return J.asof_global(KT(P.price(s, d)), P.macro(s, d), 75, 60).select("k", "t", "v", "t_right", "v_right")


@query(
    "j3_asof_forward",
    f"""SELECT p.k, p.t, {r6('p.v AS v')}, CASE WHEN datediff('day', p.t, o.t) <= 14 THEN o.t END AS t_right, {r6("CASE WHEN datediff('day', p.t, o.t) <= 14 THEN o.v END AS v_right")}
    FROM price p ASOF LEFT JOIN orders_panel o ON p.k = o.k AND p.t <= o.t""",
    ("price", "orders_panel"),
)
def _(s, d):
    return J.asof_forward(KT(P.price(s, d)), P.orders_panel(s, d), 14)


@query(
    "j4_asof_position",
    f"SELECT p.k, p.t, {r6('p.v AS v', 'CAST(o.i AS DOUBLE) AS v_right')}, o.t AS t_right FROM price p ASOF LEFT JOIN (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM orders_panel) o ON p.k = o.k AND p.t >= o.t",
    ("price", "orders_panel"),
)
def _(s, d):
    return J.asof_position(KT(P.price(s, d)), P.orders_panel(s, d))


@query("j5_lookup_exact", f"SELECT k, t, {r6('p.v AS v', 'o.v AS v_right')} FROM (SELECT k, t, v FROM price) p LEFT JOIN orders_panel o USING (k, t)", ("price", "orders_panel"))
def _(s, d):
    return J.lookup_exact(KT(P.price(s, d)), P.orders_panel(s, d))


FIN = """fin AS (SELECT c_nationkey AS k, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, SUM(o_totalprice) / 1e6 AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    versions AS (SELECT k, period, CAST(period + INTERVAL 3 MONTH + INTERVAL 44 DAY AS DATE) AS report_date, v FROM fin UNION ALL SELECT k, period, CAST(period + INTERVAL 3 MONTH + INTERVAL 134 DAY AS DATE), v * 1.01 FROM fin)"""


@query(
    "j8_yoy_as_known",
    f"""WITH {FIN} SELECT f.k, f.period, f.report_date, {r6('MAX(f.v) AS v', 'arg_max(p.v, p.report_date) AS prior_v')} FROM versions f
    LEFT JOIN versions p ON p.k = f.k AND p.period + INTERVAL 12 MONTH = f.period AND p.report_date <= f.report_date GROUP BY 1, 2, 3""",
)
def _(s, d):
    rows = P.table(s, d, "orders").join(P.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fin = rows.groupBy(F.col("c_nationkey").alias("k"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period")).agg((F.sum("o_totalprice") / 1e6).alias("v"))
    report = lambda days, by: fin.select("k", "period", F.date_add(F.add_months("period", 3), days).alias("report_date"), (F.col("v") * by).alias("v"))
    return J.yoy_as_known(report(44, 1.0).unionByName(report(134, 1.01)))


@query(
    "j9_compare_providers",
    """WITH c AS (SELECT k, COUNT(*) AS n, CAST(SUM(CASE WHEN abs(p.v - o.v) > 5 AND abs(p.v - o.v) > 0.5 * greatest(abs(p.v), abs(o.v)) THEN 1 ELSE 0 END) AS BIGINT) AS mismatches FROM (SELECT k, t, v / 10 AS v FROM price) p JOIN orders_panel o USING (k, t) GROUP BY 1)
    SELECT k, n, mismatches, CASE WHEN n < 5 THEN 'insufficient' WHEN mismatches = 0 THEN 'match' WHEN mismatches * 10 <= n THEN 'mostly' ELSE 'mismatch' END AS status FROM c""",
    ("price", "orders_panel"),
)
def _(s, d):
    return J.compare_providers(KT(P.price(s, d)).withColumn("v", F.col("v") / 10), P.orders_panel(s, d), 5, 0.5)


@query(
    "j11_pair_observations",
    """WITH a AS (SELECT k, year(t) AS y, row_number() OVER (PARTITION BY k, year(t) ORDER BY v) AS i, v FROM price), b AS (SELECT k, year(t) AS y, row_number() OVER (PARTITION BY k, year(t) ORDER BY v) AS i, v FROM orders_panel)
    SELECT k, y, CAST(SUM(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS paired, CAST(SUM(CASE WHEN b.v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_a, CAST(SUM(CASE WHEN a.v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_b FROM a FULL JOIN b USING (k, y, i) GROUP BY 1, 2""",
    ("price", "orders_panel"),
)
def _(s, d):
    return J.pair_positionally(P.price(s, d).withColumn("y", F.year("t")), P.orders_panel(s, d).withColumn("y", F.year("t")), ["k", "y"])


@query(
    "j19_value_before_days",
    f"SELECT l.k, l.latest, o.t AS t_right, {r6('o.v AS v_right')} FROM (SELECT k, MAX(t) AS latest, MAX(t) - INTERVAL 90 DAY AS t FROM price GROUP BY 1) l ASOF LEFT JOIN price o ON l.k = o.k AND l.t >= o.t",
    ("price",),
)
def _(s, d):
    return J.value_before_days(P.price(s, d), 90)


# ---- aggregations


@query("a1_series_stats", f"SELECT k, MIN(t) FILTER (v IS NOT NULL) AS first_t, MAX(t) FILTER (v IS NOT NULL) AS latest_t, COUNT(v) AS n, {r6('arg_max(v, t) FILTER (v IS NOT NULL) AS latest_v')} FROM dirty GROUP BY 1", ("dirty",))
def _(s, d):
    return A.series_stats(U_dirty(s, d))


@query("a2_quantile", f"SELECT k, {r6('quantile_cont(v, 0.1) AS p10', 'quantile_cont(v, 0.5) AS p50', 'quantile_cont(v, 0.95) AS p95')} FROM price GROUP BY 1", ("price",))
def _(s, d):
    return P.price(s, d).groupBy("k").agg(A.quantile("v", 0.1).alias("p10"), A.quantile("v", 0.5).alias("p50"), A.quantile("v", 0.95).alias("p95"))


@query(
    "a3_lower_tail_mean",
    f"SELECT k, {r6('AVG(v) AS tail_mean')}, COUNT(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v, t) AS rn, COUNT(*) OVER (PARTITION BY k) AS c FROM dirty WHERE v IS NOT NULL) WHERE rn <= greatest(1, ceil(c * 0.1)) GROUP BY 1",
    ("dirty",),
)
def _(s, d):
    return A.lower_tail_mean(U_dirty(s, d), "k")


@query(
    "a4_weighted_median",
    f"SELECT k, {r6('MIN(v) AS weighted_median')} FROM (SELECT k, v, SUM(volume) OVER (PARTITION BY k ORDER BY v RANGE UNBOUNDED PRECEDING) AS c, SUM(volume) OVER (PARTITION BY k) AS a FROM price) WHERE c * 2 >= a GROUP BY 1",
    ("price",),
)
def _(s, d):
    return A.weighted_median(P.price(s, d), "k", "v", "volume")


RETURNS = f"""{SIGNALS}, returns AS (SELECT *, year(t) AS year, lead(v, 20) OVER (PARTITION BY k ORDER BY t) / v - 1 AS ret FROM signals)"""


def returns(s, d):
    return signals(s, d).withColumn("year", F.year("t")).withColumn("ret", F.lead("v", 20).over(W.by_time()) / F.col("v") - 1)


@query(
    "a6_summarize_timing",
    f"""WITH {RETURNS} SELECT side, COUNT(*) AS n, {r6('AVG(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS hit_rate')},
    {r6('(AVG(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) + 1.96 * 1.96 / (2 * COUNT(*)) - 1.96 * sqrt(AVG(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) * (1 - AVG(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END)) / COUNT(*) + 1.96 * 1.96 / (4 * COUNT(*) * COUNT(*)))) / (1 + 1.96 * 1.96 / COUNT(*)) AS hit_low')},
    {r6('AVG(ret) AS mean', 'quantile_cont(ret, 0.5) AS median', 'quantile_cont(ret, 0.1) AS lower_decile', 'AVG(ret) FILTER (ret > 0) / abs(AVG(ret) FILTER (ret < 0)) AS payoff')}
    FROM returns WHERE side IS NOT NULL AND ret IS NOT NULL GROUP BY 1""",
    ("price",),
)
def _(s, d):
    return A.summarize_timing(returns(s, d).filter("side IS NOT NULL"), ["side"])


@query(
    "a8_summarize_segments",
    f"WITH {RETURNS} SELECT side, market, year, COUNT(*) AS n, {r6('AVG(ret) AS mean')} FROM returns WHERE side IS NOT NULL AND ret IS NOT NULL GROUP BY GROUPING SETS ((side, market, year), (side), (market), (year), ())",
    ("price",),
)
def _(s, d):
    return A.summarize_segments(returns(s, d).filter("side IS NOT NULL"))


@query(
    "a9_summarize_forecast",
    f"""WITH f AS (SELECT market, k, t, v / nullif(lag(v, 20) OVER w, 0) - 1 AS predicted, lead(v, 20) OVER w / v - 1 AS actual FROM price WINDOW w AS (PARTITION BY k ORDER BY t))
    SELECT market, COUNT(*) AS n, {r6('AVG(abs(predicted - actual)) AS mae', 'AVG(predicted - actual) AS signed', 'sqrt(AVG((predicted - actual) * (predicted - actual))) AS rmse', 'quantile_cont(abs(predicted - actual), 0.5) AS median_ae', '1 - AVG(abs(predicted - actual)) / AVG(abs(actual)) AS skill', 'AVG(CASE WHEN sign(predicted) = sign(actual) THEN 1.0 ELSE 0 END) AS direction')}
    FROM f WHERE predicted IS NOT NULL AND actual IS NOT NULL GROUP BY 1""",
    ("price",),
)
def _(s, d):
    rows = P.price(s, d).select("market", "k", "t", (F.col("v") / F.nullif(F.lag("v", 20).over(W.by_time()), F.lit(0.0)) - 1).alias("predicted"), (F.lead("v", 20).over(W.by_time()) / F.col("v") - 1).alias("actual"))
    return A.summarize_forecast(rows.filter("predicted IS NOT NULL AND actual IS NOT NULL"), ["market"])


@query("a11_median_scale", f"SELECT k, {r6('coalesce(median(p.v / o.v), 1.0) AS scale')}, COUNT(*) AS n_overlaps FROM (SELECT k, t, v FROM price) p JOIN orders_panel o USING (k, t) GROUP BY 1", ("price", "orders_panel"))
def _(s, d):
    return A.median_scale(KT(P.price(s, d)), P.orders_panel(s, d))


@query(
    "a12_detect_rebase",
    f"SELECT * FROM (SELECT k, {r6('coalesce(median(o.v / p.v), 1.0) AS scale')}, COUNT(*) AS n_overlaps FROM (SELECT k, t, v FROM price) p JOIN orders_panel o USING (k, t) GROUP BY 1) WHERE n_overlaps >= 3 AND (scale > 1.8 OR scale < 1 / 1.8)",
    ("price", "orders_panel"),
)
def _(s, d):
    return A.detect_rebase(KT(P.price(s, d)), P.orders_panel(s, d))


@query(
    "a14_directional_agreement",
    """WITH j AS (SELECT p.k, p.t, p.v, CASE WHEN datediff('day', b.t, p.t) <= 7 THEN b.v END AS b FROM price p ASOF LEFT JOIN benchmark b ON p.market = b.market AND p.t >= b.t),
    c AS (SELECT k, year(t) AS year, sign(v - lag(v) OVER w) AS x, sign(b - lag(b) OVER w) AS y FROM j WHERE b IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY t))
    SELECT k, year, COUNT(*) AS samples, CAST(SUM(CASE WHEN x = y THEN 1 ELSE 0 END) AS BIGINT) AS agreed, CASE WHEN COUNT(*) >= 3 THEN CAST(floor(SUM(CASE WHEN x = y THEN 1 ELSE 0 END) * 100.0 / COUNT(*) + 0.5) AS BIGINT) END AS rate FROM c WHERE x <> 0 AND y <> 0 GROUP BY 1, 2""",
    ("price", "benchmark"),
)
def _(s, d):
    p = P.price(s, d)
    markets = p.select("k", "market").distinct()
    days = p.select("market", "t").distinct().select(F.col("market").alias("k"), "t")
    known = J.asof_backward(days, P.benchmark(s, d).select(F.col("market").alias("k"), "t", "v"), 7).select(F.col("k").alias("market"), "t", "v_right")
    return A.directional_agreement(p.join(known, ["market", "t"]).withColumn("year", F.year("t")), ["k", "year"])


@query(
    "a16_history_density",
    f"""WITH g AS (SELECT k, t, datediff('day', lag(t) OVER (PARTITION BY k ORDER BY t), t) AS gap FROM price), a AS (SELECT k, COUNT(*) AS n, datediff('day', MIN(t), MAX(t)) AS span, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS m FROM g GROUP BY 1)
    SELECT k, n, span, {r6('m AS median_gap')}, (n < 24 OR span < 180 OR m <= 4 OR n * 365.25 / greatest(span, 1) >= 120) AS dense FROM a""",
    ("price",),
)
def _(s, d):
    return A.history_density(P.price(s, d))


@query(
    "a17_audit_gaps",
    f"""WITH c AS (SELECT market, t, row_number() OVER (PARTITION BY market ORDER BY t) AS o FROM benchmark), r AS (SELECT p.k, p.market, p.t, p.v, c.o FROM price p JOIN c USING (market, t))
    SELECT * FROM (SELECT k, market, lag(t) OVER w AS from_t, t AS to_t, o - lag(o) OVER w - 1 AS sessions, {r6('(v / lag(v) OVER w - 1) * 100 AS change_pct')} FROM r WINDOW w AS (PARTITION BY k ORDER BY t)) WHERE datediff('day', from_t, to_t) > 10""",
    ("price", "benchmark"),
)
def _(s, d):
    p = P.price(s, d)
    return A.audit_gaps(p, p.select("market", "t").distinct())


@query("a19_temporal_coverage", f"SELECT k, COUNT(*) AS years, {r6('MAX(n) / SUM(n) AS max_share')} FROM (SELECT k, year(t) AS y, COUNT(*) AS n FROM price GROUP BY 1, 2) GROUP BY 1", ("price",))
def _(s, d):
    return A.temporal_coverage(P.price(s, d))


@query(
    "a22_net_trades",
    f"""WITH g AS (SELECT k, reporter, t, SUM(changed) AS net, COUNT(*) FILTER (changed > 0) AS b, COUNT(*) FILTER (changed < 0) AS s FROM trades GROUP BY 1, 2, 3)
    SELECT k, reporter, t, {r6('net')}, TRUE AS netted FROM g WHERE b > 0 AND s > 0 AND abs(net) > 1e-9 UNION ALL SELECT k, reporter, t, {r6('changed AS net')}, FALSE FROM trades JOIN g USING (k, reporter, t) WHERE NOT (b > 0 AND s > 0)""",
    ("trades",),
)
def _(s, d):
    return A.net_trades(P.trades(s, d))


@query(
    "a23_latest_per_group",
    """WITH one AS (SELECT user_id AS k, event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
    SELECT k, event_type, ts, event_id, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS rank FROM one QUALIFY rank <= 3""",
)
def _(s, d):
    rows = P.table(s, d, "events").select(F.col("user_id").alias("k"), "event_type", "ts", "event_id")
    return A.latest_per_group(rows, ["k"], "event_type", ["ts", "event_id"], 3)


CROSS = "x AS (SELECT market, k, t, v / nullif(lag(v, 5) OVER w, 0) - 1 AS p, lead(v, 5) OVER w / v - 1 AS y FROM price WINDOW w AS (PARTITION BY k ORDER BY t))"


def cross(s, d):
    return P.price(s, d).select("market", "k", "t", (F.col("v") / F.nullif(F.lag("v", 5).over(W.by_time()), F.lit(0.0)) - 1).alias("p"), (F.lead("v", 5).over(W.by_time()) / F.col("v") - 1).alias("y"))


@query(
    "a31_daily_rank_ic",
    f"""WITH {CROSS}, r AS (SELECT *, rank() OVER (PARTITION BY market, t ORDER BY p) + (COUNT(*) OVER (PARTITION BY market, t, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY market, t ORDER BY y) + (COUNT(*) OVER (PARTITION BY market, t, y) - 1) / 2.0 AS ry FROM x WHERE p IS NOT NULL AND y IS NOT NULL),
    e AS (SELECT market, t, COUNT(*) AS n, COUNT(DISTINCT p) AS np, COUNT(DISTINCT y) AS ny, corr(rp, ry) AS ic FROM r GROUP BY 1, 2 HAVING COUNT(*) >= 5 AND COUNT(DISTINCT p) >= 2 AND COUNT(DISTINCT y) >= 2)
    SELECT market, COUNT(*) AS days, {r6('AVG(ic) AS mean_ic', 'AVG(ic) / stddev(ic) AS information_ratio')} FROM e GROUP BY 1""",
    ("price",),
)
def _(s, d):
    return A.daily_rank_ic(cross(s, d), ["market", "t"])


@query(
    "a32_top_bottom_spread",
    f"""WITH {CROSS}, r AS (SELECT *, COUNT(*) OVER (PARTITION BY t) AS n, row_number() OVER (PARTITION BY t ORDER BY p, k) AS rn FROM x WHERE p IS NOT NULL AND y IS NOT NULL)
    SELECT t, {r6('AVG(y) FILTER (rn > n - floor(n / 5)) - AVG(y) FILTER (rn <= floor(n / 5)) AS spread')} FROM r WHERE n >= 10 GROUP BY 1""",
    ("price",),
)
def _(s, d):
    return A.top_bottom_spread(cross(s, d), ["t"])


# ---- windows

BY = "WINDOW w AS (PARTITION BY k ORDER BY t)"


@query("w1_change_rate", f"SELECT k, t, {r6('CASE WHEN abs(lag(v, 5) OVER w) > 1e-9 THEN (v - lag(v, 5) OVER w) / abs(lag(v, 5) OVER w) END AS change', 'CASE WHEN lag(v, 5) OVER w > 1e-9 AND v > 1e-9 THEN ln(v / lag(v, 5) OVER w) END AS log_change')} FROM dirty {BY}", ("dirty",))
def _(s, d):
    return U_dirty(s, d).select("k", "t", W.change_rate(5).alias("change"), W.change_rate(5, log=True).alias("log_change"))


@query("w2_change_with_gap", f"SELECT k, t, {r6("CASE WHEN datediff('day', lag(t, 5) OVER w, t) <= 9 AND abs(lag(v, 5) OVER w) > 1e-9 THEN v / lag(v, 5) OVER w - 1 END AS change")} FROM price {BY}", ("price",))
def _(s, d):
    return P.price(s, d).select("k", "t", W.change_with_gap(5, 9).alias("change"))


@query("w3_trailing_mean", f"SELECT k, t, {r6('AVG(v) OVER (PARTITION BY k ORDER BY t ROWS 19 PRECEDING) AS mean20')} FROM dirty", ("dirty",))
def _(s, d):
    return U_dirty(s, d).select("k", "t", W.trailing_mean(20).alias("mean20"))


@query(
    "w4_rolling_z",
    f"SELECT k, t, {r6('CASE WHEN COUNT(v) OVER w >= 60 AND stddev_samp(v) OVER w > 1e-12 THEN (v - AVG(v) OVER w) / stddev_samp(v) OVER w END AS z')} FROM dirty WINDOW w AS (PARTITION BY k ORDER BY t ROWS 251 PRECEDING)",
    ("dirty",),
)
def _(s, d):
    return U_dirty(s, d).select("k", "t", W.rolling_z().alias("z"))


@query(
    "w5_rolling_vol",
    f"""WITH r AS (SELECT k, t, CASE WHEN lag(v) OVER w > 1e-9 AND v > 1e-9 THEN ln(v / lag(v) OVER w) END AS r FROM price {BY})
    SELECT k, t, {r6('CASE WHEN COUNT(r) OVER x >= 2 THEN stddev_samp(r) OVER x END AS vol', 'CASE WHEN COUNT(CASE WHEN r < 0 THEN r END) OVER x >= 2 THEN stddev_samp(CASE WHEN r < 0 THEN r END) OVER x END AS down')} FROM r WINDOW x AS (PARTITION BY k ORDER BY t ROWS 19 PRECEDING)""",
    ("price",),
)
def _(s, d):
    rows = P.price(s, d).withColumn("r", W.change_rate(1, log=True))
    return rows.select("k", "t", W.rolling_vol(20).alias("vol"), W.rolling_vol(20, downside=True).alias("down"))


@query(
    "w6_volatility_profile",
    f"""WITH r AS (SELECT k, t, greatest(least(CASE WHEN lag(v) OVER w > 1e-9 AND v > 1e-9 THEN ln(v / lag(v) OVER w) END, 0.12), -0.12) AS c FROM price {BY}),
    x AS (SELECT k, t, CASE WHEN COUNT(c) OVER a >= 60 THEN stddev_samp(c) OVER a END AS l, CASE WHEN COUNT(c) OVER b >= 60 THEN stddev_samp(c) OVER b END AS s FROM (SELECT k, t, CASE WHEN i = 1 THEN NULL ELSE c END AS c FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM r)) WINDOW a AS (PARTITION BY k ORDER BY t ROWS 1259 PRECEDING), b AS (PARTITION BY k ORDER BY t ROWS 251 PRECEDING))
    SELECT k, t, {r6('l AS long_vol', 's AS recent_vol', 'coalesce(s, l) * 0.75 + coalesce(l, s) * 0.25 AS effective')} FROM x""",
    ("price",),
)
def _(s, d):
    first = F.row_number().over(W.by_time()) == 1
    rows = P.price(s, d).withColumn("c", F.when(~first, X.clamp(W.change_rate(1, log=True), -0.12, 0.12)))
    rows = rows.withColumn("long_vol", W.rolling_vol(1260, "c", 60)).withColumn("recent_vol", W.rolling_vol(252, "c", 60))
    return rows.select("k", "t", "long_vol", "recent_vol", (F.coalesce("recent_vol", "long_vol") * 0.75 + F.coalesce("long_vol", "recent_vol") * 0.25).alias("effective"))


REL = f"""p AS (SELECT k, market, t, CASE WHEN lag(v) OVER w > 1e-9 THEN ln(v / lag(v) OVER w) END AS r FROM price {BY}), b AS (SELECT market, t, CASE WHEN lag(v) OVER w > 1e-9 THEN ln(v / lag(v) OVER w) END AS m FROM benchmark WINDOW w AS (PARTITION BY market ORDER BY t)),
    j AS (SELECT k, t, r, m, CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN r END AS a, CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN m END AS c, CASE WHEN r IS NOT NULL AND m < 0 THEN r END AS da, CASE WHEN r IS NOT NULL AND m < 0 THEN m END AS dc FROM p JOIN b USING (market, t))"""


@query(
    "w8_rolling_relationship",
    f"""WITH {REL} SELECT k, t, {r6('CASE WHEN COUNT(a) OVER x >= 30 THEN corr(a, c) OVER x END AS corr', 'CASE WHEN COUNT(a) OVER x >= 30 THEN covar_samp(a, c) OVER x / var_samp(c) OVER x END AS beta', 'CASE WHEN COUNT(da) OVER x >= 10 THEN covar_samp(da, dc) OVER x / var_samp(dc) OVER x END AS downside_beta')} FROM j WINDOW x AS (PARTITION BY k ORDER BY t ROWS 59 PRECEDING)""",
    ("price", "benchmark"),
)
def _(s, d):
    p = P.price(s, d)
    b = P.benchmark(s, d).withColumn("k", F.col("market")).withColumn("m", W.change_rate(1, log=True)).select("market", "t", "m")
    rows = p.withColumn("r", W.change_rate(1, log=True)).join(b, ["market", "t"])
    return W.rolling_relationship(rows).select("k", "t", "corr", "beta", "downside_beta")


@query(
    "w10_rolling_pct_rank",
    f"""WITH h AS (SELECT k, t, v, list(v) FILTER (v IS NOT NULL) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS h FROM dirty)
    SELECT k, t, {r6('CASE WHEN len(h) >= 40 AND v IS NOT NULL THEN len(list_filter(h, lambda e: e <= v)) / len(h) END AS pct')} FROM h""",
    ("dirty",),
)
def _(s, d):
    return U_dirty(s, d).select("k", "t", W.rolling_pct_rank(60, 40).alias("pct"))


@query(
    "w12_volume_profile",
    f"""SELECT k, t, {r6('CASE WHEN COUNT(volume) OVER a >= 10 THEN volume / AVG(volume) OVER a END AS volume_ratio', 'CASE WHEN COUNT(volume) OVER b >= 10 THEN AVG(volume) OVER a / AVG(volume) OVER b END AS volume_trend')} FROM price
    WINDOW a AS (PARTITION BY k ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY k ORDER BY t ROWS BETWEEN 40 PRECEDING AND 21 PRECEDING)""",
    ("price",),
)
def _(s, d):
    return W.volume_profile(P.price(s, d)).select("k", "t", "volume_ratio", "volume_trend")


@query(
    "w13_path_efficiency",
    f"""WITH r AS (SELECT k, t, v, abs(ln(v / lag(v) OVER w)) AS step FROM price {BY})
    SELECT k, t, {r6('CASE WHEN COUNT(step) OVER x >= 20 AND SUM(step) OVER x > 1e-12 THEN abs(ln(v / lag(v, 20) OVER w)) / SUM(step) OVER x END AS efficiency')} FROM r WINDOW w AS (PARTITION BY k ORDER BY t), x AS (PARTITION BY k ORDER BY t ROWS 19 PRECEDING)""",
    ("price",),
)
def _(s, d):
    return W.path_efficiency(P.price(s, d), 20).select("k", "t", "efficiency")


@query(
    "w14_range_features",
    f"SELECT k, t, {r6('MAX(v) OVER x AS hi', 'MIN(v) OVER x AS lo', '(v / MAX(v) OVER x - 1) * 100 AS drawdown_pct', 'CASE WHEN MAX(v) OVER x > MIN(v) OVER x THEN (v - MIN(v) OVER x) / (MAX(v) OVER x - MIN(v) OVER x) END AS position')} FROM price WINDOW x AS (PARTITION BY k ORDER BY t ROWS 59 PRECEDING)",
    ("price",),
)
def _(s, d):
    return W.range_features(P.price(s, d), 60).select("k", "t", "hi", "lo", "drawdown_pct", "position")


@query("w15_max_drawdown", f"SELECT k, {r6('MIN(dd) AS max_drawdown')} FROM (SELECT k, v / MAX(v) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM price) GROUP BY 1", ("price",))
def _(s, d):
    return W.max_drawdown(P.price(s, d))


@query(
    "w16_interpolate_time",
    f"""WITH o AS (SELECT k, t, v FROM dirty WHERE v IS NOT NULL), x AS (SELECT DISTINCT k, t FROM orders_panel), a AS (SELECT x.k, x.t, o.t AS ta, o.v AS va FROM x ASOF LEFT JOIN o ON x.k = o.k AND x.t >= o.t),
    b AS (SELECT a.*, o.t AS tb, o.v AS vb FROM a ASOF LEFT JOIN o ON a.k = o.k AND a.t <= o.t)
    SELECT k, t, {r6("CASE WHEN ta = tb THEN va ELSE va + (vb - va) * datediff('day', ta, t) / datediff('day', ta, tb) END AS v")} FROM b""",
    ("dirty", "orders_panel"),
)
def _(s, d):
    return W.interpolate_time(KT(U_dirty(s, d)), P.orders_panel(s, d))


@query(
    "w21_rsi",
    f"""WITH r AS (SELECT k, t, v - lag(v) OVER w AS d FROM price {BY}), x AS (SELECT k, t, COUNT(d) OVER y AS n, SUM(CASE WHEN d > 0 THEN d ELSE 0 END) OVER y AS u, SUM(CASE WHEN d < 0 THEN -d ELSE 0 END) OVER y AS dn FROM r WINDOW y AS (PARTITION BY k ORDER BY t ROWS 13 PRECEDING))
    SELECT k, t, {r6('CASE WHEN n >= 14 AND u + dn > 1e-12 THEN (u - dn) / (u + dn) END AS balance', 'CASE WHEN n >= 14 AND u + dn > 1e-12 THEN 100 * u / (u + dn) END AS rsi')} FROM x""",
    ("price",),
)
def _(s, d):
    return W.rsi(P.price(s, d)).select("k", "t", "balance", "rsi")


@query("w23_lag_observations", f"SELECT k, t, {r6('v')} FROM (SELECT k, t, lag(v, 13) OVER (PARTITION BY k ORDER BY t) AS v FROM dirty WHERE v IS NOT NULL) WHERE v IS NOT NULL", ("dirty",))
def _(s, d):
    return KT(W.lag_observations(U_dirty(s, d), 13))


@query(
    "w24_claims_signal",
    f"""WITH a AS (SELECT k, t, CASE WHEN COUNT(v) OVER x >= 4 THEN AVG(v) OVER x END AS m FROM price WINDOW x AS (PARTITION BY k ORDER BY t ROWS 3 PRECEDING)), b AS (SELECT *, MIN(m) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS f FROM a)
    SELECT k, t, {r6('m', 'CASE WHEN f > 0 THEN m / f - 1 END AS rise')} FROM b""",
    ("price",),
)
def _(s, d):
    return W.claims_signal(P.price(s, d)).select("k", "t", "m", "rise")


@query("w27_forward_outcomes", f"SELECT k, t, {r6('lead(v, 5) OVER w / v - 1 AS return5', 'lead(v, 10) OVER w / v - 1 AS return10', 'lead(v, 20) OVER w / v - 1 AS return20', 'lead(v, 63) OVER w / v - 1 AS return63', 'MAX(v) OVER x / v - 1 AS favorable', 'MIN(v) OVER x / v - 1 AS adverse')}, COUNT(v) OVER x AS path FROM price WINDOW w AS (PARTITION BY k ORDER BY t), x AS (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)", ("price",))
def _(s, d):
    return W.forward_outcomes(P.price(s, d)).select("k", "t", "return5", "return10", "return20", "return63", "favorable", "adverse", "path")


@query(
    "w29_exclude_actions",
    f"""WITH j AS (SELECT k, t, v, CASE WHEN abs(CASE WHEN lag(v) OVER w > 1e-9 AND v > 1e-9 THEN ln(v / lag(v) OVER w) END) > ln(1.05) THEN 1 ELSE 0 END AS j FROM price {BY})
    SELECT k, t, {r6('v')} FROM j QUALIFY SUM(j) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING) = 0""",
    ("price",),
)
def _(s, d):
    return KT(W.exclude_actions(P.price(s, d), 5, 2, 1.05))


@query("w30_rolling_median", f"SELECT k, t, {r6('quantile_cont(volume, 0.5) OVER (PARTITION BY k ORDER BY t ROWS 19 PRECEDING) AS median20')} FROM price", ("price",))
def _(s, d):
    return P.price(s, d).select("k", "t", W.rolling_median(20, "volume").alias("median20"))


@query(
    "w31_cs_rank",
    f"SELECT k, market, t, {r6('CASE WHEN COUNT(v) OVER (PARTITION BY market, t) >= 3 AND v IS NOT NULL THEN (rank() OVER (PARTITION BY market, t ORDER BY v NULLS LAST) + (COUNT(*) OVER (PARTITION BY market, t, v) - 1) / 2.0) / COUNT(v) OVER (PARTITION BY market, t) - 0.5 END AS rank')} FROM dirty",
    ("dirty",),
)
def _(s, d):
    return W.cs_rank(U_dirty(s, d), ["market", "t"], 3).select("k", "market", "t", "rank")


@query(
    "w34_insert_gap_breaks",
    f"SELECT k, t, {r6('v')} FROM (SELECT k, t, v FROM price UNION ALL SELECT k, CAST(t + INTERVAL 1 DAY AS DATE), NULL FROM (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) AS f FROM price) WHERE datediff('day', t, f) > 5)",
    ("price",),
)
def _(s, d):
    return W.insert_gap_breaks(P.price(s, d), 5)


@query(
    "w36_normalize_to_base",
    f"WITH b AS (SELECT MAX(f) AS base FROM (SELECT MIN(t) AS f FROM price GROUP BY k)), a AS (SELECT k, arg_min(v, t) AS bv FROM price, b WHERE t >= base GROUP BY 1) SELECT k, t, {r6('v / bv * 100 AS v')} FROM price JOIN a USING (k)",
    ("price",),
)
def _(s, d):
    return W.normalize_to_base(P.price(s, d))


@query("w40_drop_consecutive_duplicates", "SELECT k, t, v FROM (SELECT user_id AS k, event_id AS t, event_type AS v, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> v")
def _(s, d):
    return W.drop_consecutive_duplicates(P.table(s, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("t"), F.col("event_type").alias("v")))


@query("w39_stage_transitions", "SELECT k, t, stage FROM (SELECT k, t, stage, coalesce(lag(stage) OVER (PARTITION BY k ORDER BY t), 0) AS b FROM (SELECT k, t, CAST(least(3, floor(volume / 60)) AS INT) AS stage FROM price)) WHERE stage >= 2 AND stage > b", ("price",))
def _(s, d):
    return W.stage_transitions(P.price(s, d).withColumn("stage", F.least(F.lit(3), F.floor(F.col("volume") / 60)).cast("int"))).select("k", "t", "stage")


@query(
    "w38_downsample_minmax",
    f"""WITH r AS (SELECT k, t, v, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS rn, COUNT(*) OVER (PARTITION BY k) AS n FROM price), b AS (SELECT *, floor(rn / greatest(1, ceil(n * 2 / 200))) AS b FROM r),
    x AS (SELECT *, row_number() OVER (PARTITION BY k, b ORDER BY v, t) AS lo, row_number() OVER (PARTITION BY k, b ORDER BY v DESC, t) AS hi FROM b) SELECT k, t, {r6('v')} FROM x WHERE lo = 1 OR hi = 1 OR rn = 0 OR rn = n - 1""",
    ("price",),
)
def _(s, d):
    return W.downsample_minmax(P.price(s, d), 200)


@query("w41_threshold_segments", f"""WITH a AS (SELECT k, t, v, CASE WHEN v > 1000 THEN 1 ELSE 0 END AS above FROM price), c AS (SELECT *, CASE WHEN above = lag(above) OVER (PARTITION BY k ORDER BY t) THEN 0 ELSE 1 END AS ch FROM a), r AS (SELECT *, SUM(ch) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT k, MIN(t) AS from_t, MAX(t) AS to_t, COUNT(*) AS n, {r6('MAX(v) AS top')} FROM r WHERE above = 1 GROUP BY k, run""", ("price",))
def _(s, d):
    return M.threshold_segments(P.price(s, d), 1000.0)


# ---- quality


@query(
    "q1_inspect_series",
    """WITH x AS (SELECT k, t, v, last_value(CASE WHEN v > 0 THEN v END IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM dirty)
    SELECT k, t, 'zero' AS issue FROM x WHERE v = 0 UNION ALL SELECT k, t, 'range' FROM x WHERE v < 10 OR v > 5000 UNION ALL SELECT k, t, 'jump' FROM x WHERE v > 0 AND abs(v - l) > 200 AND abs(v - l) / l > 0.3""",
    ("dirty",),
)
def _(s, d):
    return Q.inspect_series(U_dirty(s, d), 10, 5000, 0.3, 200)


@query(
    "q2_recent_changes",
    f"""WITH r AS (SELECT k, t, v FROM dirty WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) <= 120), x AS (SELECT k, t, lag(v) OVER w AS before, v, datediff('day', lag(t) OVER w, t) AS gap FROM r {BY})
    SELECT k, t, {r6('before', 'v')} FROM x WHERE gap <= 10 AND abs(before) > 1e-9 AND abs(v - before) / abs(before) > 0.5 AND abs(v - before) > 300""",
    ("dirty",),
)
def _(s, d):
    return Q.recent_changes(U_dirty(s, d), 120, 0.5, 300, 10)


@query(
    "q3_missing_days",
    """WITH sp AS (SELECT k, market, MIN(t) AS a, MAX(t) AS b FROM price GROUP BY 1, 2), e AS (SELECT k, c.t FROM sp JOIN (SELECT DISTINCT market, t FROM price) c ON c.market = sp.market AND c.t BETWEEN a AND b)
    SELECT k, t FROM e WHERE NOT EXISTS (SELECT 1 FROM price p WHERE p.k = e.k AND p.t = e.t)""",
    ("price",),
)
def _(s, d):
    p = P.price(s, d)
    return Q.missing_days(p, p.select("market", "t").distinct())


@query(
    "k15_plan_repair_dates",
    """WITH sp AS (SELECT k, market, MIN(t) AS a, MAX(t) AS b FROM price GROUP BY 1, 2), e AS (SELECT k, c.t FROM sp JOIN (SELECT DISTINCT market, t FROM price) c ON c.market = sp.market AND c.t BETWEEN a AND b)
    SELECT k, t FROM e WHERE NOT EXISTS (SELECT 1 FROM price p WHERE p.k = e.k AND p.t = e.t) QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) <= 5""",
    ("price",),
)
def _(s, d):
    p = P.price(s, d)
    return Q.missing_days(p, p.select("market", "t").distinct(), 5)


@query(
    "q4_first_discontinuity",
    f"""WITH x AS (SELECT k, t, v, abs(v / lag(v) OVER w - 1) / datediff('day', lag(t) OVER w, t) AS rate, abs(v - lag(v) OVER w) / datediff('day', lag(t) OVER w, t) AS step FROM price {BY})
    SELECT k, MIN(t) AS t, {r6('arg_min(rate, t) AS rate')} FROM x WHERE rate > 0.3 AND step > 100 GROUP BY 1""",
    ("price",),
)
def _(s, d):
    return Q.first_discontinuity(P.price(s, d), 0.3, 100)


@query("q5_accept_tail")
def _(s, d):
    p = KT(P.price(s, d))
    return Q.accept_tail(p.filter("t < DATE '2000-01-01'"), p, 0.5)


@query(
    "q9_price_integrity",
    f"SELECT k, t, {r6('greatest(v / b, b / v) AS ratio')} FROM (SELECT k, t, v, lag(v) OVER w AS b, datediff('day', lag(t) OVER w, t) AS gap FROM dirty WHERE v > 0 {BY}) WHERE greatest(v / b, b / v) >= 1.8 AND gap <= 14",
    ("dirty",),
)
def _(s, d):
    return Q.price_integrity(U_dirty(s, d), 1.8, 14)


@query(
    "q10_freshness",
    """SELECT n_nationkey AS k, MAX(t) AS latest, datediff('day', MAX(t), DATE '2001-12-01') AS age, CASE WHEN MAX(t) IS NULL THEN 'missing' WHEN datediff('day', MAX(t), DATE '2001-12-01') > 30 + n_nationkey THEN 'stale' ELSE 'fresh' END AS status FROM nation LEFT JOIN price ON k = n_nationkey GROUP BY n_nationkey""",
    ("price",),
)
def _(s, d):
    return Q.freshness(P.price(s, d), "2001-12-01", P.table(s, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") + 30).alias("max_age_days")))


@query(
    "q11_output_regression",
    """WITH a AS (SELECT k, MAX(t) AS l, COUNT(*) AS n FROM price GROUP BY 1), b AS (SELECT k, MAX(t) AS l, COUNT(*) AS n FROM price WHERE k <> 3 AND (k % 2 = 0 OR t < DATE '2001-01-01') AND (k % 4 <> 0 OR day(t) > 10) GROUP BY 1)
    SELECT * FROM (SELECT k, CASE WHEN b.n IS NULL THEN 'lost' WHEN b.l < a.l THEN 'latest regressed' WHEN b.n < a.n * 0.8 THEN 'rows lost' END AS problem, a.n AS a_n, b.n AS b_n FROM a FULL JOIN b USING (k)) WHERE problem IS NOT NULL""",
    ("price",),
)
def _(s, d):
    p = KT(P.price(s, d))
    return Q.output_regression(p, p.filter("k <> 3 AND (k % 2 = 0 OR t < DATE '2001-01-01') AND (k % 4 <> 0 OR day(t) > 10)"))


@query("q12_validate_rows", "SELECT k, COUNT(*) AS n, CAST(SUM(CASE WHEN r > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated_dates, CAST(SUM(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM (SELECT k, v, COUNT(*) OVER (PARTITION BY k, t) AS r FROM (SELECT k, t, v FROM dirty UNION ALL SELECT k, t, v FROM orders_panel)) GROUP BY 1", ("dirty", "orders_panel"))
def _(s, d):
    return Q.validate_rows(KT(U_dirty(s, d)).unionByName(P.orders_panel(s, d)))


@query("q13_classify_mutability", "SELECT state, COUNT(*) AS n FROM (SELECT CASE WHEN t >= MAX(t) OVER (PARTITION BY k) - INTERVAL 35 DAY THEN 'mutable' ELSE 'settled' END AS state FROM price) GROUP BY 1", ("price",))
def _(s, d):
    return Q.classify_mutability(P.price(s, d), 35).groupBy("state").agg(F.count("*").alias("n"))


@query("q14_fingerprint")
def _(s, d):
    return Q.fingerprint(P.price(s, d))


@query(
    "f5_trading_days",
    """WITH c AS (SELECT DISTINCT t FROM price), l AS (SELECT t, make_date(year(t), 12, 31) AS e FROM c) SELECT t FROM l WHERE isodow(t) <= 5 AND strftime(t, '%m-%d') NOT IN ('01-01', '12-25')
    AND t <> CASE WHEN isodow(e) = 7 THEN e - INTERVAL 2 DAY WHEN isodow(e) = 6 THEN e - INTERVAL 1 DAY ELSE e END AND t NOT IN (SELECT t FROM orders_panel WHERE k = 1)""",
    ("price", "orders_panel"),
)
def _(s, d):
    return Q.is_trading_day(P.price(s, d).select("t").distinct(), P.orders_panel(s, d).filter("k = 1").select("t"))


@query("f2_positive_only", f"SELECT k, t, {r6('v')} FROM dirty WHERE v > 0", ("dirty",))
def _(s, d):
    return KT(U_dirty(s, d)).withColumn("v", F.when(F.col("v") > 0, F.col("v"))).filter("v IS NOT NULL")


@query("f12_eligible_series", "SELECT k, COUNT(*) AS n, MAX(t) AS latest, CAST(SUM(CASE WHEN volume <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_volume FROM price WHERE v > 0 GROUP BY 1 HAVING COUNT(*) >= 500 AND datediff('day', MAX(t), DATE '2001-11-20') <= 45", ("price",))
def _(s, d):
    return Q.eligible_series(P.price(s, d), 500, "2001-11-20")


# ---- sampling and signals


@query("k1_top_universe", f"SELECT market, code, {r6('cap')}, rank FROM (SELECT s_nationkey % 5 AS market, s_suppkey AS code, MAX(s_acctbal) AS cap, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY MAX(s_acctbal) DESC, s_suppkey) AS rank FROM supplier GROUP BY 1, 2) WHERE rank <= 10")
def _(s, d):
    return K.top_universe(P.table(s, d, "supplier").select((F.col("s_nationkey") % 5).alias("market"), F.col("s_suppkey").alias("code"), F.col("s_acctbal").alias("cap")), 10)


@query("k5_retain_tiered")
def _(s, d):
    return K.retain_tiered(P.price(s, d).select("k", "t"), 60, 26, 24, 120)


@query(
    "k7_hash_holdout",
    """WITH h AS (SELECT DISTINCT n_regionkey AS market, s_suppkey AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey), r AS (SELECT *, COUNT(*) OVER (PARTITION BY market) AS n, row_number() OVER (PARTITION BY market ORDER BY sha256('s1|' || market || '|' || code), code) AS rn FROM h)
    SELECT market, code, rn <= greatest(1, least(n - 1, CAST(round_even(n * 0.25, 0) AS INT))) AS held_out FROM r""",
)
def _(s, d):
    rows = P.table(s, d, "supplier").join(P.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("market"), F.col("s_suppkey").alias("code"))
    return K.hash_holdout(rows, "market", "code", 0.25, "s1")


@query("k8_fnv_bucket")
def _(s, d):
    return P.table(s, d, "supplier").select("s_name", K.fnv_bucket(F.col("s_name"), 5).alias("bucket"))


@query("k10_sample_anchors", f"SELECT k, t, {r6('v')} FROM price QUALIFY (row_number() OVER (PARTITION BY k ORDER BY t) - 1) % 21 = 0", ("price",))
def _(s, d):
    return KT(K.sample_anchors(P.price(s, d), 21))


@query(
    "k13_purged_folds",
    """WITH sm AS (SELECT k, t, target_t FROM (SELECT k, t, lead(t, 20) OVER (PARTITION BY k ORDER BY t) AS target_t, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i FROM price) WHERE i % 21 = 0 AND target_t IS NOT NULL),
    d AS (SELECT t, percent_rank() OVER (ORDER BY t) AS p FROM (SELECT DISTINCT t FROM sm)), b AS (SELECT fold, MIN(t) AS a, MAX(t) AS b FROM (SELECT t, ntile(3) OVER (ORDER BY t) AS fold FROM d WHERE p >= 0.5) GROUP BY 1)
    SELECT fold, CASE WHEN t >= a THEN 'validate' ELSE 'train' END AS role, COUNT(*) AS n, COUNT(DISTINCT k) AS series FROM sm JOIN b ON t BETWEEN a AND b.b OR target_t < a GROUP BY 1, 2""",
    ("price",),
)
def _(s, d):
    rows = K.sample_anchors(P.price(s, d).withColumn("target_t", F.lead("t", 20).over(W.by_time())), 21).filter("target_t IS NOT NULL")
    return K.purged_folds(rows.select("k", "t", "target_t"), 3).groupBy("fold", "role").agg(F.count("*").alias("n"), F.countDistinct("k").alias("series"))


@query(
    "k11_assign_archetypes",
    """WITH x AS (SELECT market, k, stddev_samp(v) AS x FROM price GROUP BY 1, 2), c AS (SELECT market, quantile_cont(x, 0.33) AS lo, quantile_cont(x, 0.67) AS hi FROM x GROUP BY 1) SELECT market, k, CASE WHEN x <= lo THEN 'low' WHEN x >= hi THEN 'high' ELSE 'middle' END AS tag FROM x JOIN c USING (market)""",
    ("price",),
)
def _(s, d):
    return K.assign_archetypes(P.price(s, d).groupBy("market", "k").agg(F.stddev("v").alias("x")))


@query(
    "m9_signal_runs",
    f"""WITH {SIGNALS}, f AS (SELECT k, t, side, CASE WHEN side = lag(side) OVER w THEN 0 ELSE 1 END AS f FROM signals WHERE side IS NOT NULL {BY}), r AS (SELECT *, SUM(f) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM f)
    SELECT k, CAST(run AS BIGINT) AS run, MIN(side) AS side, MIN(t) AS from_t, MAX(t) AS to_t, COUNT(*) AS n FROM r GROUP BY k, run""",
    ("price",),
)
def _(s, d):
    return M.signal_runs(signals(s, d).filter("side IS NOT NULL"))


@query("m7_collapse_episodes")
def _(s, d):
    return M.collapse_episodes(signals(s, d).filter("side IS NOT NULL"))


@query(
    "m8_calibrate_signals",
    f"""WITH {RETURNS}, g AS (SELECT k, side, i, ret FROM returns WHERE side IS NOT NULL), j AS (SELECT g.k, g.side, g.i, p.i AS pi, CASE WHEN g.side = 'buy' THEN p.ret > 0 ELSE p.ret < 0 END AS hit FROM g LEFT JOIN (SELECT * FROM g WHERE ret IS NOT NULL) p ON p.k = g.k AND p.side = g.side AND p.i + 20 < g.i),
    t AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY k, side, i ORDER BY pi DESC NULLS LAST) <= 24), o AS (SELECT k, side, i, COUNT(pi) AS n, coalesce(SUM(CASE WHEN pi IS NOT NULL AND hit THEN 1 ELSE 0 END), 0) AS h FROM t GROUP BY 1, 2, 3)
    SELECT k, side, i, n, {r6('CASE WHEN n >= 4 THEN (h + 2) / (n + 4) END AS hit_rate')} FROM o""",
    ("price",),
)
def _(s, d):
    return M.calibrate_signals(returns(s, d).filter("side IS NOT NULL").select("k", "side", "i", "ret"))


@query(
    "m24_regime_probabilities",
    f"""WITH s AS (SELECT k, AVG(v) / 500 AS a, stddev_samp(v) / 300 AS b, (MAX(v) - MIN(v)) / 1000 AS c FROM price GROUP BY 1), e AS (SELECT k, exp(a) / (exp(a) + exp(b) + exp(c)) AS p, exp(b) / (exp(a) + exp(b) + exp(c)) AS q, exp(c) / (exp(a) + exp(b) + exp(c)) AS r FROM s)
    SELECT k, {r6('p AS up', 'q AS flat', 'r AS down', '1 + (p * ln(p) + q * ln(q) + r * ln(r)) / ln(3) AS confidence')} FROM e""",
    ("price",),
)
def _(s, d):
    g = P.price(s, d).groupBy("k").agg((F.avg("v") / 500).alias("a"), (F.stddev("v") / 300).alias("b"), ((F.max("v") - F.min("v")) / 1000).alias("c"))
    p, confidence = M.regime_probabilities({"up": F.col("a"), "flat": F.col("b"), "down": F.col("c")})
    return g.select("k", p["up"].alias("up"), p["flat"].alias("flat"), p["down"].alias("down"), confidence.alias("confidence"))


# ---- functions


@query("x1_event_type", "SELECT CASE WHEN regexp_matches(event_type, '(?i)error|fail') THEN 'error' WHEN regexp_matches(event_type, '(?i)purchase|buy') THEN 'trade' WHEN regexp_matches(event_type, '(?i)view|click') THEN 'navigation' ELSE 'other' END AS kind, COUNT(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return P.table(s, d, "events").select(X.event_type(F.col("event_type")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("x2_normalize_name", "SELECT lower(regexp_replace(s_name, '[^0-9A-Za-z]+', '', 'g')) AS name, COUNT(*) AS n FROM supplier GROUP BY 1")
def _(s, d):
    return P.table(s, d, "supplier").groupBy(X.normalize_name(F.col("s_name")).alias("name")).agg(F.count("*").alias("n"))


@query("x7_latest_weekday", "SELECT t, CAST(CASE WHEN isodow(t) = 7 THEN t - INTERVAL 2 DAY WHEN isodow(t) = 6 THEN t - INTERVAL 1 DAY ELSE t END AS DATE) AS weekday, CAST(t + INTERVAL 12 MONTH AS DATE) AS next_year FROM (SELECT DISTINCT t FROM price)", ("price",))
def _(s, d):
    return P.price(s, d).select("t").distinct().select("t", X.latest_weekday(F.col("t")).alias("weekday"), X.add_years(F.col("t"), 1).alias("next_year"))


@query(
    "x9_normal_cdf",
    f"""WITH z AS (SELECT k, t, (v - AVG(v) OVER (PARTITION BY k)) / stddev_samp(v) OVER (PARTITION BY k) AS x FROM price), u AS (SELECT k, t, x, abs(x) / sqrt(2.0) AS z, 1 / (1 + 0.3275911 * abs(x) / sqrt(2.0)) AS q FROM z), y AS (SELECT *, 1 - (((((1.061405429 * q - 1.453152027) * q) + 1.421413741) * q - 0.284496736) * q + 0.254829592) * q * exp(-z * z) AS y FROM u)
    SELECT k, t, {r6('CASE WHEN x < 0 THEN (1 - y) / 2 ELSE (1 + y) / 2 END AS p')} FROM y""",
    ("price",),
)
def _(s, d):
    w = Window.partitionBy("k")
    return P.price(s, d).select("k", "t", X.normal_cdf((F.col("v") - F.avg("v").over(w)) / F.stddev("v").over(w)).alias("p"))


# ---- streams, compared with their batch equivalents


@query("st4_daily_last", f"SELECT user_id AS k, CAST(ts AS DATE) AS t, {r6('arg_max(value, (ts, event_id)) AS v', 'SUM(value) AS total')}, COUNT(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    return ST.closed(s, d, ST.daily_last)


@query(
    "st5_rolling_days",
    f"""WITH d AS (SELECT event_type AS k, CAST(ts AS DATE) AS t, value FROM events), w AS (SELECT k, value, CAST(t - INTERVAL (i) DAY AS DATE) AS t FROM d, range(7) r(i)) SELECT k, t, COUNT(*) AS n, {r6('AVG(value) AS v')} FROM w GROUP BY 1, 2""",
)
def _(s, d):
    return ST.closed(s, d, ST.rolling_days)


@query(
    "st7_sessions",
    """WITH g AS (SELECT user_id AS k, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT k, ts, SUM(f) OVER (PARTITION BY k ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT k, MIN(ts) AS from_ts, MAX(ts) + INTERVAL 6 HOUR AS to_ts, COUNT(*) AS n FROM s GROUP BY s.k, s.n""",
)
def _(s, d):
    return ST.closed(s, d, ST.sessions)


@query("st8_deduplicated", "SELECT COUNT(*) AS n, CAST(SUM(event_id) AS BIGINT) AS ids FROM events")
def _(s, d):
    return ST.drained(ST.deduplicated(ST.source(s, d))).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# ---- landed sources, models and further aggregations

from .operators import models as MO  # noqa: E402
from .sources import landed as S  # noqa: E402


@query("s1_columnar_round_trip", f"SELECT CAST(k AS VARCHAR) AS k, t, {r6('v')} FROM price", ("price",))
def _(s, d):
    return S.columnar_rows(S.to_columnar(P.price(s, d))).select("k", "t", "v")


@query(
    "s9_extract_envelope",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS item, FALSE AS failed FROM events",
)
def _(s, d):
    rows = P.table(s, d, "events").select("event_id", F.concat(F.lit('{"list": {"item": '), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.col("props")), F.lit("}}")).alias("body"))
    out = S.extract_envelope(rows, "list.item", "struct<k: bigint>")
    return out.select("event_id", F.col("item.k").alias("item"), "failed")


@query(
    "s10_decode_observations",
    f"""SELECT o_custkey % 50 AS k, CAST(o_orderdate AS DATE) AS t, {r6('ROUND(o_totalprice / 1000 + 1e-9, 4) AS v')} FROM orders WHERE o_orderkey % 17 <> 0""",
)
def _(s, d):
    o = P.table(s, d, "orders")
    text = F.format_number("o_totalprice", 2)
    raw = o.select((F.col("o_custkey") % 50).alias("k"), F.date_format("o_orderdate", "yyyyMMdd").alias("d"), F.when(F.col("o_orderkey") % 17 == 0, "n/a").otherwise(text).alias("x"))
    return S.decode_observations(raw, "yyyyMMdd", 1000.0)


@query("s12_decode_scores", f"SELECT user_id AS k, CAST(ts AS DATE) AS t, {r6('arg_max(value, event_id) AS v')} FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1, 2")
def _(s, d):
    return S.decode_scores(P.table(s, d, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("t"), F.col("value").alias("v"), F.col("event_id").alias("seq")))


@query("s25_check_segments", "SELECT 'missing' AS problem, COUNT(*) AS n FROM price WHERE k = 3 AND t < DATE '2000-01-01' HAVING COUNT(*) > 0", ("price",))
def _(s, d):
    p = KT(P.price(s, d))
    return S.check_segments(p, p.filter("t >= DATE '2000-01-01'"), p.filter("t < DATE '2000-01-01' AND k <> 3")).groupBy("problem").agg(F.count("*").alias("n"))


FEATURE_SQL = f"""f AS (SELECT k, t, v, row_number() OVER w - 1 AS i, ln(v / lag(v, 5) OVER w) AS r5, ln(v / lag(v, 20) OVER w) AS r20, ln(v / lag(v, 60) OVER w) AS r60, ln(v / lag(v) OVER w) AS r1, ln(lead(v, 20) OVER w / v) AS y, lead(t, 20) OVER w AS target_t FROM price {BY}),
    g AS (SELECT k, t, i, y, target_t, r5, r20, r60, stddev_samp(r1) OVER a AS vol20, stddev_samp(r1) OVER b AS vol60, v / MAX(v) OVER b - 1 AS draw60, CASE WHEN MAX(v) OVER b > MIN(v) OVER b THEN (v - MIN(v) OVER b) / (MAX(v) OVER b - MIN(v) OVER b) END AS pos60, ln(v / AVG(v) OVER a) AS mean20
    FROM f WINDOW a AS (PARTITION BY k ORDER BY t ROWS 19 PRECEDING), b AS (PARTITION BY k ORDER BY t ROWS 59 PRECEDING))"""


@query("m11_forecast_features", f"WITH {FEATURE_SQL} SELECT k, t, {r6(*MO.FEATURES)} FROM g", ("price",))
def _(s, d):
    return MO.forecast_features(P.price(s, d)).drop("v")


@query("m12_build_samples", f"WITH {FEATURE_SQL} SELECT k, t, target_t, {r6('y', *MO.FEATURES)} FROM g WHERE i >= 60 AND i % 21 = 0 AND y IS NOT NULL AND r60 IS NOT NULL AND vol60 IS NOT NULL AND pos60 IS NOT NULL", ("price",))
def _(s, d):
    return MO.build_samples(P.price(s, d)).select("k", "t", "target_t", "y", *MO.FEATURES)


@query("m13_fit_ridge")
def _(s, d):
    return MO.fit_ridge(MO.build_samples(P.price(s, d)), "k")


@query(
    "m27_score_journal",
    f"""WITH j AS (SELECT k, t AS as_of, v AS base, v * (1 + v / lag(v, 20) OVER w - 1) AS predicted, CAST(t + INTERVAL 28 DAY AS DATE) AS target_t, row_number() OVER w - 1 AS i, lag(v, 20) OVER w AS b FROM price {BY}),
    x AS (SELECT j.*, p.t AS pt, p.v AS pv FROM (SELECT * FROM j WHERE i % 21 = 0 AND b IS NOT NULL) j ASOF LEFT JOIN price p ON p.k = j.k AND p.t >= j.target_t)
    SELECT k, as_of, target_t, CASE WHEN datediff('day', target_t, pt) <= 14 THEN pt END AS actual_t, {r6("CASE WHEN datediff('day', target_t, pt) <= 14 THEN pv END AS actual", "CASE WHEN datediff('day', target_t, pt) <= 14 THEN ln(pv / predicted) END AS log_error")}, CASE WHEN datediff('day', target_t, pt) <= 14 THEN sign(pv - base) = sign(predicted - base) END AS direction_right FROM x""",
    ("price",),
)
def _(s, d):
    before = F.lag("v", 20).over(W.by_time())
    rows = P.price(s, d).withColumn("b", before).withColumn("i", F.row_number().over(W.by_time()) - 1).filter("i % 21 = 0 AND b IS NOT NULL")
    journal = rows.select("k", F.col("t").alias("as_of"), F.date_add("t", 28).alias("target_t"), F.col("v").alias("base"), (F.col("v") * (1 + F.col("v") / F.col("b") - 1)).alias("predicted"))
    return MO.score_journal(journal, P.price(s, d))


@query(
    "m33_financial_snapshots",
    f"""WITH {FIN}, d AS (SELECT DISTINCT k, report_date AS as_of FROM versions), l AS (SELECT d.k, d.as_of, v.period, arg_max(v.v, v.report_date) AS v FROM d JOIN versions v ON v.k = d.k AND v.report_date <= d.as_of GROUP BY 1, 2, 3)
    SELECT k, as_of, COUNT(*) AS periods, {r6('SUM(v) AS total')}, MAX(period) AS latest_period FROM l GROUP BY 1, 2""",
)
def _(s, d):
    rows = P.table(s, d, "orders").join(P.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fin = rows.groupBy(F.col("c_nationkey").alias("k"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period")).agg((F.sum("o_totalprice") / 1e6).alias("v"))
    report = lambda days, by: fin.select("k", "period", F.date_add(F.add_months("period", 3), days).alias("report_date"), (F.col("v") * by).alias("v"))
    return MO.financial_snapshots(report(44, 1.0).unionByName(report(134, 1.01)))


@query(
    "a36_candidate_profile",
    f"""WITH r AS (SELECT k, ln(v / lag(v) OVER w) AS r, datediff('day', DATE '1995-01-01', t) / 365.25 AS x, v / MAX(v) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd, ln(v) AS l FROM price {BY})
    SELECT k, {r6('stddev_samp(r) AS vol', 'regr_slope(l, x) AS trend', 'regr_r2(l, x) AS fit', 'MIN(dd) AS max_drawdown')} FROM r GROUP BY 1""",
    ("price",),
)
def _(s, d):
    return MO.candidate_profile(P.price(s, d))


@query(
    "a15_effective_period",
    """WITH a AS (SELECT k, MIN(t) AS a, MAX(t) AS b FROM price WHERE t BETWEEN DATE '1995-01-01' AND DATE '2000-01-01' GROUP BY 1)
    SELECT k, datediff('day', DATE '1995-01-01', a) <= 10 AS "full", CASE WHEN datediff('day', DATE '1995-01-01', a) > 10 THEN CAST(floor(datediff('day', a, b) / 30.4375) AS BIGINT) END AS months FROM a""",
    ("price",),
)
def _(s, d):
    return A.effective_period(P.price(s, d), "1995-01-01", "2000-01-01")


@query(
    "a20_stability",
    f"WITH {RETURNS}, e AS (SELECT side, year, COUNT(*) AS n, AVG(ret) AS mean FROM returns WHERE side IS NOT NULL AND ret IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 30) SELECT side, COUNT(*) AS cohorts, CAST(SUM(CASE WHEN mean > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, {r6('AVG(mean) AS mean', 'MIN(mean) AS worst')} FROM e GROUP BY 1",
    ("price",),
)
def _(s, d):
    return A.stability(returns(s, d).filter("side IS NOT NULL"), "year", 30)


@query(
    "k3_tail_failures",
    f"WITH {RETURNS}, w AS (SELECT side, k, t, ret, row_number() OVER (PARTITION BY side ORDER BY CASE WHEN side = 'buy' THEN ret ELSE -ret END, k, t) AS rank FROM returns WHERE side IS NOT NULL AND ret IS NOT NULL) SELECT side, rank, k, t, {r6('ret')} FROM w WHERE rank <= 20",
    ("price",),
)
def _(s, d):
    return A.tail_failures(returns(s, d).filter("side IS NOT NULL"), 20)


@query("w33_envelope", f"SELECT t, {r6('MIN(v) AS low', 'MAX(v) AS high')}, COUNT(v) AS n FROM dirty GROUP BY 1", ("dirty",))
def _(s, d):
    return A.envelope(U_dirty(s, d))


from . import queries_evidence, queries_incremental, queries_landing, queries_outcomes, queries_panels, queries_reports, queries_shapes, queries_timing  # noqa: E402, F401
