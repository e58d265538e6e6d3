"""Queries of filters, selections, oscillators and windows over the panels, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import indicators as W
from .operators import oscillators as O
from .operators import selection as L
from .operators import signals as M
from .plans import panels as P
from .plans.sql_panels import r6
from .queries import BY, KT, RETURNS, SIGNALS, U_dirty, query, returns, signals

# ---- oscillators

_POSITIVE = "SELECT k, t, v, row_number() OVER (PARTITION BY k ORDER BY t) AS i, COUNT(*) OVER (PARTITION BY k) AS n FROM price WHERE v > 0"
_EMA = f"""WITH RECURSIVE p AS MATERIALIZED ({_POSITIVE}), e AS (SELECT k, i, t, v AS e FROM p WHERE i = 1 UNION ALL SELECT p.k, p.i, p.t, p.v * (2.0 / 13) + e.e * (1 - 2.0 / 13) FROM e JOIN p ON p.k = e.k AND p.i = e.i + 1)"""


@query("w19_ema", f"{_EMA} SELECT k, t, {r6('e AS ema')} FROM e", ("price",))
def _(s, d):
    return O.ema(P.price(s, d), 12)


@query(
    "w19_macd_log",
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT k, t, i, ln(v) AS x FROM ({_POSITIVE})), e AS (SELECT k, i, t, x AS f, x AS s, CAST(0 AS DOUBLE) AS g FROM p WHERE i = 1
    UNION ALL SELECT k, i, t, f, s, (f - s) * 0.2 + g * 0.8 FROM (SELECT p.k, p.i, p.t, p.x * (2.0 / 13) + e.f * (1 - 2.0 / 13) AS f, p.x * (2.0 / 27) + e.s * (1 - 2.0 / 27) AS s, e.g FROM e JOIN p ON p.k = e.k AND p.i = e.i + 1) y)
    SELECT k, t, {r6('f - s - g AS oscillator')} FROM e""",
    ("price",),
)
def _(s, d):
    return O.macd_log(P.price(s, d))


_MACD = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, AVG(v) OVER (PARTITION BY k ORDER BY i ROWS 11 PRECEDING) AS a12, AVG(v) OVER (PARTITION BY k ORDER BY i ROWS 25 PRECEDING) AS a26 FROM ({_POSITIVE}) WHERE n >= 34),
    e AS (SELECT k, i, t, v, CAST(NULL AS DOUBLE) AS f, CAST(NULL AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS acc, CAST(NULL AS DOUBLE) AS g FROM p WHERE i = 1
    UNION ALL SELECT k, i, t, v, f, s, CASE WHEN i BETWEEN 26 AND 34 THEN acc + f - s ELSE acc END, CASE WHEN i = 34 THEN (acc + f - s) / 9 WHEN i > 34 THEN g + (f - s - g) * 0.2 END FROM (
      SELECT p.k, p.i, p.t, p.v, CASE WHEN p.i = 12 THEN a12 WHEN p.i > 12 THEN e.f + (p.v - e.f) * 2.0 / 13 END AS f, CASE WHEN p.i = 26 THEN a26 WHEN p.i > 26 THEN e.s + (p.v - e.s) * 2.0 / 27 END AS s, e.acc, e.g FROM e JOIN p ON p.k = e.k AND p.i = e.i + 1) y),
    macd AS (SELECT k, t, f - s AS macd, g AS signal_line, f - s - g AS oscillator, (f - s - g) / v * 100 AS normalized FROM e)"""


@query("w18_macd", f"{_MACD} SELECT k, t, {r6('macd', 'signal_line', 'oscillator', 'normalized')} FROM macd", ("price",))
def _(s, d):
    return O.macd(P.price(s, d))


@query(
    "w20_oscillator_signal",
    f"""{_MACD}, r AS (SELECT k, normalized AS x, row_number() OVER (PARTITION BY k ORDER BY t DESC) AS b FROM macd WHERE normalized IS NOT NULL QUALIFY b <= 40),
    g AS (SELECT k, COUNT(*) AS n, coalesce(nullif(stddev_pop(x), 0), 0.0001) AS sd, MAX(x) FILTER (b = 1) AS l, AVG(x) FILTER (b BETWEEN 2 AND 5) AS m, SUM(sign(x)) FILTER (b <= 5) AS sg FROM r GROUP BY 1)
    SELECT k, {r6('CASE WHEN n >= 8 THEN greatest(least(greatest(least(l / (sd * 1.8), 1), -1) * 0.45 + greatest(least((l - m) / sd, 1), -1) * 0.35 + sg / 5 * 0.2, 1), -1) ELSE 0 END AS score')} FROM g""",
    ("price",),
)
def _(s, d):
    return O.oscillator_signal(O.macd(P.price(s, d)))


@query(
    "w22_pit_signal",
    f"""WITH x AS (SELECT k, t, list(v) FILTER (v IS NOT NULL) OVER w AS h, AVG(v) OVER w AS m, stddev_samp(v) OVER w AS sd FROM dirty WINDOW w AS (PARTITION BY k ORDER BY t ROWS 251 PRECEDING)),
    y AS (SELECT k, t, m, greatest(sd, 1e-9) AS sd, coalesce(len(h), 0) AS n, h[-1] AS l, h[greatest(len(h) - 21, 1)] AS o FROM x)
    SELECT k, t, {r6('CASE WHEN n >= 8 THEN greatest(least((l - m) / sd, 3), -3) ELSE 0 END AS level', 'CASE WHEN n >= 8 THEN greatest(least((l - o) / sd, 3), -3) ELSE 0 END AS trend')}, CAST(n >= 8 AS INT) AS available FROM y""",
    ("dirty",),
)
def _(s, d):
    return O.pit_signal(U_dirty(s, d))


@query(
    "w11_volatility_timing",
    f"""WITH x AS (SELECT k, t, v, list(v) OVER b AS h, COUNT(v) OVER b AS n, AVG(v) OVER b AS m, stddev_samp(v) OVER b AS sd, lag(v, 5) OVER w AS v5, lag(v, 20) OVER w AS v20, MAX(v) OVER r AS hi, MIN(v) OVER r AS lo FROM price
    WINDOW w AS (PARTITION BY k ORDER BY t), b AS (PARTITION BY k ORDER BY t ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY k ORDER BY t ROWS 19 PRECEDING)),
    y AS (SELECT *, n >= 60 AS ok FROM x)
    SELECT k, t, {r6('CASE WHEN ok THEN len(list_filter(h, lambda z: z <= v)) / n END AS percentile', 'CASE WHEN ok THEN CASE WHEN sd > 1e-9 THEN (v - m) / sd ELSE 0 END END AS z', 'CASE WHEN ok THEN (v - v5) / abs(v5) * 100 END AS change5', 'CASE WHEN ok THEN (v - v20) / abs(v20) * 100 END AS change20', 'CASE WHEN ok THEN (v / hi - 1) * 100 END AS drawdown20', 'CASE WHEN ok THEN (v / lo - 1) * 100 END AS rebound20')} FROM y""",
    ("price",),
)
def _(s, d):
    return O.volatility_timing(P.price(s, d))


@query(
    "w25_overheat_memory",
    f"""WITH x AS (SELECT k, t, v, row_number() OVER w AS i, lag(v) OVER w AS base, (v / lag(v) OVER w - 1) * 100 BETWEEN 25 AND 31.5 AS hot FROM price {BY}),
    y AS (SELECT *, COUNT(*) FILTER (hot) OVER b AS n, MIN(i) FILTER (hot) OVER b AS f, MAX(i) FILTER (hot) OVER b AS l FROM x WINDOW b AS (PARTITION BY k ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
    SELECT y.k, y.t, y.n AS count, y.l - y.f AS span, y.i - y.l AS age, {r6('(y.v / MIN(z.base) FILTER (z.i = y.f) - 1) * 100 AS gain', '(y.v / MAX(z.v) - 1) * 100 AS drawdown')} FROM y JOIN x z ON z.k = y.k AND z.i BETWEEN y.f AND y.i WHERE y.n >= 2 GROUP BY y.k, y.t, y.v, y.i, y.n, y.f, y.l""",
    ("price",),
)
def _(s, d):
    return O.overheat_memory(P.price(s, d)).withColumn("span", F.col("span").cast("long")).withColumn("age", F.col("age").cast("long"))


@query(
    "w32_threshold_zones",
    f"""WITH x AS (SELECT k, t, v, lag(v) OVER w AS p FROM dirty {BY}), y AS (SELECT *, v < 1300 AS il, v > 1600 AS ih, coalesce(v >= 1300 AND p < 1300, false) AS ol, coalesce(v <= 1600 AND p > 1600, false) AS oh, coalesce(v < 1300 AND p >= 1300, false) AS nl, coalesce(v > 1600 AND p <= 1600, false) AS nh FROM x)
    SELECT k, t, {r6('CASE WHEN il OR ol THEN v END AS low', 'CASE WHEN (NOT il AND NOT ih) OR nl OR nh THEN v END AS middle', 'CASE WHEN ih OR oh THEN v END AS high', 'CASE WHEN il OR ol THEN 1300.0 END AS low_base', 'CASE WHEN ih OR oh THEN 1600.0 END AS high_base')} FROM y""",
    ("dirty",),
)
def _(s, d):
    return O.threshold_zones(U_dirty(s, d), 1300.0, 1600.0)


@query("w35_range_extrema", f"SELECT k, {r6('MIN(v) AS low')}, arg_min(t, (v, t)) AS low_t, {r6('MAX(v) AS high')}, arg_max(t, (v, -datediff('day', DATE '1990-01-01', t))) AS high_t, COUNT(v) AS n FROM dirty WHERE t BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' AND v IS NOT NULL GROUP BY 1", ("dirty",))
def _(s, d):
    return O.range_extrema(U_dirty(s, d), "1994-01-01", "1996-12-31")


@query(
    "w37_autofit_scale",
    f"""WITH b AS (SELECT k, greatest((MAX(v) - MIN(v)) / arg_min(v, t) * 100, 1) AS r FROM price WHERE v > 0 GROUP BY 1), s AS (SELECT list(r ORDER BY r) AS l FROM b) SELECT k, {r6('greatest(least(floor(l[len(l) // 2 + 1] / r * 100 + 0.5), 5000), 5) AS scale')} FROM b, s""",
    ("price",),
)
def _(s, d):
    return O.autofit_scale(P.price(s, d))


@query(
    "w28_forward_labels",
    f"""WITH x AS (SELECT k, market, t, lead(ln(v), 20) OVER w - ln(v) AS a, CAST(abs(ln(v / lag(v) OVER w)) > ln(20.0) AS INT) AS bad FROM price {BY}), y AS (SELECT k, market, t, CASE WHEN coalesce(SUM(bad) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), 0) = 0 THEN a END AS a FROM x),
    z AS (SELECT *, AVG(a) OVER (PARTITION BY market, t) AS m FROM y) SELECT k, t, {r6('a AS absolute', 'm AS market_return', 'a - m AS relative')} FROM z WHERE a IS NOT NULL""",
    ("price",),
)
def _(s, d):
    return O.forward_labels(P.price(s, d), 20, 20.0)


_SLOW = "slow AS (SELECT 'macro' AS k, t, v FROM macro UNION ALL SELECT 'leading_cycle', CAST(t + INTERVAL 3 DAY AS DATE), v FROM macro WHERE t < DATE '1998-01-01')"


@query(
    "w17_densify",
    f"""WITH {_SLOW}, days AS (SELECT DISTINCT t FROM price WHERE isodow(t) <= 5), z AS (SELECT k, MIN(t) AS a, MAX(t) AS z FROM slow GROUP BY 1),
    e AS (SELECT k, a, CASE WHEN day(z) = 1 AND k <> 'leading_cycle' THEN last_day(z) WHEN k IN ('leading_cycle', 'news_sentiment') AND z NOT IN (SELECT t FROM days) THEN coalesce((SELECT MIN(t) FROM days WHERE t > z), z) ELSE z END AS b FROM z),
    x AS (SELECT e.k, days.t FROM e JOIN days ON days.t BETWEEN a AND b), p AS (SELECT x.k, x.t, o.t AS ta, o.v AS va FROM x ASOF LEFT JOIN slow o ON x.k = o.k AND x.t >= o.t), q AS (SELECT p.*, o.t AS tb, o.v AS vb FROM p ASOF LEFT JOIN slow o ON p.k = o.k AND p.t <= o.t)
    SELECT k, t, {r6("coalesce(CASE WHEN ta = tb THEN va ELSE va + (vb - va) * datediff('day', ta, t) / datediff('day', ta, tb) END, va) AS v")} FROM q""",
    ("price", "macro"),
)
def _(s, d):
    macro = P.macro(s, d)
    slow = macro.select(F.lit("macro").alias("k"), "t", "v").unionByName(macro.filter("t < '1998-01-01'").select(F.lit("leading_cycle").alias("k"), F.date_add("t", 3).alias("t"), "v"))
    return O.densify(slow, P.price(s, d).filter("dayofweek(t) BETWEEN 2 AND 6"))


_PAIR = "pair AS (SELECT p.k, p.t, ln(p.v / lag(p.v) OVER w) AS r, ln(b.v / lag(b.v) OVER w) AS b FROM price p JOIN benchmark b USING (market, t) WINDOW w AS (PARTITION BY p.k ORDER BY p.t))"


@query(
    "w9_relationship_lagged",
    f"""WITH {_PAIR}, x AS (SELECT k, t, COUNT(CASE WHEN r IS NOT NULL THEN b END) OVER w AS n, stddev_samp(CASE WHEN r IS NOT NULL THEN b END) OVER w AS sd, corr(r, b) OVER w AS c, covar_samp(r, b) OVER w AS cv FROM pair WINDOW w AS (PARTITION BY k ORDER BY t ROWS 59 PRECEDING)),
    y AS (SELECT k, t, n, CASE WHEN n >= 30 AND sd > 1e-12 THEN c END AS corr, CASE WHEN n >= 30 AND sd > 1e-12 THEN cv / (sd * sd) END AS beta FROM x) SELECT k, t, lag(n) OVER w AS n, {r6('lag(corr) OVER w AS corr', 'lag(beta) OVER w AS beta')} FROM y {BY}""",
    ("price", "benchmark"),
)
def _(s, d):
    ln = lambda c: F.ln(F.col(c) / F.lag(c).over(W.by_time()))
    rows = P.price(s, d).join(P.benchmark(s, d).withColumnRenamed("v", "bv"), ["market", "t"]).select("k", "t", ln("v").alias("r"), ln("bv").alias("b"))
    return O.relationship_lagged(rows)


@query("w7_standardized_return", f"""WITH r AS (SELECT k, t, v, ln(v / lag(v) OVER w) AS r, ln(v / lag(v, 20) OVER w) AS c FROM price {BY}), x AS (SELECT *, COUNT(r) OVER w AS n, stddev_samp(r) OVER w AS sd FROM r WINDOW w AS (PARTITION BY k ORDER BY t ROWS 251 PRECEDING))
    SELECT k, t, {r6('c / (greatest(CASE WHEN n >= 20 THEN sd END, 0.002) * sqrt(20)) AS z')} FROM x""", ("price",))
def _(s, d):
    return W.standardized_return(P.price(s, d), 20).select("k", "t", "z")


@query(
    "m3_classify_regime",
    """WITH x AS (SELECT p.k, p.t, 100 * p.v / nullif(lag(p.v, 5) OVER w, 0) AS adr_min, p.volume AS fear_min, o.v / 10 AS crisis, percent_rank() OVER (PARTITION BY p.k ORDER BY p.v) AS vkospi_pct, percent_rank() OVER (PARTITION BY p.k ORDER BY p.volume) AS vix_pct,
      (p.v / MAX(p.v) OVER (PARTITION BY p.k ORDER BY p.t ROWS 59 PRECEDING) - 1) * 100 AS drawdown60, p.v - lag(p.v) OVER w AS macd_slope, o.v / 100 - 1.5 AS leading_change, (p.v / lag(p.v, 20) OVER w - 1) * 100 AS change20, CASE WHEN p.volume > 40 THEN 110.0 END AS news FROM price p LEFT JOIN orders_panel o USING (k, t) WINDOW w AS (PARTITION BY p.k ORDER BY p.t)),
    y AS (SELECT k, CASE WHEN (coalesce(adr_min <= 80, false))::INT + (coalesce(fear_min <= 25, false))::INT + (coalesce(crisis >= 50, false))::INT + (coalesce(vkospi_pct >= 0.8, false))::INT + (coalesce(vix_pct >= 0.8, false))::INT >= 2 THEN 'stress'
      WHEN coalesce(drawdown60, 0) <= -10 AND coalesce(macd_slope > 0, false) AND (coalesce(adr_min <= 85, false) OR coalesce(fear_min <= 35, false)) THEN 'recovery' WHEN coalesce(leading_change, 0) < -0.05 AND coalesce(change20 >= 0, false) THEN 'slowdown'
      WHEN coalesce(change20 >= 3, false) AND (coalesce(leading_change, 0) >= 0 OR coalesce(news >= 100, false)) THEN 'expansion' ELSE 'range' END AS regime FROM x)
    SELECT k, regime, COUNT(*) AS n FROM y GROUP BY 1, 2""",
    ("price", "orders_panel"),
)
def _(s, d):
    w = W.by_time()
    rows = P.price(s, d).join(P.orders_panel(s, d).withColumnRenamed("v", "o"), ["k", "t"], "left")
    rank = lambda c: F.percent_rank().over(Window.partitionBy("k").orderBy(c))
    x = rows.select(
        "k", (100 * F.col("v") / F.nullif(F.lag("v", 5).over(w), F.lit(0.0))).alias("adr_min"), F.col("volume").alias("fear_min"), (F.col("o") / 10).alias("crisis"), rank("v").alias("vkospi_pct"), rank("volume").alias("vix_pct"),
        ((F.col("v") / F.max("v").over(W.trailing(60)) - 1) * 100).alias("drawdown60"), (F.col("v") - F.lag("v").over(w)).alias("macd_slope"), (F.col("o") / 100 - 1.5).alias("leading_change"),
        ((F.col("v") / F.lag("v", 20).over(w) - 1) * 100).alias("change20"), F.when(F.col("volume") > 40, 110.0).alias("news"),
    )
    return x.select("k", M.classify_regime().alias("regime")).groupBy("k", "regime").agg(F.count("*").alias("n"))


# ---- filters


@query("f3_pick_columns", f"SELECT k, t, {r6('v')}, CAST(NULL AS DOUBLE) AS turnover FROM orders_panel", ("orders_panel",))
def _(s, d):
    return L.pick_columns(P.orders_panel(s, d), ["k", "t", "v", "turnover"])


_THIN = "thin AS (SELECT * REPLACE (CASE WHEN volume < 10 THEN 0.0 WHEN volume > 60 THEN NULL ELSE volume END AS volume) FROM dirty)"


def _thin(s, d):
    return U_dirty(s, d).withColumn("volume", F.when(F.col("volume") < 10, 0.0).when(F.col("volume") > 60, None).otherwise(F.col("volume").cast("double")))


@query("f4_valid_price_points", f"WITH {_THIN} SELECT k, t, {r6('v')} FROM thin WHERE v IS NOT NULL AND (volume IS NULL OR volume > 0)", ("dirty",))
def _(s, d):
    return KT(L.valid_price_points(_thin(s, d)))


@query("f6_sanitize_series", f"WITH {_THIN} SELECT k, t, {r6('v')} FROM thin WHERE v IS NOT NULL AND (volume IS NULL OR volume > 0) AND t IN (SELECT t FROM orders_panel WHERE isodow(t) <= 5)", ("dirty", "orders_panel"))
def _(s, d):
    return KT(L.sanitize_market_series(_thin(s, d), P.orders_panel(s, d).filter("dayofweek(t) BETWEEN 2 AND 6")))


@query("f7_slice_range", f"SELECT k, t, {r6('v')} FROM price WHERE t BETWEEN DATE '1995-02-01' AND DATE '1996-01-31'", ("price",))
def _(s, d):
    return KT(L.slice_range(P.price(s, d), "1995-02-01", "1996-01-31"))


@query("f8_rows_through", f"WITH c AS (SELECT k, CAST(MIN(t) + INTERVAL 900 DAY AS DATE) AS cutoff FROM orders_panel GROUP BY 1) SELECT k, t, {r6('v')} FROM price JOIN c USING (k) WHERE t <= cutoff", ("price", "orders_panel"))
def _(s, d):
    return KT(L.rows_through(P.price(s, d), P.orders_panel(s, d).groupBy("k").agg(F.date_add(F.min("t"), 900).alias("cutoff"))))


@query(
    "f9_report_available",
    "WITH o AS (SELECT o_orderkey AS report, CAST(o_orderdate AS DATE) AS t FROM orders), a AS (SELECT report, t, CAST(t + INTERVAL 1 DAY AS DATE) AS n FROM o) SELECT report, t, CAST(CASE isodow(n) WHEN 6 THEN n + INTERVAL 2 DAY WHEN 7 THEN n + INTERVAL 1 DAY ELSE n END AS DATE) AS usable FROM a WHERE CASE isodow(n) WHEN 6 THEN n + INTERVAL 2 DAY WHEN 7 THEN n + INTERVAL 1 DAY ELSE n END <= DATE '1997-06-30'",
)
def _(s, d):
    rows = P.table(s, d, "orders").select(F.col("o_orderkey").alias("report"), F.to_date("o_orderdate").alias("t"))
    return rows.withColumn("usable", L.available_from(F.col("t"))).filter("usable <= '1997-06-30'")


@query("f10_bounded_recent", f"SELECT k, t, {r6('v')} FROM (SELECT k, t, v FROM dirty QUALIFY datediff('day', t, MAX(t) OVER (PARTITION BY k)) <= 45) WHERE v BETWEEN 500 AND 5000 QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) <= 20", ("dirty",))
def _(s, d):
    return KT(L.bounded_recent_rows(U_dirty(s, d), 45, 500.0, 5000.0, 20))


@query("f11_candidate_filters", f"WITH c AS (SELECT k, market, t, v / nullif(lag(v, 20) OVER w, 0) - 1 AS score FROM price {BY}) SELECT k, market, t, {r6('score')} FROM c QUALIFY t = MAX(t) OVER (PARTITION BY market) AND abs(score) >= 0.01", ("price",))
def _(s, d):
    score = F.col("v") / F.nullif(F.lag("v", 20).over(W.by_time()), F.lit(0.0)) - 1
    return L.candidate_filters(P.price(s, d).select("k", "market", "t", score.alias("score")), 0.01)


@query("f13_forecast_eligibility", "WITH c AS (SELECT k, COUNT(*) FILTER (v > 0) AS c FROM dirty GROUP BY 1) SELECT k, least(c, 1500) AS used, c >= 300 AS eligible, CASE WHEN c = 0 THEN 'no-history' WHEN c < 300 THEN 'short-history' END AS reason FROM c", ("dirty",))
def _(s, d):
    return L.forecast_eligibility(U_dirty(s, d), 300, 1500)


@query(
    "f14_assign_cohorts",
    "WITH l AS (SELECT s_nationkey % 5 AS market, s_suppkey AS k FROM supplier), h AS (SELECT market, k, CASE WHEN row_number() OVER (PARTITION BY market ORDER BY k) <= COUNT(*) OVER (PARTITION BY market) // 2 THEN 'development' ELSE 'holdout' END AS c FROM l) SELECT market, k, CASE WHEN k IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) THEN 'holdout' ELSE c END AS cohort FROM h",
)
def _(s, d):
    t = P.table(s, d, "supplier")
    return L.assign_cohorts(t.select((F.col("s_nationkey") % 5).alias("market"), F.col("s_suppkey").alias("k")), t.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("k"), F.lit("holdout").alias("cohort")))


@query(
    "f15_normalize_scores",
    "WITH e AS (SELECT event_id AS k, CAST(ts AS DATE) AS t, value * 1.5 - 10 AS score, CAST(user_id % 7 - 1 AS INT) AS stage FROM events), r AS (SELECT k, t, floor(score + 0.5) AS s, stage FROM e WHERE score BETWEEN 0 AND 100) SELECT k, t, CAST(s AS BIGINT) AS score, CAST(CASE WHEN stage BETWEEN 0 AND 3 THEN stage WHEN s >= 75 THEN 3 WHEN s >= 50 THEN 2 WHEN s >= 25 THEN 1 ELSE 0 END AS INT) AS stage FROM r",
)
def _(s, d):
    return L.normalize_scores(P.table(s, d, "events").select(F.col("event_id").alias("k"), F.to_date("ts").alias("t"), (F.col("value") * 1.5 - 10).alias("score"), (F.col("user_id") % 7 - 1).cast("int").alias("stage")))


@query(
    "f16_search_universe",
    "WITH u AS (SELECT p_name AS name, 'C' || p_partkey AS code FROM part), r AS (SELECT CASE WHEN starts_with(lower(name), 'c1') THEN 0 WHEN contains(lower(name), 'c1') THEN 1 WHEN starts_with(lower(code), 'c1') THEN 2 WHEN contains(lower(code), 'c1') THEN 3 END AS rank, name, code FROM u) SELECT CAST(rank AS INT) AS rank, name, code FROM r WHERE rank IS NOT NULL ORDER BY rank, name, code LIMIT 12",
)
def _(s, d):
    return L.search_universe(P.table(s, d, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code")), "c1")


@query("j17_restrict_to", f"SELECT k, t, {r6('v')} FROM price WHERE k IN (SELECT k FROM orders_panel WHERE v > 150) AND k NOT IN (SELECT k FROM price WHERE market = 1)", ("price", "orders_panel"))
def _(s, d):
    price = P.price(s, d)
    return KT(L.restrict_to(price, P.orders_panel(s, d).filter("v > 150"), price.filter("market = 1")))


@query("j18_policy_grid", f"WITH pol(policy, n) AS (VALUES ('fast', 5), ('slow', 60)) SELECT k, policy, {r6('AVG(abs(v / o - 1)) AS mean_move')}, COUNT(o) AS n FROM (SELECT k, policy, v, CASE WHEN n = 5 THEN lag(v, 5) OVER w ELSE lag(v, 60) OVER w END AS o FROM price, pol WINDOW w AS (PARTITION BY k, policy ORDER BY t)) GROUP BY 1, 2", ("price",))
def _(s, d):
    rows = P.price(s, d).withColumn("policy", F.explode(F.array(F.lit("fast"), F.lit("slow"))))
    w = Window.partitionBy("k", "policy").orderBy("t")
    old = F.when(F.col("policy") == "fast", F.lag("v", 5).over(w)).otherwise(F.lag("v", 60).over(w))
    return rows.select("k", "policy", "v", old.alias("o")).groupBy("k", "policy").agg(F.avg(F.abs(F.col("v") / F.col("o") - 1)).alias("mean_move"), F.count("o").alias("n"))


# ---- selection


@query("k2_rank_candidates", "SELECT s_suppkey AS k, s_nationkey AS cap_rank, s_acctbal AS score FROM supplier ORDER BY score DESC, cap_rank, k LIMIT 15")
def _(s, d):
    return L.rank_candidates(P.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("cap_rank"), F.col("s_acctbal").alias("score")), 15)


_MISS = f"{RETURNS}, fc AS (SELECT k, t, lag(ret, 20) OVER (PARTITION BY k ORDER BY t) AS predicted, ret AS actual FROM returns)"


@query("k4_largest_misses", f"WITH {_MISS} SELECT k, t, {r6('abs(predicted - actual) AS miss')} FROM fc WHERE predicted - actual IS NOT NULL ORDER BY abs(predicted - actual) DESC, k, t LIMIT 20", ("price",))
def _(s, d):
    return L.largest_misses(returns(s, d).select("k", "t", F.lag("ret", 20).over(W.by_time()).alias("predicted"), F.col("ret").alias("actual"))).select("k", "t", "miss")


@query(
    "k6_retain_snapshots",
    """WITH e AS (SELECT user_id % 20 AS k, CAST(ts AS TIMESTAMP) AS saved, event_type AS print FROM events), o AS (SELECT k, CAST(saved AS DATE) AS t, print FROM e QUALIFY row_number() OVER (PARTITION BY k, CAST(saved AS DATE) ORDER BY saved DESC, print DESC) = 1),
    n AS (SELECT * FROM o QUALIFY lag(t) OVER (PARTITION BY k ORDER BY t) IS NULL OR lag(print) OVER (PARTITION BY k ORDER BY t) <> print), a AS (SELECT *, datediff('day', t, MAX(t) OVER (PARTITION BY k)) > 15 AS old FROM n),
    b AS (SELECT *, row_number() OVER (PARTITION BY k, old ORDER BY t DESC) AS place, row_number() OVER (PARTITION BY k, old, date_trunc('month', t) ORDER BY t DESC) AS im FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY k, old ORDER BY t DESC) AS mp FROM b WHERE NOT old OR im = 1)
    SELECT k, t, print FROM c WHERE (NOT old AND place <= 7) OR (old AND mp <= 60)""",
)
def _(s, d):
    return L.retain_snapshots(P.table(s, d, "events").select((F.col("user_id") % 20).alias("k"), F.col("ts").cast("timestamp").alias("saved_at"), F.col("event_type").alias("print")), recent=7, days=15)


@query("k9_validation_batches", "WITH o AS (SELECT s_nationkey AS issuer, MIN(s_suppkey) AS code FROM supplier GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY sha256('seed|' || code), code) - 1 AS rn FROM o) SELECT rn // 6 AS batch, rn % 6 AS place, issuer, code FROM r")
def _(s, d):
    return L.validation_batches(P.table(s, d, "supplier").select(F.col("s_nationkey").alias("issuer"), F.col("s_suppkey").alias("code")), 6, "seed").withColumn("place", F.col("place").cast("long"))


@query(
    "k14_purged_holdout",
    f"""WITH {SIGNALS}, c AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM price)), f AS (SELECT MIN(i) AS f FROM c WHERE t >= DATE '1997-01-01')
    SELECT k, side, s.t, CASE WHEN c.i >= f THEN 'holdout' WHEN c.i <= f - 21 THEN 'development' ELSE 'purged' END AS role FROM signals s JOIN c USING (t), f WHERE side IS NOT NULL""",
    ("price",),
)
def _(s, d):
    return L.purged_holdout(signals(s, d).filter("side IS NOT NULL").select("k", "side", "t"), P.price(s, d), "1997-01-01", 20)


@query("k16_retention_rank", "WITH u AS (SELECT c_custkey AS k, MAX(o_orderdate) AS touched_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT k, CAST(row_number() OVER (ORDER BY touched_at NULLS FIRST, k) AS INT) AS place FROM u")
def _(s, d):
    rows = P.table(s, d, "customer").join(P.table(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("k")).agg(F.max("o_orderdate").alias("touched_at"))
    return L.retention_rank(rows).select("k", "place")
