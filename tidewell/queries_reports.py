"""Queries of reports, matches, decoded sources and text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import scalars as X
from .functions import text as T
from .operators import aggregates as A
from .operators import asof as J
from .operators import indicators as W
from .operators import matching as N
from .operators import merge as U
from .operators import models as MO
from .operators import reports as R
from .operators import sampling as K
from .plans import panels as P
from .plans.sql_panels import r6
from .queries import BY, KT, ORDER_SIGNALS, SIGNALS, U_dirty, order_signals, query, returns, signals
from .sources import landed as S

# ---- reports

_SELLS = f"""{SIGNALS}, o AS (SELECT k, market, t, side, lead(v, 5) OVER w / v - 1 AS return5, lead(v, 10) OVER w / v - 1 AS return10, lead(v, 20) OVER w / v - 1 AS return20, lead(v, 63) OVER w / v - 1 AS return63, MAX(v) OVER x / v - 1 AS favorable, MIN(v) OVER x / v - 1 AS adverse FROM signals
    WINDOW w AS (PARTITION BY k ORDER BY t), x AS (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)), sells AS (SELECT * FROM o WHERE side = 'sell')"""


def _objectives_sql(by, where=""):
    return f"""SELECT {by}, COUNT(*) AS samples, AVG((return5 < 0)::INT) AS direction5, AVG((return10 < 0)::INT) AS direction10, AVG((adverse <= -0.05)::INT) AS excursion20, AVG(-return10) AS directional10, AVG(-adverse) AS favorable20, AVG(-favorable) AS adverse20, AVG((-return20 > -0.1)::INT) AS containment20,
    AVG((return20 < 0)::INT) AS direction20, AVG((return63 < 0)::INT) AS direction63, AVG((return20 < 0 AND return63 < 0)::INT) AS persistent, AVG(-return63) AS directional63 FROM sells {where} GROUP BY 1"""


_OBJECTIVE_COLUMNS = r6(
    "direction5", "direction10", "excursion20", "directional10", "favorable20", "adverse20", "containment20", "direction20", "direction63", "persistent", "directional63", "CASE WHEN adverse20 < 0 THEN favorable20 / abs(adverse20) END AS ratio20",
    "list_avg(list_filter([direction5, direction10, excursion20], lambda x: x IS NOT NULL)) AS short_correction", "list_avg(list_filter([direction20, direction63, persistent], lambda x: x IS NOT NULL)) AS medium_reversal",
)


def _sells(s, d):
    return W.forward_outcomes(signals(s, d)).filter("side = 'sell'")


@query("a7_sell_objectives", f"WITH {_SELLS}, g AS ({_objectives_sql('market')}) SELECT market, samples, {_OBJECTIVE_COLUMNS} FROM g", ("price",))
def _(s, d):
    return R.summarize_sell_objectives(_sells(s, d), ["market"])


@query(
    "a40_compare_objectives",
    f"WITH {_SELLS}, a AS ({_objectives_sql('market', 'WHERE year(t) < 1998')}), b AS ({_objectives_sql('market', 'WHERE year(t) >= 1998')}), x AS (SELECT market, samples, {_OBJECTIVE_COLUMNS} FROM a), y AS (SELECT market, samples, {_OBJECTIVE_COLUMNS} FROM b) SELECT market, x.samples AS samples_before, y.samples AS samples_after, {r6('y.short_correction - x.short_correction AS short_delta', 'y.medium_reversal - x.medium_reversal AS medium_delta')} FROM x JOIN y USING (market)",
    ("price",),
)
def _(s, d):
    rows = _sells(s, d)
    x, y = (R.summarize_sell_objectives(rows.filter(f"year(t) {c} 1998"), ["market"]).select("market", F.col("samples").alias(f"samples_{n}"), F.round(F.col("short_correction") + 2.3e-10, 6).alias(f"s{n}"), F.round(F.col("medium_reversal") + 2.3e-10, 6).alias(f"m{n}")) for c, n in (("<", "before"), (">=", "after")))
    return x.join(y, "market").select("market", "samples_before", "samples_after", (F.col("safter") - F.col("sbefore")).alias("short_delta"), (F.col("mafter") - F.col("mbefore")).alias("medium_delta"))


_PAIRS = """pairs AS (SELECT h AS horizon, k, t, market, year(t) AS year, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS grp, ret AS actual, prior AS before, prior * 0.5 AS after FROM (
    SELECT 5 AS h, k, t, market, lead(v, 5) OVER w / v - 1 AS ret, v / lag(v, 5) OVER w - 1 AS prior FROM price WINDOW w AS (PARTITION BY k ORDER BY t) UNION ALL SELECT 20, k, t, market, lead(v, 20) OVER w / v - 1, v / lag(v, 20) OVER w - 1 FROM price WINDOW w AS (PARTITION BY k ORDER BY t)
    UNION ALL SELECT 63, k, t, market, lead(v, 63) OVER w / v - 1, v / lag(v, 63) OVER w - 1 FROM price WINDOW w AS (PARTITION BY k ORDER BY t)) WHERE ret IS NOT NULL AND prior IS NOT NULL)"""


def _pairs(s, d):
    price, w = P.price(s, d), W.by_time()
    each = [F.struct(F.lit(h).alias("horizon"), (F.lead("v", h).over(w) / F.col("v") - 1).alias("actual"), (F.col("v") / F.lag("v", h).over(w) - 1).alias("before")) for h in (5, 20, 63)]
    rows = price.select("k", "t", "market", F.year("t").alias("year"), F.when(F.col("k") % 2 == 0, "a").otherwise("b").alias("grp"), F.array(*each).alias("x")).select("*", F.explode("x").alias("e"))
    return rows.select("e.horizon", "k", "t", "market", "year", "grp", "e.actual", "e.before", (F.col("e.before") * 0.5).alias("after")).filter("actual IS NOT NULL AND before IS NOT NULL")


_COMPARED = f"{_PAIRS}, seg AS (SELECT horizon, unnest(['market', 'year', 'grp']) AS family, unnest([CAST(market AS VARCHAR), CAST(year AS VARCHAR), grp]) AS segment, abs(before - actual) AS b, abs(after - actual) AS a FROM pairs), cmp AS (SELECT family, segment, horizon, COUNT(*) AS n, AVG(b) AS mae_before, AVG(a) AS mae_after, AVG(a) - AVG(b) AS delta FROM seg GROUP BY 1, 2, 3)"


@query("a10_compare_reports", f"WITH {_COMPARED} SELECT family, segment, horizon, n, {r6('mae_before', 'mae_after', 'delta')} FROM cmp", ("price",))
def _(s, d):
    return R.compare_reports(_pairs(s, d), ["market", "year", "grp"])


@query("q17_comparison_gate", f"WITH {_COMPARED}, w AS (SELECT family, segment, horizon, n, -delta / mae_before AS worse FROM cmp) SELECT family, segment, horizon, {r6('worse')}, CASE WHEN worse > 0.3 THEN 'failure' ELSE 'warning' END AS level FROM w WHERE n >= 50 AND worse > 0.15", ("price",))
def _(s, d):
    # The damped forecasts stand for the current ones here, so that some segments get worse.
    swapped = _pairs(s, d).select("horizon", "k", "t", "market", "year", "grp", "actual", F.col("after").alias("before"), F.col("before").alias("after"))
    report = R.compare_reports(swapped, ["market", "year", "grp"]).withColumn("mae_before", F.col("mae_after"))
    return R.comparison_gate(report, 50, 0.3)


@query(
    "q18_challenger_gate",
    f"""WITH {_PAIRS}, g AS (SELECT grp, horizon, COUNT(*) AS n, AVG(abs(before - actual)) AS b, AVG(abs(after - actual)) AS a FROM pairs GROUP BY 1, 2), x AS (SELECT grp, SUM((a < b)::INT) AS better, MAX((a > b * 1.05)::INT) AS much, MIN(n) AS least, COUNT(*) AS h FROM g GROUP BY 1),
    y AS (SELECT grp, better, list_filter([CASE WHEN least < 100 THEN 'samples' END, CASE WHEN h < 3 THEN 'horizons' END, CASE WHEN better < 2 THEN 'improvement' END, CASE WHEN much > 0 THEN 'regression' END], lambda z: z IS NOT NULL) AS r FROM x) SELECT grp, CAST(better AS BIGINT) AS better, array_to_string(r, ',') AS reasons, len(r) = 0 AS passed FROM y""",
    ("price",),
)
def _(s, d):
    e = lambda c: F.avg(F.abs(F.col(c) - F.col("actual")))
    return R.challenger_gate(_pairs(s, d).groupBy("grp", "horizon").agg(F.count("*").alias("n"), e("before").alias("mae_before"), e("after").alias("mae_after")), 100)


@query(
    "a13_rebase_signal",
    f"""WITH e AS (SELECT k, t, v FROM price WHERE t < DATE '1996-01-01'), n AS (SELECT k, t, v * CASE WHEN k % 3 = 0 THEN 2 WHEN k % 3 = 1 AND t >= DATE '1996-01-01' THEN 3 ELSE 1 END AS v FROM price WHERE t >= DATE '1995-06-01'),
    o AS (SELECT k, n.t, greatest(e.v, n.v) / least(e.v, n.v) AS r FROM n JOIN e USING (k, t)), a AS (SELECT k, MIN(t) AS t, arg_min(r, t) AS ratio FROM o WHERE r >= 1.8 GROUP BY 1), l AS (SELECT k, MAX(t) AS l, arg_max(v, t) AS v FROM e GROUP BY 1),
    f AS (SELECT n.k, MIN(n.t) AS t, arg_min(n.v, n.t) AS v, MIN(l.l) AS l, MIN(l.v) AS old FROM n JOIN l ON l.k = n.k AND n.t > l.l GROUP BY 1), b AS (SELECT k, t, greatest(v, old) / least(v, old) AS ratio FROM f WHERE datediff('day', l, t) <= 14)
    SELECT k, t, {r6('ratio')}, 'overlap' AS kind FROM a UNION ALL SELECT k, t, {r6('ratio')}, 'boundary' FROM b WHERE ratio >= 1.8 AND k NOT IN (SELECT k FROM a)""",
    ("price",),
)
def _(s, d):
    price = KT(P.price(s, d))
    factor = F.when(F.col("k") % 3 == 0, 2).when((F.col("k") % 3 == 1) & (F.col("t") >= "1996-01-01"), 3).otherwise(1)
    return R.find_rebase_signal(price.filter("t < '1996-01-01'"), price.filter("t >= '1995-06-01'").withColumn("v", F.col("v") * factor))


@query(
    "a21_ticker_changes",
    f"""WITH {SIGNALS}, {ORDER_SIGNALS}, a AS (SELECT k, side, t FROM signals WHERE side IS NOT NULL), b AS (SELECT k, side, t FROM order_signals WHERE side IS NOT NULL),
    c AS (SELECT *, 'added' AS c FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.side = a.side AND abs(datediff('day', b.t, a.t)) <= 5) UNION ALL SELECT *, 'removed' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.k = a.k AND b.side = a.side AND abs(datediff('day', b.t, a.t)) <= 5))
    SELECT k, side, COUNT(*) FILTER (c = 'added') AS added, COUNT(*) FILTER (c = 'removed') AS removed, coalesce(string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) FILTER (c = 'added'), '') AS added_dates, coalesce(string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) FILTER (c = 'removed'), '') AS removed_dates FROM c GROUP BY 1, 2""",
    ("price", "orders_panel"),
)
def _(s, d):
    return R.ticker_changes(signals(s, d).filter("side IS NOT NULL"), order_signals(s, d).filter("side IS NOT NULL"))


@query(
    "a24_consensus",
    f"""WITH r AS (SELECT user_id % 25 AS k, user_id % 4 AS broker, ts AS t, event_id AS id, value + 10 AS target, lag(value + 10) OVER (PARTITION BY user_id % 25, user_id % 4 ORDER BY ts, event_id) AS prior FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 25, user_id % 4 ORDER BY ts DESC, event_id DESC) <= 5),
    m AS (SELECT k, quantile_cont(target, 0.5) AS median FROM r GROUP BY 1), g AS (SELECT k, COUNT(*) AS n, MAX(median) AS median, quantile_cont(abs(target - median), 0.5) / MAX(median) AS deviation, AVG(sign(target - prior)) AS breadth FROM r JOIN m USING (k) GROUP BY 1)
    SELECT k, n, {r6('median', 'deviation', 'breadth', 'greatest(least(1 - deviation, 1), 0) * n / (n + 4) AS confidence')} FROM g""",
)
def _(s, d):
    rows = P.table(s, d, "events").select((F.col("user_id") % 25).alias("k"), (F.col("user_id") % 4).alias("broker"), F.col("ts").alias("t"), F.col("event_id").alias("id"), (F.col("value") + 10).alias("target"))
    return R.consensus(rows.withColumn("prior", F.lag("target").over(Window.partitionBy("k", "broker").orderBy("t", "id"))))


_PARTS = "parts AS (SELECT k, t, lead(v, 20) OVER w / v - 1 AS actual, 0.1 * (v / lag(v, 5) OVER w - 1) AS short, -0.2 * (v / lag(v, 20) OVER w - 1) AS medium, 0.05 * (v / lag(v, 60) OVER w - 1) AS long FROM price WINDOW w AS (PARTITION BY k ORDER BY t))"


@query(
    "a27_ablation",
    f"""WITH {_PARTS}, p AS (SELECT actual, coalesce(short, 0) AS s, coalesce(medium, 0) AS m, coalesce(long, 0) AS l FROM parts WHERE actual IS NOT NULL), o AS (SELECT AVG(abs(s + m + l - actual)) AS mae, AVG(abs(m + l - actual) - abs(s + m + l - actual)) AS a, AVG(abs(s + l - actual) - abs(s + m + l - actual)) AS b, AVG(abs(s + m - actual) - abs(s + m + l - actual)) AS c FROM p)
    SELECT {r6('mae')}, unnest(['short', 'medium', 'long']) AS family, unnest([ROUND(a + 2.3e-10, 6) + 0.0, ROUND(b + 2.3e-10, 6) + 0.0, ROUND(c + 2.3e-10, 6) + 0.0]) AS impact FROM o""",
    ("price",),
)
def _(s, d):
    w = W.by_time()
    part = lambda n, f: (f * (F.col("v") / F.lag("v", n).over(w) - 1))
    rows = P.price(s, d).select((F.lead("v", 20).over(w) / F.col("v") - 1).alias("actual"), part(5, 0.1).alias("short"), part(20, -0.2).alias("medium"), part(60, 0.05).alias("long"))
    return R.ablation(rows, ["short", "medium", "long"])


@query(
    "a28_run_trend",
    f"WITH r AS (SELECT user_id % 15 AS k, event_type <> 'error' AS ok, value AS seconds, user_id % 3 AS retries FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 15 ORDER BY ts DESC, event_id DESC) <= 10) SELECT k, COUNT(*) AS runs, {r6('AVG(ok::INT) AS healthy', 'quantile_cont(seconds, 0.5) AS median_seconds')}, CAST(SUM(retries) AS BIGINT) AS retries FROM r GROUP BY 1",
)
def _(s, d):
    e = P.table(s, d, "events")
    return R.run_trend(e.select((F.col("user_id") % 15).alias("k"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds"), (F.col("user_id") % 3).alias("retries")))


@query("a29_journal_quality", f"WITH {_PAIRS}, g AS (SELECT horizon, COUNT(*) AS n, AVG(abs(after - actual)) AS mae, 1 - AVG(abs(after - actual)) / AVG(abs(actual)) AS skill FROM pairs GROUP BY 1) SELECT horizon, n, {r6('mae', 'skill')}, CASE WHEN n < 8 THEN 'collecting' WHEN skill > 0 THEN 'usable' ELSE 'weak' END AS status FROM g", ("price",))
def _(s, d):
    return R.journal_quality(_pairs(s, d).withColumn("predicted", F.col("after")))


@query("a30_environment_coverage", f"WITH x AS (SELECT p.k, p.t, [p.v / 1500 - 1, o.v / 150 - 1, m.v / 150 - 1] AS l FROM price p LEFT JOIN orders_panel o USING (k, t) LEFT JOIN macro m USING (t)), y AS (SELECT k, t, list_filter(l, lambda z: z IS NOT NULL) AS l FROM x) SELECT k, t, len(l) AS available, {r6('list_avg(l) AS level')} FROM y", ("price", "orders_panel", "macro"))
def _(s, d):
    rows = P.price(s, d).join(P.orders_panel(s, d).withColumnRenamed("v", "o"), ["k", "t"], "left").join(P.macro(s, d).withColumnRenamed("v", "m"), "t", "left")
    levels = [F.col("v") / 1500 - 1, F.col("o") / 150 - 1, F.col("m") / 150 - 1]
    return rows.select("k", "t", F.size(F.array_compact(F.array(*levels))).cast("long").alias("available"), R.mean_of(*levels).alias("level"))


_SAMPLES = f"{_PAIRS}, samples AS (SELECT k AS grp, after - actual AS error, 1 + year % 3 AS weight, actual, sign(after) = sign(actual) AS direction, abs(after - actual) < 0.3 AS covered FROM pairs WHERE horizon = 20)"


def _samples(s, d):
    p = _pairs(s, d).filter("horizon = 20")
    return p.select(F.col("k").alias("grp"), (F.col("after") - F.col("actual")).alias("error"), (1 + F.col("year") % 3).alias("weight"), "actual", (F.signum("after") == F.signum("actual")).alias("direction"), (F.abs(F.col("after") - F.col("actual")) < 0.3).alias("covered"))


_ROBUST = f"""{_SAMPLES}, c AS (SELECT grp, quantile_cont(error, 0.5) AS center, COUNT(*) AS al FROM samples GROUP BY 1), o AS (SELECT s.*, center, al, abs(error - center) AS off FROM samples s JOIN c USING (grp)), m AS (SELECT grp, greatest(quantile_cont(off, 0.5) * 3.5, 0.025) AS tol FROM o GROUP BY 1),
    i AS (SELECT o.*, off <= tol AS inside, SUM((off <= tol)::INT) OVER (PARTITION BY grp) >= ceil(al * 0.6) AS enough FROM o JOIN m USING (grp)), g AS (SELECT grp, COUNT(*) AS n, MIN(center) AS center, SUM(error * weight) / SUM(weight) AS mean, SUM(weight) ** 2 / SUM(weight * weight) AS effective, SUM(direction::INT * weight) / SUM(weight) AS accuracy, SUM(covered::INT * weight) / SUM(weight) AS coverage, SUM(abs(error) * weight) / SUM(weight) AS mae, SUM(abs(actual) * weight) / SUM(weight) AS nc FROM i WHERE inside OR NOT enough GROUP BY 1),
    h AS (SELECT *, CASE WHEN nc > 1e-6 THEN 1 - mae / nc ELSE 0 END AS skill, effective / (effective + 12) AS rel, mean * 0.65 + center * 0.35 AS raw_bias FROM g), q AS (SELECT *, greatest(least(1 - (greatest(0, -skill) * 0.75 + greatest(0, 0.5 - accuracy) * 1.2) * rel, 1), 0.55) AS confidence FROM h),
    robust AS (SELECT grp, n, raw_bias, effective, accuracy, skill, confidence, greatest(least(CASE WHEN effective >= 3.5 AND accuracy >= 0.45 AND skill > -0.15 THEN raw_bias * rel * greatest(least((accuracy - 0.35) / 0.25, 1), 0) * greatest(least((skill + 0.15) / 0.3, 1), 0.1) ELSE 0 END, 0.1), -0.1) AS correction,
    greatest(least((1 + greatest(0, 0.68 - coverage) * 1.4 * rel) * (1 + (1 - confidence) * 0.6), 1.9), 1) AS interval_scale FROM q)"""


@query("a33_robust_bias", f"WITH {_ROBUST} SELECT grp, n, {r6('raw_bias', 'effective', 'accuracy', 'skill', 'confidence', 'correction', 'interval_scale')} FROM robust", ("price",))
def _(s, d):
    return R.robust_bias(_samples(s, d))


_MOMENTUM = f"""{_PAIRS}, samples AS (SELECT k * 1000 + horizon AS grp, horizon, after - actual AS error, 1 + year % 3 AS weight, actual, sign(after) = sign(actual) AS direction, abs(after - actual) < 0.3 AS covered, CASE WHEN k % 5 <> 0 AND year % 2 = 0 THEN abs(before - actual) END AS momentum_error FROM pairs),
    c AS (SELECT grp, quantile_cont(error, 0.5) AS center, COUNT(*) AS al FROM samples GROUP BY 1), o AS (SELECT s.*, center, al, abs(error - center) AS off FROM samples s JOIN c USING (grp)), m AS (SELECT grp, greatest(quantile_cont(off, 0.5) * 3.5, 0.025) AS tol FROM o GROUP BY 1), i AS (SELECT o.*, off <= tol AS inside, SUM((off <= tol)::INT) OVER (PARTITION BY grp) >= ceil(al * 0.6) AS enough FROM o JOIN m USING (grp)),
    g AS (SELECT grp, MAX(horizon) AS horizon, COUNT(*) AS n, MIN(center) AS center, SUM(error * weight) / SUM(weight) AS mean, SUM(weight) ** 2 / SUM(weight * weight) AS effective, SUM(direction::INT * weight) / SUM(weight) AS accuracy, SUM(covered::INT * weight) / SUM(weight) AS coverage, SUM(abs(error) * weight) / SUM(weight) AS mae, SUM(abs(actual) * weight) / SUM(weight) AS nc, SUM(momentum_error * weight) / SUM(weight) FILTER (momentum_error IS NOT NULL) AS mo FROM i WHERE inside OR NOT enough GROUP BY 1),
    h AS (SELECT *, CASE WHEN nc > 1e-6 THEN 1 - mae / nc ELSE 0 END AS skill, CASE WHEN mo > 1e-6 THEN 1 - mae / mo ELSE 0 END AS momentum_skill, effective / (effective + 12) AS rel, mean * 0.65 + center * 0.35 AS raw_bias, CASE horizon WHEN 5 THEN 0.025 WHEN 20 THEN 0.06 ELSE 0.1 END AS cap FROM g),
    q AS (SELECT *, greatest(least(1 - (greatest(0, -skill) * 0.75 + CASE WHEN mo IS NULL THEN 0 ELSE greatest(0, -momentum_skill) * 0.75 END + greatest(0, 0.5 - accuracy) * 1.2) * rel, 1), 0.55) AS confidence, effective >= 3.5 AND accuracy >= 0.45 AND skill > -0.15 AND (mo IS NULL OR momentum_skill > -0.15) AS eligible FROM h)
    SELECT grp, n, eligible, {r6('raw_bias', 'effective', 'accuracy', 'skill', 'momentum_skill', 'confidence', 'greatest(least(CASE WHEN eligible THEN raw_bias * rel * greatest(least((accuracy - 0.35) / 0.25, 1), 0) * least(greatest(least((skill + 0.15) / 0.3, 1), 0.1), CASE WHEN mo IS NULL THEN 1 ELSE greatest(least((momentum_skill + 0.15) / 0.3, 1), 0.1) END) ELSE 0 END, cap), -cap) AS correction', 'greatest(least((1 + greatest(0, 0.68 - coverage) * 1.4 * rel) * (1 + (1 - confidence) * 0.6), 1.9), 1) AS interval_scale')} FROM q"""


@query("a33_bias_against_momentum", f"WITH {_MOMENTUM}", ("price",))
def _(s, d):
    p = _pairs(s, d)
    momentum = F.when((F.col("k") % 5 != 0) & (F.col("year") % 2 == 0), F.abs(F.col("before") - F.col("actual")))
    rows = p.select((F.col("k") * 1000 + F.col("horizon")).alias("grp"), "horizon", (F.col("after") - F.col("actual")).alias("error"), (1 + F.col("year") % 3).alias("weight"), "actual", (F.signum("after") == F.signum("actual")).alias("direction"), (F.abs(F.col("after") - F.col("actual")) < 0.3).alias("covered"), momentum.alias("momentum_error"))
    return R.robust_bias(rows)


@query("m26_apply_calibration", f"WITH {_ROBUST} SELECT k, t, {r6('p.after - r.correction AS predicted', 'p.after - r.correction - 0.2 * interval_scale AS low', 'p.after - r.correction + 0.2 * interval_scale AS high')} FROM pairs p JOIN robust r ON r.grp = p.k WHERE horizon = 20", ("price",))
def _(s, d):
    b = R.robust_bias(_samples(s, d)).withColumnRenamed("grp", "series")
    rows = _pairs(s, d).filter("horizon = 20").join(b, F.col("k") == F.col("series"))
    middle = F.col("after") - F.col("correction")
    return rows.select("k", "t", middle.alias("predicted"), (middle - 0.2 * F.col("interval_scale")).alias("low"), (middle + 0.2 * F.col("interval_scale")).alias("high"))


_SCEN = f"""{_PAIRS}, sc AS (SELECT k AS grp, 1 + year % 3 AS weight, CASE WHEN ln(1 + actual) > 0.12 THEN 'upside' WHEN ln(1 + actual) < -0.12 THEN 'downside' ELSE 'sideways' END AS scenario, CASE WHEN after > 0 THEN 0.2 ELSE 0.5 END AS d, 0.3 AS m, CASE WHEN after > 0 THEN 0.5 ELSE 0.2 END AS u FROM pairs WHERE horizon = 63)"""
_ADJ = lambda key, p: f"CASE WHEN n >= 6 THEN greatest(least(ln(((o{p} + 1.5) / (w + 4.5)) / greatest((p{p} + 1.5) / (w + 4.5), 1e-6)) * n / (n + 18), 0.45), -0.45) ELSE 0 END AS adjust_{key}"


@query(
    "a34_probability_calibration",
    f"""WITH {_SCEN}, f AS (SELECT *, (scenario = 'downside')::INT AS id, (scenario = 'sideways')::INT AS im, (scenario = 'upside')::INT AS iu FROM sc), g AS (SELECT grp, COUNT(*) AS n, SUM(weight) AS w, SUM(((d - id) ** 2 + (m - im) ** 2 + (u - iu) ** 2) / 3 * weight) AS br, SUM(id * weight) AS od, SUM(im * weight) AS om, SUM(iu * weight) AS ou, SUM(d * weight) AS pd, SUM(m * weight) AS pm, SUM(u * weight) AS pu FROM f GROUP BY 1)
    SELECT grp, n, {r6(_ADJ('downside', 'd'), _ADJ('sideways', 'm'), _ADJ('upside', 'u'), 'br / w AS brier', 'CASE WHEN n >= 6 THEN greatest(least(1 - greatest(0, (br / w - 2.0 / 9) / (2.0 / 9)) * n / (n + 18), 1), 0.5) ELSE 1 END AS confidence')} FROM g""",
    ("price",),
)
def _(s, d):
    up = F.col("after") > 0
    rows = _pairs(s, d).filter("horizon = 63").select(
        F.col("k").alias("grp"), (1 + F.col("year") % 3).alias("weight"), R.realized_scenario(F.log1p("actual"), F.lit(0.08), 63).alias("scenario"), F.when(up, 0.2).otherwise(0.5).alias("p_downside"), F.lit(0.3).alias("p_sideways"), F.when(up, 0.5).otherwise(0.2).alias("p_upside")
    )
    return R.probability_calibration(rows)


@query("a37_tag_coverage", "SELECT tag, COUNT(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_type, ' '))) AS tag FROM part) GROUP BY 1")
def _(s, d):
    return P.table(s, d, "part").select(F.explode(F.array_distinct(F.split("p_type", " "))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(
    "a38_pit_audit",
    """WITH o AS (SELECT CAST(l_shipdate AS DATE) AS c, CAST(l_shipdate AS DATE) + INTERVAL (l_linenumber - 2) DAY AS target, CAST(l_shipdate AS DATE) + INTERVAL (l_linenumber % 2) DAY AS a, [CAST(l_shipdate AS DATE) - INTERVAL 3 DAY, CAST(l_shipdate AS DATE) + INTERVAL (l_linenumber - 6) DAY] AS src, l_quantity - 2 AS base, l_extendedprice AS p FROM lineitem),
    g AS (SELECT COUNT(*) FILTER (target <= c) AS x, COUNT(*) FILTER (a <> c) AS y, CAST(SUM(len(list_filter(src, lambda z: z > c))) AS BIGINT) AS z, COUNT(*) FILTER (NOT (base > 0 AND p > 0)) AS q FROM o), u AS (SELECT unnest(['target-not-after-cutoff', 'audit-as-of-mismatch', 'audit-price-as-of-mismatch', 'future-source-date', 'invalid-price']) AS kind, unnest([x, y, y, z, q]) AS n FROM g) SELECT kind, n FROM u WHERE n > 0""",
)
def _(s, d):
    c = F.to_date("l_shipdate")
    sources = F.create_map(F.lit("price"), F.date_sub(c, 3), F.lit("news"), F.date_add(c, F.col("l_linenumber").cast("int") - 6))
    return R.pit_audit(P.table(s, d, "lineitem").select(c.alias("cutoff"), F.date_add(c, F.col("l_linenumber").cast("int") - 2).alias("target"), F.date_add(c, (F.col("l_linenumber") % 2).cast("int")).alias("as_of"), F.lit(None).cast("date").alias("price_as_of"), sources.alias("sources"), (F.col("l_quantity") - 2).alias("base"), F.col("l_extendedprice").alias("predicted")))


@query("a39_outcomes_by_mode", f"WITH {_SELLS} SELECT side, mode, COUNT(*) AS n, {r6('AVG(r) AS mean', 'AVG((r > 0)::INT) AS hit_rate')} FROM (SELECT side, CASE WHEN abs(v1) > 0.1 THEN 'immediate' ELSE 'confirmed' END AS mode, return20 AS r FROM (SELECT o.*, s.v / lag(s.v) OVER (PARTITION BY s.k ORDER BY s.t) - 1 AS v1 FROM o JOIN signals s ON s.k = o.k AND s.t = o.t)) WHERE side IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2", ("price",))
def _(s, d):
    move = F.col("v") / F.lag("v").over(W.by_time()) - 1
    rows = W.forward_outcomes(signals(s, d)).withColumn("mode", F.when(F.abs(move) > 0.1, "immediate").otherwise("confirmed")).filter("side IS NOT NULL AND return20 IS NOT NULL")
    return rows.groupBy("side", "mode").agg(F.count("*").alias("n"), F.avg("return20").alias("mean"), F.avg((F.col("return20") > 0).cast("double")).alias("hit_rate"))


@query("a41_quality_diagnostic", f"WITH {_ROBUST}, x AS (SELECT grp, least(confidence, coalesce(least(accuracy * 1.9, 1), 1)) AS scale FROM robust) SELECT grp, {r6('scale')}, CASE WHEN scale >= 0.9 THEN 'healthy' WHEN scale >= 0.7 THEN 'reduced' ELSE 'weak' END AS status FROM x", ("price",))
def _(s, d):
    return R.quality_diagnostic(R.robust_bias(_samples(s, d)).select("grp", "confidence", F.least(F.col("accuracy") * 1.9, F.lit(1.0)).alias("by_accuracy")))


@query("a5_wilson_interval", f"WITH g AS (SELECT l_returnflag AS flag, SUM((l_quantity > 25)::INT) AS h, COUNT(*) AS n FROM lineitem GROUP BY 1) SELECT flag, CAST(h AS BIGINT) AS hits, n, {r6('(h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n) AS low')} FROM g")
def _(s, d):
    g = P.table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum((F.col("l_quantity") > 25).cast("int")).alias("hits"), F.count("*").alias("n"))
    return g.withColumn("low", A.wilson_low(F.col("hits"), F.col("n")))


@query(
    "a25_event_evaluation",
    f"""WITH e AS (SELECT CAST(ts AS DATE) AS t0, user_id % 25 AS k, event_type AS grp, value / 100 - 0.5 AS signal FROM events), f AS (SELECT k, CAST(t0 - INTERVAL 9000 DAY AS DATE) AS t, grp, signal FROM e WHERE abs(signal) >= 0.05), a AS (SELECT k, t, lead(v, 10) OVER (PARTITION BY k ORDER BY t) / v - 1 AS v FROM price),
    j AS (SELECT f.*, CASE WHEN datediff('day', f.t, a.t) <= 14 THEN a.v END AS r FROM f ASOF LEFT JOIN a ON a.k = f.k AND f.t <= a.t) SELECT grp, COUNT(*) AS n, {r6('AVG((sign(signal) = sign(r))::INT) AS accuracy')} FROM j WHERE r IS NOT NULL GROUP BY 1""",
    ("price",),
)
def _(s, d):
    rows = P.table(s, d, "events").select((F.col("user_id") % 25).alias("k"), F.date_sub(F.to_date("ts"), 9000).alias("t"), F.col("event_type").alias("grp"), (F.col("value") / 100 - 0.5).alias("signal"))
    return A.evaluate_events(rows, P.price(s, d), 10)


@query("a26_feature_diagnostics", f"WITH {_PARTS}, u AS (SELECT unnest(['short', 'medium', 'long']) AS feature, unnest([short, medium, long]) AS x, actual AS y FROM parts) SELECT feature, COUNT(*) AS n, {r6('corr(x, y) AS corr', 'AVG(y) FILTER (x > 0) AS mean_active', 'AVG(y) FILTER (x <= 0) AS mean_inactive')} FROM u WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1", ("price",))
def _(s, d):
    w = W.by_time()
    part = lambda n, f: (f * (F.col("v") / F.lag("v", n).over(w) - 1))
    m = F.create_map(F.lit("short"), part(5, 0.1), F.lit("medium"), part(20, -0.2), F.lit("long"), part(60, 0.05))
    return A.feature_diagnostics(P.price(s, d).select(m.alias("features"), (F.lead("v", 20).over(w) / F.col("v") - 1).alias("y")))


# ---- validation

_CAND = "cand AS (SELECT k, t, CASE WHEN k % 4 = 1 AND datediff('day', DATE '1990-01-01', t) % 97 = 0 THEN v * 40 ELSE v END AS v FROM price WHERE k % 4 <> 2 AND NOT (k % 4 = 3 AND t > DATE '1997-01-01') UNION ALL SELECT k, t, v + 1 FROM price WHERE k % 8 = 0 AND datediff('day', DATE '1990-01-01', t) % 50 = 0)"


def _candidate(s, d):
    price = KT(P.price(s, d))
    day = F.datediff("t", F.lit("1990-01-01"))
    spiked = price.filter("k % 4 <> 2 AND NOT (k % 4 = 3 AND t > '1997-01-01')").withColumn("v", F.when((F.col("k") % 4 == 1) & (day % 97 == 0), F.col("v") * 40).otherwise(F.col("v")))
    return price, spiked.unionByName(price.filter((F.col("k") % 8 == 0) & (day % 50 == 0)).withColumn("v", F.col("v") + 1))


@query(
    "q7_validate_candidate",
    f"""WITH {_CAND}, c AS (SELECT k, MAX(t) AS was, COUNT(*) AS had FROM price GROUP BY 1), dup AS (SELECT k, t, MIN(v) AS lo, MAX(v) AS hi FROM cand GROUP BY 1, 2), o AS (SELECT k, SUM((lo <> hi)::INT) AS cf, SUM((lo < 100 OR hi > 20000)::INT) AS os, MAX(t) AS now, COUNT(*) AS has FROM dup GROUP BY 1),
    j1 AS (SELECT k, t FROM (SELECT k, t, hi AS v FROM dup) QUALIFY abs(ln(v / lag(v) OVER (PARTITION BY k ORDER BY t))) > 1.5), j0 AS (SELECT k, t FROM price QUALIFY abs(ln(v / lag(v) OVER (PARTITION BY k ORDER BY t))) > 1.5), nj AS (SELECT k, COUNT(*) AS j FROM (SELECT * FROM j1 EXCEPT SELECT * FROM j0) GROUP BY 1),
    x AS (SELECT coalesce(c.k, o.k) AS k, CASE WHEN now IS NULL THEN 'lost' WHEN cf > 0 THEN 'duplicate-conflict' WHEN os > 0 THEN 'out-of-range' WHEN coalesce(j, 0) > 0 THEN 'introduced-jump' WHEN now < was THEN 'latest-regressed' WHEN has < had * 0.8 THEN 'coverage-regressed' END AS problem FROM c FULL JOIN o ON o.k = c.k LEFT JOIN nj ON nj.k = o.k) SELECT k, problem FROM x WHERE problem IS NOT NULL""",
    ("price",),
)
def _(s, d):
    return R.validate_candidate(*_candidate(s, d), 100.0, 20000.0)


@query(
    "q8_repair_candidate",
    f"WITH {_CAND}, dup AS (SELECT k, t, MIN(v) AS lo, MAX(v) AS hi FROM cand GROUP BY 1, 2), f AS (SELECT dup.k, dup.t, CASE WHEN lo = hi AND lo BETWEEN 100 AND 20000 THEN lo ELSE p.v END AS v FROM dup LEFT JOIN price p ON p.k = dup.k AND p.t = dup.t UNION ALL SELECT k, t, v FROM price WHERE k NOT IN (SELECT k FROM cand)) SELECT k, t, {r6('v')} FROM f WHERE v IS NOT NULL",
    ("price",),
)
def _(s, d):
    return R.repair_candidate(*_candidate(s, d), 100.0, 20000.0)


@query("q22_run_checks", """WITH g AS (SELECT k, COUNT(*) AS n, MAX(t) AS l, SUM((v IS NULL)::INT) AS u, COUNT(DISTINCT v) AS c FROM dirty GROUP BY 1) SELECT k, unnest(list_filter([CASE WHEN n < 540 THEN 'rows' END, CASE WHEN l < DATE '1998-11-01' THEN 'stale' END, CASE WHEN u * 20 > n THEN 'nulls' END, CASE WHEN c < 2 THEN 'flat' END], lambda x: x IS NOT NULL)) AS "check" FROM g""", ("dirty",))
def _(s, d):
    return R.run_checks(U_dirty(s, d), 540, "1998-11-01")


# ---- matches


@query("u11_merge_index_records", f"SELECT k, t, {r6('arg_max(v, q) AS v')} FROM (SELECT k, t, v, 0 AS q FROM price UNION ALL SELECT k, t, v * 10, 1 FROM orders_panel) GROUP BY 1, 2", ("price", "orders_panel"))
def _(s, d):
    return N.merge_index_records(KT(P.price(s, d)).withColumn("seq", F.lit(0)), P.orders_panel(s, d).withColumn("v", F.col("v") * 10).withColumn("seq", F.lit(1)))


@query("u13_merge_history", f"WITH m AS (SELECT k, t, arg_max(v, p) AS v FROM (SELECT k, t, v, 0 AS p FROM dirty UNION ALL SELECT k, t, v, 1 FROM orders_panel) WHERE v > 0 GROUP BY 1, 2) SELECT k, t, {r6('v')} FROM m QUALIFY t >= MAX(t) OVER (PARTITION BY k) - INTERVAL 36 MONTH", ("dirty", "orders_panel"))
def _(s, d):
    return N.merge_history(KT(U_dirty(s, d)), P.orders_panel(s, d), 3)


@query("u14_preferred_history", "WITH a AS (SELECT k, MAX(t) AS t, COUNT(*) AS n FROM price WHERE k % 5 <> 0 GROUP BY 1), b AS (SELECT k, MAX(t) AS t, COUNT(*) AS n FROM price WHERE k % 3 <> 0 AND (k % 2 = 0 OR t > DATE '1997-01-01') GROUP BY 1), c AS (SELECT k, MAX(t) AS t, COUNT(*) AS n FROM price WHERE k % 5 <> 0 AND t < DATE '1998-06-01' GROUP BY 1) SELECT coalesce(c.k, b.k) AS k, CASE WHEN c.t IS NULL THEN 'second' WHEN b.t IS NULL THEN 'first' WHEN b.t > c.t AND b.n >= floor(c.n * 0.8) THEN 'second' ELSE 'first' END AS used FROM c FULL JOIN b ON b.k = c.k", ("price",))
def _(s, d):
    price = P.price(s, d)
    return N.select_preferred_history(price.filter("k % 5 <> 0 AND t < '1998-06-01'"), price.filter("k % 3 <> 0 AND (k % 2 = 0 OR t > '1997-01-01')"))


_FINREC = "fr AS (SELECT c_nationkey AS k, CASE WHEN o_orderpriority < '3' THEN 'q' ELSE 'a' END AS freq, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, SUM(o_totalprice) / 1e6 AS revenue, CASE WHEN COUNT(*) % 3 = 0 THEN NULL ELSE AVG(o_totalprice) / 1e6 END AS income, COUNT(*) % 2 = 0 AS estimate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"


@query("u18_merge_financials", f"WITH {_FINREC}, a AS (SELECT * FROM fr WHERE period < DATE '1996-01-01'), b AS (SELECT k, freq, period, CASE WHEN estimate THEN NULL ELSE revenue * 1.1 END AS revenue, income * 0.9 AS income, false AS estimate FROM fr WHERE period >= DATE '1994-01-01') SELECT k, freq, period, {r6('coalesce(b.revenue, a.revenue) AS revenue', 'coalesce(b.income, a.income) AS income')}, coalesce(a.estimate, true) AND coalesce(b.estimate, true) AS estimate FROM a FULL JOIN b USING (k, freq, period)")
def _(s, d):
    rows = P.table(s, d, "orders").join(P.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = rows.groupBy(F.col("c_nationkey").alias("k"), F.when(F.col("o_orderpriority") < "3", "q").otherwise("a").alias("freq"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period")).agg(
        (F.sum("o_totalprice") / 1e6).alias("revenue"), F.when(F.count("*") % 3 != 0, F.avg("o_totalprice") / 1e6).alias("income"), (F.count("*") % 2 == 0).alias("estimate")
    )
    new = g.filter("period >= '1994-01-01'").select("k", "freq", "period", F.when(~F.col("estimate"), F.col("revenue") * 1.1).alias("revenue"), (F.col("income") * 0.9).alias("income"), F.lit(False).alias("estimate"))
    return N.merge_financials(g.filter("period < '1996-01-01'"), new)


@query("u19_provider_chain", f"WITH f AS (SELECT k, t, v FROM orders_panel WHERE k % 2 = 0 OR t < DATE '1995-01-01'), l AS (SELECT k, MAX(t) AS l FROM f GROUP BY 1), r AS (SELECT k, t, v, 0 AS p FROM price UNION ALL SELECT k, t, v, 1 FROM f UNION ALL SELECT k, t, v, 2 FROM dirty WHERE v > 1500) SELECT k, t, {r6('arg_max(v, p) AS v')} FROM r LEFT JOIN l USING (k) WHERE NOT coalesce(l >= DATE '1998-06-01', false) OR p = 1 GROUP BY 1, 2", ("price", "dirty", "orders_panel"))
def _(s, d):
    return N.merge_provider_chain(P.orders_panel(s, d).filter("k % 2 = 0 OR t < '1995-01-01'"), KT(P.price(s, d)), KT(U_dirty(s, d)).filter("v > 1500"), "1998-06-01")


@query(
    "j6_merge_sources",
    f"""WITH px AS (SELECT t, v FROM benchmark WHERE market = (SELECT MIN(market) FROM benchmark)), oc AS (SELECT k, t, v * 0.5 AS v FROM credit WHERE t < DATE '1996-01-01'), nc AS (SELECT k, t, v FROM credit WHERE t >= DATE '1995-01-01' AND datediff('day', DATE '1990-01-01', t) % 3 <> 0),
    fc AS (SELECT nc.k, quantile_cont(nc.v / oc.v, 0.5) AS r FROM nc JOIN oc USING (k, t) WHERE oc.v <> 0 GROUP BY 1), f0 AS (SELECT MIN(t) AS f FROM nc), ol AS (SELECT oc.k, oc.t, oc.v * CASE WHEN r > 0 AND (r > 1.15 OR r < 0.85) AND oc.t < f THEN r ELSE 1 END AS v FROM oc LEFT JOIN fc USING (k), f0),
    jn AS (SELECT k, t, coalesce(nc.v, ol.v) AS v FROM ol FULL JOIN nc USING (k, t)), dt AS (SELECT t FROM px UNION SELECT t FROM macro UNION SELECT t FROM jn), g AS (SELECT k, t FROM dt, (SELECT DISTINCT k FROM jn) WHERE t BETWEEN DATE '1994-01-01' AND DATE '1997-12-31'),
    a AS (SELECT g.k, g.t, jn.t AS ta, jn.v AS va FROM g ASOF LEFT JOIN jn ON jn.k = g.k AND g.t >= jn.t), b AS (SELECT a.*, jn.t AS tb, jn.v AS vb FROM a ASOF LEFT JOIN jn ON jn.k = a.k AND a.t <= jn.t)
    SELECT k, b.t, {r6('px.v AS price', 'macro.v AS macro', "CASE WHEN ta = tb THEN va ELSE va + (vb - va) * datediff('day', ta, b.t) / datediff('day', ta, tb) END AS credit")} FROM b LEFT JOIN px ON px.t = b.t LEFT JOIN macro ON macro.t = b.t""",
    ("price", "benchmark", "credit", "macro"),
)
def _(s, d):
    b, credit = P.benchmark(s, d), P.credit(s, d)
    px = b.join(b.agg(F.min("market").alias("market")), "market").select("t", "v")
    return N.merge_sources(px, P.macro(s, d), credit.filter("t < '1996-01-01'").withColumn("v", F.col("v") * 0.5), credit.filter((F.col("t") >= "1995-01-01") & (F.datediff("t", F.lit("1990-01-01")) % 3 != 0)), "1994-01-01", "1997-12-31")


@query(
    "j7_evidence_asof",
    f"""WITH sn AS (SELECT c_nationkey AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS as_of, list({{'t': CAST(o_orderdate AS DATE), 'v': o_totalprice / 1e6}}) AS items FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), j AS (SELECT p.k, p.t, sn.as_of, list_filter(sn.items, lambda x: x.t <= p.t) AS i FROM price p ASOF LEFT JOIN sn ON sn.k = p.k AND p.t >= sn.as_of)
    SELECT k, t, as_of, coalesce(len(i), 0) AS items, {r6('CASE WHEN i IS NOT NULL THEN coalesce(list_sum(list_transform(i, lambda x: x.v)), 0) END AS total')} FROM j""",
    ("price",),
)
def _(s, d):
    rows = P.table(s, d, "orders").join(P.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    snaps = rows.groupBy(F.col("c_nationkey").alias("k"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("as_of")).agg(F.collect_list(F.struct(F.to_date("o_orderdate").alias("t"), (F.col("o_totalprice") / 1e6).alias("v"))).alias("items")).withColumn("saved_at", F.col("as_of"))
    return N.evidence_asof(P.price(s, d), snaps).withColumn("items", F.col("items").cast("long"))


@query("j10_accept_fallback", f"WITH p AS (SELECT k, t, v FROM price WHERE t < DATE '1998-01-01'), f AS (SELECT k, t, v * CASE WHEN k % 2 = 0 THEN 1.01 ELSE 1.5 END AS v FROM price), b AS (SELECT f.k, quantile_cont(greatest(f.v, p.v) / least(f.v, p.v), 0.5) AS o FROM f JOIN p USING (k, t) GROUP BY 1), l AS (SELECT k, MAX(t) AS l FROM p GROUP BY 1) SELECT k, t, {r6('v')} FROM f JOIN b USING (k) JOIN l USING (k) WHERE o <= 1.02 AND t > l", ("price",))
def _(s, d):
    price = KT(P.price(s, d))
    return N.accept_fallback(price.filter("t < '1998-01-01'"), price.withColumn("v", F.col("v") * F.when(F.col("k") % 2 == 0, 1.01).otherwise(1.5)))


@query("j12_match_anchors", f"WITH {_PAIRS}, a AS (SELECT k, t, before AS p, ln(1 + actual) AS x FROM pairs WHERE horizon = 20), b AS (SELECT k, t, after AS p, ln(1 + actual) + CASE WHEN year % 2 = 0 THEN 0.1 ELSE 0.01 END AS y FROM pairs WHERE horizon = 20), j AS (SELECT a.k, a.p AS pa, b.p AS pb, y, abs(x - y) <= 0.03 AS same FROM a JOIN b USING (k, t)) SELECT k, COUNT(*) FILTER (same) AS n, COUNT(*) FILTER (NOT same) AS mismatches, {r6('AVG(abs(pa - y)) FILTER (same) AS mae_a', 'AVG(abs(pb - y)) FILTER (same) AS mae_b')} FROM j GROUP BY 1", ("price",))
def _(s, d):
    p = _pairs(s, d).filter("horizon = 20")
    return N.match_anchors(p.select("k", "t", F.col("before").alias("predicted"), "actual"), p.select("k", "t", F.col("after").alias("predicted"), (F.log1p("actual") + F.when(F.col("year") % 2 == 0, 0.1).otherwise(0.01)).alias("actual")))


@query(
    "j13_match_aliases",
    """WITH l AS (SELECT s_nationkey AS market, printf('%06d', s_suppkey * 13 % 1000) AS code, right(s_name, 3) AS name FROM supplier), c AS (SELECT c_nationkey AS market, printf('%06d', c_custkey) AS ccode, right(c_name, 3) AS cname FROM customer),
    r AS (SELECT l.market, code, ccode, CASE WHEN cname = name THEN 300 WHEN length(name) >= 3 AND (starts_with(cname, name) OR starts_with(name, cname)) THEN 160 ELSE 0 END + CASE WHEN left(ccode, 5) = left(code, 5) THEN 120 WHEN left(ccode, 4) = left(code, 4) THEN 30 ELSE 0 END + CASE WHEN ends_with(ccode, '0') THEN 10 ELSE 0 END AS score FROM l JOIN c USING (market)),
    q AS (SELECT * FROM r WHERE score >= 120 QUALIFY score = MAX(score) OVER (PARTITION BY market, code)) SELECT market, code, MAX(ccode) AS alias, CAST(MAX(score) AS INT) AS score FROM q GROUP BY 1, 2 HAVING COUNT(*) = 1""",
)
def _(s, d):
    six = lambda x: F.when(x.isNotNull(), F.format_string("%06d", x))
    left = P.table(s, d, "supplier").select(F.col("s_nationkey").alias("market"), six(F.col("s_suppkey") * 13 % 1000).alias("code"), F.substring("s_name", -3, 3).alias("name"))
    cands = P.table(s, d, "customer").select(F.col("c_nationkey").alias("market"), six(F.col("c_custkey")).alias("code"), F.substring("c_name", -3, 3).alias("name"))
    return N.match_aliases(left, cands)


_ALIGNED = f"al AS (SELECT k, t, ln(v / lag(v) OVER w) AS r, ln(o / lag(o) OVER w) AS b FROM (SELECT p.k, p.t, p.v, CASE WHEN datediff('day', o.t, p.t) <= 7 THEN o.v END AS o FROM price p ASOF LEFT JOIN orders_panel o ON p.k = o.k AND p.t >= o.t) {BY})"


@query("j14_aligned_returns", f"WITH {_ALIGNED} SELECT k, t, {r6('r', 'b')} FROM al", ("price", "orders_panel"))
def _(s, d):
    return N.aligned_returns(P.price(s, d), P.orders_panel(s, d))


@query("j15_select_market", f"WITH r AS (SELECT k, t, ln(v / lag(v) OVER w) AS r FROM price {BY}), b AS (SELECT market, t, ln(v / lag(v) OVER (PARTITION BY market ORDER BY t)) AS b FROM benchmark), g AS (SELECT k, market, corr(r, b) AS c FROM r JOIN b USING (t) WHERE r IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2) SELECT k, arg_max(market, (abs(c), market)) AS market, {r6('arg_max(c, (abs(c), market)) AS corr')} FROM g WHERE c IS NOT NULL GROUP BY 1", ("price", "benchmark"))
def _(s, d):
    r = P.price(s, d).select("k", "t", F.ln(F.col("v") / F.lag("v").over(W.by_time())).alias("r")).filter("r IS NOT NULL")
    b = P.benchmark(s, d).select("market", "t", F.ln(F.col("v") / F.lag("v").over(Window.partitionBy("market").orderBy("t"))).alias("b")).filter("b IS NOT NULL")
    return N.select_market(r, b)


@query("j20_fill_candidate", f"WITH dt AS (SELECT DISTINCT t FROM price WHERE t < DATE '1996-01-01'), g AS (SELECT k, t, x.v FROM dt CROSS JOIN (SELECT DISTINCT k FROM dirty) y LEFT JOIN dirty x USING (k, t)), f AS (SELECT k, t, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING), arg_min(v, t) FILTER (v IS NOT NULL) OVER (PARTITION BY k)) AS v, COUNT(v) OVER (PARTITION BY k) / COUNT(*) OVER (PARTITION BY k) AS own FROM g) SELECT k, t, {r6('v')} FROM f WHERE own >= 0.2", ("price", "dirty"))
def _(s, d):
    return N.fill_candidate(KT(U_dirty(s, d)), P.price(s, d).filter("t < '1996-01-01'"), 0.2)


@query(
    "j16_knn_predict",
    f"""WITH x AS (SELECT k, t, row_number() OVER w AS i, v / lag(v, 5) OVER w - 1 AS a, v / lag(v, 20) OVER w - 1 AS b, lead(v, 20) OVER w / v - 1 AS y FROM price {BY}), n AS (SELECT k, t, i, a, b, y FROM x WHERE a IS NOT NULL AND b IS NOT NULL), q AS (SELECT k, MAX(i) AS i FROM n GROUP BY 1),
    p AS (SELECT n.k, n.t, o.t AS tt, o.y, sqrt((n.a - o.a) ** 2 + (n.b - o.b) ** 2) AS d FROM n JOIN q ON q.k = n.k AND q.i = n.i JOIN n o ON o.k = n.k AND o.t < n.t AND o.y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY n.k, n.t ORDER BY d, o.t) <= 12) SELECT k, t, {r6('SUM(y / greatest(d, 0.1)) / SUM(1 / greatest(d, 0.1)) AS prediction')}, COUNT(*) AS n FROM p GROUP BY 1, 2""",
    ("price",),
)
def _(s, d):
    w = W.by_time()
    rows = P.price(s, d).select("k", "t", (F.col("v") / F.lag("v", 5).over(w) - 1).alias("a"), (F.col("v") / F.lag("v", 20).over(w) - 1).alias("b"), (F.lead("v", 20).over(w) / F.col("v") - 1).alias("y")).filter("a IS NOT NULL AND b IS NOT NULL")
    rows = rows.select("k", "t", F.array("a", "b").alias("f"), "y")
    last = rows.join(rows.groupBy("k").agg(F.max("t").alias("t")), ["k", "t"])
    return J.knn_predict(rows.filter("y IS NOT NULL"), last)


@query("k12_balanced_quota", "SELECT market, k, tag FROM (SELECT s_nationkey % 5 AS market, s_suppkey AS k, CASE WHEN s_acctbal < 2000 THEN 'low' ELSE 'high' END AS tag FROM supplier) QUALIFY row_number() OVER (PARTITION BY market, tag ORDER BY sha256('seed|' || k), k) <= 4")
def _(s, d):
    rows = P.table(s, d, "supplier").select((F.col("s_nationkey") % 5).alias("market"), F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") < 2000, "low").otherwise("high").alias("tag"))
    return K.balanced_quota(rows, 4, "seed")


@query(
    "m31_calibrate_predictions",
    f"""WITH {_PAIRS}, g AS (SELECT k, sc AS scale, actual AS y, before AS p FROM pairs, (SELECT unnest([0.25, 0.4, 0.55, 0.7, 0.85, 1.0]) AS sc) WHERE horizon = 20), o AS (SELECT k, scale, greatest(least(quantile_cont(y - p * scale, 0.5), 0.03), -0.03) AS o FROM g GROUP BY 1, 2), e AS (SELECT g.k, g.scale, ROUND(AVG(abs(y - p * g.scale - o)), 12) AS mae FROM g JOIN o ON o.k = g.k AND o.scale = g.scale GROUP BY 1, 2) SELECT k, {r6('CAST(arg_min(scale, (mae, scale)) AS DOUBLE) AS scale', 'MIN(mae) AS mae')} FROM e GROUP BY 1""",
    ("price",),
)
def _(s, d):
    return MO.calibrate_predictions(_pairs(s, d).filter("horizon = 20").select("k", F.col("actual").alias("y"), F.col("before").alias("p")), "k", (0.25, 0.4, 0.55, 0.7, 0.85, 1.0))


@query("f1_acceptable_values", f"SELECT k, t, {r6('v')} FROM dirty WHERE v IS NOT NULL AND NOT (k % 2 = 0 AND v = 0) AND (k % 3 = 0 OR v <= 2000) AND v >= 0", ("dirty",))
def _(s, d):
    rows = U_dirty(s, d).select("k", "t", "v", F.lit(0.0).alias("min_value"), F.when(F.col("k") % 3 != 0, 2000.0).alias("max_value"), (F.col("k") % 2 == 0).alias("reject_zero"))
    return KT(rows.filter(U.acceptable()))


# ---- sources


@query("s8_macro_csv", f"SELECT t, {r6('CASE WHEN month(t) = 3 THEN NULL ELSE v END AS v')} FROM macro", ("macro",))
def _(s, d):
    # The panel as text lines, as a provider's file would have it; a value that is no number is null.
    line = F.concat_ws(",", F.col("t").cast("string"), F.when(F.month("t") == 3, "n/a").otherwise(F.col("v").cast("string")))
    return S.csv_rows(P.macro(s, d).select(line.alias("line")))


@query("s11_html_array", f"SELECT k, t, {r6('v')} FROM orders_panel", ("orders_panel",))
def _(s, d):
    day = F.datediff("t", F.lit("1970-01-01")).cast("long") * 86400000
    pages = P.orders_panel(s, d).groupBy("k").agg(F.to_json(F.collect_list(F.array(day.cast("double"), "v"))).alias("a")).select("k", F.concat(F.lit("<script>var x = 1; const points = "), "a", F.lit(";</script>")).alias("html"))
    rows = pages.select("k", F.explode(S.html_array(F.col("html"), "points")).alias("p"))
    return rows.select("k", F.date_add(F.lit("1970-01-01").cast("date"), (F.col("p")[0] / 86400000).cast("int")).alias("t"), F.col("p")[1].alias("v"))


@query("s15_pick_best_match", f"WITH r AS (SELECT k, t, v, CASE WHEN upper(replace(n, ' ', '')) = 'MAIN' THEN 100 WHEN contains(upper(replace(n, ' ', '')), 'MAIN') THEN 50 ELSE 0 END AS s, n FROM (SELECT k, t, v, CASE WHEN k % 4 = 0 THEN 'Main' WHEN k % 4 = 1 THEN 'main 200' ELSE 'other' END AS n FROM price)) SELECT t, MAX(s) AS score, {r6('arg_max(v, (s, -k)) AS v')} FROM r WHERE s > 0 GROUP BY 1", ("price",))
def _(s, d):
    name = F.when(F.col("k") % 4 == 0, "Main").when(F.col("k") % 4 == 1, "main 200").otherwise("other")
    return S.pick_best_match(P.price(s, d).select("k", "t", "v", name.alias("name")), "MAIN")


@query("s18_check_alignment", "WITH o AS (SELECT k, MAX(t) AS l FROM orders_panel GROUP BY 1), p AS (SELECT k, MAX(t) AS l FROM price GROUP BY 1), c AS (SELECT DISTINCT t FROM price) SELECT o.k, o.l AS source_latest, p.l AS output_latest, (SELECT MIN(t) FROM c WHERE t >= o.l) AS needed, coalesce(p.l >= coalesce((SELECT MIN(t) FROM c WHERE t >= o.l), o.l), false) AS aligned FROM o LEFT JOIN p USING (k)", ("price", "orders_panel"))
def _(s, d):
    return S.check_alignment(P.orders_panel(s, d), P.price(s, d), P.price(s, d))


@query("s20_decode_filings", "SELECT user_id AS k, CAST(ts AS DATE) AS t, event_type AS title, MAX(event_id) AS id FROM events WHERE event_type <> 'view' GROUP BY 1, 2, 3")
def _(s, d):
    rows = P.table(s, d, "events").select(F.col("user_id").alias("k"), F.date_format("ts", "yyyyMMdd").alias("d"), F.col("event_type").alias("title"), F.col("event_id").alias("id"))
    return S.decode_filings(rows, "^view$")


@query("s21_decode_price_text", f"SELECT k, t, {r6('open', 'high', 'low', 'v')}, CAST(volume AS BIGINT) AS volume FROM price", ("price",))
def _(s, d):
    item = F.concat(F.lit('<item data="'), F.concat_ws("|", F.date_format("t", "yyyyMMdd"), *[F.col(c).cast("string") for c in ("open", "high", "low", "v")], F.col("volume").cast("long").cast("string")), F.lit('" />'))
    return S.decode_price_text(P.price(s, d).groupBy("k").agg(F.concat_ws("\n", F.collect_list(item)).alias("body")))


@query("s22_volatility_rows", f"SELECT k, t, {r6('v', 'CASE WHEN k % 2 = 0 THEN open END AS open')} FROM dirty WHERE v > 0", ("dirty",))
def _(s, d):
    rows = U_dirty(s, d).select("k", "t", "v", F.when(F.col("k") % 2 == 0, F.col("open")).otherwise(F.lit(-1.0)).alias("open"), F.lit(1).alias("seq"))
    return S.volatility_rows(rows)


@query("s24_live_universe", f"WITH u AS (SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'main' ELSE 'growth' END AS market, printf('%06d', s_suppkey) AS code, s_acctbal AS cap FROM supplier WHERE s_acctbal > 0) SELECT market, code, {r6('cap')}, row_number() OVER (PARTITION BY market ORDER BY cap DESC, code) AS rank FROM u QUALIFY rank <= 20")
def _(s, d):
    rows = P.table(s, d, "supplier").select(F.when(F.col("s_nationkey") % 2 == 0, "main").otherwise("growth").alias("market"), F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("raw"), F.format_number("s_acctbal", 2).alias("cap"))
    return S.live_universe(rows, 20).withColumn("rank", F.col("rank").cast("long"))


@query("s3_to_columnar", f"SELECT k, COUNT(*) AS n, MIN(t) AS first_t, MAX(t) AS last_t, {r6('SUM(ROUND(v, 6)) AS total')} FROM orders_panel GROUP BY 1", ("orders_panel",))
def _(s, d):
    # Written as payloads and read again.
    back = S.columnar_rows(S.to_columnar(P.orders_panel(s, d)))
    return back.groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("v").alias("total"))


# ---- functions

_TITLE = "CASE WHEN p_partkey % 3 = 0 THEN '[Exclusive] (Update) ' WHEN p_partkey % 3 = 1 THEN '\"' ELSE '' END || p_name || '!'"


def _titles(s, d):
    head = F.when(F.col("p_partkey") % 3 == 0, "[Exclusive] (Update) ").when(F.col("p_partkey") % 3 == 1, '"').otherwise("")
    return P.table(s, d, "part").select(F.col("p_partkey").alias("k"), F.concat(head, "p_name", F.lit("!")).alias("title"), "p_name", "p_type", "p_brand", "p_size")


@query("x3_normalize_headline", f"SELECT p_partkey AS k, trim(regexp_replace(replace(CASE WHEN p_partkey % 3 = 0 THEN lower(p_name || '!') ELSE lower({_TITLE}) END, '\"', ''), '[^A-Za-z0-9]+', ' ', 'g')) AS title FROM part")
def _(s, d):
    return _titles(s, d).select("k", T.normalize_headline(F.col("title")).alias("title"))


@query(
    "x4_headline_similarity",
    f"""WITH t AS (SELECT p_partkey AS k, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^0-9a-z]+', ' ', 'g')) AS a, trim(regexp_replace(lower(CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '') || '  ' || p_brand WHEN 1 THEN p_type || ' ' || p_name || ' ' || p_brand WHEN 2 THEN p_brand || ' ' || p_name ELSE p_type || ' ' || p_brand END), '[^0-9a-z]+', ' ', 'g')) AS b FROM part),
    w AS (SELECT *, replace(a, ' ', '') AS ca, replace(b, ' ', '') AS cb, list_distinct(list_filter(string_split(a, ' '), lambda w: length(w) > 1)) AS x, list_distinct(list_filter(string_split(b, ' '), lambda w: length(w) > 1)) AS y FROM t), n AS (SELECT *, len(list_intersect(x, y)) AS c FROM w)
    SELECT k, {r6('CASE WHEN a = b THEN 1 WHEN ca = cb THEN 0.98 WHEN least(length(ca), length(cb)) >= 12 AND (contains(ca, cb) OR contains(cb, ca)) THEN 0.9 WHEN c >= 2 THEN greatest(c / (len(x) + len(y) - c), 0.9 * c / least(len(x), len(y))) ELSE 0 END AS score')} FROM n""",
)
def _(s, d):
    kind = F.col("p_partkey") % 4
    other = F.when(kind == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("  "), "p_brand")).when(kind == 1, F.concat_ws(" ", "p_type", "p_name", "p_brand")).when(kind == 2, F.concat_ws(" ", "p_brand", "p_name")).otherwise(F.concat_ws(" ", "p_type", "p_brand"))
    rows = P.table(s, d, "part").select(F.col("p_partkey").alias("k"), T.normalize_headline(F.concat_ws(" ", "p_name", "p_brand")).alias("a"), T.normalize_headline(other).alias("b"))
    return rows.select("k", T.likeness(F.col("a"), F.col("b"), T.headline_words(F.col("a")), T.headline_words(F.col("b"))).alias("score"))


@query("x5_stock_code", "SELECT s_suppkey AS k, printf('%06d', s_suppkey) AS code FROM supplier WHERE s_suppkey % 4 <> 3")
def _(s, d):
    six = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    raw = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("KR7"), six, F.lit("003"))).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("0000"), six)).when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("code "), six)).otherwise("none")
    return P.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), T.stock_code(raw).alias("code")).filter("code IS NOT NULL")


@query("x6_number_parse", f"SELECT o_orderkey AS k, {r6('o_totalprice AS v', 'o_totalprice / 100 AS scaled')} FROM orders")
def _(s, d):
    rows = P.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.format_number("o_totalprice", 2).alias("x"))
    return rows.select("k", X.number("x").alias("v"), (X.number("x") / 100).alias("scaled"))


@query("x8_business_days_between", "WITH c AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS t FROM lineitem WHERE isodow(CAST(l_shipdate AS DATE)) <= 5)), p AS (SELECT t, lead(t, 5) OVER (ORDER BY t) AS u FROM c) SELECT t, u, CAST((SELECT COUNT(*) FROM generate_series(p.t + INTERVAL 1 DAY, p.u - INTERVAL 1 DAY, INTERVAL 1 DAY) g(x) WHERE isodow(x) <= 5) AS INT) AS days FROM p WHERE u IS NOT NULL")
def _(s, d):
    t = P.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("t")).filter("dayofweek(t) BETWEEN 2 AND 6").distinct()
    return t.withColumn("u", F.lead("t", 5).over(Window.orderBy("t"))).filter("u IS NOT NULL").select("t", "u", X.business_days_between(F.col("t"), F.col("u")).alias("days"))


@query("x10_aligned_arrays", f"WITH a AS (SELECT k, list(v ORDER BY t) AS v, list(volume ORDER BY t) AS q FROM price GROUP BY 1), z AS (SELECT k, v[-20:] AS v, q[-20:] AS q FROM a) SELECT k, len(v) AS n, {r6('list_sum(list_transform(list_zip(v, q), lambda x: x[1] * x[2])) / list_sum(q) AS vwap')} FROM z", ("price",))
def _(s, d):
    rows = P.price(s, d).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", "v", F.col("volume").cast("double").alias("q")))).alias("s"))
    tail = rows.select("k", F.slice("s", F.greatest(F.size("s") - 19, F.lit(1)), 20).alias("s"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return tail.select("k", F.size("s").cast("long").alias("n"), (total(F.zip_with("s.v", "s.q", lambda x, y: x * y)) / total(F.col("s.q"))).alias("vwap"))


@query("x11_map_sums", f"SELECT p_partkey AS k, {r6('(CASE WHEN p_size > 25 THEN p_size ELSE 0 END) + p_retailprice AS total')}, CAST(2 + (p_size > 25)::INT AS BIGINT) AS entries FROM part")
def _(s, d):
    m = F.create_map(F.lit("size"), F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0).cast("double"), F.lit("price"), F.col("p_retailprice").cast("double"), F.lit("rank"), F.lit(1.0))
    return P.table(s, d, "part").select(F.col("p_partkey").alias("k"), T.sum_of_keys(m, ["size", "price"]).alias("total"), F.size(T.compact_map(m)).cast("long").alias("entries"))


@query("x14_filing_calendar", "WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), c(code, m, d, a) AS (VALUES ('Q1', 5, 15, 0), ('H1', 8, 14, 0), ('Q3', 11, 14, 0), ('FY', 3, 31, 1)) SELECT CAST(y AS INT) AS year, code, make_date(y + a, m, d) AS available FROM y, c WHERE make_date(y + a, m, d) <= DATE '1998-06-30'")
def _(s, d):
    years = P.table(s, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return X.filing_calendar(years, "1998-06-30")


@query("x15_growth", f"SELECT k, t, {r6('CASE WHEN abs(lag(v, 20) OVER w) >= 1e-9 THEN greatest(least((v - lag(v, 20) OVER w) / greatest(abs(lag(v, 20) OVER w), 1), 1.5), -1.5) END AS growth')} FROM dirty {BY}", ("dirty",))
def _(s, d):
    return U_dirty(s, d).select("k", "t", T.growth(F.col("v"), F.lag("v", 20).over(W.by_time())).alias("growth"))


@query("x16_freshness_scale", f"WITH a AS (SELECT k, datediff('day', MAX(t), DATE '1998-12-01') AS age FROM orders_panel WHERE v > 200 GROUP BY 1) SELECT k, age, {r6('CASE WHEN age <= 30 THEN 1 ELSE greatest(0.2, 1 - (age - 30) / 400) END AS scale')} FROM a", ("orders_panel",))
def _(s, d):
    rows = P.orders_panel(s, d).filter("v > 200").groupBy("k").agg(F.datediff(F.lit("1998-12-01"), F.max("t")).cast("long").alias("age"))
    return rows.withColumn("scale", X.freshness_scale(F.col("age"), 30, 400, 0.2))


@query("x17_smoothstep", f"WITH e AS (SELECT k, arg_max(v, t) AS b, MAX(v) AS top FROM price GROUP BY 1), x AS (SELECT k, b, top, d, least(greatest(d / 20.0, 0), 1) AS s FROM e, (SELECT unnest(range(0, 21)) AS d)) SELECT k, d AS day, {r6('b + (top - b) * s * s * (3 - 2 * s) AS v')} FROM x", ("price",))
def _(s, d):
    e = P.price(s, d).groupBy("k").agg(F.max_by("v", "t").alias("b"), F.max("v").alias("top")).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(20))))
    return e.select("k", F.col("day").cast("long").alias("day"), T.smoothstep(F.col("day"), 0.0, F.col("b"), 20.0, F.col("top")).alias("v"))


@query("x18_smooth_path", f"WITH a AS (SELECT k, t, CASE WHEN lag(v) OVER w IS NULL OR lead(v) OVER w IS NULL THEN v ELSE lag(v) OVER w * 0.2 + v * 0.6 + lead(v) OVER w * 0.2 END AS v FROM price {BY}) SELECT k, t, {r6('CASE WHEN lag(v) OVER w IS NULL OR lead(v) OVER w IS NULL THEN v ELSE lag(v) OVER w * 0.2 + v * 0.6 + lead(v) OVER w * 0.2 END AS v')} FROM a {BY}", ("price",))
def _(s, d):
    rows = KT(P.price(s, d))
    for _ in range(2):
        rows = rows.withColumn("v", T.smooth_path("v", F.lag("v").over(W.by_time()), F.lead("v").over(W.by_time())))
    return rows


@query("x19_semantic_group", "SELECT CASE WHEN regexp_matches(p_type, '(?i)steel|tin|copper|nickel|brass') THEN 'metal' WHEN regexp_matches(p_type, '(?i)standard|economy') THEN 'plain' WHEN regexp_matches(p_type, '(?i)promo|large|medium') THEN 'fine' ELSE 'other' END AS grp, COUNT(*) AS n FROM part GROUP BY 1")
def _(s, d):
    return P.table(s, d, "part").groupBy(T.semantic_group(F.col("p_type")).alias("grp")).agg(F.count("*").alias("n"))


@query("x20_to_ticker", "SELECT s_suppkey AS k, printf('%06d', s_suppkey) || CASE WHEN s_nationkey % 2 = 0 THEN '.KS' ELSE '.KQ' END AS ticker FROM supplier")
def _(s, d):
    return P.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), T.to_ticker(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.when(F.col("s_nationkey") % 2 == 0, "main").otherwise("growth")).alias("ticker"))
