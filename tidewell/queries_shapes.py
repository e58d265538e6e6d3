"""Queries of price paths, shocks, peaks and kinds of accounts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import indicators as W
from .operators import shapes as SH
from .plans import panels as P
from .plans.sql_panels import r6
from .queries import KT, SIGNALS, query, signals


@query(
    "w26_shock_profile",
    f"""WITH r AS (SELECT k, t, v, row_number() OVER w AS i, v / lag(v) OVER w - 1 AS x FROM price WINDOW w AS (PARTITION BY k ORDER BY t)), a AS (SELECT k, t, v, i, CASE WHEN abs(x) <= 0.315 THEN x END AS m FROM r),
    b AS (SELECT *, list({{'i': i, 'm': m, 'v': v}}) OVER x AS l, v / first(v) OVER x - 1 AS c8, v / first(v) OVER y - 1 AS c5 FROM a WINDOW x AS (PARTITION BY k ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), y AS (PARTITION BY k ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
    c AS (SELECT b.*, s, list_filter(l, lambda z: coalesce(z.m * s >= 0.25, false)) AS wide FROM b, (VALUES (1), (-1)) d(s) WHERE i >= 6), e AS (SELECT *, wide[len(wide)] AS ref, len(wide) AS n, i - wide[len(wide)].i AS age, len(wide) >= 2 AND c8 * s >= 0.5 AND coalesce(m * s >= 0.08, false) AS goes FROM c WHERE len(wide) > 0),
    f AS (SELECT *, (v / ref.v - 1) * s <= -0.12 AS cooled, greatest(abs(ref.m) / 0.25 * (1 - age * 0.1), CASE WHEN goes THEN 1 + least(0.5, (n - 2) * 0.18 + greatest(0, abs(c8) - 0.5)) ELSE 0 END) AS raw FROM e), g AS (SELECT *, least(raw * CASE WHEN cooled THEN 0.35 ELSE 1 END, 1.5) AS strength FROM f),
    h AS (SELECT * FROM g WHERE (age <= 4 OR goes) AND strength >= 0.75 QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY strength DESC, age, s DESC) = 1)
    SELECT b.k, b.t, CASE h.s WHEN 1 THEN 'overbought' WHEN -1 THEN 'oversold' ELSE 'neutral' END AS direction, {r6('coalesce(h.strength, 0) AS strength')}, h.age, {r6('h.ref.m AS event_move', 'h.m AS latest_move', 'h.c5 AS cumulative5')}, coalesce(h.n, 0) AS extremes, h.cooled FROM b LEFT JOIN h ON b.k = h.k AND b.t = h.t""",
    ("price",),
)
def _(s, d):
    return SH.shock_profile(KT(P.price(s, d)))


@query(
    "w42_reversal_peaks",
    """WITH RECURSIVE r AS (SELECT k, t, v, row_number() OVER w - 1 AS i, MAX(v) OVER x AS top, MIN(v) OVER y AS low, lead(t, 20) OVER w AS e FROM price WINDOW w AS (PARTITION BY k ORDER BY t), x AS (PARTITION BY k ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), y AS (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
    c AS (SELECT k, t, i FROM r WHERE i >= 60 AND e IS NOT NULL AND v >= top * 0.998 AND low / v - 1 <= -0.08), p AS (SELECT k, MIN(i) AS i FROM c GROUP BY k UNION ALL SELECT p.k, MIN(c.i) FROM p JOIN c ON c.k = p.k AND c.i > p.i + 24 GROUP BY p.k)
    SELECT c.k, c.t, (SELECT COUNT(*) FROM c z WHERE z.k = p.k AND z.i BETWEEN p.i AND p.i + 24) AS n FROM p JOIN c USING (k, i)""",
    ("price",),
)
def _(s, d):
    # Shorter histories than the operator's defaults, since the smallest tables have few days a series.
    return SH.reversal_peaks(KT(P.price(s, d)), history=60, high=60)


@query(
    "m22_classify_paths",
    f"""WITH r AS (SELECT k, t, v, ln(v / lag(v) OVER (PARTITION BY k ORDER BY t)) AS c FROM price), p AS (SELECT k, t, v, ln(lead(v, 5) OVER w / v) AS early, ln(lead(v, 10) OVER w / v) AS middle, ln(lead(v, 15) OVER w / v) AS late, ln(lead(v, 20) OVER w / v) AS "end", list(v) OVER x AS p, stddev_samp(c) OVER y AS sd FROM r
    WINDOW w AS (PARTITION BY k ORDER BY t), x AS (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING), y AS (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
    q AS (SELECT *, ln(list_max(p) / v) AS peak, list_position(p, list_max(p)) - 1 AS peak_row, ln(list_min(p) / v) AS trough, list_position(p, list_min(p)) - 1 AS trough_row, greatest(0.06, sd * sqrt(20), 0.025) AS scale, CASE WHEN "end" > 0.06 THEN 'upside' WHEN "end" < -0.06 THEN 'downside' ELSE 'sideways' END AS role FROM p WHERE "end" IS NOT NULL),
    z AS (SELECT *, "end" AS e, greatest(0.06 * 0.7, scale * 0.45) AS s FROM q)
    SELECT k, t, role, CASE role WHEN 'upside' THEN CASE WHEN trough_row <= 11 AND trough <= -s AND e - trough >= s * 1.35 THEN 'dip_then_rise' WHEN peak_row <= 10 AND peak >= greatest(e * 1.12, s * 1.5) AND abs(e - late) <= s * 0.8 THEN 'surge_then_hold' WHEN abs(middle) <= s * 0.65 AND e - middle >= s THEN 'sideways_then_rise' WHEN peak_row >= 7 AND peak - e >= s * 0.65 THEN 'rise_then_pullback' ELSE 'steady_up' END
    WHEN 'downside' THEN CASE WHEN peak_row <= 13 AND peak >= s AND peak - e >= s * 1.35 THEN 'rise_then_fall' WHEN abs(middle) <= s * 0.65 AND middle - e >= s THEN 'sideways_then_fall' WHEN trough_row <= 12 AND abs(e - trough) <= s * 0.7 AND abs(e - late) <= s * 0.65 THEN 'drop_then_hold' WHEN trough_row <= 17 AND e - trough >= s * 0.65 THEN 'drop_then_rebound' ELSE 'steady_down' END
    ELSE CASE WHEN peak >= s * 1.25 AND peak_row <= 14 AND peak - e >= s THEN CASE WHEN peak_row <= 8 AND abs(e - late) <= s * 0.75 THEN 'rise_then_hold' ELSE 'rise_then_fall' END WHEN trough <= s * -1.25 AND trough_row <= 14 AND e - trough >= s THEN CASE WHEN abs(e - late) <= s * 0.75 THEN 'drop_then_hold' ELSE 'drop_then_recover' END ELSE 'range' END END AS shape,
    {r6('early', 'middle', 'late', 'e AS end', 'peak')}, peak_row, {r6('trough')}, trough_row, {r6('scale')} FROM z""".replace("AS end,", 'AS "end",'),
    ("price",),
)
def _(s, d):
    return SH.classify_paths(KT(P.price(s, d)))


@query(
    "a18_holdout_quality",
    f"""WITH {SIGNALS}, o AS (SELECT market, t, side, CASE side WHEN 'buy' THEN 1 ELSE -1 END AS s, lead(v, 20) OVER w / v - 1 AS r, MAX(v) OVER x / v - 1 AS hi, MIN(v) OVER x / v - 1 AS lo FROM signals WINDOW w AS (PARTITION BY k ORDER BY t), x AS (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
    g AS (SELECT market, side, COUNT(*) AS n, SUM((r * s > 0)::INT) AS h, AVG(r * s) AS d, AVG(CASE s WHEN 1 THEN lo ELSE -hi END) AS a, AVG(CASE s WHEN 1 THEN hi ELSE -lo END) AS f FROM o WHERE side IS NOT NULL AND r IS NOT NULL AND year(t) >= 1996 GROUP BY 1, 2),
    q AS (SELECT market, SUM(n) AS n, SUM(h) AS h, SUM(d * n) / SUM(n) AS directional, SUM(a * n) / SUM(n) AS adverse, SUM(f * n) / SUM(n) AS favorable FROM g GROUP BY 1)
    SELECT market, CAST(n AS BIGINT) AS samples, {r6('h / n AS hit_rate', '(h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n) AS hit_rate_low', 'directional', 'adverse', 'favorable')} FROM q""",
    ("price",),
)
def _(s, d):
    buy = F.col("side") == "buy"
    sign = F.when(buy, 1).otherwise(-1)
    rows = W.forward_outcomes(signals(s, d)).filter("side IS NOT NULL AND return20 IS NOT NULL AND year(t) >= 1996")
    sides = rows.groupBy("market", "side").agg(
        F.count("*").alias("samples"), F.sum((F.col("return20") * sign > 0).cast("int")).alias("hits"), F.lit(None).cast("double").alias("hit_rate"), F.avg(F.col("return20") * sign).alias("directional"),
        F.avg(F.when(buy, F.col("adverse")).otherwise(-F.col("favorable"))).alias("adverse"), F.avg(F.when(buy, F.col("favorable")).otherwise(-F.col("adverse"))).alias("favorable"),
    )
    return SH.holdout_quality(sides, "market")


#: Names of accounts are made of the order table's flags here.
FLAGS = [("A0", "revenue", 40), ("R0", "revenue", 35), ("N0|N1", "operating", 40), ("A1|R1", "operating", 30), ("A2|R2", "net", 40)]


@query(
    "x13_account_kinds",
    f"""WITH n AS (SELECT l_orderkey AS k, l_linenumber AS o, l_extendedprice AS x, (l_linestatus = 'F')::INT AS p, l_returnflag || CAST(l_partkey % 3 AS VARCHAR) AS name FROM lineitem),
    a AS (SELECT *, CASE WHEN name IN ('A0', 'R0') THEN 'revenue' WHEN name IN ('N0', 'N1', 'A1', 'R1') THEN 'operating' WHEN name IN ('A2', 'R2') THEN 'net' END AS kind, CASE WHEN name = 'R0' THEN 35 WHEN name IN ('A1', 'R1') THEN 30 ELSE 40 END AS r FROM n),
    b AS (SELECT * FROM a WHERE kind IS NOT NULL QUALIFY p = MAX(p) OVER (PARTITION BY k)), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY k, kind ORDER BY r DESC, o, x DESC) = 1)
    SELECT k, {r6("MAX(x) FILTER (kind = 'revenue') AS revenue", "MAX(x) FILTER (kind = 'operating') AS operating", "MAX(x) FILTER (kind = 'net') AS net")}, MAX(p) AS preferred FROM c GROUP BY 1""",
)
def _(s, d):
    name = F.concat("l_returnflag", (F.col("l_partkey") % 3).cast("string")).alias("name")
    rows = P.table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), name, F.col("l_linestatus").alias("division"), F.col("l_extendedprice").alias("amount"), F.col("l_linenumber").alias("ord"))
    return SH.account_kinds(rows, FLAGS, ["k"], "F")
