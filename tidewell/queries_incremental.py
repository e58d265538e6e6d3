"""Queries of incremental merges and tiered cohorts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import incremental as I
from .operators.indicators import by_time
from .plans import panels as P
from .plans.sql_panels import r6
from .queries import KT, query

_TAIL = """last AS (SELECT k, MAX(t) AS last_t, arg_max(v, t) AS last_v FROM seed GROUP BY 1), r AS (SELECT m.k, m.t, m.v, row_number() OVER (PARTITION BY m.k ORDER BY m.t) AS i FROM moved m JOIN last USING (k) WHERE m.t > last_t),
    walk AS (SELECT k, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS t, last_v AS v, last_v AS held, 0 AS breaks, FALSE AS kept FROM last
      UNION ALL SELECT k, i, t, v, CASE WHEN good THEN v ELSE held END, CASE WHEN breaks >= 2 THEN 2 WHEN good THEN 0 ELSE breaks + 1 END, good FROM (SELECT r.k, r.i, r.t, r.v, w.held, w.breaks, w.breaks < 2 AND abs(r.v - w.held) <= abs(w.held) * {rel} AS good FROM walk w JOIN r ON r.k = w.k AND r.i = w.i + 1))"""


@query("q5_accepted_tail", f"WITH RECURSIVE seed AS (SELECT k, t, v FROM price WHERE t < DATE '2000-01-01'), moved AS (SELECT k, t, v FROM price), {_TAIL.format(rel=1.5)} SELECT k, t, {r6('v')} FROM walk WHERE kept", ("price",))
def _(s, d):
    p = KT(P.price(s, d))
    return I.accept_tail(p.filter("t < DATE '2000-01-01'"), p, 1.5)


@query(
    "q6_merge_incremental",
    f"""WITH RECURSIVE seed AS (SELECT k, t, v FROM price WHERE t < DATE '2000-01-01'), live AS (SELECT k, t, v * CASE k % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 1.01 ELSE 3 END AS v FROM price WHERE t >= DATE '1999-06-01'),
    o AS (SELECT k, s.v / l.v AS ratio, row_number() OVER (PARTITION BY k ORDER BY t DESC) AS back, COUNT(*) OVER (PARTITION BY k) AS n FROM seed s JOIN live l USING (k, t) WHERE s.v > 0 AND l.v > 0),
    g AS (SELECT k, median(ratio) AS m, MAX(n) AS n FROM o WHERE back <= 20 GROUP BY 1), f AS (SELECT k, CASE WHEN n >= 5 AND m BETWEEN 0.5 AND 2 AND (m > 1.02 OR m < 0.98) THEN m ELSE 1 END AS factor FROM g),
    moved AS (SELECT l.k, l.t, l.v * coalesce(factor, 1) AS v FROM live l LEFT JOIN f USING (k)), {_TAIL.format(rel=1.5)}
    SELECT k, t, {r6('coalesce(w.v, s.v) AS v')} FROM seed s FULL JOIN (SELECT k, t, v FROM walk WHERE kept UNION ALL SELECT k, t, v FROM live ANTI JOIN seed USING (k)) w USING (k, t)""",
    ("price",),
)
def _(s, d):
    p = KT(P.price(s, d))
    other = F.when(F.col("k") % 3 == 0, 0.8).when(F.col("k") % 3 == 1, 1.01).otherwise(3.0)
    return I.merge_incremental(p.filter("t < DATE '2000-01-01'"), p.filter("t >= DATE '1999-06-01'").withColumn("v", F.col("v") * other), 1.5)


# The tiers of cohorts, the nearest first, with the records that each needs.
TIERS = [("own-regime", 4, ["k", "regime"]), ("own", 5, ["k"]), ("cohort-regime", 6, ["market", "vol", "regime"]), ("group", 10, ["market", "vol"]), ("market-regime", 10, ["market", "regime"]), ("market", 12, ["market"]), ("global", 16, [])]
_TIER_SQL = " UNION ALL ".join(f"SELECT f.id, {i} AS i, '{name}' AS tier, COUNT(*) AS n, SUM(r.weight * r.error) / SUM(r.weight) AS bias FROM told f JOIN records r ON r.actual_t <= f.as_of{''.join(f' AND r.{c} = f.{c}' for c in columns)} GROUP BY f.id HAVING COUNT(*) >= {least}" for i, (name, least, columns) in enumerate(TIERS))


@query(
    "m25_calibration_tiers",
    f"""WITH x AS (SELECT k, market, t, ln(v / lag(v, 20) OVER w) AS momentum, ln(lead(v, 20) OVER w / v) AS actual, lead(t, 20) OVER w AS actual_t FROM price WINDOW w AS (PARTITION BY k ORDER BY t)),
    m AS (SELECT *, row_number() OVER (PARTITION BY k, date_trunc('month', t) ORDER BY t DESC) AS back FROM x WHERE momentum IS NOT NULL),
    told AS (SELECT k * 100000 + datediff('day', DATE '1990-01-01', t) AS id, k, market, t AS as_of, CASE WHEN momentum > 0.3 THEN 'up' WHEN momentum < -0.3 THEN 'down' ELSE 'flat' END AS regime, CASE WHEN abs(momentum) > 1 THEN 'high' WHEN k % 4 <> 0 THEN 'low' END AS vol, 0.4 * momentum - actual AS error, actual_t FROM m WHERE back = 1),
    records AS (SELECT *, 1 + k % 3 AS weight FROM told WHERE error IS NOT NULL), t AS ({_TIER_SQL}), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) = 1)
    SELECT told.id, coalesce(tier, 'none') AS tier, coalesce(n, 0) AS n, {r6('coalesce(bias, 0) AS bias')} FROM told LEFT JOIN b USING (id)""",
    ("price",),
)
def _(s, d):
    w = by_time()
    x = P.price(s, d).select("k", "market", "t", F.ln(F.col("v") / F.lag("v", 20).over(w)).alias("momentum"), F.ln(F.lead("v", 20).over(w) / F.col("v")).alias("actual"), F.lead("t", 20).over(w).alias("actual_t")).filter("momentum IS NOT NULL")
    last = x.groupBy("k", "market", F.trunc("t", "month").alias("month")).agg(F.max_by(F.struct("t", "momentum", "actual", "actual_t"), "t").alias("x")).select("k", "market", "x.*")
    regime = F.when(F.col("momentum") > 0.3, "up").when(F.col("momentum") < -0.3, "down").otherwise("flat")
    vol = F.when(F.abs("momentum") > 1, "high").when(F.col("k") % 4 != 0, "low")
    told = last.select((F.col("k").cast("long") * 100000 + F.datediff("t", F.lit("1990-01-01"))).alias("id"), "k", "market", F.col("t").alias("as_of"), regime.alias("regime"), vol.alias("vol"), (0.4 * F.col("momentum") - F.col("actual")).alias("error"), "actual_t")
    records = told.filter("error IS NOT NULL").withColumn("weight", (1 + F.col("k") % 3).cast("double"))
    return I.choose_tiers(told.drop("error", "actual_t"), records, TIERS)
