"""Queries of report evidence, fingerprints and random features, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import evidence as E
from .operators import indicators as W
from .plans import panels as P
from .plans.sql_panels import r6
from .queries import query

_C = lambda x, low, high: f"greatest({low}, least({high}, coalesce({x}, 0)))"


@query(
    "m20_score_evidence",
    f"""WITH r AS (SELECT event_id AS id, user_id, value, lag(value) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 3) OVER w AS c, event_id % 11 AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT id, CASE WHEN a > 0 THEN value / a - 1 END AS eps, CASE WHEN q <> 3 THEN value - b END AS roe, CASE WHEN c > 0 AND q <> 5 THEN (value / c - 1) * 0.2 END AS tg, (q % 3) / 2.0 AS breadth, q % 4 AS streak, CASE WHEN q <> 7 THEN q / 20.0 END AS dev, q / 10.0 AS parser, 1 AS coverage, ((a > 0)::INT + (b IS NOT NULL)::INT) / 2.0 AS prim FROM r),
    d AS (SELECT *, CASE WHEN tg < 0 THEN {_C('tg / 0.12', -1, 0)} WHEN tg >= 0 THEN {_C('tg / 0.24', 0, 1)} ELSE 0 END AS t, CASE WHEN abs(eps) >= 0.02 THEN sign(eps) ELSE 0 END AS e, CASE WHEN abs(roe) >= 0.5 THEN sign(roe) ELSE 0 END AS o FROM i),
    w AS (SELECT *, CASE WHEN t < 0 THEN 0.24::DOUBLE WHEN t > 0 THEN 0.12 ELSE 0.08 END AS tw FROM d), s AS (SELECT *, (eps IS NOT NULL)::INT * 0.58::DOUBLE + (roe IS NOT NULL)::INT * 0.3::DOUBLE + (tg IS NOT NULL)::INT * tw AS total,
    {_C('eps / 0.25', -1, 1)} * 0.58::DOUBLE + {_C('roe / 5.0', -1, 1)} * 0.3::DOUBLE + CASE WHEN tg IS NOT NULL THEN t * tw ELSE 0 END AS x, e <> 0 AND o <> 0 AND e <> o AS conflict, t < 0 AND (e < 0 OR o < 0) AS down, t > 0 AND (e > 0 OR o > 0) AS up FROM w),
    g AS (SELECT *, CASE WHEN total > 0 THEN x / total ELSE 0 END AS earnings FROM s),
    f AS (SELECT *, {_C('earnings - CASE WHEN t < 0 THEN 0.05 * breadth + CASE WHEN streak >= 2 THEN 0.04 ELSE 0 END ELSE 0 END - CASE WHEN down THEN 0.08 ELSE 0 END + CASE WHEN up THEN 0.025 ELSE 0 END', -1, 1)} AS signal,
    {_C('parser * 0.45 + coverage * 0.25 + coalesce(prim, 0) * 0.3 - CASE WHEN dev IS NULL THEN 0.12 ELSE least(dev / 0.35, 0.45) END - CASE WHEN conflict THEN 0.15 ELSE 0 END + CASE WHEN down THEN 0.05 ELSE 0 END', 0.1, 0.92)} AS confidence FROM g)
    SELECT id, {r6('t AS target_signal', 'earnings', 'signal', 'confidence', 'signal * confidence * CASE WHEN signal < 0 THEN 0.024 ELSE 0.016 END AS adjustment')}, conflict, down AS down_agrees, up AS up_agrees FROM f""",
)
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = P.table(s, d, "events").select("event_id", "value", *[F.lag("value", n).over(w).alias(c) for n, c in ((1, "a"), (2, "b"), (3, "c"))], (F.col("event_id") % 11).alias("q"))
    q = F.col("q")
    reports = rows.select(
        F.col("event_id").alias("id"), F.when(F.col("a") > 0, F.col("value") / F.col("a") - 1).alias("eps_change"), F.when(q != 3, F.col("value") - F.col("b")).alias("roe_change"),
        F.when((F.col("c") > 0) & (q != 5), (F.col("value") / F.col("c") - 1) * 0.2).alias("target_change"), (q % 3 / 2).alias("cut_breadth"), (q % 4).alias("cut_streak"), F.when(q != 7, q / 20).alias("target_deviation"),
        (q / 10).alias("parser_confidence"), F.lit(1.0).alias("coverage"), (((F.col("a") > 0).cast("int") + F.col("b").isNotNull().cast("int")) / 2).alias("primary_coverage"),
    )
    return E.score_evidence(reports).select("id", "target_signal", "earnings", "signal", "confidence", "adjustment", "conflict", "down_agrees", "up_agrees")


@query(
    "x12_evidence_fingerprint",
    """WITH r AS (SELECT o_custkey AS k, {'date': strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d'), 'title': trim(regexp_replace(o_orderpriority, '\\s+', ' ', 'g'))} AS e FROM orders WHERE o_orderdate IS NOT NULL)
    SELECT k, COUNT(*) AS n, sha256(CAST(to_json(list(e ORDER BY e.date, e.title)) AS VARCHAR)) AS fingerprint FROM r WHERE e.title <> '' GROUP BY 1""",
)
def _(s, d):
    return E.fingerprint(P.table(s, d, "orders").withColumnRenamed("o_custkey", "k"), "k", "o_orderdate", "o_orderpriority")


_FEATURES = ["r5", "r20", "r60"]
_WEIGHTS, _BIASES = E.random_weights(len(_FEATURES), 8)
_UNITS = [f"1 - 2 / (exp(2 * ({b!r} + {' + '.join(f'{c} * {w!r}' for c, w in zip(_FEATURES, row, strict=True))})) + 1) AS h{k}" for k, (row, b) in enumerate(zip(_WEIGHTS, _BIASES, strict=True))]


@query(
    "m14_random_features",
    f"WITH f AS (SELECT k, t, ln(v / lag(v, 5) OVER w) AS r5, ln(v / lag(v, 20) OVER w) AS r20, ln(v / lag(v, 60) OVER w) AS r60 FROM price WINDOW w AS (PARTITION BY k ORDER BY t)) SELECT k, t, {r6(*_UNITS)} FROM f",
    ("price",),
)
def _(s, d):
    w = W.by_time()
    rows = P.price(s, d).select("k", "t", *[F.ln(F.col("v") / F.lag("v", n).over(w)).alias(c) for c, n in zip(_FEATURES, (5, 20, 60), strict=True)])
    return E.random_features(rows, _FEATURES).drop(*_FEATURES)
