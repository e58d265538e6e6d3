"""Queries of outcomes, their summaries, liquidity, trading days, journals and model selection, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from .operators import challenger as CH
from .operators import models as MO
from .operators import outcomes as O
from .operators import profiles as PR
from .operators import selection_of_models as S
from .operators.indicators import by_time
from .plans import panels as P
from .plans.sql_panels import r6
from .queries import SIGNALS, query, signals
from .sources.versioned import stored
from .streaming import stateful as SF
from .streaming import streams as ST

_HIT = "CASE WHEN side = 'buy' THEN {x} / v - 1 >= m ELSE {x} / v - 1 <= -m END"
_OUTCOMES = f"""WITH {SIGNALS}, a AS (SELECT *, k % 4 <> 0 AS stock, CASE WHEN k % 4 <> 0 THEN 0.07 ELSE 0.04 END - 1e-10 AS m, lead(v, 5) OVER w AS v5, lead(v, 10) OVER w AS v10, lead(v, 20) OVER w AS v20, lead(v, 63) OVER w AS v63,
      MAX(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS hi10, MIN(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS lo10, MAX(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS hi20, MIN(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS lo20,
      MIN(v) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near_low, MAX(v) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near_high, list(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS path FROM signals WINDOW w AS (PARTITION BY k ORDER BY t)),
    b AS (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sign FROM a WHERE side IS NOT NULL AND v63 IS NOT NULL),
    o AS (SELECT k, t, side, stock, {', '.join(f"v{n} / v - 1 AS return{n}, (v{n} / v - 1) * sign AS directional{n}, (v{n} / v - 1) * sign > 0 AS direction{n}" for n in (5, 10, 20, 63))},
      CASE WHEN side = 'buy' THEN least(0, lo20 / v - 1) ELSE least(0, 1 - hi20 / v) END AS adverse20, CASE WHEN side = 'buy' THEN greatest(0, hi20 / v - 1) ELSE greatest(0, 1 - lo20 / v) END AS favorable20,
      CASE WHEN side = 'buy' THEN v / near_low - 1 ELSE 1 - v / near_high END AS turning_distance, {', '.join(f"CASE WHEN side = 'buy' THEN hi{n} / v - 1 >= m ELSE lo{n} / v - 1 <= -m END AS hit{n}" for n in (10, 20))},
      CAST(list_position(list_transform(path, lambda x: {_HIT.format(x='x')}), TRUE) AS INTEGER) AS days_to_hit FROM b)"""
_MEASURES = [f"{c}{n}" for c in ("return", "directional") for n in (5, 10, 20, 63)] + ["adverse20", "favorable20", "turning_distance"]


def _outcomes(s, d):
    return O.signal_outcomes(signals(s, d).withColumn("stock", F.col("k") % 4 != 0))


@query("w27_signal_outcomes", f"{_OUTCOMES} SELECT k, t, side, stock, {r6(*_MEASURES)}, direction5, direction10, direction20, direction63, hit10, hit20, days_to_hit FROM o", ("price",))
def _(s, d):
    return _outcomes(s, d)


@query(
    "a6_timing_outcomes",
    f"""{_OUTCOMES} SELECT side, stock, COUNT(*) AS n, {r6('AVG(direction20::INT) AS direction20', 'AVG(direction63::INT) AS direction63', 'AVG(hit20::INT) AS excursion20', 'AVG(directional20) AS mean20', 'AVG(directional63) AS mean63', 'quantile_cont(directional20, 0.5) AS median20', 'quantile_cont(directional63, 0.5) AS median63', 'quantile_cont(directional20, 0.1) AS lower_decile20',
    'AVG(adverse20) AS adverse', 'AVG(favorable20) AS favorable', 'AVG(directional20) FILTER (directional20 > 0) / abs(AVG(directional20) FILTER (directional20 < 0)) AS payoff', 'CASE WHEN AVG(adverse20) < 0 THEN AVG(favorable20) / abs(AVG(adverse20)) END AS favorable_adverse', 'AVG(turning_distance) AS turning_distance', 'AVG(days_to_hit) AS days_to_hit', 'COUNT(days_to_hit) / COUNT(*) AS coverage')} FROM o GROUP BY 1, 2""",
    ("price",),
)
def _(s, d):
    return O.timing_summary(_outcomes(s, d), ["side", "stock"], "days_to_hit")


_FORECASTS = """WITH f AS (SELECT market, k, t, v, ln(v / lag(v, 20) OVER w) AS momentum, ln(lead(v, 20) OVER w / v) AS actual FROM price WINDOW w AS (PARTITION BY k ORDER BY t)),
    g AS (SELECT *, 0.3 * momentum AS predicted, 0.3 * momentum - 0.5 AS low, 0.3 * momentum + 0.5 AS high, CASE WHEN actual > 0.12 THEN 'upside' WHEN actual < -0.12 THEN 'downside' ELSE 'sideways' END AS actual_class,
      CASE WHEN momentum > 0.4 THEN 0.6 ELSE 0.2 END AS p_upside, CASE WHEN momentum < -0.4 THEN 0.6 ELSE 0.2 END AS p_downside FROM f WHERE momentum IS NOT NULL AND actual IS NOT NULL),
    h AS (SELECT *, 1 - p_upside - p_downside AS p_sideways, CASE WHEN k % 5 = 0 THEN NULL WHEN p_upside > 0.5 THEN 'upside' WHEN p_downside > 0.5 THEN 'downside' ELSE 'sideways' END AS top FROM g)"""


@query(
    "a9_forecast_quality",
    f"""{_FORECASTS}, m AS (SELECT market, COUNT(*) AS n, AVG(abs(predicted - actual)) AS mae, AVG(predicted - actual) AS signed, sqrt(AVG((predicted - actual) * (predicted - actual))) AS rmse, quantile_cont(abs(predicted - actual), 0.5) AS median_ae, AVG(abs(actual)) AS no_change_mae, AVG(abs(momentum - actual)) AS momentum_mae,
      AVG((sign(predicted) = sign(actual))::INT) AS direction, AVG((actual > 0)::INT) AS always_up, COUNT(top) AS told, AVG((top = actual_class)::INT) AS class_accuracy, AVG(power(p_upside - (actual_class = 'upside')::INT, 2) + power(p_sideways - (actual_class = 'sideways')::INT, 2) + power(p_downside - (actual_class = 'downside')::INT, 2)) FILTER (top IS NOT NULL) AS brier,
      AVG((actual BETWEEN low AND high)::INT) AS coverage, COUNT(*) FILTER (actual_class = 'upside') AS actual_upside, COUNT(*) FILTER (actual_class = 'sideways') AS actual_sideways, COUNT(*) FILTER (actual_class = 'downside') AS actual_downside, COUNT(*) FILTER (top = 'upside') AS told_upside, COUNT(*) FILTER (top = 'sideways') AS told_sideways, COUNT(*) FILTER (top = 'downside') AS told_downside FROM h GROUP BY 1)
    SELECT market, n, told, {r6('mae', 'signed', 'rmse', 'median_ae', 'no_change_mae', 'momentum_mae', '1 - mae / no_change_mae AS skill', '1 - mae / momentum_mae AS momentum_skill', 'direction', '(direction + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(direction * (1 - direction) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) AS direction_low', 'always_up', 'class_accuracy', 'brier', 'coverage', 'greatest(actual_upside, actual_sideways, actual_downside) / n AS majority_accuracy')},
    actual_upside, actual_sideways, actual_downside, told_upside, told_sideways, told_downside, CASE greatest(actual_upside, actual_sideways, actual_downside) WHEN actual_upside THEN 'upside' WHEN actual_sideways THEN 'sideways' ELSE 'downside' END AS majority FROM m""",
    ("price",),
)
def _(s, d):
    w = by_time()
    rows = P.price(s, d).select("market", "k", "t", F.ln(F.col("v") / F.lag("v", 20).over(w)).alias("momentum"), F.ln(F.lead("v", 20).over(w) / F.col("v")).alias("actual")).filter("momentum IS NOT NULL AND actual IS NOT NULL")
    rows = rows.withColumn("predicted", 0.3 * F.col("momentum")).withColumn("low", F.col("predicted") - 0.5).withColumn("high", F.col("predicted") + 0.5)
    rows = rows.withColumn("actual_class", F.when(F.col("actual") > 0.12, "upside").when(F.col("actual") < -0.12, "downside").otherwise("sideways"))
    rows = rows.withColumn("p_upside", F.when(F.col("momentum") > 0.4, 0.6).otherwise(0.2)).withColumn("p_downside", F.when(F.col("momentum") < -0.4, 0.6).otherwise(0.2)).withColumn("p_sideways", 1 - F.col("p_upside") - F.col("p_downside"))
    top = F.when(F.col("k") % 5 == 0, F.lit(None).cast("string")).when(F.col("p_upside") > 0.5, "upside").when(F.col("p_downside") > 0.5, "downside").otherwise("sideways")
    return O.forecast_summary(rows.withColumn("top", top), ["market"])


_TRAIL = "(PARTITION BY k ORDER BY t ROWS {n} PRECEDING)"


def _over(f: str, c: str, n: int, least: int) -> str:
    return f"CASE WHEN COUNT({c}) OVER {_TRAIL.format(n=n - 1)} >= {least} THEN {f} OVER {_TRAIL.format(n=n - 1)} END"


@query(
    "w30_liquidity_features",
    f"""WITH p AS (SELECT k, t, v, CASE WHEN day(t) % 9 <> 0 THEN volume END AS volume FROM price), a AS (SELECT *, ln(1 + volume) AS log_volume, ln(1 + v * volume) AS log_turnover, abs(v / lag(v) OVER (PARTITION BY k ORDER BY t) - 1) / nullif(v * volume, 0) AS move FROM p)
    SELECT k, t, {r6('log_volume', 'log_turnover', f"log_volume - {_over('AVG(log_volume)', 'log_volume', 20, 10)} AS volume_surprise20", f"log_turnover - {_over('AVG(log_turnover)', 'log_turnover', 20, 10)} AS turnover_surprise20", f"log_turnover - {_over('AVG(log_turnover)', 'log_turnover', 63, 30)} AS turnover_trend63",
    f"{_over('quantile_cont(log_turnover, 0.5)', 'log_turnover', 63, 30)} AS turnover_level63", f"{_over('AVG(move)', 'move', 20, 10)} * 1e9 AS amihud20", f"AVG((volume IS NOT NULL)::INT) OVER {_TRAIL.format(n=62)} AS coverage63")} FROM a""",
    ("price",),
)
def _(s, d):
    return O.liquidity_features(P.price(s, d).withColumn("volume", F.when(F.dayofmonth("t") % 9 != 0, F.col("volume"))))


@query(
    "f5_open_and_reference_dates",
    """WITH c AS (SELECT DISTINCT t FROM price WHERE isodow(t) <= 5), closed AS (SELECT DISTINCT t FROM orders_panel WHERE k = 1), opened AS (SELECT DISTINCT t FROM orders_panel WHERE k = 2), ref AS (SELECT DISTINCT t FROM orders_panel WHERE k = 3 AND t BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'),
    l AS (SELECT t, make_date(year(t), 12, 31) AS e, (SELECT MIN(t) FROM ref) AS since, (SELECT MAX(t) FROM ref) AS until FROM c)
    SELECT t FROM l WHERE t IN (SELECT t FROM opened) OR CASE WHEN t BETWEEN since AND until THEN t IN (SELECT t FROM ref) ELSE t NOT IN (SELECT t FROM closed) AND strftime(t, '%m-%d') NOT IN ('01-01', '12-25') AND t <> CASE WHEN isodow(e) = 7 THEN e - INTERVAL 2 DAY WHEN isodow(e) = 6 THEN e - INTERVAL 1 DAY ELSE e END END""",
    ("price", "orders_panel"),
)
def _(s, d):
    other = P.orders_panel(s, d)
    reference = other.filter("k = 3 AND t BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
    return O.trading_days(P.price(s, d).select("t").distinct(), other.filter("k = 1"), other.filter("k = 2"), reference)


_SCORES = f"""WITH j AS (SELECT k, t AS as_of, v AS base, ln(v / lag(v, 20) OVER w) AS momentum FROM price WINDOW w AS (PARTITION BY k ORDER BY t)), i AS (SELECT *, 0.4 * momentum AS predicted, 0.4 * momentum - 0.6 AS low, 0.4 * momentum + 0.6 AS high, as_of + 28 AS target_t FROM j WHERE momentum IS NOT NULL),
    x AS (SELECT i.*, CASE WHEN p.t - i.target_t <= 14 THEN p.t END AS actual_t, CASE WHEN p.t - i.target_t <= 14 THEN ln(p.v / base) END AS actual FROM i ASOF LEFT JOIN price p ON p.k = i.k AND p.t >= i.target_t)
    SELECT k, datediff('day', DATE '1990-01-01', as_of) AS id, as_of, target_t, actual_t, {r6('actual', 'abs(predicted - actual) AS error', 'predicted - actual AS signed', 'abs(momentum - actual) AS momentum_error', 'abs(actual) AS no_change_error')}, sign(predicted) = sign(actual) AS direction_right, actual BETWEEN low AND high AS covered FROM x"""


def _journal(s, d):
    rows = P.price(s, d).withColumn("momentum", F.ln(F.col("v") / F.lag("v", 20).over(by_time()))).filter("momentum IS NOT NULL")
    told = rows.select("k", F.datediff("t", F.lit("1990-01-01")).cast("long").alias("id"), F.col("t").alias("as_of"), F.date_add("t", 28).alias("target_t"), F.col("v").alias("base"), "momentum", (0.4 * F.col("momentum")).alias("predicted"))
    return told.withColumn("low", F.col("predicted") - 0.6).withColumn("high", F.col("predicted") + 0.6)


@query("m27_journal_scores", _SCORES, ("price",))
def _(s, d):
    return O.score_journal(_journal(s, d), P.price(s, d))


@query("st12_journal_stream", _SCORES, ("price",))
def _(s, d):
    """Forecasts and prices land in three parts; a last row of another key ends the wait for prices that never come."""
    events = SF.journal_events(_journal(s, d), P.price(s, d))
    end = s.range(1).select(*[(F.lit(-1) if f.name == "k" else F.lit(ST.END) if f.name == "t" else F.lit(True) if f.name == "is_price" else F.lit(1.0) if f.name == "v" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    return SF.in_landings(events.unionByName(end), ["1995-03-01", "1998-03-01"], SF.journal_scores, "journal")


@query(
    "st10_ledger_stream",
    """WITH a AS (SELECT user_id AS k, event_id AS id, ts, event_type <> 'error' AS ok FROM events), b AS (SELECT *, COUNT(*) FILTER (ok) OVER w AS run, MAX(ts) FILTER (ok) OVER w AS last_success, MAX(ts) FILTER (NOT ok) OVER w AS last_failure FROM a WINDOW w AS (PARTITION BY k ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, COUNT(*) FILTER (NOT ok) OVER (PARTITION BY k, run ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n FROM b)
    SELECT k, id, ts, CASE WHEN ok THEN 'ready' WHEN last_success IS NOT NULL THEN 'stale' ELSE 'error' END AS state, CAST(CASE WHEN ok THEN 0 ELSE n END AS INTEGER) AS failures, last_success, last_failure,
      CASE WHEN NOT ok THEN ts + to_seconds(least(300, 30 * CAST(power(2, least(4, n - 1)) AS INTEGER))) END AS next_attempt FROM c""",
)
def _(s, d):
    rows = P.table(s, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    attempts = rows.withColumn("t", F.to_date("ts"))
    return SF.in_landings(attempts, ["2024-01-05", "2024-01-12"], SF.source_ledger, "ledger")


@query("m15_select_model")
def _(s, d):
    """One model for each market, of all its series."""
    prices = P.price(s, d)
    rows = MO.build_samples(prices).join(prices.select("k", F.col("market").alias("g")).distinct(), "k")
    rows = rows.withColumn("baseline", 0.5 * F.col("r20")).withColumn("vol", F.col("vol60"))
    return S.select_models(rows.select("g", "t", "target_t", "y", "baseline", "vol", *MO.FEATURES).na.drop(), list(MO.FEATURES), 20, lookbacks=(1, 2, 4), least=20)


@query("a35_structural_profile")
def _(s, d):
    rows = P.price(s, d).join(P.benchmark(s, d).withColumnRenamed("v", "bench"), ["market", "t"])
    return PR.structural_profile(rows.select("k", "t", "v", "bench"))


def _monthly_samples(s, d):
    """Features and outcomes of each series' last row of a month, dated at its beginning, so that series can be ranked."""
    w = by_time()
    rows = MO.forecast_features(P.price(s, d)).withColumn("y", F.ln(F.lead("v", 20).over(w) / F.col("v"))).withColumn("target_t", F.lead("t", 20).over(w)).filter("y IS NOT NULL AND r60 IS NOT NULL")
    last = rows.groupBy("k", F.trunc("t", "month").alias("month")).agg(F.max_by(F.struct("target_t", "y", *MO.FEATURES), "t").alias("x"))
    return last.select("k", F.col("month").alias("t"), "x.*")


_SPAN = datetime.date(2000, 1, 1), datetime.date(2000, 12, 31)


@query("m30_rolling_challenger")
def _(s, d):
    rows = stored(CH.ranked_samples(_monthly_samples(s, d), list(MO.FEATURES)), "challenger")
    told = CH.rolling_predictions(rows, rows, *_SPAN, months=6)
    return told.select("k", "t", "target_t", "cutoff", "y", "label", "predicted")


@query("m37_challenger_rungs")
def _(s, d):
    return CH.run_challenger(_monthly_samples(s, d), list(MO.FEATURES), *_SPAN, months=6)
