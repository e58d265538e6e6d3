"""Queries of timing features, behaviour, arms and episodes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import episodes as E
from .operators import timing as T
from .plans import panels as P
from .plans.sql_panels import r6
from .queries import query
from .queries_panels import _MACD
from .streaming import stateful as SF

_CHANGES = ", ".join(f"CASE WHEN abs(lag(v, {n}) OVER w) > 1e-9 THEN (v / lag(v, {n}) OVER w - 1) * 100 END AS change{n}" for n in (1, 2, 5, 20, 60, 120, 252, 756, 1260))


def _rows(n: int, until: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY k ORDER BY t ROWS BETWEEN {n} PRECEDING AND {until})"


def _efficiency(n: int) -> str:
    return f"CASE WHEN i >= {min(20, n)} THEN CASE WHEN SUM(abs(r)) OVER {_rows(n - 1)} > 1e-9 THEN least(1.0, abs(ln(v / first_value(v) OVER {_rows(n)})) / SUM(abs(r)) OVER {_rows(n - 1)}) ELSE 0.0 END END AS efficiency{n}"


_Z = ", ".join(f"CASE WHEN COUNT(r) OVER {_rows(62)} >= 20 THEN ln(v / lag(v, {n}) OVER w) / (greatest(stddev_samp(r) OVER {_rows(62)}, 0.002) * sqrt({n})) END AS z{n}" for n in (5, 20, 60))
_NONE = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ["crisis", *[f"{p}_{c}" for p in ("vkospi", "vix") for c in "pct z change5 change20 rebound20 corr beta observations".split()]])
_PAIR = "r IS NOT NULL AND m IS NOT NULL"
_DOWN = f"{_PAIR} AND m < 0"
#: The features of the timing panel.
_FEATURES = _MACD.removesuffix(")") + f"""),
    lead AS (SELECT t + 60 AS at, ROUND(v / 100 + 0.0000013, 4) AS lead_index FROM macro),
    x AS (SELECT p.k, p.market, p.t, p.v, p.volume, b.v AS bench, d.adr, o.fear, o.news, o.credit_change, o.credit_pct, ROUND(c.normalized, 6) AS oscillator, CASE WHEN p.t - l.at <= 75 THEN l.lead_index END AS lead_index, p.market % 2 = 1 AS growth, TRUE AS stock, {_NONE}
      FROM price p JOIN benchmark b USING (market, t) JOIN breadth d USING (market, t) LEFT JOIN mood o USING (t) LEFT JOIN macd c ON c.k = p.k AND c.t = p.t ASOF LEFT JOIN lead l ON l.at <= p.t WHERE p.v > 0),
    y AS (SELECT *, row_number() OVER w - 1 AS i, ln(v / lag(v) OVER w) AS r, ln(bench / lag(bench) OVER w) AS m FROM x WINDOW w AS (PARTITION BY k ORDER BY t)),
    z AS (SELECT *, greatest(least(r, 0.12), -0.12) AS c FROM y),
    f0 AS (SELECT * EXCLUDE (r, m, c),
      CASE WHEN COUNT(r) FILTER ({_PAIR}) OVER {_rows(59)} >= 30 THEN corr(r, m) FILTER ({_PAIR}) OVER {_rows(59)} END AS corr, CASE WHEN COUNT(r) FILTER ({_PAIR}) OVER {_rows(59)} >= 30 THEN covar_samp(r, m) FILTER ({_PAIR}) OVER {_rows(59)} / var_samp(m) FILTER ({_PAIR}) OVER {_rows(59)} END AS beta,
      CASE WHEN COUNT(r) FILTER ({_DOWN}) OVER {_rows(59)} >= 10 THEN covar_samp(r, m) FILTER ({_DOWN}) OVER {_rows(59)} / var_samp(m) FILTER ({_DOWN}) OVER {_rows(59)} END AS downside_beta,
      MIN(adr) OVER {_rows(19)} AS adr_min, MIN(fear) OVER {_rows(19)} AS fear_min, MIN(news) OVER {_rows(19)} AS news_min, MIN(credit_change) OVER {_rows(19)} AS credit_change_min, MIN(credit_pct) OVER {_rows(19)} AS credit_pct_min,
      {_CHANGES}, {_Z}, (bench / lag(bench, 20) OVER w - 1) * 100 AS bench20,
      CASE WHEN COUNT(volume) OVER {_rows(20, "1 PRECEDING")} >= 10 THEN volume / AVG(volume) OVER {_rows(20, "1 PRECEDING")} END AS volume_ratio,
      CASE WHEN COUNT(volume) OVER {_rows(20, "1 PRECEDING")} >= 10 AND AVG(volume) OVER {_rows(40, "21 PRECEDING")} > 0 THEN AVG(volume) OVER {_rows(20, "1 PRECEDING")} / AVG(volume) OVER {_rows(40, "21 PRECEDING")} END AS volume_trend,
      (v / MAX(v) OVER {_rows(59)} - 1) * 100 AS drawdown60, (v / MAX(v) OVER {_rows(119)} - 1) * 100 AS drawdown120,
      CASE WHEN MAX(v) OVER {_rows(119)} > MIN(v) OVER {_rows(119)} THEN (v - MIN(v) OVER {_rows(119)}) / (MAX(v) OVER {_rows(119)} - MIN(v) OVER {_rows(119)}) END AS position120,
      {_efficiency(60)}, {_efficiency(120)}, oscillator - lag(oscillator) OVER w AS macd_slope, lag(oscillator) OVER w - lag(oscillator, 2) OVER w AS prior_slope, lead_index - lag(lead_index, 40) OVER w AS leading_change,
      CASE WHEN COUNT(c) OVER {_rows(3779)} >= 60 THEN stddev_samp(c) OVER {_rows(3779)} * sqrt(252) * 100 END AS long_vol, CASE WHEN COUNT(c) OVER {_rows(251)} >= 60 THEN stddev_samp(c) OVER {_rows(251)} * sqrt(252) * 100 END AS recent_vol, COUNT(c) OVER {_rows(3779)} AS history_days
      FROM z WINDOW w AS (PARTITION BY k ORDER BY t)),
    f1 AS (SELECT *, change20 - bench20 AS relative20, coalesce(long_vol, recent_vol) * 0.75 + coalesce(recent_vol, long_vol) * 0.25 AS effective_vol, coalesce(credit_change_min <= -5 AND credit_pct_min <= 0.1, FALSE) AS washed_out FROM f0),
    f2 AS (SELECT *, CASE WHEN effective_vol IS NULL THEN 1.0 ELSE greatest(0.65, least(1.6, effective_vol / 35)) END AS vol_scale, (coalesce(adr_min <= 80, FALSE))::INT + (coalesce(fear_min <= 25, FALSE))::INT + washed_out::INT AS score FROM f1),
    f AS (SELECT *, CASE WHEN (coalesce(adr_min <= 80, FALSE))::INT + (coalesce(fear_min <= 25, FALSE))::INT >= 2 THEN 'stress'
      WHEN coalesce(drawdown60, 0) <= -10 AND coalesce(macd_slope > 0, FALSE) AND (coalesce(adr_min <= 85, FALSE) OR coalesce(fear_min <= 35, FALSE)) THEN 'recovery' WHEN coalesce(leading_change, 0) < -0.05 AND coalesce(change20 >= 0, FALSE) THEN 'slowdown'
      WHEN coalesce(change20 >= 3, FALSE) AND (coalesce(leading_change, 0) >= 0 OR coalesce(news >= 100, FALSE)) THEN 'expansion' ELSE 'range' END AS regime FROM f2)"""  # fmt: skip
_PANELS = ("price", "benchmark", "macro", "mood", "breadth")
FEATURES = """i adr fear news lead_index leading_change credit_change credit_pct oscillator corr beta downside_beta adr_min fear_min news_min credit_change_min credit_pct_min change1 change2 change5 change20 change60 change120 change252 change756 change1260
    z5 z20 z60 bench20 relative20 volume_ratio volume_trend drawdown60 drawdown120 position120 efficiency60 efficiency120 macd_slope prior_slope long_vol recent_vol effective_vol vol_scale history_days washed_out score regime""".split()
_WHOLE = {"i", "history_days", "washed_out", "score", "regime", "behavior", "long_direction"}


def _columns(names: list[str]) -> str:
    return ", ".join(c if c in _WHOLE else r6(c) for c in names)


def _features(s, d):
    return T.timing_features(P.timing_panel(s, d))


@query("m2_timing_features", f"{_FEATURES} SELECT k, t, {_columns(FEATURES)} FROM f", _PANELS)
def _(s, d):
    return _features(s, d).select("k", "t", *FEATURES)


@query("m3_regimes_of_features", f"{_FEATURES} SELECT k, regime, COUNT(*) AS n, MIN(t) AS first_t, MAX(t) AS last_t FROM f GROUP BY 1, 2", _PANELS)
def _(s, d):
    return _features(s, d).groupBy("k", "regime").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("m4_behavior_profile", f"{_FEATURES} SELECT k, t, {_columns(T.BEHAVIOR_COLUMNS)} FROM {T.layered_sql('f', T.BEHAVIOR)}", _PANELS)
def _(s, d):
    return T.behavior_profile(_features(s, d)).select("k", "t", *T.BEHAVIOR_COLUMNS)


def _arms(s, d):
    return T.signal_arms(T.behavior_profile(_features(s, d)))


@query("m5_signal_arms", f"{_FEATURES} SELECT k, t, {', '.join(f'coalesce({c}, FALSE) AS {c}' for c in T.FLAGS)} FROM {T.layered_sql('f', T.BEHAVIOR + T.ARMS)}", _PANELS)
def _(s, d):
    return _arms(s, d).select("k", "t", *T.FLAGS)


@query("m6_detect_episodes")
def _(s, d):
    return E.detect_episodes(_arms(s, d))


@query("st6_episode_stream")
def _(s, d):
    """Lands in three parts, between which the query stops; the signals that stand are those of m6."""
    rows = E.reduced(_arms(s, d))
    return E.standing(SF.in_landings(rows, ["1997-06-01", "1999-09-01"], SF.episode_changes, "episodes"))
