"""Timing features of series in their markets, behaviour profiles, and the arms that open buying and selling episodes.

Everything here is columns: windows over one partitioning of the panel, then arithmetic, so a panel is shuffled once. The rules are
tables of SQL expressions by name, in layers; an expression reads the layers before its own. A comparison with a missing operand
doesn't hold, unless the expression says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import by_time, rolling_relationship, trailing
from .signals import classify_regime

#: What a panel may have besides k, t, v, volume, bench: breadth, fear, news and leading indexes, credit (change over 20 rows in percent, and its
#: rank among earlier changes), crisis score, and two volatility indexes, each with rank, z, changes, rebound and its relation to the series.
CONTEXT = {c: "double" for c in "adr fear news lead_index credit_change credit_pct crisis oscillator".split()} | {
    f"{p}_{c}": "double" for p in ("vkospi", "vix") for c in "pct z change5 change20 rebound20 corr beta observations".split()
} | {"stock": "boolean", "growth": "boolean"}
_DEFAULTS = {"stock": True, "growth": False}


def _percent(n: int, v: str = "v") -> Column:
    before = F.lag(v, n).over(by_time())
    return F.when(F.abs(before) > 1e-9, (F.col(v) / before - 1) * 100)


def timing_features(panel: DataFrame) -> DataFrame:
    """One row of features for each row of the panel (k, t, v, volume, bench and what it has of CONTEXT); positive values only."""
    rows = panel.filter("v > 0")
    for c, kind in CONTEXT.items():
        if c not in panel.columns:
            rows = rows.withColumn(c, F.lit(_DEFAULTS.get(c)).cast(kind))
    w = by_time()
    rows = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("r", F.ln(F.col("v") / F.lag("v").over(w)))
    rows = rows.withColumn("m", F.when((F.col("bench") > 0) & (F.lag("bench").over(w) > 0), F.ln(F.col("bench") / F.lag("bench").over(w)))).withColumn("c", F.greatest(F.least("r", F.lit(0.12)), F.lit(-0.12)))
    rows = rolling_relationship(rows, 60, 30, 10)
    sd = F.greatest(F.when(F.count("r").over(trailing(63)) >= 20, F.stddev("r").over(trailing(63))), F.lit(0.002))
    enough = F.count("r").over(trailing(63)) >= 20

    def annual(n: int) -> Column:
        return F.when(F.count("c").over(trailing(n)) >= 60, F.stddev("c").over(trailing(n)) * (252**0.5) * 100)

    def efficiency(n: int) -> Column:
        walked = F.sum(F.abs("r")).over(trailing(n))
        net = F.abs(F.ln(F.col("v") / F.first("v").over(w.rowsBetween(-n, 0))))
        return F.when(F.col("i") >= min(20, n), F.when(walked > 1e-9, F.least(F.lit(1.0), net / walked)).otherwise(0.0))

    low = lambda c: F.min(c).over(trailing(20))
    recent, prior = w.rowsBetween(-20, -1), w.rowsBetween(-40, -21)
    mean = F.avg("volume").over(recent)
    filled = F.count("volume").over(recent) >= 10
    slope = F.col("oscillator") - F.lag("oscillator").over(w)
    high60, high120, low120 = F.max("v").over(trailing(60)), F.max("v").over(trailing(120)), F.min("v").over(trailing(120))
    out = rows.select(
        *[c for c in rows.columns if c not in ("r", "m", "c")],
        low("adr").alias("adr_min"), low("fear").alias("fear_min"), low("news").alias("news_min"), low("credit_change").alias("credit_change_min"), low("credit_pct").alias("credit_pct_min"),
        *[_percent(n).alias(f"change{n}") for n in (1, 2, 5, 20, 60, 120, 252, 756, 1260)],
        *[F.when(enough, F.ln(F.col("v") / F.lag("v", n).over(w)) / (sd * n**0.5)).alias(f"z{n}") for n in (5, 20, 60)],
        _percent(20, "bench").alias("bench20"),
        F.when(filled & (mean > 0), F.col("volume") / mean).alias("volume_ratio"),
        F.when(filled & (F.avg("volume").over(prior) > 0), mean / F.avg("volume").over(prior)).alias("volume_trend"),
        ((F.col("v") / high60 - 1) * 100).alias("drawdown60"), ((F.col("v") / high120 - 1) * 100).alias("drawdown120"),
        F.when(high120 > low120, (F.col("v") - low120) / (high120 - low120)).alias("position120"),
        efficiency(60).alias("efficiency60"), efficiency(120).alias("efficiency120"),
        slope.alias("macd_slope"), (F.lag("oscillator").over(w) - F.lag("oscillator", 2).over(w)).alias("prior_slope"),
        (F.col("lead_index") - F.lag("lead_index", 40).over(w)).alias("leading_change"),
        annual(3780).alias("long_vol"), annual(252).alias("recent_vol"), F.count("c").over(trailing(3780)).alias("history_days"),
    )
    out = out.withColumn("relative20", F.col("change20") - F.col("bench20")).withColumn("effective_vol", F.coalesce("long_vol", "recent_vol") * 0.75 + F.coalesce("recent_vol", "long_vol") * 0.25)
    out = out.withColumn("vol_scale", F.when(F.col("effective_vol").isNull(), 1.0).otherwise(F.greatest(F.lit(0.65), F.least(F.lit(1.6), F.col("effective_vol") / 35))))
    out = out.withColumn("washed_out", F.coalesce((F.col("credit_change_min") <= -5) & (F.col("credit_pct_min") <= 0.1), F.lit(False)))
    signs = [F.col("adr_min") <= 80, F.col("fear_min") <= 25, F.col("washed_out")]
    out = out.withColumn("score", sum(F.coalesce(x.cast("int"), F.lit(0)) for x in signs))
    return out.withColumn("regime", classify_regime())


Layers = list[dict[str, str]]


def layered(df: DataFrame, layers: Layers) -> DataFrame:
    """The columns of a table of expressions, layer by layer."""
    for layer in layers:
        df = df.select("*", *[F.expr(e).alias(c) for c, e in layer.items()])
    return df


def _unit(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def _any(*names: str) -> str:
    return "(" + " OR ".join(f"coalesce({n}, FALSE)" for n in names) + ")"


def _number_of(*conditions: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions) + ")"


# Weights, spans and thresholds of the behaviour scores.
_HORIZONS = {252: 0.5, 756: 0.3, 1260: 0.2}
BEHAVIOR: Layers = [
    {
        "scale": "greatest(0.65, least(1.6, coalesce(vol_scale, 1.0)))", "link": "abs(coalesce(corr, 0.0))", "pull": "abs(coalesce(beta, 0.0))", "walk60": _unit("coalesce(efficiency60, 0.0)"), "walk120": _unit("coalesce(efficiency120, 0.0)"),
        "move60": "coalesce(change60, 0.0)", "move120": "coalesce(change120, 0.0)", "place": "coalesce(nullif(position120, 0.0), 0.5)",
        **{f"annual{n}": f"CASE WHEN change{n} > -100 THEN (power(1 + change{n} / 100, CAST(252 AS DOUBLE) / {n}) - 1) * 100 END" for n in _HORIZONS},
    },
    {
        "magnitude": _unit("abs(move60) / greatest(12.0, 24 * scale) * 0.45 + abs(move120) / greatest(20.0, 42 * scale) * 0.55"), "direction": "move60 * 0.45 + move120 * 0.55", "persistence": _unit("walk60 * 0.45 + walk120 * 0.55"),
        "downside": "greatest(0.0, coalesce(nullif(downside_beta, 0.0), pull))", "low_volatility": _unit("(1.05 - scale) / 0.4"), "high_volatility": _unit("(scale - 0.95) / 0.55"), "index_independent": _unit("(0.6 - link) / 0.6"), "index_sensitive": _unit("link * 0.55 + least(1.0, pull / 1.4) * 0.45"),
        "horizons": _number_of(*[f"annual{n} IS NOT NULL" for n in _HORIZONS]),
        "annual_return": "coalesce((" + " + ".join(f"coalesce(annual{n} * {x}, 0.0)" for n, x in _HORIZONS.items()) + ") / nullif(" + " + ".join(f"CASE WHEN annual{n} IS NULL THEN 0.0 ELSE {x} END" for n, x in _HORIZONS.items()) + ", 0.0), 0.0)",
        "long_scale": "CASE WHEN long_vol > 0 THEN greatest(0.65, least(1.6, long_vol / 35)) ELSE scale END",
    },
    {
        "trend_up": f"CASE WHEN direction > 0 THEN {_unit('magnitude * 0.65 + persistence * 0.35')} ELSE 0.0 END", "trend_down": f"CASE WHEN direction < 0 THEN {_unit('magnitude * 0.65 + persistence * 0.35')} ELSE 0.0 END",
        "range_bound": _unit(f"(1 - magnitude) * 0.45 + (1 - persistence) * 0.35 + {_unit('1 - abs(place - 0.5) * 2')} * 0.2"), "defensive": _unit(f"low_volatility * 0.4 + index_independent * 0.25 + {_unit('(1.15 - downside) / 1.15')} * 0.35"),
        "long_direction": "CASE WHEN annual_return > 3 THEN 'up' WHEN annual_return < -3 THEN 'down' ELSE 'range' END", "long_magnitude": _unit("abs(annual_return) / greatest(20.0, 45 * long_scale)"),
    },
    {
        "high_vol_momentum": _unit("high_volatility * 0.45 + greatest(trend_up, trend_down) * 0.35 + persistence * 0.2"), "low_vol_range": _unit("low_volatility * 0.5 + range_bound * 0.5"), "trend_following": _unit("greatest(trend_up, trend_down) * 0.7 + persistence * 0.3"),
        "consistency": "CASE WHEN horizons = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(" + " + ".join(f"CASE WHEN (long_direction = 'range' AND abs(annual{n}) <= 5) OR (long_direction = 'up' AND annual{n} > 0) OR (long_direction = 'down' AND annual{n} < 0) THEN 1.0 ELSE 0.0 END" for n in _HORIZONS) + " AS DOUBLE) / horizons END",
    },
    {
        # The first of the highest, in this order.
        "behavior": "CASE WHEN NOT stock THEN 'market-index' WHEN history_days < 120 THEN 'insufficient-history' "
        + " ".join(f"WHEN {a} >= greatest(low_vol_range, high_vol_momentum, trend_following, defensive, index_independent) THEN '{b}'" for a, b in (("low_vol_range", "lowVolRange"), ("high_vol_momentum", "highVolMomentum"), ("trend_following", "trendFollowing"), ("defensive", "defensive")))
        + " ELSE 'indexIndependent' END",
    },
]
BEHAVIOR_COLUMNS = "behavior low_volatility high_volatility range_bound trend_up trend_down defensive index_independent index_sensitive low_vol_range high_vol_momentum trend_following annual_return long_direction long_magnitude consistency".split()


def behavior_profile(features: DataFrame) -> DataFrame:
    """The features with scores of behaviour, the long-term direction, and the dominant behaviour."""
    return layered(features, BEHAVIOR)


def _stressed(p: str, least: float) -> str:
    return f"{p}_near AND {p}_pct >= {least} AND (coalesce({p}_z, -1e9) >= 0.8 OR coalesce({p}_change20, -1e9) >= 20)"


def _calm(p: str, most: float, change5: float, rebound: float) -> str:
    return f"{p}_near AND ((coalesce({p}_pct <= {most}, FALSE) AND coalesce({p}_z, 1e9) <= -0.35) OR (coalesce({p}_pct <= 0.6, FALSE) AND coalesce({p}_change5, -1e9) >= {change5} AND coalesce({p}_rebound20, -1e9) >= {rebound}))"


_STOCK = "CASE WHEN stock THEN scale ELSE 1.0 END"
# The thresholds of the arms. ``f`` is a stock's volatility scale, 1 for an index; limits come in pairs for the growth market and others.
ARMS: Layers = [
    {
        "f": _STOCK, "calm_stock": "stock AND scale <= 0.9", "near_high": "drawdown60 >= -2.5", "long_near_high": "drawdown120 >= -1.2",
        "extreme_buy": "(stock AND abs(change1) <= 31.5 AND change1 <= -25) OR (NOT stock AND abs(change1) <= 20 AND change1 <= -8)", "extreme_sell": "(stock AND abs(change1) <= 31.5 AND change1 >= 25) OR (NOT stock AND abs(change1) <= 20 AND change1 >= 8)",
        "vkospi_near": "vkospi_observations >= 60 AND vkospi_corr <= -0.15 AND vkospi_beta < 0", "vix_near": "vix_observations >= 60 AND vix_corr <= -0.1 AND vix_beta < 0",
        "short_fall": "change20 <= CASE WHEN growth THEN -22 ELSE -20 END AND drawdown60 <= CASE WHEN growth THEN -28 ELSE -25 END", "long_fall": "change60 <= -30 AND drawdown120 <= -40",
        "moderate_fall": "(change20 <= CASE WHEN growth THEN -15 ELSE -12 END AND drawdown60 <= CASE WHEN growth THEN -20 ELSE -16 END) OR (change60 <= -20 AND drawdown120 <= -25)",
        "shock": "change5 <= -12 AND drawdown60 <= -15 AND adr <= 95", "washed_breadth": "adr_min <= 75", "credit_reset": "credit_change_min <= -4 AND credit_pct_min <= 0.15",
        "broad_fall": "change20 <= CASE WHEN growth THEN -11 ELSE -7 END AND drawdown60 <= CASE WHEN growth THEN -13 ELSE -10 END", "deep_fall": "change20 <= CASE WHEN growth THEN -15 ELSE -10 END AND drawdown60 <= CASE WHEN growth THEN -17 ELSE -11 END",
        "apart": "corr IS NULL OR corr <= 0.35 OR beta IS NULL OR beta <= 0.35", "support": _number_of("adr_min <= 95", "fear_min <= 45", "news_min <= 100", "regime IN ('stress', 'recovery', 'slowdown')"),
        "profiled": "behavior NOT IN ('market-index', 'insufficient-history')",
        "credit_crowded": "credit_change >= 6 AND credit_pct >= 0.65", "crowd": "coalesce(fear >= 70, FALSE) OR coalesce(news >= 110, FALSE) OR coalesce(adr >= 115, FALSE)", "divergence": "coalesce(adr, 1e9) <= 60 AND credit_change >= 8 AND credit_pct >= 0.6",
        "extended": "coalesce(z20 >= 1.5, FALSE) OR coalesce(z60 >= 1.8, FALSE)", "far_extended": "coalesce(z20 >= 2.5, FALSE) OR coalesce(z60 >= 2.5, FALSE)", "volume_climax": "volume_ratio >= 1.8", "volume_fade": "volume_trend <= 0.72 AND change20 >= 8",
        "old_credit": "credit_change >= 6 AND (credit_pct >= 0.9 OR (credit_pct >= 0.7 AND oscillator >= 0.25) OR (credit_change >= 12 AND credit_pct >= 0.7 AND change60 >= 25))", "old_breadth": "adr >= 119",
    },
    {
        "vkospi_stress": _stressed("vkospi", 0.85), "vix_stress": _stressed("vix", 0.8), "vkospi_calm": _calm("vkospi", 0.2, 8, 10), "vix_calm": _calm("vix", 0.25, 6, 8), "fall": _any("short_fall", "long_fall"),
        "medium_correction": "stock AND ((change20 <= -8 * f AND drawdown60 <= -14 * f AND adr_min <= CASE WHEN calm_stock THEN 85 ELSE 80 END) OR (change20 <= -5 * f AND change60 <= -8 * f AND drawdown120 <= -14 * f AND adr_min <= CASE WHEN calm_stock THEN 95 ELSE 90 END))",
        "relative_washout": "stock AND change20 <= -f AND drawdown120 <= -5 * f AND relative20 <= -10 * f AND adr_min <= 75 AND apart AND oscillator < 0",
        "range_floor": "stock AND profiled AND range_bound >= 0.55 AND position120 <= 0.18 AND change20 <= -greatest(3.0, 5 * f) AND drawdown120 <= -greatest(7.0, 11 * f) AND oscillator < 0 AND support >= 1",
        "trend_pullback": "stock AND profiled AND trend_up >= 0.55 AND change120 >= greatest(8.0, 13 * f) AND change20 <= -greatest(4.0, 6 * f) AND drawdown60 <= -greatest(5.0, 8 * f) AND oscillator < 0 AND support >= 1 AND regime <> 'stress'",
        "credit_driven": "near_high AND credit_change >= 10 AND credit_pct >= 0.75 AND change20 >= 15", "clustered": "near_high AND change20 >= 8 AND credit_change >= 5 AND credit_pct >= 0.75 AND adr >= 110 AND oscillator >= 0.5",
        "climax": "stock AND near_high AND ((change20 >= greatest(24.0, 35 * f) AND z20 >= 1.5) OR (change20 >= greatest(10.0, 15 * f) AND z60 >= 1.8) OR (change20 >= greatest(10.0, 15 * f) AND credit_change >= 5 AND credit_pct >= 0.75) OR (change20 >= greatest(8.0, 12 * f) AND z20 >= 1.1 AND volume_climax))",
        "distribution": "stock AND near_high AND (coalesce(oscillator >= 0.25, FALSE) OR coalesce(change20 >= 22 AND z20 >= 1.8, FALSE)) AND ((change20 >= greatest(11.0, 18 * f) AND z20 >= 1.5) OR (change60 >= greatest(19.0, 30 * f) AND z60 >= 1.8))",
        "mature": "stock AND long_near_high AND oscillator >= CASE WHEN calm_stock THEN 0.25 ELSE 0.4 END AND ((change20 >= greatest(6.5, 10 * f) AND z20 >= CASE WHEN calm_stock THEN 0.9 ELSE 1.1 END) OR (change60 >= greatest(11.5, 18 * f) AND z60 >= CASE WHEN calm_stock THEN 1.0 ELSE 1.3 END))",
        "calm_top": "calm_stock AND near_high AND oscillator >= 0.2 AND ((change5 >= greatest(5.0, 9 * f) AND z5 >= 1.35 AND volume_climax) OR (change20 >= greatest(6.0, 9 * f) AND z20 >= 0.9) OR (change60 >= greatest(11.0, 18 * f) AND z60 >= 1.0))",
        "range_ceiling": "stock AND profiled AND range_bound >= 0.55 AND position120 >= 0.86 AND change20 >= greatest(3.0, 5 * f) AND oscillator >= 0.15 AND (coalesce(volume_climax, FALSE) OR crowd OR coalesce(volume_fade, FALSE)) AND regime IN ('range', 'slowdown')",
        "trend_exhaustion": "stock AND profiled AND trend_up >= 0.55 AND near_high AND change120 >= greatest(18.0, 30 * f) AND ((z20 >= 1.2 AND volume_fade) OR (z60 >= 1.5 AND oscillator >= 0.3)) AND regime IN ('expansion', 'slowdown', 'range')",
        "parabolic": "stock AND near_high AND change1 >= 15 AND change2 >= 35 AND change5 >= greatest(45.0, 55 * f) AND z5 >= 2.2 AND oscillator >= 0.5 AND volume_climax",
        "fear_rotation": "stock AND near_high AND adr <= 85 AND (fear <= 35 OR fear >= 60) AND bench20 <= -3 AND change20 >= 4 AND relative20 >= 9 AND oscillator >= 0.2 AND (corr IS NULL OR corr <= 0.35 OR beta <= 0.35)",
        "sentiment_top": "stock AND near_high AND adr <= 88 AND fear >= 60 AND change20 >= 8 AND oscillator >= 0.2 AND volume_climax",
    },
    {
        "stress_reasons": _number_of("long_fall", "adr <= 80", "fear <= 30", "credit_change <= -10 AND credit_pct <= CASE WHEN long_fall THEN 0.25 ELSE 0.1 END", "vix_stress"),
        "moderate_reasons": _number_of("adr_min <= 85", "fear_min <= 35", "credit_change_min <= -3 AND credit_pct_min <= 0.2", "news_min <= 95", "vix_stress", "vkospi_stress"),
        "overheat": _number_of("credit_crowded", "crowd", "divergence", "oscillator >= 0.5", "vkospi_calm", "vix_calm"), "risk_driven": _any("credit_driven", "clustered"),
        "old_sell": "t <= DATE '2021-12-31' AND long_near_high AND (coalesce(change20 >= 3, FALSE) OR coalesce(change60 >= 15, FALSE)) AND " + _any("old_credit", "old_breadth"),
        "crowding": "greatest(CASE WHEN old_breadth THEN greatest(0.0, (adr - 100) / 20) ELSE 0.0 END, CASE WHEN old_credit THEN credit_pct + greatest(0.0, credit_change - 6) / 20 ELSE 0.0 END)",
    },
    {
        "strong_arm": "fall AND stress_reasons >= 2",
        "moderate_arm": _any("shock", "medium_correction", "relative_washout", "range_floor", "trend_pullback", "(moderate_fall AND moderate_reasons >= CASE WHEN growth THEN 2 ELSE 1 END)"),
        "broad_arm": "broad_fall AND credit_reset AND " + _any("washed_breadth", "deep_fall"),
        "extended_top": "near_high AND extended AND (overheat >= 2 OR (far_extended AND overheat >= 1))",
    },
    {
        "buy_arm": "NOT coalesce(extreme_buy, FALSE) AND " + _any("strong_arm", "moderate_arm", "broad_arm"),
        "sell_arm": _any("risk_driven", "climax", "distribution", "mature", "calm_top", "range_ceiling", "trend_exhaustion", "parabolic", "fear_rotation", "sentiment_top", "extended_top"),
    },
]
#: The arms of both sides, as they are reported.
BUY_ARMS = "strong_arm moderate_arm broad_arm shock medium_correction relative_washout range_floor trend_pullback".split()
SELL_ARMS = "credit_driven clustered climax distribution mature calm_top range_ceiling trend_exhaustion parabolic fear_rotation sentiment_top extended_top old_sell".split()
FLAGS = ["extreme_buy", "extreme_sell", "buy_arm", "sell_arm", *BUY_ARMS, *SELL_ARMS]


def signal_arms(profiles: DataFrame) -> DataFrame:
    """The profiles with a flag for each arm, and for whether a side is armed at all; a flag is never null."""
    rows = layered(profiles, ARMS)
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in FLAGS})


def layered_sql(source: str, layers: Layers) -> str:
    """The same layers over a SQL relation."""
    for layer in layers:
        source = "(SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in layer.items()) + f" FROM {source})"
    return source
