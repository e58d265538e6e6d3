"""Shapes of price paths and what they tell: shocks, reversal peaks, classes of paths, quality across sides, kinds of accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import wilson_low
from .indicators import by_time
from .oscillators import clamp
from .signals import collapse_episodes


def shock_profile(df: DataFrame, threshold: float = 0.25, largest: float = 0.315, cluster: bool = True) -> DataFrame:
    """At each row of (k, t, v): the stronger of an upward and a downward shock in the last nine moves, or a neutral profile.

    Moves beyond ``largest`` are faults and don't count. A shock of the last five rows counts by its size and loses a tenth a row; several of nine rows
    that go on count as a cluster. A shock that the price has taken back by 12 % has cooled. Active from a strength of 0.75, after six rows at least.
    """
    w = by_time()
    move = F.col("v") / F.lag("v").over(w) - 1
    rows = df.filter("v > 0").select("k", "t", "v", F.row_number().over(w).alias("i"), F.when(F.abs(move) <= largest, move).alias("m"))
    nine = w.rowsBetween(-8, 0)
    rows = rows.select("*", F.collect_list(F.struct("i", "m", "v")).over(nine).alias("moves"), (F.col("v") / F.first("v").over(nine) - 1).alias("c8"), (F.col("v") / F.first("v").over(w.rowsBetween(-5, 0)) - 1).alias("c5"))

    def side(sign: int) -> Column:
        wide = F.filter("moves", lambda x: F.coalesce(x.m * sign >= threshold, F.lit(False)))
        last = F.try_element_at(wide, F.lit(-1))
        age = F.col("i") - last.i
        goes_on = F.lit(cluster) & (F.size(wide) >= 2) & (F.col("c8") * sign >= 0.5) & F.coalesce(F.col("m") * sign >= 0.08, F.lit(False))
        single = F.abs(last.m) / threshold * (1 - age * 0.1)
        many = F.when(goes_on, 1 + F.least(F.lit(0.5), (F.size(wide) - 2) * 0.18 + F.greatest(F.lit(0.0), F.abs("c8") - 0.5))).otherwise(0.0)
        cooled = (F.col("v") / last.v - 1) * sign <= -0.12
        strength = clamp(F.greatest(single, many) * F.when(cooled, 0.35).otherwise(1.0), 0, 1.5)
        active = (F.col("i") >= 6) & ((age <= 4) | goes_on) & (strength >= 0.75)
        return F.when(active, F.struct(strength.alias("strength"), (-age).alias("newer"), F.lit(sign).alias("sign"), last.m.alias("event"), F.size(wide).alias("n"), cooled.alias("cooled")))

    best = rows.withColumn("best", F.array_max(F.array_compact(F.array(side(1), side(-1)))))
    b = F.col("best")
    return best.select(
        "k", "t", F.coalesce(F.when(b.sign > 0, "overbought").when(b.sign < 0, "oversold"), F.lit("neutral")).alias("direction"), F.coalesce(b.strength, F.lit(0.0)).alias("strength"), (-b.newer).alias("age"),
        b.event.alias("event_move"), F.when(b.isNotNull(), F.col("m")).alias("latest_move"), F.when(b.isNotNull(), F.col("c5")).alias("cumulative5"), F.coalesce(b.n, F.lit(0)).alias("extremes"), b.cooled.alias("cooled"),
    )


def reversal_peaks(df: DataFrame, history: int = 252, high: int = 120, ahead: int = 20, fall: float = -0.08, spacing: int = 25) -> DataFrame:
    """(k, t, n): rows at their trailing high before a fall, spaced from the last peak that was kept; n rows stand for each. Only candidates reach the fold."""
    w = by_time()
    i, top, low = F.row_number().over(w) - 1, F.max("v").over(w.rowsBetween(1 - high, 0)), F.min("v").over(w.rowsBetween(1, ahead))
    rows = df.select("k", "t", "v", i.alias("i"), top.alias("top"), low.alias("low"), F.lead("t", ahead).over(w).alias("end"))
    peaks = rows.filter((F.col("i") >= history) & F.col("end").isNotNull() & (F.col("v") >= F.col("top") * 0.998) & (F.col("low") / F.col("v") - 1 <= fall))
    return collapse_episodes(peaks.withColumn("side", F.lit("sell")), spacing - 1).select("k", "t", "n")


def classify_paths(df: DataFrame, horizon: int = 20, flat: float = 0.06) -> DataFrame:
    """The shape of the log path over the next rows from each row that has as many: role by its end, class by where its extremes and quarters lie."""
    w = by_time()
    at = {name: int(horizon * share + 0.5) for name, share in (("early", 0.25), ("middle", 0.5), ("late", 0.75), ("end", 1))}
    log = lambda c: F.ln(c / F.col("v"))
    rows = df.filter("v > 0").withColumn("c", F.ln(F.col("v") / F.lag("v").over(w)))
    rows = rows.select("k", "t", "v", *[log(F.lead("v", n).over(w)).alias(name) for name, n in at.items()], F.collect_list("v").over(w.rowsBetween(0, horizon)).alias("p"), F.stddev_samp("c").over(w.rowsBetween(1, horizon)).alias("sd"))
    rows = rows.filter("end IS NOT NULL").select(
        "k", "t", *at, log(F.array_max("p")).alias("peak"), (F.array_position("p", F.array_max("p")) - 1).alias("peak_row"), log(F.array_min("p")).alias("trough"), (F.array_position("p", F.array_min("p")) - 1).alias("trough_row"),
        F.greatest(F.lit(flat), F.col("sd") * horizon**0.5, F.lit(0.025)).alias("scale"),
    )
    c = {x: F.col(x) for x in (*at, "peak", "peak_row", "trough", "trough_row")}
    s, end, h = F.greatest(F.lit(flat * 0.7), F.col("scale") * 0.45), F.col("end"), horizon
    held = lambda share: F.abs(end - c["late"]) <= s * share
    waits = F.abs("middle") <= s * 0.65
    high_first = (c["peak"] >= s * 1.25) & (c["peak_row"] <= h * 0.7) & (c["peak"] - end >= s)
    low_first = (c["trough"] <= s * -1.25) & (c["trough_row"] <= h * 0.7) & (end - c["trough"] >= s)
    # Shapes by role, the first that holds; the last of each role holds always.
    shapes = {
        "upside": [
            ("dip_then_rise", (c["trough_row"] <= h * 0.55) & (c["trough"] <= -s) & (end - c["trough"] >= s * 1.35)),
            ("surge_then_hold", (c["peak_row"] <= h * 0.5) & (c["peak"] >= F.greatest(end * 1.12, s * 1.5)) & held(0.8)),
            ("sideways_then_rise", waits & (end - c["middle"] >= s)),
            ("rise_then_pullback", (c["peak_row"] >= h * 0.35) & (c["peak"] - end >= s * 0.65)),
            ("steady_up", F.lit(True)),
        ],
        "downside": [
            ("rise_then_fall", (c["peak_row"] <= h * 0.65) & (c["peak"] >= s) & (c["peak"] - end >= s * 1.35)),
            ("sideways_then_fall", waits & (c["middle"] - end >= s)),
            ("drop_then_hold", (c["trough_row"] <= h * 0.6) & (F.abs(end - c["trough"]) <= s * 0.7) & held(0.65)),
            ("drop_then_rebound", (c["trough_row"] <= h * 0.85) & (end - c["trough"] >= s * 0.65)),
            ("steady_down", F.lit(True)),
        ],
        "sideways": [
            ("rise_then_hold", high_first & (c["peak_row"] <= h * 0.4) & held(0.75)),
            ("rise_then_fall", high_first),
            ("drop_then_hold", low_first & held(0.75)),
            ("drop_then_recover", low_first),
            ("range", F.lit(True)),
        ],
    }
    role = F.when(end > flat, "upside").when(end < -flat, "downside").otherwise("sideways")
    steps = [(F.col("role") == r) & holds for r, ladder in shapes.items() for _, holds in ladder]
    names = [name for ladder in shapes.values() for name, _ in ladder]
    key = F.coalesce(*[F.when(step, name) for step, name in zip(steps, names)])
    return rows.withColumn("role", role).select("k", "t", "role", key.alias("shape"), *at, "peak", "peak_row", "trough", "trough_row", "scale")


def holdout_quality(df: DataFrame, by: str) -> DataFrame:
    """Both sides' rows (side, samples, hits, hit_rate, directional, adverse, favorable) as one by group, weighted by samples; hits stand before the rate, a missing mean is 0."""
    n = F.greatest(F.coalesce("samples", F.lit(0)), F.lit(0))
    hits = F.coalesce(F.col("hits"), F.coalesce("hit_rate", F.lit(0.0)) * n)
    mean = lambda c: F.sum(F.coalesce(c, F.lit(0.0)) * F.col("n")) / F.sum("n")
    g = df.select("*", n.alias("n"), hits.alias("h")).filter("n > 0").groupBy(by).agg(F.sum("n").alias("samples"), F.sum("h").alias("hits"), *[mean(c).alias(c) for c in ("directional", "adverse", "favorable")])
    return g.select(by, "samples", (F.col("hits") / F.col("samples")).alias("hit_rate"), wilson_low(F.col("hits"), F.col("samples")).alias("hit_rate_low"), "directional", "adverse", "favorable")


def account_kinds(df: DataFrame, rules: list[tuple[str, str, int]], by: list[str], prefer: str) -> DataFrame:
    """Accounts (name, division, amount, ord) as one row a key with a column a kind.

    A rule is (pattern of the whole name, kind, priority); other names go. Of a kind the highest priority counts, of equal ones the first, then the largest. A key that
    has any known account in the preferred division takes all kinds from it, even if some are missing there.
    """
    find = lambda i: reduce(lambda c, r: c.when(F.col("name").rlike(f"^({r[0]})$"), F.lit(r[i])), rules[1:], F.when(F.col("name").rlike(f"^({rules[0][0]})$"), F.lit(rules[0][i])))
    rows = df.filter("amount IS NOT NULL").select(*by, "amount", "ord", find(1).alias("kind"), find(2).alias("priority"), (F.col("division") == prefer).cast("int").alias("preferred")).filter("kind IS NOT NULL")
    kinds = list(dict.fromkeys(r[1] for r in rules))
    pick = lambda kind: F.max_by("amount", F.when(F.col("kind") == kind, F.struct("priority", -F.col("ord"), "amount"))).alias(kind)
    each = rows.groupBy(*by, F.coalesce("preferred", F.lit(0)).alias("preferred")).agg(*[pick(kind) for kind in kinds])
    return each.groupBy(*by).agg(*[F.max_by(kind, "preferred").alias(kind) for kind in kinds], F.max("preferred").alias("preferred"))
