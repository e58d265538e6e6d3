"""Reports on forecasts and signals: objectives, comparisons, calibration, audits and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_time
from .oscillators import clamp
from .selection import reason_list


def mean_of(*columns: Column) -> Column:
    """Mean of those that have a value."""
    known = F.array_compact(F.array(*columns))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def summarize_sell_objectives(df: DataFrame, by: list[str], fall: float = -0.05) -> DataFrame:
    """Sell signals (return5, 10, 20, 63, favorable, adverse) against a short correction and a medium reversal; composites are means of the rates that there are."""
    rate = lambda c: F.avg(c.cast("double"))
    down = lambda h: rate(F.col(f"return{h}") < 0)
    g = df.groupBy(*by).agg(
        F.count("*").alias("samples"), down(5).alias("direction5"), down(10).alias("direction10"), rate(F.col("adverse") <= fall).alias("excursion20"), F.avg(-F.col("return10")).alias("directional10"),
        F.avg(-F.col("adverse")).alias("favorable20"), F.avg(-F.col("favorable")).alias("adverse20"), rate(-F.col("return20") > -0.1).alias("containment20"),
        down(20).alias("direction20"), down(63).alias("direction63"), rate((F.col("return20") < 0) & (F.col("return63") < 0)).alias("persistent"), F.avg(-F.col("return63")).alias("directional63"),
    )
    ratio = F.when(F.col("adverse20") < 0, F.col("favorable20") / F.abs("adverse20"))
    return g.select("*", ratio.alias("ratio20"), mean_of(F.col("direction5"), F.col("direction10"), F.col("excursion20")).alias("short_correction"), mean_of(F.col("direction20"), F.col("direction63"), F.col("persistent")).alias("medium_reversal"))


def compare_reports(pairs: DataFrame, families: list[str]) -> DataFrame:
    """Paired forecasts (horizon, actual, before, after, segment columns) by each family of segments: errors before and after, and what changed."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).cast("string").alias("segment")) for f in families]))
    rows = pairs.withColumn("_s", each).select("horizon", "_s.family", "_s.segment", *[F.abs(F.col(c) - F.col("actual")).alias(c) for c in ("before", "after")]).filter("before IS NOT NULL AND after IS NOT NULL")
    g = rows.groupBy("family", "segment", "horizon").agg(F.count("*").alias("n"), F.avg("before").alias("mae_before"), F.avg("after").alias("mae_after"))
    return g.withColumn("delta", F.col("mae_after") - F.col("mae_before"))


def comparison_gate(report: DataFrame, least: int, limit: float) -> DataFrame:
    """Segments that got worse: a failure beyond the limit, a warning beyond half of it."""
    rel = F.col("delta") / F.col("mae_before")
    level = F.when(rel > limit, "failure").when(rel > limit / 2, "warning")
    return report.filter(F.col("n") >= least).select("family", "segment", "horizon", rel.alias("worse"), level.alias("level")).filter("level IS NOT NULL")


def challenger_gate(by_horizon: DataFrame, least: int) -> DataFrame:
    """(grp, passed, reasons): better in at least two of three horizons, with enough samples in all, never much worse."""
    better, much = (F.col("mae_after") < F.col("mae_before")).cast("int"), (F.col("mae_after") > F.col("mae_before") * 1.05).cast("int")
    g = by_horizon.groupBy("grp").agg(F.sum(better).alias("better"), F.max(much).alias("much"), F.min("n").alias("least"), F.count("*").alias("horizons"))
    reasons = reason_list(("samples", F.col("least") < least), ("horizons", F.col("horizons") < 3), ("improvement", F.col("better") < 2), ("regression", F.col("much") > 0))
    return g.select("grp", F.col("better").alias("better"), F.concat_ws(",", reasons).alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def find_rebase_signal(existing: DataFrame, incoming: DataFrame, ratio: float = 1.8, days: int = 14) -> DataFrame:
    """By key: the first overlapping point that diverges, else a jump from the last existing point to the next one within some days."""
    off = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.greatest(a, b) / F.least(a, b)).otherwise(1.0)
    a = existing.select("k", "t", F.col("v").alias("old"))
    both = incoming.join(a, ["k", "t"]).withColumn("ratio", off("old", "v")).filter(F.col("ratio") >= ratio)
    overlap = both.groupBy("k").agg(F.min("t").alias("t"), F.min_by("ratio", "t").alias("ratio")).withColumn("kind", F.lit("overlap"))
    last = existing.groupBy("k").agg(F.max("t").alias("last"), F.max_by("v", "t").alias("old"))
    after = incoming.join(last, "k").filter("t > last").groupBy("k").agg(F.min("t").alias("t"), F.min_by("v", "t").alias("v"), F.first("last").alias("last"), F.first("old").alias("old"))
    edge = after.withColumn("ratio", off("old", "v")).filter((F.datediff("t", "last") <= days) & (F.col("ratio") >= ratio)).select("k", "t", "ratio", F.lit("boundary").alias("kind"))
    return overlap.select("k", "t", "ratio", "kind").unionByName(edge.join(overlap.select("k"), "k", "left_anti"))


def ticker_changes(new: DataFrame, old: DataFrame, days: int = 5) -> DataFrame:
    """(k, side, added, removed, added_dates, removed_dates): signals without a counterpart within some days, in both directions."""
    from .merge import new_signal_rows

    rows = new_signal_rows(new, old, days).withColumn("change", F.lit("added")).unionByName(new_signal_rows(old, new, days).withColumn("change", F.lit("removed")))
    dates = lambda c: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("change") == c, F.col("t")))), lambda t: t.cast("string")))
    count = lambda c: F.sum((F.col("change") == c).cast("int"))
    return rows.groupBy("k", "side").agg(count("added").alias("added"), count("removed").alias("removed"), dates("added").alias("added_dates"), dates("removed").alias("removed_dates"))


def consensus(df: DataFrame, last: int = 5) -> DataFrame:
    """Of each broker's latest reports (k, broker, t, id, target, prior) on a series: median target, its deviation, and how many raised or cut it."""
    w = Window.partitionBy("k", "broker").orderBy(F.desc("t"), F.desc("id"))
    rows = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= last)
    middle = rows.groupBy("k").agg(F.percentile("target", F.lit(0.5)).alias("median"))
    g = rows.join(middle, "k").groupBy("k").agg(
        F.count("*").alias("n"), F.max("median").alias("median"), (F.percentile(F.abs(F.col("target") - F.col("median")), F.lit(0.5)) / F.max("median")).alias("deviation"),
        F.avg(F.signum(F.col("target") - F.col("prior"))).alias("breadth"),
    )
    return g.withColumn("confidence", clamp(1 - F.col("deviation"), 0, 1) * F.col("n") / (F.col("n") + 4))


def ablation(df: DataFrame, families: list[str]) -> DataFrame:
    """How much the mean absolute error grows when a family's part (a column) is taken from the prediction, their sum."""
    whole = reduce(Column.__add__, [F.coalesce(F.col(f), F.lit(0.0)) for f in families])
    base = F.abs(whole - F.col("actual"))
    without = [F.avg(F.abs(whole - F.coalesce(F.col(f), F.lit(0.0)) - F.col("actual")) - base).alias(f) for f in families]
    one = df.filter("actual IS NOT NULL").agg(F.avg(base).alias("mae"), *without)
    return one.select("mae", F.explode(F.create_map(*[x for f in families for x in (F.lit(f), F.col(f))])).alias("family", "impact"))


def run_trend(runs: DataFrame, last: int = 10) -> DataFrame:
    """By source: the last runs (k, at, id, ok, seconds, retries): healthy rate, median duration, retries."""
    w = Window.partitionBy("k").orderBy(F.desc("at"), F.desc("id"))
    rows = runs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= last)
    return rows.groupBy("k").agg(F.count("*").alias("runs"), F.avg(F.col("ok").cast("double")).alias("healthy"), F.percentile("seconds", F.lit(0.5)).alias("median_seconds"), F.sum("retries").alias("retries"))


def journal_quality(df: DataFrame, least: int = 8) -> DataFrame:
    """By horizon: scored forecasts, their error and skill, and whether they are enough to use."""
    e = F.abs(F.col("predicted") - F.col("actual"))
    g = df.filter("predicted IS NOT NULL AND actual IS NOT NULL").groupBy("horizon").agg(F.count("*").alias("n"), F.avg(e).alias("mae"), (1 - F.avg(e) / F.avg(F.abs("actual"))).alias("skill"))
    return g.withColumn("status", F.when(F.col("n") < least, "collecting").when(F.col("skill") > 0, "usable").otherwise("weak"))


#: How far a correction may go, by horizon; 0.1 for others.
CORRECTION_CAPS = {5: 0.025, 10: 0.04, 20: 0.06, 63: 0.1, 126: 0.16}


def robust_bias(samples: DataFrame, cap: float = 0.1) -> DataFrame:
    """By group: bias of errors (grp, error, weight, actual, direction, covered) without outliers, shrunk by the effective number of samples.

    Outliers lie beyond 3.5 median deviations (0.025 at least); they stay if they are more than two fifths. Samples that have a ``momentum_error`` (null where
    none is known) are held against momentum too, and those with a ``horizon``, the same in a group, have its cap. Then ``momentum_skill`` and ``eligible`` are told.
    """
    momentum, horizons = "momentum_error" in samples.columns, "horizon" in samples.columns
    center = samples.groupBy("grp").agg(F.percentile("error", F.lit(0.5)).alias("center"), F.count("*").alias("all"))
    rows = samples.join(center, "grp").withColumn("off", F.abs(F.col("error") - F.col("center")))
    mad = rows.groupBy("grp").agg(F.greatest(F.percentile("off", F.lit(0.5)) * 3.5, F.lit(0.025)).alias("tolerance"))
    rows = rows.join(mad, "grp").withColumn("inside", F.col("off") <= F.col("tolerance"))
    enough = F.sum(F.col("inside").cast("int")).over(Window.partitionBy("grp")) >= F.ceil(F.col("all") * 0.6)
    used = rows.withColumn("enough", enough).filter(F.col("inside") | ~F.col("enough"))
    w = F.col("weight")
    mean = lambda c: F.sum(c * w) / F.sum(w)
    g = used.groupBy("grp").agg(
        F.count("*").alias("n"), F.first("center").alias("center"), mean(F.col("error")).alias("mean"), (F.sum(w) ** 2 / F.sum(w * w)).alias("effective"), mean(F.col("direction").cast("double")).alias("accuracy"),
        mean(F.col("covered").cast("double")).alias("coverage"), mean(F.abs("error")).alias("mae"), mean(F.abs("actual")).alias("no_change"),
        *([(F.sum(F.col("momentum_error") * w) / F.nullif(F.sum(F.when(F.col("momentum_error").isNotNull(), w)), F.lit(0))).alias("momentum")] if momentum else []), *([F.max("horizon").alias("horizon")] if horizons else []),
    )
    skill = F.when(F.col("no_change") > 1e-6, 1 - F.col("mae") / F.col("no_change")).otherwise(0.0)
    g = g.withColumn("skill", skill).withColumn("reliability", F.col("effective") / (F.col("effective") + 12)).withColumn("raw_bias", F.col("mean") * 0.65 + F.col("center") * 0.35)
    eligible = (F.col("effective") >= 3.5) & (F.col("accuracy") >= 0.45) & (F.col("skill") > -0.15)
    baseline = clamp((F.col("skill") + 0.15) / 0.3, 0.1, 1)
    penalty = F.greatest(F.lit(0.0), -F.col("skill")) * 0.75 + F.greatest(F.lit(0.0), 0.5 - F.col("accuracy")) * 1.2
    if momentum:
        # Without a momentum error there is nothing to be worse than.
        known = F.col("momentum").isNotNull()
        g = g.withColumn("momentum_skill", F.when(F.col("momentum") > 1e-6, 1 - F.col("mae") / F.col("momentum")).otherwise(0.0))
        penalty = penalty + F.when(known, F.greatest(F.lit(0.0), -F.col("momentum_skill")) * 0.75).otherwise(0.0)
        baseline = F.least(baseline, F.when(known, clamp((F.col("momentum_skill") + 0.15) / 0.3, 0.1, 1)).otherwise(1.0))
        eligible = eligible & (~known | (F.col("momentum_skill") > -0.15))
    quality = clamp((F.col("accuracy") - 0.35) / 0.25, 0, 1) * baseline
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in CORRECTION_CAPS.items() for x in p]), F.col("horizon")), F.lit(cap)) if horizons else F.lit(cap)
    g = g.withColumn("confidence", clamp(1 - penalty * F.col("reliability"), 0.55, 1))
    correction = F.greatest(F.least(F.when(eligible, F.col("raw_bias") * F.col("reliability") * quality).otherwise(0.0), limit), -limit)
    interval = (1 + F.greatest(F.lit(0.0), 0.68 - F.col("coverage")) * 1.4 * F.col("reliability")) * (1 + (1 - F.col("confidence")) * 0.6)
    return g.select("grp", "n", "raw_bias", "effective", "accuracy", "skill", "confidence", correction.alias("correction"), clamp(interval, 1, 1.9).alias("interval_scale"), *(["momentum_skill", eligible.alias("eligible")] if momentum else []))


SCENARIOS = ("downside", "sideways", "upside")


def realized_scenario(actual: Column, volatility: Column, horizon: int) -> Column:
    band = clamp(clamp(volatility, 0.005, 0.08) * horizon**0.5 * 0.35, 0.012, 0.12)
    return F.when(actual > band, "upside").when(actual < -band, "downside").when(actual.isNotNull(), "sideways")


def probability_calibration(samples: DataFrame) -> DataFrame:
    """By group: log adjustments of scenario probabilities (grp, weight, scenario, p_downside, p_sideways, p_upside) and the scale of their confidence; none with fewer than 6."""
    prior, w = 1.5, F.col("weight")
    hit = lambda key: (F.col("scenario") == key).cast("double")
    brier = reduce(Column.__add__, [(F.col(f"p_{key}") - hit(key)) ** 2 for key in SCENARIOS]) / 3
    sums = [F.sum(x * w).alias(f"{name}_{key}") for key in SCENARIOS for name, x in (("observed", hit(key)), ("predicted", F.col(f"p_{key}")))]
    g = samples.filter("scenario IS NOT NULL").groupBy("grp").agg(F.count("*").alias("n"), F.sum(w).alias("total"), F.sum(brier * w).alias("brier"), *sums)
    reliability = F.col("n") / (F.col("n") + 18)
    share = lambda c: (F.col(c) + prior) / (F.col("total") + prior * 3)
    adjust = lambda key: F.when(F.col("n") >= 6, clamp(F.ln(share(f"observed_{key}") / F.greatest(share(f"predicted_{key}"), F.lit(1e-6))) * reliability, -0.45, 0.45)).otherwise(0.0)
    score = F.col("brier") / F.greatest("total", F.lit(1e-9))
    scale = F.when(F.col("n") >= 6, clamp(1 - F.greatest(F.lit(0.0), (score - 2 / 9) / (2 / 9)) * reliability, 0.5, 1)).otherwise(1.0)
    return g.select("grp", "n", *[adjust(key).alias(f"adjust_{key}") for key in SCENARIOS], score.alias("brier"), scale.alias("confidence"))


def pit_audit(df: DataFrame) -> DataFrame:
    """(kind, n): what in observations (cutoff, target, as_of, price_as_of, sources: name -> date, base, predicted) was not known at their cutoff."""
    c = F.col("cutoff")
    late = F.size(F.filter(F.map_values("sources"), lambda x: x > F.col("cutoff")))
    kinds = {
        "invalid-cutoff": c.isNull(), "target-not-after-cutoff": F.col("target").isNull() | (F.col("target") <= c), "audit-as-of-mismatch": F.col("as_of").isNull() | (F.col("as_of") != c),
        "audit-price-as-of-mismatch": F.coalesce("price_as_of", "as_of").isNull() | (F.coalesce("price_as_of", "as_of") != c), "invalid-price": ~F.coalesce((F.col("base") > 0) & (F.col("predicted") > 0), F.lit(False)),
    }
    counts = [F.sum(F.coalesce(x, F.lit(False)).cast("long")).alias(k) for k, x in kinds.items()] + [F.sum(F.coalesce(late, F.lit(0)).cast("long")).alias("future-source-date")]
    one = df.agg(*counts)
    return one.select(F.explode(F.create_map(*[x for name in (*kinds, "future-source-date") for x in (F.lit(name), F.col(f"`{name}`"))])).alias("kind", "n")).filter("n > 0")


def quality_diagnostic(df: DataFrame) -> DataFrame:
    """By group: the least of several confidence scales, and what it means."""
    least = F.least(*[F.coalesce(F.col(c), F.lit(1.0)) for c in df.columns if c != "grp"])
    return df.select("grp", least.alias("scale"), F.when(least >= 0.9, "healthy").when(least >= 0.7, "reduced").otherwise("weak").alias("status"))


def validate_candidate(current: DataFrame, candidate: DataFrame, low: float, high: float, least: float = 0.8) -> DataFrame:
    """(k, problem): the first rung that a candidate series (k, t, v) fails: lost, conflicting duplicates, out of range, introduced jump, latest or coverage regressed."""
    cur = current.filter("v IS NOT NULL").groupBy("k").agg(F.max("t").alias("was"), F.count("*").alias("had"))
    jump = lambda df: df.withColumn("j", F.abs(F.ln(F.col("v") / F.lag("v").over(by_time()))) > 1.5).filter("j").select("k", "t")
    positive = lambda df: df.filter("v > 0")
    new = jump(positive(candidate).groupBy("k", "t").agg(F.max("v").alias("v"))).join(jump(positive(current)), ["k", "t"], "left_anti").groupBy("k").agg(F.count("*").alias("jumps"))
    dup = candidate.filter("v IS NOT NULL").groupBy("k", "t").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    own = dup.groupBy("k").agg(F.sum((F.col("lo") != F.col("hi")).cast("int")).alias("conflicts"), F.sum(((F.col("lo") < low) | (F.col("hi") > high)).cast("int")).alias("outside"), F.max("t").alias("now"), F.count("*").alias("has"))
    rows = cur.join(own, "k", "full").join(new, "k", "left")
    problem = (
        F.when(F.col("now").isNull(), "lost").when(F.col("conflicts") > 0, "duplicate-conflict").when(F.col("outside") > 0, "out-of-range").when(F.coalesce("jumps", F.lit(0)) > 0, "introduced-jump")
        .when(F.col("now") < F.col("was"), "latest-regressed").when(F.col("has") < F.col("had") * least, "coverage-regressed")
    )
    return rows.select("k", problem.alias("problem")).filter("problem IS NOT NULL")


def repair_candidate(current: DataFrame, candidate: DataFrame, low: float, high: float) -> DataFrame:
    """The candidate with every value out of range or in conflict replaced by the current one, or dropped; keys that it lost come back."""
    own = candidate.filter("v IS NOT NULL").groupBy("k", "t").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    good = (F.col("lo") == F.col("hi")) & F.col("lo").between(low, high)
    lost = current.join(candidate.select("k").distinct(), "k", "left_anti").select("k", "t", "v")
    fixed = own.join(current.select("k", "t", F.col("v").alias("old")), ["k", "t"], "left").select("k", "t", F.when(good, F.col("lo")).otherwise(F.col("old")).alias("v"))
    return fixed.unionByName(lost).filter("v IS NOT NULL")


def run_checks(df: DataFrame, least: int, newest: str) -> DataFrame:
    """(k, check): series of a run with too few rows, too old, empty values, or values that don't move."""
    g = df.groupBy("k").agg(F.count("*").alias("n"), F.max("t").alias("last"), F.sum(F.col("v").isNull().cast("int")).alias("nulls"), F.countDistinct("v").alias("kinds"))
    failed = reason_list(("rows", F.col("n") < least), ("stale", F.col("last") < F.lit(newest).cast("date")), ("nulls", F.col("nulls") * 20 > F.col("n")), ("flat", F.col("kinds") < 2))
    return g.select("k", F.explode(failed).alias("check"))
