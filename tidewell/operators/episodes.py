"""Buying and selling episodes: the one rule of this library that has to walk a series row by row.

An arm opens an episode, which follows the extreme of the price until a turn of momentum confirms it within the arm's window; the signal is then dated at the
extreme (or at the confirmation). Further confirmations of an unlocked episode replace its signal. Episodes end on recovery,
renewed weakness, or staleness; selling waits between signals. Extreme days give signals at once.

All that can be said of a row without its history is a column already (``timing``); ``walk`` reads these columns and a small state. The batch
form walks whole series, each in its group; the stream (``streaming.stateful``) keeps the state of each series between batches. Both
give changes of signals: (slot, revision), of which the last one of a slot stands.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import timing
from .indicators import by_time

# Rows and ratios of the episode rules.
BUY_STALE_ROWS, SELL_COOLDOWN, OLD_SELL_COOLDOWN = 40, 10, 35
FAILED_AFTER, FAILED_RATIO, RECOVERED_RATIO, NEAR_PEAK, REACCELERATION = 3, 0.96, 1.12, 0.997, 1.05
#: Signals whose dates a walk still compares with new ones; confirmations reach back 20 rows at most.
RECENT = 64

SIGNALS = "k {kind}, side string, slot int, revision int, t date, setup_t date, confirm_t date, mode string, family string, price double"
#: What a walk reads of a row.
BOOLEANS = [*timing.FLAGS, "calm_stock", "fall", "moderate_fall", "turned_up", "recovered", "corrected", "cycle_low", "pulled_back", "shallow_cycle", "rolled_over", "old_rollover", "credit_rollover", "credit_spike", "near_high", "volume_climax", "divergence", "far_extended", "continued", "stock", "osc_positive", "osc_negative", "osc_recent_positive", "slope_down"]
NUMBERS = ["v", "f", "crowding", "drawdown60", "change20", "spike_row"]


def reduced(arms: DataFrame) -> DataFrame:
    """(k, t, i) and the columns that a walk reads: the arms, and the conditions under which episodes turn, reset or end."""
    w = by_time()
    spike = (F.col("change1") >= 25) & (F.col("change1") <= 31.5)
    past = w.rowsBetween(-8, -1)
    at = F.when(spike, F.struct(F.col("i").alias("i"), F.lag("v").over(w).alias("base")))
    rows = arms.withColumn("_at", at).withColumn("_v", F.struct("i", "v"))
    first, last, count = F.first("_at", True).over(past), F.last("_at", True).over(past), F.count("_at").over(past)
    # The highest price since the first spike of the window, itself included.
    rows = rows.withColumn("_first", first).withColumn("_last", last).withColumn("_count", count).withColumn("_prices", F.collect_list("_v").over(w.rowsBetween(-8, 0)))
    high = F.array_max(F.transform(F.filter("_prices", lambda x: x["i"] >= F.col("_first.i")), lambda x: x["v"]))
    conditions = {
        "spiked": (F.col("_count") >= 2) & F.col("stock") & ~F.col("extreme_sell") & (F.col("_last.i") - F.col("_first.i") <= 5) & (F.col("i") - F.col("_last.i") <= 4) & ((F.col("v") / F.col("_first.base") - 1) * 100 >= 60) & ((F.col("v") / high - 1) * 100 >= -5) & (F.col("change1") >= 10),
    }
    rows = rows.withColumn("continued", conditions["spiked"]).withColumn("spike_row", F.col("_last.i").cast("double"))
    extra = {
        "turned_up": "oscillator < 0 AND macd_slope > 0 AND (prior_slope IS NULL OR prior_slope <= 0 OR macd_slope >= abs(prior_slope) * 0.75)",
        "recovered": "(adr IS NULL OR adr >= 95) AND oscillator > 0",
        "corrected": "coalesce(drawdown60 <= -12, FALSE) OR coalesce(change20 <= -10 AND oscillator < 0, FALSE)",
        "cycle_low": "oscillator < 0",
        "pulled_back": "drawdown120 <= -3",
        "shallow_cycle": "coalesce(drawdown60 <= -5, FALSE) OR coalesce(change20 <= 0, FALSE)",
        "rolled_over": "macd_slope <= 0 AND prior_slope > 0 AND (oscillator > 0 OR oscillator - macd_slope > 0)",
        "old_rollover": "macd_slope <= 0 AND prior_slope > 0",
        "credit_rollover": "drawdown60 <= -0.1",
        "credit_spike": "old_sell AND credit_change >= 8 AND credit_pct >= 0.9 AND macd_slope < 0",
        "osc_positive": "oscillator > 0",
        "osc_negative": "oscillator < 0",
        "osc_recent_positive": "oscillator > 0 OR oscillator - macd_slope > 0",
        "slope_down": "macd_slope <= 0",
    }
    rows = rows.select("*", *[F.expr(e).alias(c) for c, e in extra.items()])
    return rows.select("k", "t", "i", *[F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in BOOLEANS], *[F.col(c).cast("double").alias(c) for c in NUMBERS])


class Walk:
    """The state of one series, and what a row does to it."""

    def __init__(self, text: str | None = None):
        held = json.loads(text) if text else {}
        self.buy: dict | None = held.get("buy")
        self.sell: dict | None = held.get("sell")
        self.last_sell: int | None = held.get("last_sell")
        self.last_old_sell: int | None = held.get("last_old_sell")
        self.last_spike: float = held.get("last_spike", -1.0)
        #: By side: the number of slots so far, and [slot, date, mode, revision] of the latest.
        self.slots: dict[str, int] = held.get("slots", {"buy": 0, "sell": 0})
        self.recent: dict[str, list] = held.get("recent", {"buy": [], "sell": []})

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    # -- signals

    def _give(self, side: str, episode: dict, date: str, setup: str, confirm: str, mode: str, family: str, price: float) -> Iterator[tuple]:
        """A signal into its episode's slot, or into that of the same date unless an exceptional one stands there."""
        same = next((x for x in self.recent[side] if x[1] == date), None)
        if same is not None:
            episode["slot"] = same[0]
            if same[2] in ("extreme-daily", "overheat-continuation"):
                return
        if episode.get("slot") is None:
            episode["slot"] = self.slots[side]
            self.slots[side] += 1
            self.recent[side] = [*self.recent[side][-RECENT + 1 :], [episode["slot"], date, mode, 0]]
            revision = 0
        else:
            entry = next((x for x in self.recent[side] if x[0] == episode["slot"]), None)
            if entry is None:
                return
            entry[1], entry[2], entry[3] = date, mode, entry[3] + 1
            revision = entry[3]
        yield side, episode["slot"], revision, date, setup, confirm, mode, family, price

    # -- rows

    def row(self, x: dict) -> Iterator[tuple]:
        if x["extreme_buy"]:
            yield from self._give("buy", {}, x["t"], x["t"], x["t"], "extreme-daily", "shock-reversal", x["v"])
            self.buy = None
        if x["extreme_sell"]:
            yield from self._give("sell", {}, x["t"], x["t"], x["t"], "extreme-daily", "blowoff-exhaustion", x["v"])
            self.sell = None
        if x["continued"] and x["spike_row"] > self.last_spike:
            yield from self._give("sell", {}, x["t"], x["t"], x["t"], "overheat-continuation", "blowoff-continuation", x["v"])
            self.last_spike, self.sell = x["spike_row"], None
        yield from self._buying(x)
        yield from self._selling(x)

    def _buying(self, x: dict) -> Iterator[tuple]:
        i, price, e = x["i"], x["v"], self.buy
        if e:
            failed = (e["broad"] or e["shock"] or e["relative"]) and e["locked"] and i - e["confirmed"] >= FAILED_AFTER and price <= e["signal_low"] * FAILED_RATIO
            recovered = price >= e["low"] * RECOVERED_RATIO and x["recovered"]
            stale = i - e["low_row"] > BUY_STALE_ROWS and not x["moderate_fall"]
            if failed or recovered or stale:
                e = self.buy = None
        if x["buy_arm"]:
            patient = 10 if x["calm_stock"] else 7
            if e is None:
                days = 12 if x["range_floor"] else 8 if x["trend_pullback"] or x["fall"] else 5 if x["strong_arm"] else patient if x["medium_correction"] or x["relative_washout"] else 5
                family = "range-floor-reversal" if x["range_floor"] else "trend-pullback" if x["trend_pullback"] else "capitulation-reversal" if x["strong_arm"] else "relative-washout" if x["relative_washout"] else "correction-reversal"
                e = self.buy = {"low": price, "low_row": i, "low_t": x["t"], "days": days, "family": family, "shock": x["shock"], "relative": x["relative_washout"], "broad": x["broad_arm"] and not x["strong_arm"] and not x["moderate_arm"], "locked": False, "slot": None}
            elif not e["locked"]:
                if x["strong_arm"]:
                    e["broad"], e["days"] = False, 8 if x["fall"] else 5
                elif x["moderate_arm"]:
                    e["broad"], e["shock"] = False, e["shock"] or x["shock"]
                    if x["medium_correction"] or x["relative_washout"]:
                        e["relative"], e["days"] = e["relative"] or x["relative_washout"], max(e["days"], patient)
                    if x["range_floor"]:
                        e["family"], e["days"] = "range-floor-reversal", max(e["days"], 12)
                    elif x["trend_pullback"]:
                        e["family"], e["days"] = "trend-pullback", max(e["days"], 8)
        # A locked episode follows the price down only while it is armed.
        if e and price < e["low"] and (x["buy_arm"] or not e["locked"]):
            e["low"], e["low_row"], e["low_t"] = price, i, x["t"]
        if e and not e["locked"] and i - e["low_row"] <= e["days"] and x["turned_up"]:
            at_once = e["broad"] or e["relative"]
            yield from self._give("buy", e, x["t"] if at_once else e["low_t"], e["low_t"], x["t"], "confirmation" if at_once else "turning-point", e["family"], price)
            if at_once or e["shock"]:
                e["locked"], e["confirmed"], e["signal_low"] = True, i, e["low"]

    def _selling(self, x: dict) -> Iterator[tuple]:
        i, price, e = x["i"], x["v"], self.sell
        old = x["old_sell"] and (self.last_old_sell is None or i - self.last_old_sell >= OLD_SELL_COOLDOWN)
        arm = (x["sell_arm"] or old) and (self.last_sell is None or i - self.last_sell >= SELL_COOLDOWN)
        if e:
            fall = (price / e["peak"] - 1) * 100
            confirmed = e["confirmed"]
            corrected = (not e["reaccelerated"] or confirmed is not None) and x["corrected"]
            after = confirmed is not None and i > confirmed
            completed = after and not e["old"] and (fall <= -max(6.0, 12 * x["f"]) if x["stock"] else fall <= -5 or (fall <= -3 and x["cycle_low"]))
            pulled_back = after and e["old"] and x["pulled_back"]
            renewed = confirmed is not None and i - confirmed >= 20 and x["shallow_cycle"]
            if corrected or completed or pulled_back or renewed:
                e = self.sell = None
        again = bool(x["stock"] and arm and e and e["confirmed"] is not None and i - e["confirmed"] >= SELL_COOLDOWN and price >= (e["confirmed_peak"] or e["peak"]) * REACCELERATION and x["change20"] >= 20 and x["volume_climax"] and (x["credit_driven"] or x["divergence"] or x["far_extended"]))
        if again:
            e = self.sell = None
        kinds = {"risk": x["credit_driven"] or x["clustered"], "distribution": x["distribution"], "mature": x["mature"], "calm": x["calm_top"], "ceiling": x["range_ceiling"], "exhaustion": x["trend_exhaustion"], "parabolic": x["parabolic"], "rotation": x["fear_rotation"], "old": old}
        if arm:
            family = "blowoff-exhaustion" if x["parabolic"] else "range-ceiling-rollover" if x["range_ceiling"] else "trend-exhaustion" if x["trend_exhaustion"] else "distribution-rollover" if x["distribution"] else None
            if e is None:
                e = self.sell = {"peak": price, "peak_row": i, "peak_t": x["t"], "family": family or ("crowding-rollover" if kinds["risk"] else "overheat-rollover"), "crowding": x["crowding"], "reaccelerated": again, "locked": False, "confirmed": None, "confirmed_peak": None, "slot": None, **kinds}
            else:
                e.update({c: e[c] or v for c, v in kinds.items()})
                e["family"] = family or e["family"]
                if not e["locked"] and (price >= e["peak"] or (price >= e["peak"] * NEAR_PEAK and x["crowding"] >= e["crowding"] + 0.05)):
                    e["peak"], e["peak_row"], e["peak_t"], e["crowding"] = price, i, x["t"], x["crowding"]
        if e is None:
            return
        if not e["locked"] and x["near_high"] and price > e["peak"]:
            e["peak"], e["peak_row"], e["peak_t"] = price, i, x["t"]
        fall = (price / e["peak"] - 1) * 100
        credit = (kinds["risk"] or e["risk"]) and x["credit_rollover"]
        if e["old"]:
            turned = x["old_rollover"] or (x["credit_spike"] and old)
        elif e["parabolic"] and x["parabolic"] and e["peak_row"] == i:
            turned = True
        else:
            turned = (x["rolled_over"] or credit) and (not x["stock"] or fall <= -4)
        limit = -2.5 if e["rotation"] else -2 if e["calm"] else -5 if e["mature"] else -2.5
        kind = e["distribution"] or e["mature"] or e["calm"] or e["rotation"] or e["ceiling"] or e["exhaustion"]
        left = x["stock"] and kind and fall <= limit and x["slope_down"] and (e["mature"] or x["osc_recent_positive"])
        days = 8 if e["rotation"] else 20 if e["mature"] else 15 if e["exhaustion"] else 12 if e["ceiling"] or e["calm"] else 8 if e["distribution"] else 3
        new_peak = e["confirmed"] is None or e["peak_row"] > e["confirmed"]
        if not e["locked"] and new_peak and i - e["peak_row"] <= days and (turned or left):
            yield from self._give("sell", e, e["peak_t"], e["peak_t"], x["t"], "rollover", e["family"], price)
            e["confirmed"], e["confirmed_peak"], e["locked"] = i, e["peak"], e["old"]
            self.last_sell = i
            if e["old"]:
                self.last_old_sell = i


def walked(walk: Walk, rows: pd.DataFrame, k) -> pd.DataFrame:
    """The changes of signals that rows of one series, in order of time, bring."""
    names = ["i", *BOOLEANS, *NUMBERS]
    dates = [str(t)[:10] for t in rows["t"]]
    columns = [rows[c].tolist() for c in names]
    out: list[tuple] = []
    for date, *values in zip(dates, *columns, strict=True):
        out += [(k, *change) for change in walk.row({"t": date, **dict(zip(names, values, strict=True))})]
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in SIGNALS.split(", ")])
    for c in ("t", "setup_t", "confirm_t"):
        frame[c] = pd.to_datetime(frame[c]).dt.date
    return frame


def signal_changes(rows: DataFrame) -> DataFrame:
    """All changes of signals of whole series. One series is a group: thirty years of days are 7,500 rows."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return walked(Walk(), group.sort_values("i"), key[0])

    return rows.groupBy("k").applyInPandas(run, SIGNALS.format(kind=dict(rows.dtypes)["k"]))


def standing(changes: DataFrame) -> DataFrame:
    """The signals that stand: the last change of each slot."""
    last = F.row_number().over(Window.partitionBy("k", "side", "slot").orderBy(F.desc("revision")))
    return changes.withColumn("_n", last).filter("_n = 1").drop("_n", "revision")


def detect_episodes(arms: DataFrame) -> DataFrame:
    """(k, side, slot, t, setup_t, confirm_t, mode, family, price): the signals of all series. arms: ``timing.signal_arms``."""
    return standing(signal_changes(reduced(arms)))
