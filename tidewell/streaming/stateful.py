"""Streams that keep a state by key: episodes, journals that wait for prices, and the health of sources."""

from __future__ import annotations

import contextlib
import datetime
import json
import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import episodes
from .streams import shared_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB while queries are started, as processors of keyed state need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class EpisodeWalker(StatefulProcessor):
    """Walks each series on from where its state stands; a series without rows for a while gives its state up."""

    def __init__(self, idle_days: int):
        self.idle = datetime.timedelta(days=idle_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.walk = handle, handle.getValueState("walk", "state string, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.walk.get() if self.walk.exists() else (None, -1)
        walk = episodes.Walk(held[0])
        part = pd.concat(list(rows)).sort_values("i")
        # Rows that were walked already, as a source may repeat them, change nothing.
        part = part[part["i"] > held[1]].drop_duplicates("i")
        changes = episodes.walked(walk, part, key[0])
        if len(part):
            self.walk.update((walk.dump(), int(part["i"].iloc[-1])))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            last = datetime.datetime.fromisoformat(str(part["t"].iloc[-1])[:10]).replace(tzinfo=datetime.UTC)
            self.handle.registerTimer(int((last + self.idle).timestamp() * 1000))
        yield changes

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.walk.clear()
        return iter([])

    def close(self) -> None:
        pass


def episode_changes(rows: DataFrame, idle_days: int = 400, delay: str = "10 days") -> DataFrame:
    """Changes of signals of a stream of ``episodes.reduced`` rows, in which a series' rows come in order but for those of one batch."""
    kind = dict(rows.dtypes)["k"]
    timed = rows.withColumn("ts", F.col("t").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("k").transformWithStateInPandas(EpisodeWalker(idle_days), episodes.SIGNALS.format(kind=kind), "Append", "EventTime")


def in_landings(rows: DataFrame, cuts: list[str], transform, purpose: str = "landings") -> DataFrame:
    """What a stream gives whose source lands in parts, cut at dates; the query stops after each part and goes on from its checkpoint."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    out = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows.filter((F.lit(True) if low is None else F.col("t") >= low) & (F.lit(True) if high is None else F.col("t") < high))
        part.write.mode("append").parquet(folder + "/in")
        with keyed_state(spark):
            stream = transform(spark.readStream.schema(rows.schema).parquet(folder + "/in"))
            out = stream.schema
            query = stream.writeStream.outputMode("append").format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/log").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(out).parquet(folder + "/out")


# Seconds until a failed source is tried again, doubled with each failure up to a limit.
RETRY_SECONDS, RETRY_DOUBLINGS, RETRY_MOST = 30, 4, 300
LEDGER = "k {kind}, id long, ts timestamp, state string, failures int, last_success timestamp, last_failure timestamp, next_attempt timestamp"


class SourceLedger(StatefulProcessor):
    """What each attempt at a source leaves: whether it is ready, stale (it was good once) or in error, and when to try again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("health", "failures int, last_success timestamp, last_failure timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        failures, good, bad = self.held.get() if self.held.exists() else (0, None, None)
        out = []
        for row in pd.concat(list(rows)).sort_values(["ts", "id"]).itertuples():
            at = row.ts.to_pydatetime()
            if row.ok:
                failures, good, again = 0, at, None
            else:
                failures, bad = failures + 1, at
                again = at + datetime.timedelta(seconds=min(RETRY_MOST, RETRY_SECONDS * 2 ** min(RETRY_DOUBLINGS, failures - 1)))
            out.append((key[0], row.id, at, "ready" if row.ok else "stale" if good else "error", failures, good, bad, again))
        self.held.update((failures, good, bad))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER.split(", ")])
        for c in ("ts", "last_success", "last_failure", "next_attempt"):
            frame[c] = pd.to_datetime(frame[c])
        yield frame

    def close(self) -> None:
        pass


def source_ledger(attempts: DataFrame) -> DataFrame:
    """The ledger of a stream of attempts (k, id, ts, ok)."""
    return attempts.groupBy("k").transformWithStateInPandas(SourceLedger(), LEDGER.format(kind=dict(attempts.dtypes)["k"]), "Append", "None")


SCORES = "k {kind}, id long, as_of date, target_t date, actual_t date, actual double, error double, signed double, direction_right boolean, covered boolean, momentum_error double, no_change_error double"


class JournalScorer(StatefulProcessor):
    """Keeps forecasts until a price on or after their target comes, or until none can that is still on time."""

    def __init__(self, late: int):
        self.late = datetime.timedelta(days=late)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.pending = handle, handle.getValueState("pending", "forecasts string")

    def _expiry(self, target: str) -> int:
        """The first time at which no price for the target is on time."""
        day = datetime.datetime.fromisoformat(target).replace(tzinfo=datetime.UTC)
        return int((day + self.late + datetime.timedelta(days=1)).timestamp() * 1000)

    def _held(self) -> dict[str, dict]:
        return json.loads(self.pending.get()[0]) if self.pending.exists() else {}

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCORES.split(", ")])
        for c in ("as_of", "target_t", "actual_t"):
            frame[c] = pd.to_datetime(frame[c]).dt.date
        return frame

    @staticmethod
    def _score(k, f: dict, t: str | None, v: float | None) -> tuple:
        if t is None:
            return k, f["id"], f["as_of"], f["target"], None, *[None] * 7
        actual = math.log(v / f["base"])
        sign = lambda x: (x > 0) - (x < 0)
        return k, f["id"], f["as_of"], f["target"], t, actual, abs(f["predicted"] - actual), f["predicted"] - actual, sign(f["predicted"]) == sign(actual), f["low"] <= actual <= f["high"], abs(f["momentum"] - actual), abs(actual)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, out = self._held(), []
        # Of one day forecasts come first; their targets lie ahead.
        for row in pd.concat(list(rows)).sort_values(["t", "is_price"], kind="stable").itertuples():
            t = str(row.t)[:10]
            if not row.is_price:
                target = str(row.target_t)[:10]
                held[str(row.id)] = {"id": int(row.id), "as_of": t, "target": target, "base": row.v, "predicted": row.predicted, "low": row.low, "high": row.high, "momentum": row.momentum}
                continue
            for name in [n for n, f in held.items() if f["target"] <= t]:
                f = held.pop(name)
                late = datetime.date.fromisoformat(t) - datetime.date.fromisoformat(f["target"]) > self.late
                out.append(self._score(key[0], f, None if late else t, row.v))
        self._keep(held)
        yield self._frame(out)

    def _keep(self, held: dict[str, dict]) -> None:
        """The forecasts that wait, and one timer: for the first that can be given up."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer(min(self._expiry(f["target"]) for f in held.values()))
        self.pending.update((json.dumps(held),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # All that the watermark has passed go at once, not those of this timer alone.
        now, held = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), self._held()
        gone = [n for n, f in held.items() if self._expiry(f["target"]) <= now]
        out = [self._score(key[0], held.pop(n), None, None) for n in gone]
        self._keep(held)
        yield self._frame(out)

    def close(self) -> None:
        pass


def journal_events(journal: DataFrame, prices: DataFrame) -> DataFrame:
    """Forecasts (as ``outcomes.score_journal`` takes them) and prices (k, t, v) as rows of one kind, which a source can deliver as they come."""
    told = journal.select("k", F.col("as_of").alias("t"), F.lit(False).alias("is_price"), F.col("base").alias("v"), F.col("id").cast("long").alias("id"), "target_t", "predicted", "low", "high", "momentum")
    none = lambda kind: F.lit(None).cast(kind)
    seen = prices.select("k", "t", F.lit(True).alias("is_price"), "v", none("long").alias("id"), none("date").alias("target_t"), *[none("double").alias(c) for c in ("predicted", "low", "high", "momentum")])
    return told.unionByName(seen)


def journal_scores(events: DataFrame, late: int = 14, delay: str = "3 days") -> DataFrame:
    """Scores of a stream of ``journal_events``, each once its price is there or can't come any more."""
    timed = events.withColumn("ts", F.col("t").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("k").transformWithStateInPandas(JournalScorer(late), SCORES.format(kind=dict(events.dtypes)["k"]), "Append", "EventTime")
