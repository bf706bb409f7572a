"""Keyed state with timers: deposits that evaporate, agents that go idle.

Both run as stateful processors over a stream and as folds over a table, with the same results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loam.functions.dynamics import CEILING, DECAY_RATES, FLOOR

#: Milliseconds of a tick.
TICK = 86_400_000
RATE = DECAY_RATES["exploration"]
_DEPOSITS = "drawer_id long, tag string, tick long, value double"


def decayed(events: DataFrame, rate: float = RATE) -> DataFrame:
    """events (drawer_id, tag, tick, seq, amount) -> (drawer_id, tag, tick, value): each deposit as it was left by its last event.

    Between events it loses ``rate`` of itself a tick, and is gone below the floor; the first amount, and the first after it has
    gone, counts from 0 to 1, later ones add up to the ceiling.  Events of one tick go by seq.  One aggregate over a key's own
    ordered events.
    """
    key = events.groupBy("drawer_id", "tag").agg(F.array_sort(F.collect_list(F.struct("tick", "seq", F.col("amount").cast("double").alias("amount")))).alias("e"))

    def step(acc: Column, e: Column) -> Column:
        v = acc["value"] * F.pow(F.lit(1 - rate), e["tick"] - acc["tick"])
        fresh = acc["value"].isNull() | (v < FLOOR)
        return F.struct(e["tick"].alias("tick"), F.when(fresh, F.least(F.greatest(e["amount"], F.lit(0.0)), F.lit(1.0))).otherwise(F.least(v + e["amount"], F.lit(CEILING))).alias("value"))

    start = F.struct(F.lit(0).cast("long").alias("tick"), F.lit(None).cast("double").alias("value"))
    return key.select("drawer_id", "tag", F.aggregate("e", start, step).alias("s")).select("drawer_id", "tag", "s.tick", "s.value")


def at_tick(deposits: DataFrame, tick: Column, rate: float = RATE) -> DataFrame:
    """What decayed() left, as it stands at a later tick; what has gone is left out."""
    v = F.col("value") * F.pow(F.lit(1 - rate), tick - F.col("tick"))
    return deposits.select("drawer_id", "tag", v.alias("value")).where(F.col("value") >= FLOOR)


class Decay(StatefulProcessor):
    """decayed() over a stream: a value and its tick for each key, and a timer for the tick at which it is gone."""

    def __init__(self, rate: float = RATE):
        self.rate = rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value double, tick long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        v, at = self.held.get() if self.held.exists() else (None, 0)
        for tick, _, amount in sorted(x for pdf in rows for x in zip(pdf.tick, pdf.seq, pdf.amount, strict=True)):
            left = None if v is None else v * (1 - self.rate) ** (tick - at)
            v = min(max(float(amount), 0.0), 1.0) if left is None or left < FLOOR else min(left + float(amount), CEILING)
            at = int(tick)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.held.update((v, at))
        gone = at + (math.floor(math.log(FLOOR / v) / math.log(1 - self.rate)) + 1 if v > FLOOR else 1)
        self.handle.registerTimer(gone * TICK)
        yield pd.DataFrame([(*key, at, v)], columns=["drawer_id", "tag", "tick", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame([(*key, expiredTimerInfo.getExpiryTimeInMs() // TICK, 0.0)], columns=["drawer_id", "tag", "tick", "value"])

    def close(self) -> None:
        pass


def decaying(events: DataFrame, late: str = "1 day", rate: float = RATE) -> DataFrame:
    """A stream of events (drawer_id, tag, ts, seq, amount) as changes (drawer_id, tag, tick, value); 0 when a deposit has gone.
    A tick is a day of UTC.  A micro-batch's rows of a key are put in order; rows later than ``late`` are dropped.  Needs the RocksDB state store."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("tick", F.floor(F.unix_millis("ts") / TICK)).withWatermark("ts", late)
    return rows.groupBy("drawer_id", "tag").transformWithStateInPandas(Decay(rate), _DEPOSITS, "Update", "EventTime")
