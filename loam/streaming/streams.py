"""Structured Streaming: windows with late data, deposits, the safety machine, exploration feedback, cycles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp; without a zone it is read as the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total): tumbling windows; rows later than ``late`` are dropped."""
    w = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


_FSM = "user_id long, state string, total int, errors int, anomalies int"


def safety_machine(ops: DataFrame) -> DataFrame:
    """ops (user_id, ts, event_id, kind): the machine's state per user after each micro-batch."""
    from loam.operators.safety import ANOMALY_RATE, ERROR_RATE, MAX_DEGRADED, MIN_OPS

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        st, deg, n, err, odd = state.get if state.exists else ("BOOT", 0, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in rows.kind:
            n, err, odd = n + 1, err + (kind == "error"), odd + (kind == "anomaly")
            many = n >= MIN_OPS
            bad = many and err / n > ERROR_RATE
            if st == "EMERGENCY_STOP":
                continue
            if many and odd / n > ANOMALY_RATE:
                st = "EMERGENCY_STOP"
            elif st == "BOOT":
                st = "NOMINAL"
            elif st == "NOMINAL" and bad:
                st, deg = "DEGRADED", 1
            elif st == "DEGRADED":
                deg += 1
                if bad:
                    st = "SAFE_MODE" if deg > MAX_DEGRADED else st
                elif many:
                    st, deg = "NOMINAL", 0
        state.update((st, deg, n, int(err), int(odd)))
        yield pd.DataFrame([(key[0], st, n, int(err), int(odd))], columns=["user_id", "state", "total", "errors", "anomalies"])

    return ops.groupBy("user_id").applyInPandasWithState(run, _FSM, "state string, degraded int, total int, errors int, anomalies int", "update", GroupStateTimeout.NoTimeout)


def deposits(events: DataFrame) -> DataFrame:
    """events (drawer_id, tag, ts, seq, amount): value per (drawer, tag), capped in order."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        v = state.get[0] if state.exists else None
        for a in pd.concat(list(frames)).sort_values("seq").amount:
            v = min(max(float(a), 0.0), 1.0) if v is None else min(v + float(a), 5.0)
        state.update((v,))
        yield pd.DataFrame([(key[0], key[1], v)], columns=["drawer_id", "tag", "value"])

    return events.groupBy("drawer_id", "tag").applyInPandasWithState(run, "drawer_id long, tag string, value double", "value double", "update", GroupStateTimeout.NoTimeout)


def exploration(yields: DataFrame) -> DataFrame:
    """yields (key, seq, value): the clamped exploration ratio, with the last two yields as state."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        e, a, b = state.get if state.exists else (0.5, -1.0, -1.0)
        for c in pd.concat(list(frames)).sort_values("seq").value:
            if a >= 0:
                if c <= b <= a and a > 0:
                    e = min(e + 0.1, 0.9)
                elif c > b:
                    e = max(e - 0.05, 0.1)
            a, b = b, float(c)
        state.update((e, a, b))
        yield pd.DataFrame([(key[0], e)], columns=["key", "explore"])

    return yields.groupBy("key").applyInPandasWithState(run, "key long, explore double", "explore double, a double, b double", "update", GroupStateTimeout.NoTimeout)


def run_cycles(observations: DataFrame, cycle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """One micro-batch is one cycle: ``cycle`` gets its rows and its number; ends when the input is used up."""
    return observations.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there into an in-memory table; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
