"""The safety controller: breaker rates, the state machine as an ordered fold, its audit log, and the transfer ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Thresholds of the state machine.
ERROR_RATE, ANOMALY_RATE, MAX_DEGRADED, MIN_OPS = 0.1, 0.25, 10, 5


def breaker_rates(ops: DataFrame, key: str) -> DataFrame:
    """ops (key, kind in ok, error, anomaly): rates of each key."""
    n = F.count("*")
    return ops.groupBy(key).agg(n.alias("total"), (F.count_if(F.col("kind") == "error") / n).alias("error_rate"), (F.count_if(F.col("kind") == "anomaly") / n).alias("anomaly_rate"))


def transition(s: Column, kind: Column) -> Column:
    """One operation and one tick after it: struct(state, degraded, total, errors, anomalies)."""
    total, errors, anomalies = s["total"] + 1, s["errors"] + (kind == "error").cast("int"), s["anomalies"] + (kind == "anomaly").cast("int")
    enough = total >= MIN_OPS
    bad, odd = enough & (errors / total > ERROR_RATE), enough & (anomalies / total > ANOMALY_RATE)
    st, d = s["state"], s["degraded"]
    state = (
        F.when(st == "EMERGENCY_STOP", st).when(odd, "EMERGENCY_STOP").when(st == "BOOT", "NOMINAL").when((st == "NOMINAL") & bad, "DEGRADED")
        .when((st == "DEGRADED") & bad & (d + 1 > MAX_DEGRADED), "SAFE_MODE").when((st == "DEGRADED") & ~bad & enough, "NOMINAL").otherwise(st)
    )
    moved = (st != "EMERGENCY_STOP") & ~odd
    degraded = F.when(moved & (st == "NOMINAL") & bad, 1).when(moved & (st == "DEGRADED") & ~bad & enough, 0).when(moved & (st == "DEGRADED"), d + 1).otherwise(d)
    return F.struct(state.alias("state"), degraded.cast("int").alias("degraded"), total.cast("int").alias("total"), errors.cast("int").alias("errors"), anomalies.cast("int").alias("anomalies"))


def start() -> Column:
    return F.struct(F.lit("BOOT").alias("state"), *[F.lit(0).alias(c) for c in ("degraded", "total", "errors", "anomalies")])


def final_state(ops: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """(key, state, total, errors, anomalies) after all operations of a key in order."""
    e = ops.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*seq, "kind"))).alias("e"))
    s = F.aggregate("e", start(), lambda acc, x: transition(acc, x["kind"]))
    return e.select(key, s.alias("s")).select(key, "s.state", "s.total", "s.errors", "s.anomalies")


def audit_log(ops: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """(key, n, event, from_state, to_state): every operation of a key, numbered from 1, with the state before and after it."""
    e = ops.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*seq, "kind"))).alias("e"))
    first = F.struct(start().alias("s"), F.array().cast("array<struct<event:string,from_state:string,to_state:string>>").alias("log"))

    def step(acc: Column, x: Column) -> Column:
        now = transition(acc["s"], x["kind"])
        return F.struct(now.alias("s"), F.array_append(acc["log"], F.struct(x["kind"].alias("event"), acc["s"]["state"].alias("from_state"), now["state"].alias("to_state"))).alias("log"))

    r = e.select(key, F.aggregate("e", first, step)["log"].alias("log"))
    return r.select(key, F.posexplode("log").alias("n", "l")).select(key, (F.col("n") + 1).alias("n"), "l.*")


# ---------------------------------------------------------------- ledger


def ledger_append(ledger: DataFrame, new: DataFrame, chain: int) -> DataFrame:
    """new (seq, op, amount, recipient) as pending transactions with the next nonces and their hashes."""
    from loam.operators.provenance import tx_hash

    top = ledger.agg(F.coalesce(F.max("nonce"), F.lit(0)).alias("__top"))
    n = new.join(F.broadcast(top)).withColumn("nonce", F.col("__top") + F.row_number().over(W.orderBy("seq")))
    made = n.select("nonce", "op", "amount", "recipient", tx_hash(F.lit(chain).cast("long"), F.col("nonce").cast("long"), F.col("op")).alias("hash"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("reason"))
    return ledger.unionByName(made)


def ledger_settle(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes (hash, ok, reason): the first transaction of a hash becomes confirmed or failed."""
    first = ledger.groupBy("hash").agg(F.min("nonce").alias("nonce"))
    o = outcomes.dropDuplicates(["hash"]).select("hash", F.col("ok").alias("__ok"), F.col("reason").alias("__r")).join(first, "hash")
    j = ledger.join(o, ["hash", "nonce"], "left")
    hit = F.col("__ok").isNotNull() & (F.col("status") == "pending")
    return j.withColumns({"reason": F.when(hit & ~F.col("__ok"), F.col("__r")).otherwise(F.col("reason")), "status": F.when(hit, F.when(F.col("__ok"), "confirmed").otherwise("failed")).otherwise(F.col("status"))}).select(*ledger.columns)


def ledger_status(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count_if(F.col("status") == "pending").alias("n_pending"), F.count_if(F.col("status") == "confirmed").alias("n_confirmed"))
