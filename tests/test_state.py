"""Deposits that evaporate: the stream against the fold."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loam.streaming import state

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_fold_equals_plain_version(spark):
    r = random.Random(1)
    rows = [(r.randrange(4), r.choice("ab"), r.randrange(400), i, round(r.uniform(-1, 3), 2)) for i in range(120)]
    want = {}
    for d, t, tick, _, a in sorted(rows, key=lambda x: (x[2], x[3])):
        v, at = want.get((d, t), (None, 0))
        left = None if v is None else v * 0.9 ** (tick - at)
        want[d, t] = (min(max(a, 0.0), 1.0) if left is None or left < 1e-4 else min(left + a, 5.0), tick)
    df = spark.createDataFrame(rows, "drawer_id long, tag string, tick long, seq long, amount double").repartition(3)
    got = {(x.drawer_id, x.tag): (x.value, x.tick) for x in state.decayed(df, 0.1).collect()}
    assert got == {k: (pytest.approx(v), t) for k, (v, t) in want.items()}
    left = {(x.drawer_id, x.tag): x.value for x in state.at_tick(state.decayed(df, 0.1), F.lit(410), 0.1).collect()}
    assert left == {k: pytest.approx(v * 0.9 ** (410 - t)) for k, (v, t) in want.items() if v * 0.9 ** (410 - t) >= 1e-4}


def test_stream_equals_fold_and_timers_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    day = lambda n: datetime(2024, 1, 1, 6, tzinfo=UTC) + timedelta(days=n)
    r = random.Random(2)
    kind = "drawer_id long, tag string, ts timestamp, seq long, amount double"
    batches = [[(r.randrange(3), "a", day(n + r.randrange(3)), 10 * n + i, round(r.uniform(0.2, 2), 2)) for i in range(4)] for n in (0, 3, 6)] + [[(7, "late", day(400), 9999, 1.0)], [(7, "late", day(401), 10_000, 1.0)]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, kind).coalesce(1).write.parquet(f"{tmp_path}/src/{k}")
        s = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/src")
        q = state.decaying(s).writeStream.outputMode("update").foreachBatch(lambda df, i, k=k: df.write.mode("append").parquet(f"{tmp_path}/out/{k}")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    epoch = (day(0).date() - datetime(1970, 1, 1).date()).days
    rows = [(d, t, (ts.date() - day(0).date()).days + epoch, seq, a) for b in batches for d, t, ts, seq, a in b]
    want = {(x.drawer_id, x.tag): (x.tick, x.value) for x in state.decayed(spark.createDataFrame(rows, "drawer_id long, tag string, tick long, seq long, amount double")).collect()}
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").collect()
    last = {}
    for x in sorted(out, key=lambda x: x.tick):
        if x.value > 0:
            last[x.drawer_id, x.tag] = (x.tick, x.value)
    assert last == {k: (t, pytest.approx(v)) for k, (t, v) in want.items()}
    gone = {(x.drawer_id, x.tag): x.tick for x in out if x.value == 0}
    assert gone and set(gone) == {k for k in want if k != (7, "late")}
    for k, t in gone.items():
        tick, v = want[k]
        assert v * 0.95 ** (t - tick) < 1e-4 <= v * 0.95 ** (t - 1 - tick)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
