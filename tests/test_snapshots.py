"""The versioned sink and source."""

import glob

import pytest
from pyspark.sql import functions as F

from loam.sources.snapshots import Folder, Snapshots


@pytest.fixture
def table(spark, tmp_path):
    spark.dataSource.register(Snapshots)
    return f"file://{tmp_path}/t"


def put(df, uri, mode="append"):
    df.write.format("snapshots").option("path", uri).mode(mode).save()


def test_versions_and_round_trip(spark, table):
    a = spark.createDataFrame([(1, "x", [1.5], None), (2, None, [], {"k": 1})], "id long, t string, v array<double>, m map<string,int>").repartition(3)
    put(a, table)
    put(a.withColumn("id", F.col("id") + 10), table)
    put(a.limit(1), table, "overwrite")
    read = lambda **o: spark.read.format("snapshots").option("path", table).options(**o).load()
    assert [read(version=v).count() for v in (1, 2, 3)] == [2, 4, 1] and read().count() == 1
    assert sorted(map(str, read(version=1).collect())) == sorted(map(str, a.collect())) and read().schema == a.schema
    put(a.limit(0), table)
    assert read().count() == 1 and Folder(table).latest() == 4
    with pytest.raises(RuntimeError):
        Folder(table).put({"version": 2})


def test_a_failed_job_leaves_nothing(spark, table, tmp_path):
    put(spark.range(5), table)
    files = set(glob.glob(f"{tmp_path}/t/data/*"))
    broken = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 990, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        put(broken, table)
    assert set(glob.glob(f"{tmp_path}/t/data/*")) == files and Folder(table).latest() == 1
    assert spark.read.format("snapshots").option("path", table).load().count() == 5


def test_a_stream_goes_on_where_it_ended(spark, table, tmp_path):
    put(spark.range(0, 5), table)

    def run():
        s = spark.readStream.format("snapshots").option("path", table).load()
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        return sorted(r.id for r in spark.read.schema("id long").parquet(f"{tmp_path}/out").collect())

    assert run() == [0, 1, 2, 3, 4]
    put(spark.range(5, 7), table)
    put(spark.range(7, 9), table)
    assert run() == list(range(9))
    assert run() == list(range(9))
