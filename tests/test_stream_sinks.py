"""Sinks over several micro-batches: upsert with a key index, window versions, late rows kept."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1)
ROW = "timestamp timestamp, v int"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture()
def d():
    return tempfile.mkdtemp(prefix="vigil-sinks-", dir="/tmp")


def test_upsert_opens_only_folders_that_meet_the_batch(spark, d):
    sink = ST.upsert_new_rows(f"{d}/t", order=["v"])
    sink(spark.createDataFrame([(at(k), k) for k in range(10)], ROW), 0)
    sink(spark.createDataFrame([(at(k), k) for k in range(100, 110)], ROW), 1)
    # Batch 0 holds no key of the next batch's range: its files may even be unreadable.
    for name in os.listdir(f"{d}/t/batch_id=0"):
        if name.endswith(".parquet"):
            with open(f"{d}/t/batch_id=0/{name}", "wb") as f:
                f.write(b"not parquet")
    for crc in [n for n in os.listdir(f"{d}/t/batch_id=0") if n.endswith(".crc")]:
        os.unlink(f"{d}/t/batch_id=0/{crc}")
    sink(spark.createDataFrame([(at(105), -1), (at(200), 1), (at(200), 0), (None, 5)], ROW), 2)
    rows = spark.read.parquet(f"{d}/t/batch_id=2").collect()
    assert [(r.timestamp, r.v) for r in rows] == [(at(200), 0)]
    sink(spark.createDataFrame([], ROW), 3)
    sink(spark.createDataFrame([(at(105), -1), (at(200), 1), (at(200), 0), (None, 5)], ROW), 2)  # replayed
    assert [(r.timestamp, r.v) for r in spark.read.parquet(f"{d}/t/batch_id=2").collect()] == [(at(200), 0)]


def test_ids_are_unique_over_many_tasks_and_batches(spark, d):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("timestamp", T.TimestampType())])
    sink = ST.upsert_new_rows(f"{d}/t", order=["_seq"], schema=schema)
    for k in range(2):
        rows = spark.range(k * 5000, k * 5000 + 5000, 1, 2500).select(
            (F.lit(T0) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp").alias("timestamp"))
        sink(rows, k)
    got = spark.read.schema("id long, timestamp timestamp, batch_id long").parquet(f"{d}/t")
    assert got.count() == 10_000 == got.select("id").distinct().count()
    ends = got.groupBy("batch_id").agg(F.min("id"), F.max("id")).orderBy("batch_id").collect()
    assert [tuple(r)[1:] for r in ends] == [(0, 4999), (1 << 40, (1 << 40) + 4999)]


def stream(spark, d, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/in/p{i}")
        os.utime(next(f"{d}/in/p{i}/{x}" for x in os.listdir(f"{d}/in/p{i}") if x.endswith(".parquet")), (1e9 + i, 1e9 + i))
    return (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
            .parquet(f"{d}/in"))


NET = "timestamp timestamp, src_ip string, dst_ip string, dst_port int, bytes_sent long"


def test_newest_window_versions_equal_the_batch_result(spark, d):
    parts = [[(at(k), f"s{k % 2}", "d", k, 10) for k in range(b * 4, b * 4 + 9)] for b in range(3)]
    ST.run_to_table(ST.window_stats(stream(spark, d, parts, NET)), f"{d}/out", f"{d}/ck", "update")
    rows = [r for p in parts for r in p]
    want = {}
    for t, s, _, _, n in rows:
        key = (T0 + dt.timedelta(minutes=5 * ((t - T0).seconds // 300)), s)
        want[key] = (want.get(key, (0, 0))[0] + n, want.get(key, (0, 0))[1] + 1)
    got = ST.latest_windows(spark, f"{d}/out")
    assert {(r.time_window, r.src_ip): (r.bytes_sent, r.events) for r in got.collect()} == want  # the last interval too
    assert spark.read.parquet(f"{d}/out").count() > len(want)
    ST.compact_windows(spark, f"{d}/out", f"{d}/small")
    assert sorted(map(str, ST.latest_windows(spark, f"{d}/small").collect())) == sorted(map(str, got.collect()))
    assert spark.read.parquet(f"{d}/small").count() == len(want)


def test_late_rows_are_kept(spark, d):
    parts = [[(at(60), 1), (at(5), 2)], [(at(55), 3), (at(49), 4), (at(90), 5), (None, 6)], [(at(79), 7), (at(80), 8), (at(10), 9)]]
    sink = ST.split_late(ST.upsert_new_rows(f"{d}/out", order=["v"]), f"{d}/late")
    stream(spark, d, parts, ROW).writeStream.foreachBatch(sink).option("checkpointLocation", f"{d}/ck").trigger(
        availableNow=True).start().awaitTermination()
    late = {r.v for r in spark.read.parquet(f"{d}/late").collect()}
    assert late == {4, 7, 9}  # older than the greatest time of the batches before less ten minutes
    on_time = {r.v for r in spark.read.parquet(f"{d}/out").collect()}
    assert on_time == {1, 2, 3, 5, 8}  # the sink itself leaves out rows without a time
    sink(spark.createDataFrame(parts[2], ROW), 2)  # replayed: split alike
    assert {r.v for r in spark.read.parquet(f"{d}/late").collect()} == late


def test_on_time_and_late_rows_are_the_input(spark, d):
    kept = []
    sink = ST.split_late(lambda rows, batch_id: kept.extend(r.v for r in rows.collect()), f"{d}/late")
    parts = [[(at(60 * b + m), 100 * b + m) for m in range(0, 60, 7)] + [(at(m), 1000 + 100 * b + m) for m in range(3)] for b in range(3)]
    for b, rows in enumerate(parts):
        sink(spark.createDataFrame(rows, ROW), b)
    late = [r.v for r in spark.read.parquet(f"{d}/late").collect()]
    assert sorted(kept + late) == sorted(v for p in parts for _, v in p) and len(late) == 6
