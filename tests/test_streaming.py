"""Streaming operators: state rules over several micro-batches, stream = batch, restart."""

import datetime as dt
import os
import tempfile
import uuid

import pytest

from vigil.operators import windows as W
from vigil.operators.throttle import throttle_sink
from vigil.session import shared_dir
from vigil.streaming import streams as ST


def _drive(spark, df, mode="append"):
    name = "t_" + uuid.uuid4().hex[:8]
    ST.run_to_memory(df, name, shared_dir(spark, name), mode)
    return spark.table(name)


def _batches(spark, parts, schema, make_sink, states=0):
    """Feed each list of rows as one micro-batch; the rows of the sink's table."""
    d = tempfile.mkdtemp(prefix="vigil-batches-", dir="/tmp")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/in/p{i}")
        os.utime(next(f"{d}/in/p{i}/{x}" for x in os.listdir(f"{d}/in/p{i}") if x.endswith(".parquet")), (1e9 + i, 1e9 + i))
    src = (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
           .parquet(f"{d}/in"))
    sink = make_sink(f"{d}/out", *[f"{d}/state{k}" for k in range(states)])
    q = src.writeStream.foreachBatch(sink).option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(os.listdir(f"{d}/out")) == len(parts)
    # A replayed batch gives the same rows again.
    last = spark.createDataFrame(parts[-1], schema)
    before = sorted(map(str, spark.read.parquet(f"{d}/out").collect()))
    sink(last, len(parts) - 1)
    assert sorted(map(str, spark.read.parquet(f"{d}/out").collect())) == before
    return spark.read.parquet(f"{d}/out").collect()


CRON = "cron_file string, snapshot_ts timestamp, line_no long, line string"


@pytest.mark.parametrize("size", [1, 2, 5])
def test_cron_state_rule(spark, size):
    t0 = dt.datetime(2024, 1, 1)
    snaps = [
        ["* * * * * a", "# comment", "  # indented", ""],   # first: everything new
        ["* * * * * a"],                                     # removal only: nothing, state kept
        ["* * * * * a", "* * * * * b"],                      # b new -> state replaced
        ["* * * * * b"],                                     # nothing new
        ["* * * * * a", "* * * * * b"],                      # a re-added: new vs last changed? no
    ]
    rows = [[("/etc/crontab", t0 + dt.timedelta(days=i), j, ln) for j, ln in enumerate(s)] for i, s in enumerate(snaps)]
    parts = [[r for p in rows[i:i + size] for r in p] for i in range(0, 5, size)]
    got = sorted((r.snapshot_ts.day, r.job) for r in _batches(spark, parts, CRON, ST.cron_diff_sink, 1))
    assert got == [(1, ""), (1, "# indented"), (1, "* * * * * a"), (3, "* * * * * b")]


ALERT = "id long, user_name string, timestamp timestamp"


def test_throttle_greedy(spark):
    hours = [0, 3 + 59 / 60, 4, 7 + 59 / 60, 8]
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "a" if i < 5 else "b", t0 + dt.timedelta(hours=h)) for i, h in enumerate(hours + [0, 1])]
    per_user = lambda table: throttle_sink(table, by=["user_name"])
    for parts in ([rows], [rows[:2], rows[2:4], rows[4:]]):
        assert sorted(r.id for r in _batches(spark, parts, ALERT, per_user)) == [0, 2, 4, 5]
    # One throttle for all: the last pass is carried from batch to batch.
    for parts in ([rows[:5]], [rows[:1], rows[1:2], rows[2:3], rows[3:5]]):
        assert sorted(r.id for r in _batches(spark, parts, ALERT, throttle_sink)) == [0, 2, 4]


def test_upsert_carries_over_batches(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [[(1, "x", t0), (2, "x", t0)], [(3, "x", t0), (4, "x", t0 + dt.timedelta(seconds=1))], [(5, "x", t0)]]
    assert sorted(r.id for r in _batches(spark, rows, ALERT, ST.upsert_new_rows)) == [1, 4]


def test_file_changes_stream_equals_batch(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), f"/etc/f{i % 2}", m)
            for i, m in enumerate([5, 5, 3, 9, 7, 9, 8, 12, 12, 1])]
    schema = "id long, timestamp timestamp, file string, mtime_s long"
    want = sorted((r.file, r.mtime_s) for r in W.file_mod_changes(spark.createDataFrame(rows, schema)).collect())
    for size in (1, 3, 10):
        parts = [rows[i:i + size] for i in range(0, 10, size)]
        got = _batches(spark, parts, schema, ST.file_changes_sink, 1)
        assert sorted((r.file, r.mtime_s) for r in got) == want


@pytest.fixture(scope="module")
def layouts(spark):
    """The same ``events`` rows as one file and as a folder of parts."""
    d = tempfile.mkdtemp(prefix="vigil-layouts-", dir="/tmp")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.repartition(5).write.parquet(f"{d}/folder/events.parquet")
    for t in ("nation",):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{d}/folder/{t}.parquet")
    return "/root/testdata/sf0.001", f"{d}/folder"


STREAMS = ["stream_alerts", "stream_window_stats", "stream_first_seen_keys", "stream_window_totals", "stream_correlate",
           "stream_file_changes", "stream_cron_diff", "stream_throttle", "stream_throttle_keyed", "stream_upsert_new"]


@pytest.mark.parametrize("name", STREAMS)
def test_stream_queries_read_either_layout(spark, layouts, name):
    import __spark_entry__ as E

    one, many = (sorted(map(str, E.queries()[name](spark, d).collect())) for d in layouts)
    assert one == many and one


def test_stream_of_nothing_fails(spark):
    with pytest.raises(FileNotFoundError):
        ST.stream_table(spark, "/tmp/no-such-table.parquet", spark.range(1).schema)


def test_restart_from_checkpoint_first_seen(spark):
    d = tempfile.mkdtemp(prefix="vigil-restart-", dir="/tmp")
    schema = "id long, timestamp timestamp, command string"
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t0, "a"), (2, t0, "b")], schema).write.parquet(f"{d}/in/part1")
    ck, name = f"{d}/ck", "fs_" + uuid.uuid4().hex[:8]
    out = f"{d}/out"

    def run():
        src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/in")
        q = (ST.first_seen(src, ["command"]).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    spark.createDataFrame([(3, t0, "a"), (4, t0, "c")], schema).write.parquet(f"{d}/in/part2")
    run()  # restarts from the checkpoint: "a" is not reported again
    assert sorted(r.command for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_alerts_filter(spark):
    ev = spark.createDataFrame([("suspicious_command", "rm -rf x", None), ("network_event", None, 22),
                                ("network_event", None, 80), ("cron_event", None, None)],
                               "type string, command string, dst_port int")
    got = [r.alert for r in ST.alerts(ev).collect()]
    assert got == ["ALERT: Suspicious command detected - rm -rf x", "ALERT: Suspicious network activity on port 22"]


def test_stream_events_route_and_quarantine(spark):
    import json

    d = tempfile.mkdtemp(prefix="vigil-ndjson-", dir="/tmp")
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/a.ndjson", "w") as f:
        f.write(json.dumps({"type": "network_event", "timestamp": "2024-01-01T00:00:01", "dst_port": 23}) + "\n")
        f.write("not json\n\n")
        f.write(json.dumps({"timestamp": "2024-01-01 00:00:02", "job": "x"}) + "\n")
    ev = ST.stream_events(spark, f"{d}/in")
    q = ST.stream_route(ev, f"{d}/out", f"{d}/ck")
    q.awaitTermination()
    routed = spark.read.json(f"{d}/out/batch=*")
    assert [r.value for r in spark.read.text(f"{d}/out/_quarantine").collect()] == ["not json"]
    assert sorted(r.type for r in routed.collect()) == ["network_event", "unknown"]
    alerts = _drive(spark, ST.alerts(ST.stream_events(spark, f"{d}/in")))
    assert [r.alert for r in alerts.collect()] == ["ALERT: Suspicious network activity on port 23"]


def test_late_rows_dropped_and_counted(spark):
    d = tempfile.mkdtemp(prefix="vigil-late-", dir="/tmp")
    schema = "id long, timestamp timestamp, src_ip string, dst_ip string, dst_port int, bytes_sent long"
    t0 = dt.datetime(2024, 1, 1, 1, 0)
    spark.createDataFrame([(1, t0, "a", "b", 1, 10)], schema).write.parquet(f"{d}/in/p1")
    ck, out = f"{d}/ck", f"{d}/out"

    def run():
        src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/in")
        q = (ST.window_stats(src).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return q

    run()
    spark.createDataFrame([(2, t0 - dt.timedelta(hours=1), "a", "b", 1, 10)], schema).write.parquet(f"{d}/in/p2")
    q = run()
    assert ST.late_rows(q) == 1


def test_size_column(spark):
    from vigil.operators.features import size_column

    assert size_column(spark.createDataFrame([(1.0, 2.0)], "memory double, cpu double")) == "cpu"
    assert size_column(spark.createDataFrame([(1,)], "x int")) is None


def _greedy(times, gap):
    out, last = [], None
    for i, t in sorted(enumerate(times), key=lambda x: (x[1], x[0])):
        if last is None or t - last >= gap:
            out.append(i)
            last = t
    return sorted(out)


def test_distributed_throttle_matches_sequential(spark):
    import random

    from vigil.operators.throttle import throttle_batch

    hours = [0, 3 + 59 / 60, 4, 7 + 59 / 60, 8]
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t0 + dt.timedelta(hours=h)) for i, h in enumerate(hours)],
                               "id long, timestamp timestamp")
    assert sorted(r.id for r in throttle_batch(df).collect()) == [0, 2, 4]
    rnd = random.Random(11)
    times = [t0 + dt.timedelta(seconds=rnd.randint(0, 20 * 24 * 3600)) for _ in range(600)]
    times += [t0 + dt.timedelta(days=3, seconds=rnd.randint(0, 600)) for _ in range(200)]  # hot burst
    df = spark.createDataFrame(list(enumerate(times)), "id long, timestamp timestamp")
    assert sorted(r.id for r in throttle_batch(df).collect()) == _greedy(times, dt.timedelta(hours=4))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(r.id for r in throttle_batch(df).collect()) == _greedy(times, dt.timedelta(hours=4))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_upsert_skips_stored_and_duplicate_keys(spark):
    d = tempfile.mkdtemp(prefix="vigil-upsert-", dir="/tmp")
    schema = "id long, timestamp timestamp, command string"
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t0, "a"), (2, t0, "b"), (3, t0 + dt.timedelta(seconds=1), "c")],
                          schema).write.parquet(f"{d}/in/p1")
    table, ck = f"{d}/table", f"{d}/ck"

    def run():
        src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/in")
        q = (src.writeStream.foreachBatch(ST.upsert_new_rows(table)).option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    spark.createDataFrame([(4, t0 + dt.timedelta(seconds=1), "dup"), (5, t0 + dt.timedelta(seconds=2), "d")],
                          schema).write.parquet(f"{d}/in/p2")
    run()
    got = sorted((r.id, r.command) for r in spark.read.parquet(table).collect())
    assert got == [(1, "a"), (3, "c"), (5, "d")]


def test_ingest_application_end_to_end(spark):
    import json

    from vigil.streaming.ingest import await_all, start_ingest

    d = tempfile.mkdtemp(prefix="vigil-ingest-", dir="/tmp")
    os.makedirs(f"{d}/in")
    ev = [
        {"type": "suspicious_command", "timestamp": "2024-01-01T00:00:01", "user": "r", "command": "nc -e sh", "pid": 7},
        {"type": "suspicious_command", "timestamp": "2024-01-01T00:00:01", "user": "r", "command": "dup ts", "pid": 8},
        {"type": "network_event", "timestamp": "2024-01-01T00:00:02", "src_ip": "1.1.1.1", "dst_ip": "2.2.2.2",
         "src_port": 40000, "dst_port": 22, "flags": "S"},
        {"type": "cron_event", "timestamp": "2024-01-01T00:00:03", "cron_file": "/etc/crontab", "job": "* * * * * x"},
    ]
    with open(f"{d}/in/a.ndjson", "w") as f:
        for e in ev:
            f.write(json.dumps(e) + "\n")
        f.write("{broken\n")
    await_all(start_ingest(spark, f"{d}/in", f"{d}/out", f"{d}/ck"))
    cmds = spark.read.parquet(f"{d}/out/tables/commands").collect()
    assert [(r.command, r.pid) for r in cmds] == [("nc -e sh", 7)]       # first row per timestamp kept
    assert spark.read.parquet(f"{d}/out/tables/network").count() == 1
    assert sorted(r.alert for r in spark.read.parquet(f"{d}/out/alerts").collect()) == [
        "ALERT: Suspicious command detected - dup ts", "ALERT: Suspicious command detected - nc -e sh",
        "ALERT: Suspicious network activity on port 22"]
    assert [r.value for r in spark.read.text(f"{d}/out/routed/_quarantine").collect()] == ["{broken"]
    # A second file with an already stored timestamp adds nothing to the table (restart from checkpoints).
    with open(f"{d}/in/b.ndjson", "w") as f:
        f.write(json.dumps({**ev[0], "command": "later same ts"}) + "\n")
    await_all(start_ingest(spark, f"{d}/in", f"{d}/out", f"{d}/ck"))
    assert spark.read.parquet(f"{d}/out/tables/commands").count() == 1


def test_ingested_tables_feed_the_analytics(spark):
    """Files -> tables with the stored schema -> incidents and features; a time window prunes date folders."""
    import json

    from vigil.operators import clean as C
    from vigil.operators import detect as D
    from vigil.operators import features as M
    from vigil.sources import schemas
    from vigil.streaming.ingest import await_all, start_ingest

    d = tempfile.mkdtemp(prefix="vigil-analytics-", dir="/tmp")
    os.makedirs(f"{d}/events")
    os.makedirs(f"{d}/process")
    with open(f"{d}/events/a.ndjson", "w") as f:
        for i in range(12):
            f.write(json.dumps({"type": "network_event", "timestamp": f"2024-01-{1 + i // 4:02d}T00:00:{i:02d}", "src_ip": "9.9.9.9",
                                "dst_ip": "192.168.154.133", "src_port": 40000, "dst_port": 100 + i, "flags": "S"}) + "\n")
    line = "2024-01-0{d} 10:00:0{s},{p},root,{c},40.0,100,10,1,S,0:01.00,nc -lvnp {p},{h}\n"
    with open(f"{d}/process/a.csv", "w") as f:
        f.write("Timestamp,PID,User,CPU,Memory,VIRT,RES,SHR,S,Time Used,Command,Hashed Command\n")
        for i in range(6):
            f.write(line.format(d=1 + i // 2, s=i, p=i, c=float(i), h="ab" * 32))
        f.write("broken line\n")
    await_all(start_ingest(spark, f"{d}/events", f"{d}/out", f"{d}/ck", process_dir=f"{d}/process"))
    process, network = (spark.read.parquet(f"{d}/out/tables/{t}") for t in ("process", "network"))
    assert [c for c in process.columns if c not in ("event_date", "batch_id")] == schemas.PROCESS.names
    assert network.select("id").distinct().count() == 12 and process.filter("id is null").count() == 0
    assert [r.value for r in spark.read.text(f"{d}/out/process_quarantine").collect()] == ["broken line"]
    kinds = {r.type for r in D.detect_incidents(network, process).collect()}
    assert {"Multiple Ports Accessed", "High Memory Process", "Suspicious Process"} <= kinds
    feats = M.behavior_features(M.preprocess_process(process))
    assert feats.count() == 6 and feats.filter("cpu_rolling_mean is null").count() == 0
    recent = C.fetch_window(process, 24)
    assert recent.count() == 2
    plan = recent._jdf.queryExecution().executedPlan().toString()
    # The scan of the rows, not the one behind the newest time.
    assert any("event_date" in p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:])
