"""File sources, quarantine and sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from vigil import rules
from vigil.sources import files as FS
from vigil.sources import schemas

H = "a" * 64


def _tmp():
    return tempfile.mkdtemp(prefix="vigil-src-", dir="/tmp")


def test_process_csv_commas_header_and_bad_rows(spark):
    d = _tmp()
    lines = [",".join(rules.PROCESS_CSV_HEADER),
             f"2024-01-01 10:00:00,12,root,1.5,2.0,12m,1.2g,100,S,0:01.00,python3 -c print(1,2),{H}",
             f"2024-01-01 10:00:00,13,root,1.5,2.0,100,10,1,S,0:01.00,ls,{H}",
             "garbage,line",
             ""]
    with open(os.path.join(d, "p.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    df = FS.read_process_csv(spark, d)
    good, bad = FS.quarantine(df)
    rows = good.orderBy("_row").collect()
    assert [r.command for r in rows] == ["python3 -c print(1,2)", "ls"]
    assert rows[0].virt == 12288 and rows[0].res == 1258291
    assert [r._corrupt_record for r in bad.collect()] == ["garbage,line"]


def test_ndjson_bad_blank_and_missing_type(spark):
    d = _tmp()
    with open(os.path.join(d, "e.ndjson"), "w") as f:
        f.write(json.dumps({"type": "network_event", "timestamp": "2024-01-01T10:00:00.123456", "dst_port": 22}) + "\n")
        f.write("{not json\n\n")
        f.write(json.dumps({"timestamp": "2024-01-01T10:00:01", "command": "x"}) + "\n")
    df = FS.read_events_ndjson(spark, d)
    good, bad = FS.quarantine(df)
    typed = FS.typed_events(good).orderBy("_row").collect()
    assert [r.type for r in typed] == ["network_event", "unknown"]
    assert typed[0].timestamp.microsecond == 123456
    assert bad.count() == 1


def test_route_and_append_table(spark):
    d = _tmp()
    ev = spark.createDataFrame([("cron_event", "a"), (None, "b")], "type string, job string")
    FS.route_events(ev, f"{d}/routed", F.lit("2024-01-01").cast("date"))
    back = spark.read.json(f"{d}/routed")
    assert sorted(r.type for r in back.collect()) == ["cron_event", "unknown"]
    rows = spark.createDataFrame([(1, "2024-01-02 03:04:05", "x")], "id long, timestamp string, command string")
    FS.append_table(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")), f"{d}/cmds",
                    schemas.COMMANDS)
    t = spark.read.parquet(f"{d}/cmds")
    assert t.filter("event_date = '2024-01-02'").count() == 1
    assert FS.table_exists(spark, f"{d}/cmds") and not FS.table_exists(spark, f"{d}/nothing")
    assert FS.read_table_or_empty(spark, f"{d}/nothing", schemas.COMMANDS).count() == 0


def test_parse_top(spark):
    import datetime as dt

    text = ["top - 10:00:00 up 1 day", "", "    PID USER      PR  NI    VIRT    RES    SHR S  %CPU  %MEM     TIME+ COMMAND",
            "   1234 root      20   0   12.5m   1.0g   2048 R  99.0   1.5   0:05.00 stress --cpu 4",
            "  short line", ""]
    rows = [(1, dt.datetime(2024, 1, 1, 10), i, ln) for i, ln in enumerate(text)]
    lines = spark.createDataFrame(rows, "snapshot_id long, ts timestamp, line_no int, line string")
    got = FS.parse_top(lines).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.pid, r.user_name, r.cpu, r.memory, r.command, r.virt, r.res) == (
        1234, "root", 99.0, 1.5, "stress --cpu 4", 12800, 1048576)
