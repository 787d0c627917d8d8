"""The interval joins compute a row's bounds once, not once a pair."""

import datetime as dt
import re
import tempfile

from conftest import net_rows, proc_rows, ts

from vigil.operators import joins as J
from vigil.streaming import streams as ST

MICRO = dt.timedelta(microseconds=1)
EDGES = [ts(h=1, s=300), ts(h=1, s=-300), ts(h=1, s=300) + MICRO, ts(h=1, s=-300) - MICRO, ts(h=1, s=300) - MICRO, None]


def test_batch_pairs_are_only_compared(spark):
    proc = proc_rows(spark, [dict(pid=40000, timestamp=ts(h=1)), dict(pid=40000, timestamp=None)])
    net = net_rows(spark, [dict(src_port=40000, timestamp=t) for t in EDGES])
    got = J.correlate_process_network(proc, net)
    assert sorted(r.id for r in got.collect()) == [0, 1, 4]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "INTERVAL" not in re.search(r"Join .*", plan).group()


def test_stream_pairs_are_only_compared_and_state_goes(spark):
    d = tempfile.mkdtemp(prefix="vigil-bounds-", dir="/tmp")
    late = [dict(pid=40001, timestamp=ts(h=9))]
    proc_rows(spark, [dict(pid=40000, timestamp=ts(h=1)), dict(pid=40000, timestamp=None), *late]).write.parquet(f"{d}/p")
    net = [dict(src_port=40000, timestamp=t) for t in EDGES] + [dict(src_port=40002, timestamp=ts(h=9))]
    net_rows(spark, net).write.parquet(f"{d}/n")
    p, n = (spark.readStream.schema(spark.read.parquet(f"{d}/{x}").schema).parquet(f"{d}/{x}") for x in "pn")
    q = ST.run_to_table(ST.correlate(p, n), f"{d}/out", f"{d}/ck")
    assert sorted(r.id for r in spark.read.parquet(f"{d}/out").collect()) == [0, 1, 4]
    join = re.search(r"StreamingSymmetricHashJoin .*", q._jsq.explainInternal(False)).group()
    assert "INTERVAL" not in join.split("state info")[0]
    # Of the rows at one o'clock none can match any more; those at nine stay (the process row in three buckets).
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
