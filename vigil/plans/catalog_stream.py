"""Registered streaming queries.

Each one streams the driver's ``events`` parquet (``availableNow``), derives
the entity through the same adapter column expressions, runs the streaming
operator into a parquet table in the shared folder and returns that table.  Operators whose
streaming result equals a batch result get an SQL oracle; the others
(watermark-dependent windows, arbitrary-row dedup) get the rows-only check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import rules
from vigil.functions.predicates import high_risk_match
from vigil.plans.registry import query
from vigil.session import shared_dir
from vigil.sources import adapters as AD
from vigil.streaming import streams as ST

OWN = rules.OWN_IP


def _events_stream(t) -> DataFrame:
    """The whole ``events`` table, stored as one file or as a folder."""
    return ST.stream_table(t.spark, f"{t.sf_dir}/events.parquet", t.raw("events").schema)


def _drive(t, df: DataFrame, make_sink, *, states: int = 0) -> DataFrame:
    """Run a foreachBatch sink over everything available; its table."""
    name = "vigil_" + uuid.uuid4().hex[:12]
    table = shared_dir(t.spark, f"{name}_out")
    sink = make_sink(table, *[shared_dir(t.spark, f"{name}_state") for _ in range(states)])
    q = (df.writeStream.foreachBatch(sink).option("checkpointLocation", shared_dir(t.spark, f"{name}_ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.parquet(table).drop("batch_id")


def _run(t, df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream into a parquet table in the shared folder; read it back."""
    name = "vigil_" + uuid.uuid4().hex[:12]
    path = shared_dir(t.spark, f"{name}_out")
    ST.run_to_table(df, path, shared_dir(t.spark, f"{name}_ck"), mode)
    return t.spark.read.parquet(path)


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def _envelope(t) -> DataFrame:
    """Commands and network events in one stream, as the collector sends them."""
    ev = _events_stream(t)
    proc = AD.process_from_events(ev)
    cmds = proc.filter(high_risk_match(F.col("command"))).select(
        F.lit("suspicious_command").alias("type"), "id", "timestamp", "command",
        F.lit(None).cast("int").alias("dst_port"))
    net = AD.network_from_events(ev).select(
        F.lit("network_event").alias("type"), "id", "timestamp", F.lit(None).cast("string").alias("command"),
        "dst_port")
    return cmds.unionByName(net)


@query("stream_alerts", f"""
    SELECT 'suspicious_command' AS type, id, timestamp, command, CAST(NULL AS INTEGER) AS dst_port,
           'ALERT: Suspicious command detected - ' || command AS alert FROM commands
    UNION ALL
    SELECT 'network_event', id, timestamp, NULL, dst_port,
           'ALERT: Suspicious network activity on port ' || CAST(dst_port AS VARCHAR) FROM network
    WHERE dst_port IN ({', '.join(str(p) for p in rules.ALERT_PORTS)})""", ("commands", "network"))
def _stream_alerts(t):
    return _ntz(_run(t, ST.alerts(_envelope(t))), "timestamp")


@query("stream_window_stats")
def _stream_window_stats(t):
    net = AD.network_from_events(_events_stream(t))
    return _run(t, ST.window_stats(net))


@query("stream_first_seen")
def _stream_first_seen(t):
    proc = AD.process_from_events(_events_stream(t))
    return _run(t, ST.first_seen(proc.select("id", "timestamp", "command"), ["command"]))


@query("stream_first_seen_keys", "SELECT DISTINCT command FROM process", ("process",))
def _stream_first_seen_keys(t):
    proc = AD.process_from_events(_events_stream(t))
    return _run(t, ST.first_seen(proc.select("id", "timestamp", "command"), ["command"])).select("command")


@query("stream_window_totals", """
    SELECT time_bucket(INTERVAL 5 MINUTES, timestamp) AS time_window, src_ip, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent,
           count(*) AS events FROM network WHERE src_ip IS NOT NULL GROUP BY 1, 2""", ("network",))
def _stream_window_totals(t):
    """Complete output mode: every window of the state, exact sums/counts."""
    net = AD.network_from_events(_events_stream(t)).filter(F.col("src_ip").isNotNull())
    agg = ST.window_stats(net).select("time_window", "src_ip", "bytes_sent", "events")
    return _ntz(_run(t, agg, "complete"), "time_window")


@query("stream_window_updates", """
    SELECT time_bucket(INTERVAL 5 MINUTES, timestamp) AS time_window, src_ip, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent,
           count(*) AS events FROM network WHERE src_ip IS NOT NULL GROUP BY 1, 2""", ("network",))
def _stream_window_updates(t):
    """Update output mode: versions of changed windows, the newest of each."""
    net = AD.network_from_events(_events_stream(t)).filter(F.col("src_ip").isNotNull())
    name = "vigil_" + uuid.uuid4().hex[:12]
    path = shared_dir(t.spark, f"{name}_out")
    ST.run_to_table(ST.window_stats(net).select("time_window", "src_ip", "bytes_sent", "events"), path,
                    shared_dir(t.spark, f"{name}_ck"), "update")
    return _ntz(ST.latest_windows(t.spark, path), "time_window")


@query("stream_growing_events", """
    SELECT CASE WHEN id % 50 <> 0 THEN 'network_event' ELSE 'unknown' END AS type, CASE WHEN id % 50 <> 0 THEN timestamp END AS timestamp,
           CASE WHEN id % 50 <> 0 THEN src_ip END AS src_ip, CASE WHEN id % 50 <> 0 THEN dst_ip END AS dst_ip,
           CASE WHEN id % 50 <> 0 THEN dst_port END AS dst_port, CASE WHEN id % 50 <> 0 THEN bytes_sent END AS bytes_sent,
           CASE WHEN id % 50 = 0 THEN '{"id":' || id END AS rejected FROM network""", ("network",))
def _stream_growing_events(t):
    """All network events as NDJSON log files, every 50th line broken off,
    read as growing files: parsed rows and rejected lines."""
    from vigil.streaming.growing import growing_events

    line = F.to_json(F.struct("id", F.lit("network_event").alias("type"), F.col("timestamp").cast("string").alias("timestamp"),
                              "src_ip", "dst_ip", "dst_port", "bytes_sent"))
    broken = F.concat(F.lit('{"id":'), F.col("id").cast("string"))
    name = "vigil_" + uuid.uuid4().hex[:12]
    folder = shared_dir(t.spark, f"{name}_logs")
    t.network.select(F.when(F.col("id") % 50 == 0, broken).otherwise(line).alias("value")).write.text(folder)
    events = growing_events(t.spark, folder, "part-*")
    return _ntz(_run(t, events.select("type", "timestamp", "src_ip", "dst_ip", F.col("dst_port").cast("int").alias("dst_port"),
                                      "bytes_sent", F.col("_corrupt_record").alias("rejected"))), "timestamp")


@query("stream_correlate", f"""
    SELECT p.id AS process_id, p.timestamp AS process_timestamp, p.pid, p.command, n.id, n.timestamp,
           n.src_ip, n.dst_ip, n.dst_port
    FROM process p JOIN network n ON n.src_port = p.pid
      AND n.timestamp BETWEEN p.timestamp - INTERVAL {rules.CORRELATION_MINUTES} MINUTES
                          AND p.timestamp + INTERVAL {rules.CORRELATION_MINUTES} MINUTES""", ("process", "network"))
def _stream_correlate(t):
    ev = _events_stream(t)
    out = ST.correlate(AD.process_from_events(ev), AD.network_from_events(_events_stream(t)))
    return _ntz(_run(t, out), "process_timestamp", "timestamp")


@query("stream_file_changes", """
    SELECT file, timestamp, mtime_s FROM (
      SELECT *, max(mtime_s) OVER (PARTITION BY file ORDER BY timestamp, id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM file_ev) x
    WHERE mtime_s > prev_max""", ("file_ev",))
def _stream_file_changes(t):
    files = AD.file_from_events(_events_stream(t))
    return _ntz(_drive(t, files, ST.file_changes_sink, states=1), "timestamp")


CRON_STATE_SQL = """
    WITH RECURSIVE s AS (SELECT DISTINCT cron_file, CAST(snapshot_date AS TIMESTAMP) AS snapshot_ts, job FROM cron),
    d AS (SELECT cron_file, snapshot_ts, row_number() OVER (PARTITION BY cron_file ORDER BY snapshot_ts) AS rn
          FROM (SELECT DISTINCT cron_file, snapshot_ts FROM s) x),
    walk(cron_file, rn, snapshot_ts, prev_state, state) AS (
      SELECT cron_file, rn, snapshot_ts, CAST(NULL AS TIMESTAMP), snapshot_ts FROM d WHERE rn = 1
      UNION ALL
      SELECT d.cron_file, d.rn, d.snapshot_ts, w.state,
             CASE WHEN EXISTS (SELECT 1 FROM s x WHERE x.cron_file = d.cron_file AND x.snapshot_ts = d.snapshot_ts
                               AND NOT EXISTS (SELECT 1 FROM s y WHERE y.cron_file = d.cron_file
                                               AND y.snapshot_ts = w.state AND y.job = x.job))
                  THEN d.snapshot_ts ELSE w.state END
      FROM walk w JOIN d ON d.cron_file = w.cron_file AND d.rn = w.rn + 1)
    SELECT w.cron_file, w.snapshot_ts, x.job FROM walk w JOIN s x ON x.cron_file = w.cron_file
      AND x.snapshot_ts = w.snapshot_ts
    WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.cron_file = w.cron_file AND y.snapshot_ts = w.prev_state
                      AND y.job = x.job)
"""


@query("stream_cron_diff", CRON_STATE_SQL, ("cron",))
def _stream_cron_diff(t):
    cron = AD.cron_from_events(_events_stream(t))
    lines = cron.select("cron_file", F.col("snapshot_date").cast("timestamp").alias("snapshot_ts"),
                        F.col("id").alias("line_no"), F.col("job").alias("line"))
    return _ntz(_drive(t, lines, ST.cron_diff_sink, states=1), "snapshot_ts")


THROTTLE_SQL = f"""
    WITH RECURSIVE a AS (SELECT id, timestamp FROM commands),
    chain(id, timestamp) AS (
      SELECT * FROM (SELECT id, timestamp FROM a ORDER BY timestamp, id LIMIT 1) first_alert
      UNION ALL
      SELECT (SELECT a.id FROM a WHERE a.timestamp >= c.timestamp + INTERVAL {rules.ALERT_INTERVAL_HOURS} HOURS
              ORDER BY a.timestamp, a.id LIMIT 1),
             (SELECT min(a.timestamp) FROM a WHERE a.timestamp >= c.timestamp + INTERVAL {rules.ALERT_INTERVAL_HOURS} HOURS)
      FROM chain c WHERE c.id IS NOT NULL)
    SELECT id, timestamp FROM chain WHERE id IS NOT NULL"""


@query("stream_throttle", THROTTLE_SQL, ("commands",))
def _stream_throttle(t):
    """Distributed throttle per micro-batch (foreachBatch), state = last pass."""
    from vigil.operators.throttle import throttle_sink

    proc = AD.process_from_events(_events_stream(t))
    cmds = proc.filter(high_risk_match(F.col("command"))).select("id", "timestamp")
    return _ntz(_drive(t, cmds, throttle_sink), "timestamp")


@query("throttle_alerts", THROTTLE_SQL, ("commands",))
def _throttle_alerts(t):
    from vigil.operators.throttle import throttle_batch

    return throttle_batch(t.commands.select("id", "timestamp"))


@query("stream_throttle_keyed", f"""
    WITH RECURSIVE a AS (SELECT id, timestamp, user_name FROM commands),
    chain(user_name, id, timestamp) AS (
      SELECT user_name, id, timestamp FROM (
        SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY timestamp, id) AS rn FROM a) f WHERE rn = 1
      UNION ALL
      SELECT c.user_name,
             (SELECT a.id FROM a WHERE a.user_name = c.user_name
                AND a.timestamp >= c.timestamp + INTERVAL {rules.ALERT_INTERVAL_HOURS} HOURS
              ORDER BY a.timestamp, a.id LIMIT 1),
             (SELECT min(a.timestamp) FROM a WHERE a.user_name = c.user_name
                AND a.timestamp >= c.timestamp + INTERVAL {rules.ALERT_INTERVAL_HOURS} HOURS)
      FROM chain c WHERE c.id IS NOT NULL)
    SELECT id, timestamp, user_name FROM chain WHERE id IS NOT NULL""", ("commands",))
def _stream_throttle_keyed(t):
    """One throttle per user: the distributed throttle with a group column."""
    from vigil.operators.throttle import throttle_sink

    proc = AD.process_from_events(_events_stream(t))
    cmds = proc.filter(high_risk_match(F.col("command"))).select("id", "timestamp", "user_name")
    return _ntz(_drive(t, cmds, lambda table: throttle_sink(table, by=["user_name"])), "timestamp")


@query("stream_upsert_new", "SELECT id, timestamp, pid, command FROM process", ("process",))
def _stream_upsert_new(t):
    proc = AD.process_from_events(_events_stream(t)).select("id", "timestamp", "pid", "command")
    return _ntz(_drive(t, proc, ST.upsert_new_rows), "timestamp")
