"""Registered variants whose inputs make a rule fire where the derived
tables alone give no row, and facts that SQL can check about results that
are random or approximate."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import rules
from vigil.operators import aggregates as A
from vigil.operators import detect as D
from vigil.operators import sets as X
from vigil.plans.catalog_misc import _intel
from vigil.plans.catalog_process import THREAT_CMD_SQL
from vigil.plans.catalog_stream import _drive, _events_stream, _ntz, _run
from vigil.plans.registry import query
from vigil.sources import adapters as AD
from vigil.streaming import streams as ST

OWN = rules.OWN_IP
NET = ("network",)

# -- variants that fire -------------------------------------------------------------------

#: Our own address is only ever a destination in the derived table: the same rows seen from the other side.
SWAPPED = "(SELECT * REPLACE (dst_ip AS src_ip, src_ip AS dst_ip) FROM network)"


def _swapped(t):
    return t.network.withColumns({"src_ip": F.col("dst_ip"), "dst_ip": F.col("src_ip")})


@query("outbound_counts_reversed", f"""
    SELECT dst_ip, count(*) AS count FROM {SWAPPED} x WHERE src_ip = '{OWN}' AND dst_ip IS NOT NULL GROUP BY dst_ip""", NET)
def _outbound_reversed(t):
    return A.outbound_counts(_swapped(t))


@query("top_outbound_reversed", f"""
    SELECT dst_ip, count(*) AS count FROM {SWAPPED} x WHERE src_ip = '{OWN}' AND dst_ip IS NOT NULL
    GROUP BY dst_ip ORDER BY count DESC, dst_ip LIMIT {rules.TOP_N}""", NET)
def _top_outbound_reversed(t):
    return A.top_outbound(_swapped(t))


@query("high_threat_filter_any", f"""
    SELECT * FROM (SELECT *, {THREAT_CMD_SQL} AS threat_score FROM commands) x WHERE threat_score > 0""", ("commands",))
def _high_threat_any(t):
    return D.high_threat_filter(t.commands, 0)


@query("dedup_first_hourly", """
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY id) AS rn
      FROM (SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp) FROM process) p) x WHERE rn = 1""", ("process",))
def _dedup_first_hourly(t):
    """Timestamps cut to the hour, so that keys repeat."""
    return X.dedup_first(t.process.withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz")), ["timestamp"], ["id"])


@query("stream_upsert_new_hourly", """
    SELECT id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY id) AS rn
      FROM (SELECT id, date_trunc('hour', timestamp) AS timestamp FROM process) p) x WHERE rn = 1""", ("process",))
def _stream_upsert_hourly(t):
    proc = AD.process_from_events(_events_stream(t)).select("id", F.date_trunc("hour", "timestamp").alias("timestamp"))
    return _ntz(_drive(t, proc, ST.upsert_new_rows), "timestamp")


_EVENTS_SQL = f"""
    SELECT * FROM (SELECT 'network' AS source, src_ip AS ip, dst_ip, dst_port, flags, CAST(NULL AS VARCHAR) AS command, timestamp
      FROM network WHERE src_ip = '{OWN}' OR dst_ip = '{OWN}' ORDER BY timestamp DESC, id DESC LIMIT {rules.RECENT_PER_SOURCE}) a
    UNION ALL
    SELECT * FROM (SELECT 'suspicious_command', '{OWN}', NULL, NULL, NULL, command, timestamp
      FROM commands ORDER BY timestamp DESC, id DESC LIMIT {rules.RECENT_PER_SOURCE}) b"""


@query("recent_events_with_commands", _EVENTS_SQL, ("network", "commands"))
def _recent_events_with_commands(t):
    """Commands that carry an address take part."""
    return X.recent_events_for_ip(t.network, t.commands.withColumn("ip", F.lit(OWN)), OWN)


# -- facts about approximate and random results ---------------------------------------------

@query("stream_window_closed", f"""
    SELECT time_bucket(INTERVAL 5 MINUTES, timestamp) AS time_window, src_ip, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent,
           count(*) AS events FROM network
    GROUP BY 1, 2 HAVING time_bucket(INTERVAL 5 MINUTES, min(timestamp)) + INTERVAL {rules.BUCKET_MINUTES} MINUTES
      <= (SELECT max(timestamp) FROM network) - INTERVAL 10 MINUTES""", NET)
def _stream_window_closed(t):
    """Append mode: exact parts of every window that the watermark has closed."""
    net = AD.network_from_events(_events_stream(t))
    return _ntz(_run(t, ST.window_stats(net)).select("time_window", "src_ip", "bytes_sent", "events"), "time_window")


@query("approx_port_scan_error", """
    SELECT count(*) AS pairs, count(*) AS close FROM (SELECT src_ip, dst_ip FROM network
      WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY 1, 2) x""", NET)
def _approx_port_scan_error(t):
    """Pairs, and those whose approximate port count is off by at most one or 5 %."""
    exact = D.port_scan_stats(t.network).select("src_ip", "dst_ip", F.col("unique_ports").alias("ports"))
    both = D.approx_port_scan_stats(t.network).join(exact, ["src_ip", "dst_ip"])
    off = F.abs(F.col("unique_ports") - F.col("ports"))
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(off <= F.greatest(F.lit(1.0), 0.05 * F.col("ports"))).alias("close"))


@query("score_facts", "SELECT count(*) AS n_rows, count(*) AS in_range, true AS share_ok FROM process", ("process",))
def _score_facts(t):
    """Every row is scored, raw scores lie in [-1, 0] (so scores differ from
    the offset by at most one), and about 5 % are anomalies."""
    s = _intel(t).process
    share = F.avg((F.col("is_anomaly") == -1).cast("double"))
    return s.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs("anomaly_score") <= 1).alias("in_range"),
                 (F.abs(share - rules.FOREST_CONTAMINATION) < 0.02).alias("share_ok"))


@query("kmeans_facts", "SELECT count(DISTINCT src_ip) AS sources, true AS few_clusters FROM network", NET)
def _kmeans_facts(t):
    from vigil.operators.cluster import kmeans_sources

    return kmeans_sources(t.network).agg(F.countDistinct("src_ip").alias("sources"),
                                         F.countDistinct("cluster").between(1, 4).alias("few_clusters"))
