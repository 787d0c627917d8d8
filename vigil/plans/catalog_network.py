"""Registered network queries: detectors, incidents, aggregates, top-k.

Each query reads the whole ``events`` table through the network adapter.
Floating outputs that are one IEEE operation on identical inputs (ratios,
rates) are compared as is; only sums whose order differs between engines
are rounded (6 decimals) on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import rules
from vigil.functions import predicates as P
from vigil.functions import scalars as S
from vigil.operators import aggregates as A
from vigil.operators import clean as C
from vigil.operators import detect as D
from vigil.operators import joins as J
from vigil.operators import sets as X
from vigil.operators import windows as W
from vigil.plans.oracle import sql_external, sql_regex_ci, sql_str
from vigil.plans.registry import query

OWN = rules.OWN_IP
NET = ("network",)
PORTS = ", ".join(str(p) for p in rules.C2_PORTS)
C2_SQL = (f"CAST((COALESCE(dst_port IN ({PORTS}), FALSE) OR "
          f"{sql_regex_ci('dst_ip', rules.C2_DOMAINS)}) AS INTEGER)")
C2X_SQL = (f"CAST(({sql_regex_ci('dst_ip', rules.C2_DOMAINS_EXTENDED)} OR COALESCE(dst_port IN ({PORTS}), FALSE) "
           f"OR COALESCE(protocol IN ({', '.join(sql_str(p) for p in rules.C2_PROTOCOLS_EXTENDED)}), FALSE) "
           f"OR COALESCE(hour(timestamp) BETWEEN 0 AND 5, FALSE)) AS INTEGER)")
EXFIL_SQL = f"CAST(({sql_external('dst_ip')} AND COALESCE(bytes_sent > {rules.EXFIL_BYTES}, FALSE)) AS INTEGER)"
RATE_SQL = "bytes_sent / (duration + 0.001)"
DIFF_SQL = ("CASE WHEN src_ip IS NOT NULL AND dst_ip IS NOT NULL THEN (epoch_us(timestamp) - epoch_us(lag(timestamp) "
            "OVER (PARTITION BY src_ip, dst_ip ORDER BY timestamp, id))) / 1e6 END")
SCAN_STATS_SQL = f"""
  SELECT src_ip, dst_ip, unique_ports, first_attempt, last_attempt, scan_duration,
         (unique_ports >= {rules.SCAN_PORTS_ALWAYS} OR (unique_ports >= {rules.SCAN_PORTS_BURST}
          AND scan_duration <= {rules.SCAN_BURST_SECONDS})) AS is_scan
  FROM (SELECT src_ip, dst_ip, count(DISTINCT dst_port) AS unique_ports, min(timestamp) AS first_attempt,
               max(timestamp) AS last_attempt,
               (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS scan_duration
        FROM network WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL AND timestamp IS NOT NULL
        GROUP BY src_ip, dst_ip) s
"""
SCANNED_SQL = f"""
  SELECT n.*, s.is_scan, CAST(COALESCE(CAST(s.is_scan AS INTEGER), 0) AS INTEGER) AS scan_risk
  FROM network n LEFT JOIN ({SCAN_STATS_SQL}) s ON n.src_ip = s.src_ip AND n.dst_ip = s.dst_ip
  WHERE n.timestamp IS NOT NULL
"""
SCORED_SQL = f"""
  SELECT n.*, s.is_scan, CAST(COALESCE(CAST(s.is_scan AS INTEGER), 0) AS INTEGER) AS scan_risk
  FROM (SELECT *, {C2_SQL} AS c2_risk, {RATE_SQL} AS transfer_rate, {EXFIL_SQL} AS exfil_risk FROM network) n
  LEFT JOIN ({SCAN_STATS_SQL}) s ON n.src_ip = s.src_ip AND n.dst_ip = s.dst_ip
  WHERE n.timestamp IS NOT NULL
"""


def _flag_text_sql(col: str) -> str:
    exact = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in rules.TCP_FLAG_TEXT)
    letter = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in rules.TCP_FLAG_TEXT if len(k) == 1)
    u = f"upper({col})"
    letters = (f"array_to_string(list_filter(list_transform(string_split({u}, ''), lambda x: CASE x {letter} END), "
               f"lambda x: x IS NOT NULL), ' | ')")
    return (f"CASE WHEN {col} IS NULL OR {col} = '' OR {col} = 'None' THEN 'No flags' "
            f"ELSE COALESCE(CASE {u} {exact} END, NULLIF({letters}, ''), 'Uncommon flags: ' || {u}) END")


def scored(t):
    """Network rows with the three detector flags (shared by many queries)."""
    return D.detect_network_threats(t.network)


# -- adapters / scans ----------------------------------------------------------------

@query("adapter_network", "SELECT * FROM network", NET)
def _adapter_network(t):
    return t.network


@query("fetch_window_24h",
       "SELECT * FROM network WHERE timestamp >= (SELECT max(timestamp) FROM network) - INTERVAL 24 HOURS", NET)
def _fetch_window(t):
    return C.fetch_window(t.network, 24)


@query("latest_n", "SELECT * FROM network ORDER BY timestamp DESC, id DESC LIMIT 1000", NET)
def _latest_n(t):
    return C.latest_n(t.network, 1000)


@query("filter_suspicious_ports",
       "SELECT * FROM network WHERE COALESCE(src_port IN (22, 23, 80, 443, 8080) OR "
       "dst_port IN (22, 23, 80, 443, 8080), FALSE)", NET)
def _filter_suspicious_ports(t):
    return C.filter_suspicious_ports(t.network)


@query("is_external_ip", f"SELECT id, dst_ip, {sql_external('dst_ip')} AS is_external FROM network", NET)
def _is_external(t):
    return C.with_external_flag(t.network).select("id", "dst_ip", "is_external")


@query("tcp_flag_text", f"SELECT id, flags, {_flag_text_sql('flags')} AS flag_analysis FROM network", NET)
def _tcp_flag_text(t):
    return t.network.select("id", "flags", S.tcp_flag_text(F.col("flags")).alias("flag_analysis"))


@query("with_defaults",
       "SELECT id, timestamp, src_ip, dst_ip, dst_port, CAST(0 AS INTEGER) AS bytes_sent, "
       "CAST(1 AS INTEGER) AS duration FROM network", NET)
def _with_defaults(t):
    n = t.network.select("id", "timestamp", "src_ip", "dst_ip", "dst_port")
    return C.with_defaults(n, {"bytes_sent": 0, "duration": 1, "dst_port": -1})


@query("coerce_timestamp",
       "SELECT id, TRY_CAST(CASE WHEN flags = 'SEC' THEN 'not a time' ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S') END "
       "AS TIMESTAMP) AS timestamp FROM network", NET)
def _coerce_timestamp(t):
    # Timestamps as text, as the collector sends them (ISO with 'T'); rows of
    # the malformed-flag kind ('SEC') carry garbage text instead.
    txt = F.when(F.col("flags") == "SEC", F.lit("not a time")).otherwise(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    df = t.network.select("id", txt.alias("timestamp"))
    return C.coerce_timestamp(df, "timestamp").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("drop_invalid_ts",
       "SELECT id, ts AS timestamp FROM (SELECT id, TRY_CAST(CASE WHEN flags = 'SEC' THEN 'not a time' "
       "ELSE strftime(timestamp, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS ts FROM network) x WHERE ts IS NOT NULL",
       NET)
def _drop_invalid_ts(t):
    txt = F.when(F.col("flags") == "SEC", F.lit("not a time")).otherwise(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    df = C.coerce_timestamp(t.network.select("id", txt.alias("timestamp")), "timestamp")
    return C.drop_invalid_ts(df).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


# -- detectors -------------------------------------------------------------------------

@query("detect_c2", f"SELECT *, {C2_SQL} AS c2_risk FROM network", NET)
def _detect_c2(t):
    return D.detect_c2(t.network)


@query("c2_threats", f"SELECT * FROM (SELECT *, {C2_SQL} AS c2_risk FROM network) x WHERE c2_risk = 1", NET)
def _c2_threats(t):
    return C.flag_filter(D.detect_c2(t.network), "c2_risk")


@query("detect_c2_extended", f"SELECT *, CAST(hour(timestamp) AS INTEGER) AS hour, {C2X_SQL} AS c2_risk FROM network",
       NET)
def _detect_c2x(t):
    return D.detect_c2_extended(t.network)


@query("detect_exfil", f"SELECT *, {RATE_SQL} AS transfer_rate, {EXFIL_SQL} AS exfil_risk FROM network", NET)
def _detect_exfil(t):
    return D.detect_exfil(t.network)


@query("exfil_threats",
       f"SELECT * FROM (SELECT *, {RATE_SQL} AS transfer_rate, {EXFIL_SQL} AS exfil_risk FROM network) x "
       "WHERE exfil_risk = 1", NET)
def _exfil_threats(t):
    return C.flag_filter(D.detect_exfil(t.network), "exfil_risk")


@query("detect_exfil_extended", f"""
    SELECT *, CAST(({sql_external('dst_ip')} AND (COALESCE(bytes_sent > {rules.EXFIL_BYTES}, FALSE)
             OR COALESCE(time_diff > 0 AND time_diff <= {rules.BEACON_MAX_GAP_SECONDS}, FALSE))) AS INTEGER) AS exfil_risk
    FROM (SELECT *, {RATE_SQL} AS transfer_rate, {DIFF_SQL} AS time_diff FROM network) x""", NET)
def _detect_exfil_x(t):
    return D.detect_exfil_extended(t.network)


@query("beaconing", f"""
    SELECT *, COALESCE(time_diff > 0 AND time_diff <= {rules.BEACON_MAX_GAP_SECONDS}, FALSE) AS periodic_flag
    FROM (SELECT *, {DIFF_SQL} AS time_diff FROM network) x""", NET)
def _beaconing(t):
    return W.beaconing(t.network)


@query("port_scan_stats", SCAN_STATS_SQL, NET)
def _port_scan_stats(t):
    return D.port_scan_stats(t.network)


@query("approx_port_scan")
def _approx_port_scan(t):
    return D.approx_port_scan_stats(t.network)


@query("detect_port_scanning", SCANNED_SQL, NET)
def _detect_port_scanning(t):
    return D.detect_port_scanning(t.network)


@query("scan_threats", f"SELECT * FROM ({SCANNED_SQL}) x WHERE scan_risk = 1", NET)
def _scan_threats(t):
    return C.flag_filter(D.detect_port_scanning(t.network), "scan_risk")


@query("network_threats", SCORED_SQL, NET)
def _network_threats(t):
    return scored(t)


# -- incidents -------------------------------------------------------------------------

@query("incident_syn_flood", f"""
    SELECT 'Possible SYN Flood' AS type, src_ip AS source, 'Critical' AS severity,
           src_ip || ' sent ' || CAST(n AS VARCHAR) || ' SYN packets' AS description,
           (SELECT max(timestamp) FROM network) AS timestamp
    FROM (SELECT src_ip, count(*) AS n FROM network WHERE flags = 'S' AND dst_ip = '{OWN}' AND src_ip IS NOT NULL
          GROUP BY src_ip) a
    WHERE n >= {rules.SYN_THRESHOLD}""", NET)
def _incident_syn_flood(t):
    return D.incident_syn_flood(t.network)


# -- aggregates -----------------------------------------------------------------------

@query("port_access_counts", f"""
    SELECT src_ip, dst_port, count(*) AS count FROM network
    WHERE dst_ip = '{OWN}' AND src_ip IS NOT NULL AND dst_port IS NOT NULL
    GROUP BY src_ip, dst_port HAVING count(*) >= {rules.PORT_THRESHOLD}""", NET)
def _port_access_counts(t):
    return A.port_access_counts(t.network)


@query("syn_flood_pairs", f"""
    SELECT src_ip, dst_ip, count(*) AS count FROM network
    WHERE flags = 'S' AND src_ip IS NOT NULL AND dst_ip IS NOT NULL
    GROUP BY src_ip, dst_ip HAVING count(*) >= {rules.SYN_THRESHOLD} AND dst_ip = '{OWN}'""", NET)
def _syn_flood_pairs(t):
    return A.syn_flood_pairs(t.network)


@query("inbound_counts",
       f"SELECT src_ip, count(*) AS count FROM network WHERE dst_ip = '{OWN}' AND src_ip IS NOT NULL GROUP BY src_ip",
       NET)
def _inbound(t):
    return A.inbound_counts(t.network)


@query("outbound_counts",
       f"SELECT dst_ip, count(*) AS count FROM network WHERE src_ip = '{OWN}' AND dst_ip IS NOT NULL GROUP BY dst_ip",
       NET)
def _outbound(t):
    return A.outbound_counts(t.network)


@query("top_inbound", f"""
    SELECT src_ip, count(*) AS count FROM network WHERE dst_ip = '{OWN}' AND src_ip IS NOT NULL
    GROUP BY src_ip ORDER BY count DESC, src_ip LIMIT {rules.TOP_N}""", NET)
def _top_inbound(t):
    return A.top_inbound(t.network)


@query("top_outbound", f"""
    SELECT dst_ip, count(*) AS count FROM network WHERE src_ip = '{OWN}' AND dst_ip IS NOT NULL
    GROUP BY dst_ip ORDER BY count DESC, dst_ip LIMIT {rules.TOP_N}""", NET)
def _top_outbound(t):
    return A.top_outbound(t.network)


@query("network_metrics", f"""
    SELECT count(*) AS total_events, count(DISTINCT src_ip) AS unique_ips,
      (SELECT count(*) FROM (SELECT src_ip, dst_port FROM network WHERE dst_ip = '{OWN}' AND src_ip IS NOT NULL
         AND dst_port IS NOT NULL GROUP BY src_ip, dst_port HAVING count(*) >= {rules.PORT_THRESHOLD}) a)
         AS multi_port_accesses,
      (SELECT count(*) FROM (SELECT src_ip, dst_ip FROM network WHERE flags = 'S' AND src_ip IS NOT NULL
         AND dst_ip IS NOT NULL GROUP BY src_ip, dst_ip HAVING count(*) >= {rules.SYN_THRESHOLD}
         AND dst_ip = '{OWN}') b) AS potential_floods
    FROM network""", NET)
def _network_metrics(t):
    return A.network_metrics(t.network)


@query("network_window_stats", f"""
    SELECT time_bucket(INTERVAL 5 MINUTES, timestamp) AS time_window, src_ip, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent,
           count(DISTINCT dst_port) AS n_dst_ports, count(DISTINCT dst_ip) AS n_dst_ips,
           max(c2_risk) AS c2_risk, max(exfil_risk) AS exfil_risk
    FROM (SELECT *, {C2_SQL} AS c2_risk, {EXFIL_SQL} AS exfil_risk FROM network) x
    WHERE timestamp IS NOT NULL AND src_ip IS NOT NULL
    GROUP BY 1, 2""", NET)
def _network_window_stats(t):
    return A.network_window_stats(D.detect_exfil(D.detect_c2(t.network)))


@query("scanned_ports_by_source", f"""
    SELECT src_ip, count(DISTINCT dst_port) AS unique_ports FROM ({SCANNED_SQL}) x
    WHERE scan_risk = 1 AND src_ip IS NOT NULL GROUP BY src_ip""", NET)
def _scanned_ports(t):
    return A.scanned_ports_by_source(C.flag_filter(D.detect_port_scanning(t.network), "scan_risk"))


@query("c2_rollup", f"""
    SELECT src_ip, dst_ip, protocol, CAST(sum(bytes_sent) AS DECIMAL(38,0)) AS bytes_sent,
           CAST(grouping(src_ip, dst_ip, protocol) AS BIGINT) AS level
    FROM (SELECT *, {C2_SQL} AS c2_risk FROM network) x WHERE c2_risk = 1
    GROUP BY ROLLUP (src_ip, dst_ip, protocol)""", NET)
def _c2_rollup(t):
    return A.c2_rollup(C.flag_filter(D.detect_c2(t.network), "c2_risk")).withColumn("level", F.col("level").cast("bigint"))


@query("exfil_flows", f"""
    SELECT src_ip, dst_ip, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent, count(*) AS flows
    FROM (SELECT *, {EXFIL_SQL} AS exfil_risk FROM network) x
    WHERE exfil_risk = 1 AND src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY src_ip, dst_ip""", NET)
def _exfil_flows(t):
    return A.exfil_flows(C.flag_filter(D.detect_exfil(t.network), "exfil_risk"))


@query("network_threat_counts", f"""
    SELECT count(*) FILTER (WHERE c2_risk = 1) AS c2_rows, count(*) FILTER (WHERE exfil_risk = 1) AS exfil_rows,
           count(*) FILTER (WHERE scan_risk = 1) AS scan_rows FROM ({SCORED_SQL}) x""", NET)
def _network_threat_counts(t):
    return A.network_threat_counts(scored(t))


@query("syn_ack_ratio", """
    SELECT src_ip, count(*) AS packets, count(*) FILTER (WHERE flags = 'S') AS syn,
           count(*) FILTER (WHERE COALESCE(contains(upper(flags), 'A'), FALSE)) AS ack,
           count(*) FILTER (WHERE flags = 'S') / count(*) AS syn_share,
           count(*) FILTER (WHERE COALESCE(contains(upper(flags), 'A'), FALSE)) / count(*) AS ack_share,
           CASE WHEN count(*) FILTER (WHERE COALESCE(contains(upper(flags), 'A'), FALSE)) = 0 THEN NULL
                ELSE count(*) FILTER (WHERE flags = 'S')
                     / count(*) FILTER (WHERE COALESCE(contains(upper(flags), 'A'), FALSE)) END AS syn_ack_ratio
    FROM network WHERE src_ip IS NOT NULL GROUP BY src_ip""", NET)
def _syn_ack_ratio(t):
    return A.syn_ack_ratio(t.network)


@query("hourly_timeline", """
    WITH c AS (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS events FROM network
               WHERE timestamp IS NOT NULL GROUP BY 1),
         g AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM c)
    SELECT g.hour, COALESCE(c.events, 0) AS events FROM g LEFT JOIN c ON g.hour = c.hour""", NET)
def _hourly_timeline(t):
    return A.hourly_timeline(t.network)


# -- sets, dedup, lookups ---------------------------------------------------------------

@query("first_seen_connections", """
    SELECT id, timestamp, src_ip, dst_ip, src_port, dst_port, flags, bytes_sent, duration, protocol FROM (
      SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port ORDER BY timestamp, id) AS rn
      FROM network WHERE COALESCE(src_port IN (22, 23, 80, 443, 8080) OR dst_port IN (22, 23, 80, 443, 8080), FALSE)
    ) x WHERE rn = 1""", NET)
def _first_seen_connections(t):
    return X.first_seen_connections(t.network)


@query("recent_events_for_ip", f"""
    SELECT 'network' AS source, src_ip AS ip, dst_ip, dst_port, flags, timestamp FROM network
    WHERE src_ip = '{OWN}' OR dst_ip = '{OWN}' ORDER BY timestamp DESC, id DESC LIMIT {rules.RECENT_PER_SOURCE}""",
       NET)
def _recent_events_for_ip(t):
    return X.recent_events_for_ip(t.network, t.commands, OWN)


@query("per_source_latest", f"""
    SELECT id, timestamp, src_ip, dst_ip, src_port, dst_port, flags, bytes_sent, duration, protocol FROM (
      SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY timestamp DESC, id DESC) AS rn FROM network) x
    WHERE rn <= {rules.RECENT_PER_SOURCE}""", NET)
def _per_source_latest(t):
    return W.per_group_latest(t.network, ["src_ip"])


IPS_SQL = f"""
  SELECT ip, CASE WHEN regexp_full_match(ip, '{P.IPV4_RE.strip('^$')}')
             THEN CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
                  + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) END AS ip_num
  FROM (SELECT src_ip AS ip FROM network UNION SELECT dst_ip FROM network) u
  WHERE ip IS NOT NULL AND ip <> '' AND ip <> '{OWN}'
"""


@query("all_ips", IPS_SQL, NET)
def _all_ips(t):
    return X.sorted_ips(X.all_ips(t.network, t.commands))


@query("report_ips", f"SELECT * FROM ({IPS_SQL}) x ORDER BY ip_num NULLS LAST, ip LIMIT {rules.TOP_N}", NET)
def _report_ips(t):
    return X.report_ips(X.all_ips(t.network, t.commands))


@query("ip_enrich", f"""
    SELECT i.ip, i.ip_num,
      CASE WHEN i.ip = '{OWN}' THEN 'Whitelisted' WHEN i.ip_num IS NULL THEN 'Invalid IP address' ELSE 'OK' END AS status,
      CASE WHEN i.ip_num IS NULL THEN NULL ELSE COALESCE(g.country, 'Unknown') END AS country,
      CASE WHEN i.ip_num IS NULL THEN NULL ELSE 'Unknown' END AS region,
      CASE WHEN i.ip_num IS NULL THEN NULL ELSE 'Unknown' END AS city,
      CASE WHEN i.ip_num IS NULL THEN NULL ELSE 'Unknown' END AS isp,
      CASE WHEN i.ip_num IS NULL THEN NULL ELSE 'Unknown' END AS asn,
      CASE WHEN i.ip_num IS NULL THEN NULL ELSE 0 END AS threat_score,
      CASE WHEN i.ip_num IS NULL THEN NULL ELSE 'Unknown' END AS reputation
    FROM ({IPS_SQL}) i LEFT JOIN geo g ON i.ip_num BETWEEN g.ip_start AND g.ip_end""", ("network", "geo"))
def _ip_enrich(t):
    return J.ip_enrich(X.all_ips(t.network, t.commands), t.geo)


@query("bulk_ip_report", f"""
    SELECT i.ip, COALESCE(g.country, 'Unknown') AS country, 'Unknown' AS isp, 0 AS threat_score,
           '{dict(rules.THREAT_INTEL_SOURCES)["AbuseIPDB"]}' || i.ip AS abuseipdb,
           '{dict(rules.THREAT_INTEL_SOURCES)["VirusTotal"]}' || i.ip AS virustotal
    FROM ({IPS_SQL}) i LEFT JOIN geo g ON i.ip_num BETWEEN g.ip_start AND g.ip_end
    WHERE i.ip_num IS NOT NULL""", ("network", "geo"))
def _bulk_ip_report(t):
    return J.bulk_ip_report(X.all_ips(t.network, t.commands), t.geo)


@query("incident_multi_port",
       f"""
    SELECT 'Multiple Ports Accessed' AS type, src_ip AS source, 'High' AS severity,
           src_ip || ' accessed ' || CAST(n AS VARCHAR) || ' different ports' AS description,
           (SELECT max(timestamp) FROM network) AS timestamp
    FROM (SELECT src_ip, count(DISTINCT dst_port) AS n FROM network
          WHERE dst_ip = '{OWN}' AND src_ip IS NOT NULL GROUP BY src_ip) a
    WHERE n >= {rules.PORT_THRESHOLD}
    """, NET)
def _incident_multi_port(t):
    return D.incident_multi_port(t.network)


@query("intel_links", f"""
    SELECT ip, {', '.join(f"'{base}' || ip AS link_{name.lower()}" for name, base in rules.THREAT_INTEL_SOURCES)}
    FROM ({IPS_SQL}) i""", NET)
def _intel_links(t):
    ips = X.all_ips(t.network, t.commands)
    links = S.intel_links(F.col("ip"))
    return ips.select("ip", *[links[n].alias(f"link_{n.lower()}") for n, _ in rules.THREAT_INTEL_SOURCES])


@query("validate_ip", f"""
    SELECT ip, regexp_full_match(ip, '{P.IPV4_RE.strip('^$')}') AS is_valid FROM ({IPS_SQL}) i""", NET)
def _validate_ip(t):
    return X.all_ips(t.network, t.commands).select("ip", P.validate_ip(F.col("ip")).alias("is_valid"))


@query("union_collector", """
    SELECT 'suspicious_command' AS type, id, timestamp, user_name, command, CAST(pid AS BIGINT) AS pid,
           NULL AS file, CAST(NULL AS BIGINT) AS mtime_s, NULL AS cron_file, NULL AS job, NULL AS src_ip,
           NULL AS dst_ip, CAST(NULL AS INTEGER) AS src_port, CAST(NULL AS INTEGER) AS dst_port, NULL AS flags
    FROM commands
    UNION ALL SELECT 'file_event', id, timestamp, NULL, NULL, NULL, file, mtime_s, NULL, NULL, NULL, NULL, NULL, NULL,
           NULL FROM file_ev
    UNION ALL SELECT 'cron_event', id, timestamp, NULL, NULL, NULL, NULL, NULL, cron_file, job, NULL, NULL, NULL, NULL,
           NULL FROM cron
    UNION ALL SELECT 'network_event', id, timestamp, NULL, NULL, NULL, NULL, NULL, NULL, NULL, src_ip, dst_ip,
           src_port, dst_port, flags FROM network WHERE COALESCE(src_port IN (22, 23, 80, 443, 8080)
           OR dst_port IN (22, 23, 80, 443, 8080), FALSE)""", ("commands", "file_ev", "cron", "network"))
def _union_collector(t):
    cmds = t.commands.select(F.lit("suspicious_command").alias("type"), "id", "timestamp", "user_name", "command",
                             F.col("pid").cast("bigint").alias("pid"))
    files = t.files.select(F.lit("file_event").alias("type"), "id", "timestamp", "file", "mtime_s")
    cron = t.cron.select(F.lit("cron_event").alias("type"), "id", "timestamp", "cron_file", "job")
    net = C.filter_suspicious_ports(t.network).select(F.lit("network_event").alias("type"), "id", "timestamp",
                                                      "src_ip", "dst_ip", "src_port", "dst_port", "flags")
    return X.union_events(cmds, files, cron, net)


@query("network_view_scored", f"""
    SELECT *, CAST(0 AS INTEGER) AS threat_score, {_flag_text_sql('flags')} AS flag_analysis FROM network""", NET)
def _network_view_scored(t):
    from vigil.plans.network_view import score_network

    return score_network(t.network)
