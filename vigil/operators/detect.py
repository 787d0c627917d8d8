"""Network detectors and incident rules (DataFrame -> DataFrame).

Scale notes
-----------
* Port-scan statistics use a single ``countDistinct`` per (src, dst): Catalyst
  plans it as a two-level aggregate keyed first by (src, dst, port), so even a
  pair holding a third of all rows is pre-aggregated map-side and the final
  state per key is bounded by the number of distinct ports (<= 65536).
* The per-pair verdicts are written as a table and joined back on (src, dst):
  with an exchange of its own on either side, the join of a hot pair can be
  split by adaptive execution.
* Incident rules aggregate before anything is projected, and their output is
  bounded by the number of distinct sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import rules
from vigil.functions import predicates as P
from vigil.functions import scalars as S
from vigil.operators.clean import coerce_timestamp, drop_invalid_ts, with_defaults
from vigil.session import cut_lineage

INCIDENT_COLUMNS = ["type", "source", "severity", "description", "timestamp"]


def _as_of(df: DataFrame, ts: str = "timestamp") -> Column:
    """Scalar subquery: newest timestamp of ``df`` (replaces the wall clock)."""
    return df.select(F.max(ts)).scalar()


# -- C2 / exfiltration -------------------------------------------------------

def detect_c2(network: DataFrame) -> DataFrame:
    """Adds ``c2_risk`` (0/1): C2 port or pastebin/github.io destination."""
    n = with_defaults(network, {"dst_port": -1, "dst_ip": ""})
    return n.withColumn("c2_risk", S.c2_risk(F.col("dst_port"), F.col("dst_ip")))


def detect_c2_extended(network: DataFrame) -> DataFrame:
    """C2 rule variant: more domains, protocol list and night hours (0-5)."""
    n = with_defaults(network, {"dst_port": -1, "dst_ip": "", "protocol": None})
    return n.withColumn("hour", F.hour("timestamp")).withColumn(
        "c2_risk", S.c2_risk_extended(F.col("dst_port"), F.col("dst_ip"), F.col("protocol"), F.col("timestamp"))
    )


def detect_exfil(network: DataFrame, threshold: int = rules.EXFIL_BYTES) -> DataFrame:
    """Adds ``transfer_rate`` and ``exfil_risk`` (external and > 1 MiB)."""
    n = with_defaults(network, {"bytes_sent": 0, "duration": 1})
    n = n.withColumn("transfer_rate", S.transfer_rate(F.col("bytes_sent"), F.col("duration")))
    if "dst_ip" not in n.columns:
        return n.withColumn("exfil_risk", F.lit(0))
    return n.withColumn("exfil_risk", S.exfil_risk(F.col("dst_ip"), F.col("bytes_sent"), threshold))


def detect_exfil_extended(network: DataFrame) -> DataFrame:
    """Exfil variant: external and (large or beaconing gap 0 < d <= 1 h)."""
    from vigil.operators.windows import time_diff

    n = network.withColumn("transfer_rate", S.transfer_rate(F.col("bytes_sent"), F.col("duration")))
    n = time_diff(n)
    return n.withColumn(
        "exfil_risk", S.exfil_risk_extended(F.col("dst_ip"), F.col("bytes_sent"), F.col("time_diff"))
    )


# -- port scanning -------------------------------------------------------------

def port_scan_stats(network: DataFrame, th: rules.Thresholds = rules.Thresholds()) -> DataFrame:
    """Per (src_ip, dst_ip): distinct ports, first/last attempt, duration and
    the scan verdict (>= 20 ports, or >= 10 ports within <= 300 s)."""
    n = network.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    stats = n.groupBy("src_ip", "dst_ip").agg(
        F.countDistinct("dst_port").alias("unique_ports"),
        F.min("timestamp").alias("first_attempt"),
        F.max("timestamp").alias("last_attempt"),
    )
    duration = F.timestamp_diff("MICROSECOND", F.col("first_attempt"), F.col("last_attempt")) / F.lit(1e6)
    return stats.withColumn("scan_duration", duration).withColumn(
        "is_scan",
        (F.col("unique_ports") >= th.scan_ports_always)
        | ((F.col("unique_ports") >= th.scan_ports_burst) & (F.col("scan_duration") <= th.scan_burst_seconds)),
    )


def approx_port_scan_stats(network: DataFrame, rsd: float = 0.01,
                           th: rules.Thresholds = rules.Thresholds()) -> DataFrame:
    """HyperLogLog variant of :func:`port_scan_stats` (fixed-size state per
    pair, usable in streaming aggregations)."""
    n = network.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    stats = n.groupBy("src_ip", "dst_ip").agg(
        F.approx_count_distinct("dst_port", rsd).alias("unique_ports"),
        F.min("timestamp").alias("first_attempt"),
        F.max("timestamp").alias("last_attempt"),
    )
    duration = F.timestamp_diff("MICROSECOND", F.col("first_attempt"), F.col("last_attempt")) / F.lit(1e6)
    return stats.withColumn("scan_duration", duration).withColumn(
        "is_scan",
        (F.col("unique_ports") >= th.scan_ports_always)
        | ((F.col("unique_ports") >= th.scan_ports_burst) & (F.col("scan_duration") <= th.scan_burst_seconds)),
    )


def detect_port_scanning(network: DataFrame, th: rules.Thresholds = rules.Thresholds()) -> DataFrame:
    """Detail rows with ``is_scan`` of their (src, dst) pair and ``scan_risk``.

    Absent columns get defaults (a timestamp: now).  The
    verdicts are written as a table, so the join has an exchange of its own
    on either side and adaptive execution can split a hot pair."""
    n = with_defaults(network, {"src_ip": "0.0.0.0", "dst_ip": "0.0.0.0", "dst_port": -1,
                                "timestamp": "now"})
    n = drop_invalid_ts(coerce_timestamp(n, "timestamp"), "timestamp")
    verdict = cut_lineage(port_scan_stats(n, th).select("src_ip", "dst_ip", "is_scan"), "scans")
    return n.join(verdict, ["src_ip", "dst_ip"], "left").withColumn("scan_risk", S.scan_risk(F.col("is_scan")))


def detect_network_threats(network: DataFrame) -> DataFrame:
    """All three network detectors, in the order the dashboard applies them."""
    return detect_port_scanning(detect_exfil(detect_c2(network)))


# -- incidents -------------------------------------------------------------------

def _incident(df: DataFrame, kind: str, source: Column, severity: str, text: Column, as_of: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("type"),
        source.cast("string").alias("source"),
        F.lit(severity).alias("severity"),
        text.alias("description"),
        as_of.alias("timestamp"),
    )


def incident_multi_port(network: DataFrame, as_of: Column | None = None,
                        th: rules.Thresholds = rules.Thresholds()) -> DataFrame:
    """I1: a source touching >= 5 distinct ports of our host."""
    as_of = as_of if as_of is not None else _as_of(network)
    agg = (
        network.filter((F.col("dst_ip") == th.own_ip) & F.col("src_ip").isNotNull())
        .groupBy("src_ip")
        .agg(F.countDistinct("dst_port").alias("n"))
        .filter(F.col("n") >= th.port_threshold)
    )
    return _incident(agg, "Multiple Ports Accessed", F.col("src_ip"), "High",
                     S.text_multi_port(F.col("src_ip"), F.col("n")), as_of)


def incident_syn_flood(network: DataFrame, as_of: Column | None = None,
                       th: rules.Thresholds = rules.Thresholds()) -> DataFrame:
    """I2: a source sending >= 15 bare SYN packets to our host."""
    as_of = as_of if as_of is not None else _as_of(network)
    agg = (
        network.filter((F.col("flags") == "S") & (F.col("dst_ip") == th.own_ip) & F.col("src_ip").isNotNull())
        .groupBy("src_ip")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= th.syn_threshold)
    )
    return _incident(agg, "Possible SYN Flood", F.col("src_ip"), "Critical",
                     S.text_syn_flood(F.col("src_ip"), F.col("n")), as_of)


def _command_col(process: DataFrame) -> str | None:
    for c in ("command", "Command"):
        if c in process.columns:
            return c
    return None


def high_memory_filter(process: DataFrame, threshold: float = rules.HIGH_MEMORY) -> DataFrame:
    cmd = _command_col(process)
    out = process.filter(S.over(F.col("memory"), threshold))
    return out.filter(~P.is_whitelisted(F.col(cmd))) if cmd else out


def suspicious_process_filter(process: DataFrame) -> DataFrame:
    cmd = _command_col(process)
    if cmd is None:
        return process.limit(0)
    return process.filter(P.suspicious_process(F.col(cmd)))


def incident_high_memory(process: DataFrame, as_of: Column | None = None,
                         th: rules.Thresholds = rules.Thresholds()) -> DataFrame:
    """I3: memory above the threshold and not whitelisted."""
    as_of = as_of if as_of is not None else _as_of(process)
    cmd = _command_col(process)
    rows = high_memory_filter(process, th.high_memory)
    source = F.col("process_name") if "process_name" in process.columns else F.lit("Unknown")
    cmd_col = F.col(cmd) if cmd else F.lit("Unknown")
    return _incident(rows, "High Memory Process", source, "High",
                     S.text_high_memory(F.col("memory"), cmd_col), as_of)


def incident_suspicious_process(process: DataFrame, as_of: Column | None = None) -> DataFrame:
    """I4: incident keyword regex hit and not whitelisted."""
    as_of = as_of if as_of is not None else _as_of(process)
    cmd = _command_col(process)
    rows = suspicious_process_filter(process)
    c = F.col(cmd) if cmd else F.lit(None).cast("string")
    return _incident(rows, "Suspicious Process", c, "High", S.text_suspicious(c), as_of)


def detect_incidents(network: DataFrame | None, process: DataFrame | None,
                     as_of: Column | None = None, th: rules.Thresholds = rules.Thresholds()) -> DataFrame:
    """I5: all rows of the four incident rules (duplicates kept).

    One aggregate per source decides I1 and I2, one pass over the processes
    I3 and I4; a row gives as many incidents as rules it meets."""
    if as_of is None:
        marks = [_as_of(d) for d in (network, process) if d is not None]
        as_of = marks[0] if len(marks) == 1 else F.greatest(*marks)
    parts: list[DataFrame] = []
    if network is not None:
        src = F.col("src_ip")
        per_source = (network.filter((F.col("dst_ip") == th.own_ip) & src.isNotNull()).groupBy("src_ip")
                      .agg(F.countDistinct("dst_port").alias("ports"), F.count_if(F.col("flags") == "S").alias("syns")))
        parts.append(_any_of(per_source, as_of, [
            (F.col("ports") >= th.port_threshold, "Multiple Ports Accessed", src, "High", S.text_multi_port(src, F.col("ports"))),
            (F.col("syns") >= th.syn_threshold, "Possible SYN Flood", src, "Critical", S.text_syn_flood(src, F.col("syns")))]))
    if process is not None:
        cmd = _command_col(process)
        c = F.col(cmd) if cmd else F.lit(None).cast("string")
        memory = S.over(F.col("memory"), th.high_memory)
        source = F.col("process_name") if "process_name" in process.columns else F.lit("Unknown")
        parts.append(_any_of(process, as_of, [
            (memory & ~P.is_whitelisted(c) if cmd else memory, "High Memory Process", source, "High",
             S.text_high_memory(F.col("memory"), c if cmd else F.lit("Unknown"))),
            (P.suspicious_process(c) if cmd else F.lit(False), "Suspicious Process", c, "High", S.text_suspicious(c))]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _any_of(df: DataFrame, as_of: Column, rules_: list[tuple]) -> DataFrame:
    """One incident row per row of ``df`` and rule (condition, type, source,
    severity, text) that it meets."""
    hits = [F.when(cond, F.struct(F.lit(kind).alias("type"), source.cast("string").alias("source"),
                                  F.lit(severity).alias("severity"), text.alias("description")))
            for cond, kind, source, severity, text in rules_]
    return df.select(F.explode(F.array_compact(F.array(*hits))).alias("x")).select("x.*", as_of.alias("timestamp"))


SEVERITY_RANK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}


def sort_incidents(incidents: DataFrame, severity_order: str = "lexical") -> DataFrame:
    """Severity descending then timestamp descending.  ``lexical`` compares
    the severity text (so High sorts before Critical, as reproduced);
    ``rank`` uses Critical > High > Medium > Low.  Ties go by the text columns."""
    ties = [F.col(c) for c in ("type", "source", "description")]
    if severity_order == "rank":
        rank = F.coalesce(
            F.try_element_at(F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))]),
                             F.col("severity")), F.lit(0))
        return incidents.orderBy(rank.desc(), F.col("timestamp").desc(), *ties)
    return incidents.orderBy(F.col("severity").desc(), F.col("timestamp").desc(), *ties)


def critical_anomalies(scored: DataFrame, max_score: float = rules.ALERT_MIN_ANOMALY_SCORE) -> DataFrame:
    return scored.filter((F.col("is_anomaly") == -1) & (F.col("anomaly_score") < max_score))


def high_threat_filter(df: DataFrame, threshold: int = rules.HIGH_THREAT_VIEW) -> DataFrame:
    if "threat_score" not in df.columns:
        df = df.withColumn("threat_score", S.threat_score(df))
    return df.filter(F.col("threat_score") > threshold)


def alert_rows(scored_process: DataFrame, network: DataFrame) -> DataFrame:
    """I6: rows of the alert mail: critical anomalies and network threats
    (threat score > 80), one frame with a ``kind`` column."""
    crit = critical_anomalies(scored_process).select(
        F.lit("anomaly").alias("kind"), F.col("timestamp"), F.col("command").alias("detail"),
        F.col("user_name"), F.col("anomaly_score").alias("score"),
        F.lit(None).cast("string").alias("src_ip"), F.lit(None).cast("string").alias("dst_ip"),
        F.lit(None).cast("int").alias("dst_port"),
    )
    net = high_threat_filter(network, rules.HIGH_THREAT_ALERT).select(
        F.lit("network").alias("kind"), F.col("timestamp"), F.lit(None).cast("string").alias("detail"),
        F.lit(None).cast("string").alias("user_name"), F.col("threat_score").cast("double").alias("score"),
        F.col("src_ip"), F.col("dst_ip"), F.col("dst_port"),
    )
    return crit.unionByName(net)
