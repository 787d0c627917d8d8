"""Aggregations and top-k reports (DataFrame -> DataFrame).

Every aggregate here is algebraic (count / sum / min / max / avg) or a single
distinct count, so Catalyst splits it into a partial (map-side) and a final
aggregate: a hot group key costs one pre-aggregated row per input partition
in the shuffle, not its raw rows.  Group-key filters sit below the
aggregate and reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import rules
from vigil.functions import scalars as S
from vigil.operators.clean import coerce_timestamp, with_defaults


def _count() -> Column:
    return F.count(F.lit(1))


# A1 --------------------------------------------------------------------------
def process_metrics(process: DataFrame, exact_scale: int | None = None) -> DataFrame:
    """Row count, mean CPU, mean memory (``exact_scale``: see ``mean_of``)."""
    return process.agg(
        _count().alias("total_processes"),
        S.mean_of(F.col("cpu"), exact_scale).alias("avg_cpu"),
        S.mean_of(F.col("memory"), exact_scale).alias("avg_memory"),
    )


# A5 / A6 / A7 ------------------------------------------------------------------
def port_access_counts(network: DataFrame, own_ip: str = rules.OWN_IP,
                       threshold: int = rules.PORT_THRESHOLD) -> DataFrame:
    """Events per (source, destination port) towards our host, >= threshold."""
    return (
        network.filter(F.col("dst_ip") == own_ip)
        .filter(F.col("src_ip").isNotNull() & F.col("dst_port").isNotNull())
        .groupBy("src_ip", "dst_port").agg(_count().alias("count"))
        .filter(F.col("count") >= threshold)
    )


def syn_flood_pairs(network: DataFrame, own_ip: str = rules.OWN_IP,
                    threshold: int = rules.SYN_THRESHOLD) -> DataFrame:
    """Bare-SYN packets per (source, destination) >= threshold, towards us.
    The destination test is written after the aggregate, as in the source;
    Catalyst pushes it below the aggregate into the scan."""
    return (
        network.filter((F.col("flags") == "S") & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
        .groupBy("src_ip", "dst_ip").agg(_count().alias("count"))
        .filter((F.col("count") >= threshold) & (F.col("dst_ip") == own_ip))
    )


def inbound_counts(network: DataFrame, own_ip: str = rules.OWN_IP) -> DataFrame:
    return (
        network.filter((F.col("dst_ip") == own_ip) & F.col("src_ip").isNotNull())
        .groupBy("src_ip").agg(_count().alias("count"))
    )


def outbound_counts(network: DataFrame, own_ip: str = rules.OWN_IP) -> DataFrame:
    return (
        network.filter((F.col("src_ip") == own_ip) & F.col("dst_ip").isNotNull())
        .groupBy("dst_ip").agg(_count().alias("count"))
    )


# A2 --------------------------------------------------------------------------
def network_metrics(network: DataFrame, own_ip: str = rules.OWN_IP) -> DataFrame:
    """Events, distinct sources, number of multi-port and SYN-flood rows.
    The two counts are scalar subqueries (no cross join)."""
    n_ports = port_access_counts(network, own_ip).select(_count()).scalar()
    n_floods = syn_flood_pairs(network, own_ip).select(_count()).scalar()
    return network.agg(
        _count().alias("total_events"),
        F.countDistinct("src_ip").alias("unique_ips"),
    ).select("*", n_ports.alias("multi_port_accesses"), n_floods.alias("potential_floods"))


# A3 / A4 -----------------------------------------------------------------------
def command_metrics(commands: DataFrame, threshold: int = rules.HIGH_THREAT_VIEW) -> DataFrame:
    score = S.threat_score(commands)
    return commands.agg(
        _count().alias("total_commands"),
        F.count_if(score > threshold).alias("high_threat_commands"),
    )


def cron_metrics(cron: DataFrame) -> DataFrame:
    return cron.agg(_count().alias("total_cron_events"))


# A9 ----------------------------------------------------------------------------
def network_window_stats(network: DataFrame, minutes: int = rules.BUCKET_MINUTES) -> DataFrame:
    """Per (5-minute bucket, source): bytes, distinct ports, distinct
    destinations and the max of the risk flags that are present.  Columns the
    stored table may lack get the behaviour analysis' defaults."""
    network = coerce_timestamp(with_defaults(network, {"bytes_sent": 0, "dst_port": -1, "dst_ip": "0.0.0.0", "src_ip": "0.0.0.0"}))
    n = network.withColumn("time_window", S.floor_minutes(F.col("timestamp"), minutes))
    aggs = [
        F.sum("bytes_sent").alias("bytes_sent"),
        F.countDistinct("dst_port").alias("n_dst_ports"),
        F.countDistinct("dst_ip").alias("n_dst_ips"),
    ]
    for flag in ("c2_risk", "exfil_risk"):
        if flag in network.columns:
            aggs.append(F.max(flag).alias(flag))
    return (
        n.filter(F.col("time_window").isNotNull() & F.col("src_ip").isNotNull())
        .groupBy("time_window", "src_ip").agg(*aggs)
    )


# A10 / A11 / A12 ---------------------------------------------------------------
def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(_count().alias("count"))


def command_counts(commands: DataFrame) -> DataFrame:
    return value_counts(commands, "command")


def severity_counts(incidents: DataFrame) -> DataFrame:
    return value_counts(incidents, "severity")


def scanned_ports_by_source(scan_rows: DataFrame) -> DataFrame:
    return (
        scan_rows.filter(F.col("src_ip").isNotNull())
        .groupBy("src_ip").agg(F.countDistinct("dst_port").alias("unique_ports"))
    )


# A13 / A18 ---------------------------------------------------------------------
def behavior_cells(process: DataFrame, window_stats: DataFrame, risk: str,
                   minutes: int = rules.BUCKET_MINUTES) -> DataFrame:
    """What the behaviour join says per (window, command, pid, n_dst_ports),
    without the join's rows: process rows are counted per (window, command,
    pid) and sources per (window, n_dst_ports) first, and a cell stands for
    ``rows`` x ``sources`` joined rows.  Null group keys are dropped."""
    p = (process.filter(F.col("command").isNotNull())
         .groupBy(S.floor_minutes(F.col("timestamp"), minutes).alias("time_window"), "command", "pid")
         .agg(_count().alias("rows"), F.count(risk).alias("risks"), F.max(risk).alias("max_risk"), F.sum(risk).alias("sum_risk")))
    n = (window_stats.filter(F.col("n_dst_ports").isNotNull()).groupBy("time_window", "n_dst_ports")
         .agg(_count().alias("sources"), F.sum("bytes_sent").alias("bytes_sent")))
    return p.join(n, "time_window")


def threat_matrix(process: DataFrame, window_stats: DataFrame, risk: str = "anomaly_risk") -> DataFrame:
    """Per (command, n_dst_ports) of the behaviour join: max risk, total
    bytes, distinct pids."""
    return (
        behavior_cells(process, window_stats, risk).groupBy("command", "n_dst_ports")
        .agg(F.max("max_risk").alias("max_risk"), F.sum(F.col("bytes_sent") * F.col("rows")).alias("bytes_sent"),
             F.countDistinct("pid").alias("n_pids"))
    )


def top_matrix(matrix: DataFrame, n: int = 10) -> DataFrame:
    return matrix.orderBy(F.col("max_risk").desc(), F.col("command"), F.col("n_dst_ports")).limit(n)


def risk_density(process: DataFrame, window_stats: DataFrame, risk: str = "anomaly_risk") -> DataFrame:
    """Per (n_dst_ports, command) of the behaviour join: mean risk."""
    total = F.sum(F.col("sum_risk") * F.col("sources"))
    return (
        behavior_cells(process, window_stats, risk).groupBy("n_dst_ports", "command")
        .agg(F.try_divide(total, F.sum(F.col("risks") * F.col("sources"))).alias("avg_risk"))
    )


# A14 / A15 ---------------------------------------------------------------------
def hourly_timeline(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Events per hour with zero-filled gaps between the first and last hour.

    The hour grid is generated from min/max (its size grows with the time
    span, not the row count) and left-joined to the hourly counts."""
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
    counts = df.filter(F.col(ts).isNotNull()).groupBy(hour.alias("hour")).agg(_count().alias("events"))
    grid = counts.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour")
    )
    return grid.join(counts, "hour", "left").select("hour", F.coalesce("events", F.lit(0)).alias("events"))


def time_histogram(df: DataFrame, width_minutes: int = 60, ts: str = "timestamp") -> DataFrame:
    """Event counts in fixed-width time bins (cron timeline)."""
    b = F.window(F.col(ts), f"{width_minutes} minutes").start
    return df.filter(F.col(ts).isNotNull()).groupBy(b.alias("bin_start")).agg(_count().alias("events"))


# A16 ---------------------------------------------------------------------------
def hour_command_cpu(process: DataFrame, exact_scale: int | None = None) -> DataFrame:
    """Long form of the heat map: mean CPU per (user, hour, command)."""
    return (
        process.filter(F.col("command").isNotNull() & F.col("timestamp").isNotNull())
        .groupBy("user_name", F.hour("timestamp").alias("hour"), "command")
        .agg(S.mean_of(F.col("cpu"), exact_scale).alias("avg_cpu"))
    )


def hour_command_pivot(process: DataFrame, commands: list[str], exact_scale: int | None = None) -> DataFrame:
    """Wide heat map: one row per (user, hour), one column per command of
    ``commands``.  The columns are the caller's choice (a chart's rows);
    finding them in the data would bring every distinct command to the
    driver.  All commands are in the long form, ``hour_command_cpu``."""
    base = process.filter(F.col("command").isNotNull() & F.col("timestamp").isNotNull()).withColumn("hour", F.hour("timestamp"))
    return base.groupBy("user_name", "hour").pivot("command", commands).agg(S.mean_of(F.col("cpu"), exact_scale))


# A17 ---------------------------------------------------------------------------
def c2_rollup(c2_rows: DataFrame) -> DataFrame:
    """Hierarchical byte totals src -> dst -> protocol (sunburst data).  The
    grand-total row sums every row, so the sum is a 38-digit decimal (no
    64-bit overflow at any scale)."""
    return c2_rows.rollup("src_ip", "dst_ip", "protocol").agg(
        F.sum(F.col("bytes_sent").cast("decimal(38,0)")).alias("bytes_sent"), F.grouping_id().alias("level")
    )


# A19 / A20 -------------------------------------------------------------------
def network_threat_counts(network_scored: DataFrame) -> DataFrame:
    return network_scored.agg(
        F.count_if(F.col("c2_risk") == 1).alias("c2_rows"),
        F.count_if(F.col("exfil_risk") == 1).alias("exfil_rows"),
        F.count_if(F.col("scan_risk") == 1).alias("scan_rows"),
    )


def threat_counts(scored_process: DataFrame, network_scored: DataFrame) -> DataFrame:
    net = network_threat_counts(network_scored)
    return scored_process.agg(
        _count().alias("processes_analyzed"),
        F.count_if(F.col("is_anomaly") == -1).alias("anomalies"),
    ).select(
        "*",
        net.select("c2_rows").scalar().alias("c2_rows"),
        net.select("exfil_rows").scalar().alias("exfil_rows"),
    )


def exfil_flows(exfil_rows: DataFrame) -> DataFrame:
    return (
        exfil_rows.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
        .groupBy("src_ip", "dst_ip").agg(F.sum("bytes_sent").alias("bytes_sent"), _count().alias("flows"))
    )


# A22 ---------------------------------------------------------------------------
def syn_ack_ratio(network: DataFrame) -> DataFrame:
    """Per source: share of bare-SYN packets, share of packets with ACK, and
    SYN/ACK ratio (NULL when no ACK was seen)."""
    syn = F.count_if(F.col("flags") == "S")
    ack = F.count_if(F.coalesce(F.upper(F.col("flags")).contains("A"), F.lit(False)))
    return (
        network.filter(F.col("src_ip").isNotNull())
        .groupBy("src_ip")
        .agg(_count().alias("packets"), syn.alias("syn"), ack.alias("ack"))
        .withColumn("syn_share", F.col("syn") / F.col("packets"))
        .withColumn("ack_share", F.col("ack") / F.col("packets"))
        .withColumn("syn_ack_ratio", F.try_divide(F.col("syn"), F.col("ack")))
    )


# top-k -------------------------------------------------------------------------
def top_by_count(counts: DataFrame, key: str, n: int = rules.TOP_N) -> DataFrame:
    """``n`` largest counts, ties by key ascending (TakeOrderedAndProject)."""
    return counts.orderBy(F.col("count").desc(), F.col(key)).limit(n)


def top_inbound(network: DataFrame, n: int = rules.TOP_N) -> DataFrame:
    return top_by_count(inbound_counts(network), "src_ip", n)


def top_outbound(network: DataFrame, n: int = rules.TOP_N) -> DataFrame:
    return top_by_count(outbound_counts(network), "dst_ip", n)


def top_commands(commands: DataFrame, n: int = rules.TOP_N) -> DataFrame:
    return top_by_count(command_counts(commands), "command", n)


def sort_by_threat(df: DataFrame) -> DataFrame:
    if "threat_score" not in df.columns:
        df = df.withColumn("threat_score", S.threat_score(df))
    return df.orderBy(F.col("threat_score").desc(), F.col("timestamp").desc(), F.col("id").desc())


def value_histogram(df: DataFrame, col: str, width: float) -> DataFrame:
    """Counts per fixed-width bin of a numeric column (bin = lower edge);
    NULL values are left out (chart data: anomaly scores, CPU usage)."""
    edge = (F.floor(F.col(col) / F.lit(width)) * F.lit(width)).cast("double")
    return df.filter(F.col(col).isNotNull()).groupBy(edge.alias("bin_start")).agg(_count().alias("count"))
