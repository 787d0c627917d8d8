"""Report numbers (A21) as one long table ``(section, metric, value)``.

The report's text, charts and mail delivery are presentation and are not
built; this is the data behind them.  Every part is a sum over pre-aggregated
counts of a whole table (or a top-5 of them), stacked with ``unionByName``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import rules
from vigil.functions import predicates as P
from vigil.functions import scalars as S
from vigil.operators import aggregates as A
from vigil.operators import sets as X
from vigil.session import cut_lineage


def _long(df: DataFrame, section: str) -> DataFrame:
    """One-row frame of metrics -> rows (section, metric, value double)."""
    cols = df.columns
    stack = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {stack}) AS (metric, value)").select(
        F.lit(section).alias("section"), "metric", "value")


def _keyed(df: DataFrame, section: str, key: str) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("metric"),
                     F.col("count").cast("double").alias("value"))


def report_summary(network: DataFrame, process: DataFrame, commands: DataFrame,
                   th: rules.Thresholds = rules.Thresholds()) -> DataFrame:
    """Every number of the report from one pass over each table: network rows
    are counted per (source, destination, port, flags) and command lines per
    text, both written once, and the numbers are sums over these counts."""
    flows = cut_lineage(network.groupBy("src_ip", "dst_ip", "dst_port", "flags").agg(F.count(F.lit(1)).alias("n")), "report-flows")
    said = cut_lineage(commands.groupBy("command").agg(F.count(F.lit(1)).alias("n")), "report-commands")
    total = F.sum("n")

    to_us = flows.filter((F.col("dst_ip") == th.own_ip) & F.col("src_ip").isNotNull())
    busy = (to_us.filter(F.col("dst_port").isNotNull()).groupBy("src_ip", "dst_port").agg(total.alias("n"))
            .filter(F.col("n") >= rules.PORT_THRESHOLD).select(F.count(F.lit(1))).scalar())
    by_source = cut_lineage(to_us.groupBy("src_ip").agg(
        total.alias("count"), F.countDistinct("dst_port").alias("ports"),
        F.coalesce(F.sum(F.when(F.col("flags") == "S", F.col("n"))), F.lit(0)).alias("syns")), "report-sources")
    floods = by_source.filter(F.col("syns") >= rules.SYN_THRESHOLD).select(F.count(F.lit(1))).scalar()
    net = flows.agg(F.coalesce(total, F.lit(0)).alias("total_events"), F.countDistinct("src_ip").alias("unique_ips")).select(
        "*", busy.alias("multi_port_accesses"), floods.alias("potential_floods"))
    outbound = (flows.filter((F.col("src_ip") == th.own_ip) & F.col("dst_ip").isNotNull())
                .groupBy("dst_ip").agg(total.alias("count")))

    cmd = F.col("command")
    rows = process.agg(
        F.count(F.lit(1)).alias("total_processes"), S.mean_of(F.col("cpu"), 2).alias("avg_cpu"),
        S.mean_of(F.col("memory"), 2).alias("avg_memory"),
        F.count_if(S.over(F.col("memory"), th.high_memory) & ~P.is_whitelisted(cmd)).alias("high_memory"),
        F.count_if(P.suspicious_process(cmd)).alias("suspicious"))
    proc = cut_lineage(rows, "report-process")
    many = by_source.agg(F.count_if(F.col("ports") >= th.port_threshold).alias("ports"),
                         F.count_if(F.col("syns") >= th.syn_threshold).alias("syns"))
    ports, syns = many.select("ports").scalar(), many.select("syns").scalar()
    high = ports + F.col("high_memory") + F.col("suspicious")
    severities = proc.select(F.explode(F.array(
        F.struct(F.lit("High").alias("severity"), high.alias("count")),
        F.struct(F.lit("Critical").alias("severity"), syns.alias("count")))).alias("x")).select("x.*")

    score = S.threat_score(said)
    parts = [
        _long(proc.select("total_processes", "avg_cpu", "avg_memory"), "process"),
        _long(net, "network"),
        _keyed(A.top_by_count(by_source, "src_ip", rules.TOP_N), "top_inbound", "src_ip"),
        _keyed(A.top_by_count(outbound, "dst_ip", rules.TOP_N), "top_outbound", "dst_ip"),
        _long(said.agg(F.coalesce(total, F.lit(0)).alias("total_commands"),
                       F.coalesce(F.sum(F.when(score > rules.HIGH_THREAT_VIEW, F.col("n"))), F.lit(0)).alias("high_threat_commands")),
              "commands"),
        _keyed(A.top_by_count(said.filter(cmd.isNotNull()).withColumnRenamed("n", "count"), "command", rules.TOP_N),
               "top_commands", "command"),
        _long(proc.select((high + syns).alias("total_incidents")), "incidents"),
        _keyed(severities.filter(F.col("count") > 0), "incidents_by_severity", "severity"),
        _long(X.all_ips(flows, commands).agg(F.count(F.lit(1)).alias("unique_ips")), "threat_intel"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary_sql(incidents_sql: str, threat_cmd_sql: str) -> str:
    """DuckDB twin of :func:`report_summary` (expects the ``as_of_ts`` CTE)."""
    own, pt, st, n = rules.OWN_IP, rules.PORT_THRESHOLD, rules.SYN_THRESHOLD, rules.TOP_N
    return f"""
  SELECT 'process' AS section, 'total_processes' AS metric, CAST(count(*) AS DOUBLE) AS value FROM process
  UNION ALL SELECT 'process', 'avg_cpu', CAST(sum(CAST(cpu AS DECIMAL(38,2))) AS DOUBLE) / count(cpu) FROM process
  UNION ALL SELECT 'process', 'avg_memory', CAST(sum(CAST(memory AS DECIMAL(38,2))) AS DOUBLE) / count(memory)
     FROM process
  UNION ALL SELECT 'network', 'total_events', count(*) FROM network
  UNION ALL SELECT 'network', 'unique_ips', count(DISTINCT src_ip) FROM network
  UNION ALL SELECT 'network', 'multi_port_accesses', count(*) FROM (SELECT src_ip, dst_port FROM network
     WHERE dst_ip = '{own}' AND src_ip IS NOT NULL AND dst_port IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {pt}) a
  UNION ALL SELECT 'network', 'potential_floods', count(*) FROM (SELECT src_ip, dst_ip FROM network
     WHERE flags = 'S' AND src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY 1, 2
     HAVING count(*) >= {st} AND dst_ip = '{own}') b
  UNION ALL SELECT 'top_inbound', src_ip, c FROM (SELECT src_ip, count(*) AS c FROM network
     WHERE dst_ip = '{own}' AND src_ip IS NOT NULL GROUP BY 1 ORDER BY c DESC, src_ip LIMIT {n}) ti
  UNION ALL SELECT 'top_outbound', dst_ip, c FROM (SELECT dst_ip, count(*) AS c FROM network
     WHERE src_ip = '{own}' AND dst_ip IS NOT NULL GROUP BY 1 ORDER BY c DESC, dst_ip LIMIT {n}) tout
  UNION ALL SELECT 'commands', 'total_commands', count(*) FROM commands
  UNION ALL SELECT 'commands', 'high_threat_commands', count(*) FILTER (WHERE {threat_cmd_sql} > {rules.HIGH_THREAT_VIEW})
     FROM commands
  UNION ALL SELECT 'top_commands', command, c FROM (SELECT command, count(*) AS c FROM commands
     WHERE command IS NOT NULL GROUP BY 1 ORDER BY c DESC, command LIMIT {n}) tc
  UNION ALL SELECT 'incidents', 'total_incidents', count(*) FROM ({incidents_sql}) i1
  UNION ALL SELECT 'incidents_by_severity', severity, count(*) FROM ({incidents_sql}) i2 GROUP BY severity
  UNION ALL SELECT 'threat_intel', 'unique_ips', count(*) FROM (SELECT src_ip AS ip FROM network UNION
     SELECT dst_ip FROM network) u WHERE ip IS NOT NULL AND ip <> '' AND ip <> '{own}'
"""
