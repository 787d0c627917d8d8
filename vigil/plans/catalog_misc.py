"""Registered queries over cron, file and geo entities, incidents and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import rules
from vigil.operators import aggregates as A
from vigil.operators import detect as D
from vigil.operators import sets as X
from vigil.operators import windows as W
from vigil.plans import report
from vigil.plans.catalog_process import NOT_WL, SUSP_SQL, THREAT_CMD_SQL
from vigil.plans.registry import query

OWN = rules.OWN_IP

INCIDENTS_SQL = f"""
  SELECT 'Multiple Ports Accessed' AS type, src_ip AS source, 'High' AS severity,
         src_ip || ' accessed ' || CAST(n AS VARCHAR) || ' different ports' AS description, (SELECT ts FROM as_of_ts) AS timestamp
  FROM (SELECT src_ip, count(DISTINCT dst_port) AS n FROM network WHERE dst_ip = '{OWN}' AND src_ip IS NOT NULL
        GROUP BY src_ip) a WHERE n >= {rules.PORT_THRESHOLD}
  UNION ALL
  SELECT 'Possible SYN Flood', src_ip, 'Critical', src_ip || ' sent ' || CAST(n AS VARCHAR) || ' SYN packets',
         (SELECT ts FROM as_of_ts)
  FROM (SELECT src_ip, count(*) AS n FROM network WHERE flags = 'S' AND dst_ip = '{OWN}' AND src_ip IS NOT NULL
        GROUP BY src_ip) b WHERE n >= {rules.SYN_THRESHOLD}
  UNION ALL
  SELECT 'High Memory Process', 'Unknown', 'High',
         'Process using ' || CAST(memory AS VARCHAR) || '% Memory: ' || command, (SELECT ts FROM as_of_ts)
  FROM process WHERE memory > {rules.HIGH_MEMORY} AND {NOT_WL}
  UNION ALL
  SELECT 'Suspicious Process', command, 'High', 'Suspicious command detected: ' || command, (SELECT ts FROM as_of_ts)
  FROM process WHERE {SUSP_SQL}
"""
ASOF_SQL = "as_of_ts AS (SELECT greatest((SELECT max(timestamp) FROM network), (SELECT max(timestamp) FROM process)) AS ts)"
NP = ("network", "process")


def incidents(t):
    return D.detect_incidents(t.network, t.process)


@query("detect_incidents", f"WITH {ASOF_SQL} {INCIDENTS_SQL}", NP)
def _detect_incidents(t):
    return incidents(t)


@query("sort_incidents", f"WITH {ASOF_SQL} SELECT * FROM ({INCIDENTS_SQL}) i ORDER BY severity DESC, timestamp DESC",
       NP)
def _sort_incidents(t):
    return D.sort_incidents(incidents(t))


@query("severity_counts", f"WITH {ASOF_SQL} SELECT severity, count(*) AS count FROM ({INCIDENTS_SQL}) i GROUP BY 1",
       NP)
def _severity_counts(t):
    return A.severity_counts(incidents(t))


# -- cron -----------------------------------------------------------------------------

@query("adapter_cron", "SELECT * FROM cron", ("cron",))
def _adapter_cron(t):
    return t.cron


@query("cron_metrics", "SELECT count(*) AS total_cron_events FROM cron", ("cron",))
def _cron_metrics(t):
    return A.cron_metrics(t.cron)


@query("cron_histogram", """
    SELECT time_bucket(INTERVAL 60 MINUTES, timestamp) AS bin_start, count(*) AS events FROM cron
    WHERE timestamp IS NOT NULL GROUP BY 1""", ("cron",))
def _cron_histogram(t):
    return A.time_histogram(t.cron, 60)


@query("cron_new_jobs", """
    WITH s AS (SELECT DISTINCT cron_file, snapshot_date, job FROM cron),
         d AS (SELECT cron_file, snapshot_date,
                      lag(snapshot_date) OVER (PARTITION BY cron_file ORDER BY snapshot_date) AS prev_date
               FROM (SELECT DISTINCT cron_file, snapshot_date FROM s) x)
    SELECT s.cron_file, s.snapshot_date, s.job FROM s JOIN d USING (cron_file, snapshot_date)
    WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.cron_file = s.cron_file AND p.snapshot_date = d.prev_date
                      AND p.job = s.job)""", ("cron",))
def _cron_new_jobs(t):
    return X.cron_new_jobs(t.cron)


# -- files / geo ------------------------------------------------------------------------

@query("file_mod_changes", """
    SELECT * FROM (SELECT *, max(mtime_s) OVER (PARTITION BY file ORDER BY timestamp, id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max
                   FROM file_ev WHERE file IS NOT NULL) x
    WHERE mtime_s > prev_max""", ("file_ev",))
def _file_mod_changes(t):
    return W.file_mod_changes(t.files)


@query("adapter_geo", "SELECT * FROM geo", ("geo",))
def _adapter_geo(t):
    return t.geo


# -- report ---------------------------------------------------------------------------

@query("report_summary", f"WITH {ASOF_SQL} " + report.summary_sql(INCIDENTS_SQL, THREAT_CMD_SQL),
       ("network", "process", "commands"))
def _report_summary(t):
    return report.report_summary(t.network, t.process, t.commands)


# -- model (rows-only checks: scores come from a randomised model) ------------------------

#: Folder of the model fitted on a table in this application; the queries below share it.
_MODELS: dict[tuple[str, str], str] = {}


def _intel(t):
    from vigil.plans.flagship import process_intelligence
    from vigil.session import shared_dir

    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    path = _MODELS.setdefault(key, shared_dir(t.spark, "forest-model"))
    return process_intelligence(t.process, t.network, model_path=path)


@query("fit_isolation_forest")
def _fit_forest(t):
    from vigil.operators import features as M
    from vigil.operators import forest as FR

    _, matrix, _, _ = M.prepare_model_input(t.process)
    return FR.fit_isolation_forest(matrix, [c for c in rules.MODEL_FEATURES if c in matrix.columns]).nodes


@query("score_anomalies")
def _score_anomalies(t):
    return _intel(t).process.select("id", "timestamp", "user_name", "command", "anomaly_score", "is_anomaly",
                                    "anomaly_risk")


@query("top_anomalies")
def _top_anomalies(t):
    from vigil.plans.flagship import top_anomalies

    return top_anomalies(_intel(t).process).select("id", "command", "anomaly_score", "anomaly_risk")


@query("critical_anomalies")
def _critical(t):
    return D.critical_anomalies(_intel(t).process).select("id", "command", "anomaly_score")


@query("process_intelligence")
def _process_intelligence(t):
    return _intel(t).merged.select("id", "timestamp", "pid", "user_name", "command", "anomaly_score",
                                   "is_anomaly", "anomaly_risk", "time_window", "src_ip", "bytes_sent",
                                   "n_dst_ports", "n_dst_ips", "c2_risk", "exfil_risk")


@query("related_activity")
def _related(t):
    from vigil.plans.flagship import related_activity

    return related_activity(_intel(t))


def _matrix(t):
    i = _intel(t)
    return A.threat_matrix(i.process, A.network_window_stats(i.network))


@query("threat_matrix")
def _threat_matrix(t):
    return _matrix(t)


@query("top_matrix")
def _top_matrix(t):
    return A.top_matrix(_matrix(t))


@query("threat_counts")
def _threat_counts(t):
    i = _intel(t)
    return A.threat_counts(i.process, i.network)


@query("alert_rows")
def _alert_rows(t):
    i = _intel(t)
    return D.alert_rows(i.process, i.network)


@query("kmeans_network")
def _kmeans(t):
    from vigil.operators.cluster import kmeans_sources

    return kmeans_sources(t.network)


# -- text parsers over rendered entity rows --------------------------------------------

@query("parse_top", """
    SELECT time_bucket(INTERVAL 5 MINUTES, timestamp) AS timestamp, pid, user_name, cpu, memory, virt, res, shr, s,
           time_used, command, sha256(command) AS hashed_command FROM process""", ("process",))
def _parse_top(t):
    from vigil.sources.files import parse_top, top_lines_from_process

    return parse_top(top_lines_from_process(t.process))


@query("parse_process_csv", """
    SELECT CAST(date_trunc('second', timestamp) AS TIMESTAMP) AS timestamp, pid, user_name, cpu, memory, virt, res,
           shr, s, time_used, command, hashed_command FROM process""", ("process",))
def _parse_process_csv(t):
    from vigil.sources.files import parse_process_csv

    p = t.process
    line = F.concat_ws(",", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "pid", "user_name", "cpu", "memory",
                       "virt", "res", "shr", "s", "time_used", "command", "hashed_command")
    header = p.limit(1).select(F.lit(",".join(rules.PROCESS_CSV_HEADER)).alias("value"))
    parsed = parse_process_csv(header.unionByName(p.select(line.alias("value"))))
    return parsed.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("sort_incidents_rank", f"WITH {ASOF_SQL} SELECT * FROM ({INCIDENTS_SQL}) i", NP)
def _sort_incidents_rank(t):
    return D.sort_incidents(incidents(t), "rank")


@query("anomaly_score_histogram")
def _anomaly_score_histogram(t):
    return A.value_histogram(_intel(t).process, "anomaly_score", 0.05)
