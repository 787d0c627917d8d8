"""Registered process / command queries (filters, scorers, features)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import rules
from vigil.functions import scalars as S
from vigil.operators import aggregates as A
from vigil.operators import clean as C
from vigil.operators import detect as D
from vigil.operators import features as M
from vigil.operators import joins as J
from vigil.operators import sets as X
from vigil.operators import windows as W
from vigil.plans.catalog_network import C2_SQL, EXFIL_SQL
from vigil.plans.oracle import WHITELIST_SQL, sql_contains_any, sql_regex_ci, sql_str
from vigil.plans.registry import query

PROC = ("process",)
CMDS = ("commands",)
NOT_WL = f"NOT {WHITELIST_SQL}"
EXCL_SQL = sql_contains_any("command", rules.OVER_LIMIT_EXCLUSIONS)
SUSP_SQL = f"{sql_regex_ci('command', rules.INCIDENT_KEYWORDS)} AND NOT {WHITELIST_SQL}"


def _threat_sql(cols: set[str]) -> str:
    terms = []
    if "command" in cols:
        for kw in rules.THREAT_KEYWORDS:
            terms.append(f"CASE WHEN COALESCE(contains(lower(command), {sql_str(kw)}), FALSE) "
                         f"THEN {rules.THREAT_KEYWORD_WEIGHT} ELSE 0 END")
    if "cpu" in cols:
        terms.append(f"CASE WHEN COALESCE(cpu > 90 AND memory > 90, FALSE) THEN {rules.THREAT_RESOURCE_WEIGHT} ELSE 0 END")
    return f"CAST(least({' + '.join(terms)}, {rules.THREAT_CAP}) AS INTEGER)"


THREAT_CMD_SQL = _threat_sql({"command"})
THREAT_PROC_SQL = _threat_sql({"command", "cpu"})


# -- adapters / filters ------------------------------------------------------------

@query("adapter_process", "SELECT * FROM process", PROC)
def _adapter_process(t):
    return t.process


@query("rename_columns",
       "SELECT id, timestamp AS \"Timestamp\", pid, user_name, cpu, memory, virt, res, shr, s, time_used, command, "
       "hashed_command FROM process", PROC)
def _rename_columns(t):
    return C.rename_columns(t.process)


@query("drop_columns", "SELECT id, timestamp, user_name, command, pid FROM commands", CMDS)
def _drop_columns(t):
    raw = t.commands.withColumn("type", F.lit("suspicious_command"))
    return C.drop_columns(raw, ["type", "not_there"])


@query("match_high_risk_commands", "SELECT * FROM commands", CMDS)
def _match_high_risk(t):
    return C.match_high_risk_commands(t.process).select("id", "timestamp", "user_name", "command", "pid")


def _patterns_values() -> str:
    distinct = list(dict.fromkeys(rules.HIGH_RISK_COMMANDS))
    return ", ".join(f"({sql_str(p)})" for p in distinct)


@query("match_high_risk_detail", f"""
    SELECT p.id, p.command, r.pattern FROM process p
    JOIN (VALUES {_patterns_values()}) r(pattern) ON contains(p.command, r.pattern)""", PROC)
def _match_high_risk_detail(t):
    return M.high_risk_detail(t.process)


@query("is_whitelisted", f"SELECT id, command, {WHITELIST_SQL} AS is_whitelisted FROM process", PROC)
def _is_whitelisted(t):
    return C.with_whitelist_flag(t.process).select("id", "command", "is_whitelisted")


@query("suspicious_process_filter", f"SELECT * FROM process WHERE {SUSP_SQL}", PROC)
def _suspicious_filter(t):
    return D.suspicious_process_filter(t.process)


@query("high_memory_filter", f"SELECT * FROM process WHERE memory > {rules.HIGH_MEMORY} AND {NOT_WL}", PROC)
def _high_memory_filter(t):
    return D.high_memory_filter(t.process)


#: Events lie minutes apart, so the registered snapshot is the newest row's day.
DAY = 24 * 60
LAST_DAY = "timestamp >= (SELECT date_trunc('day', max(timestamp)) FROM process)"


@query("over_limit_cpu", f"SELECT * FROM process WHERE {LAST_DAY} AND cpu > {rules.OVER_LIMIT_CPU} AND {NOT_WL} AND NOT {EXCL_SQL}",
       PROC)
def _over_limit_cpu(t):
    return C.over_limit_candidates(t.process, "cpu", minutes=DAY)


@query("over_limit_memory",
       f"SELECT * FROM process WHERE {LAST_DAY} AND memory > {rules.OVER_LIMIT_MEMORY} AND {NOT_WL} AND NOT {EXCL_SQL}", PROC)
def _over_limit_memory(t):
    return C.over_limit_candidates(t.process, "memory", minutes=DAY)


@query("manager_view", f"""
    SELECT *, CASE WHEN length(command) > 50 THEN substr(command, 1, 50) || '...' ELSE command END AS command_short
    FROM (SELECT * FROM process WHERE {LAST_DAY} ORDER BY cpu DESC, id DESC LIMIT 10) x WHERE {NOT_WL} AND NOT {EXCL_SQL}""", PROC)
def _manager_view(t):
    return C.manager_view(t.process, minutes=DAY)


@query("user_slice", "SELECT * FROM process WHERE user_name = 'user3'", PROC)
def _user_slice(t):
    return C.user_slice(t.process, "user3")


@query("distinct_users", "SELECT DISTINCT user_name FROM process WHERE user_name IS NOT NULL", PROC)
def _distinct_users(t):
    return C.distinct_users(t.process)


# -- incidents ----------------------------------------------------------------------

@query("incident_high_memory", f"""
    SELECT 'High Memory Process' AS type, 'Unknown' AS source, 'High' AS severity,
           'Process using ' || CAST(memory AS VARCHAR) || '% Memory: ' || command AS description,
           (SELECT max(timestamp) FROM process) AS timestamp
    FROM process WHERE memory > {rules.HIGH_MEMORY} AND {NOT_WL}""", PROC)
def _incident_high_memory(t):
    return D.incident_high_memory(t.process)


@query("incident_suspicious_process", f"""
    SELECT 'Suspicious Process' AS type, command AS source, 'High' AS severity,
           'Suspicious command detected: ' || command AS description,
           (SELECT max(timestamp) FROM process) AS timestamp
    FROM process WHERE {SUSP_SQL}""", PROC)
def _incident_suspicious(t):
    return D.incident_suspicious_process(t.process)


# -- scorers and scalars ---------------------------------------------------------------

@query("threat_score", f"SELECT id, command, {THREAT_CMD_SQL} AS threat_score FROM commands", CMDS)
def _threat_score(t):
    c = t.commands
    return c.select("id", "command", S.threat_score(c).alias("threat_score"))


@query("threat_score_process", f"SELECT id, command, cpu, memory, {THREAT_PROC_SQL} AS threat_score FROM process",
       PROC)
def _threat_score_process(t):
    p = t.process
    return p.select("id", "command", "cpu", "memory", S.threat_score(p).alias("threat_score"))


@query("high_threat_filter", f"""
    SELECT * FROM (SELECT *, {THREAT_CMD_SQL} AS threat_score FROM commands) x
    WHERE threat_score > {rules.HIGH_THREAT_VIEW}""", CMDS)
def _high_threat_filter(t):
    return D.high_threat_filter(t.commands)


@query("sort_by_threat", f"SELECT *, {THREAT_CMD_SQL} AS threat_score FROM commands", CMDS)
def _sort_by_threat(t):
    return A.sort_by_threat(t.commands)


def _proc_info_sql() -> str:
    tok = "regexp_extract(command, '^\\s*(\\S+)', 1)"
    name = f"(CASE WHEN {tok} = '' THEN NULL ELSE string_split({tok}, '/')[-1] END)"
    known = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in rules.KNOWN_PROCESSES)
    high = ", ".join(sql_str(x) for x in rules.HIGH_RISK_PROCESSES)
    desc = f"(CASE lower({name}) {known} END)"
    urls = dict(rules.PROCESS_INFO_URLS)
    pl = urls["ProcessLibrary"].split("{}")
    fn = urls["File.net"].split("{}")
    return f"""
      CASE WHEN {name} IS NULL THEN 'Unknown' ELSE {name} END AS process,
      CASE WHEN {name} IS NULL THEN 'No process information available' ELSE COALESCE({desc}, 'Unknown') END AS description,
      CASE WHEN {name} IS NULL THEN 'Unknown' WHEN lower({name}) IN ({high}) THEN 'High'
           WHEN {desc} IS NOT NULL THEN 'Medium' ELSE 'Unknown' END AS risk_level,
      CASE WHEN {name} IS NULL THEN NULL ELSE {sql_str(pl[0])} || {name} || {sql_str(pl[1])} END AS url_processlibrary,
      CASE WHEN {name} IS NULL THEN NULL ELSE {sql_str(fn[0])} || {name} || {sql_str(fn[1])} END AS url_filenet"""


@query("process_info", f"SELECT id, command, {_proc_info_sql()} FROM process", PROC)
def _process_info(t):
    return M.process_info_columns(t.process)


@query("command_scalars", """
    SELECT id, command, sha256(command) AS hash_command,
           CASE WHEN length(command) > 50 THEN substr(command, 1, 50) || '...' ELSE command END AS command_short,
           CASE WHEN memory = 0 THEN NULL ELSE cpu / memory END AS cpu_mem_ratio,
           CAST(res + 1 AS VARCHAR) || CASE s WHEN 'Z' THEN 'm' WHEN 'R' THEN 'g' ELSE '' END AS mem_text,
           CAST(round((res + 1) * CASE s WHEN 'Z' THEN 1024 WHEN 'R' THEN 1048576 ELSE 1 END) AS BIGINT) AS mem_kib
    FROM process""", PROC)
def _command_scalars(t):
    return M.command_scalars(t.process)


@query("command_entropy", """
    SELECT id, command, round(list_sum(list_transform(list_distinct(string_split(command, '')),
             lambda ch: -(len(list_filter(string_split(command, ''), lambda x: x = ch)) / length(command))
                   * log2(len(list_filter(string_split(command, ''), lambda x: x = ch)) / length(command)))), 6) AS entropy
    FROM process""", PROC)
def _command_entropy(t):
    return t.process.select("id", "command", F.round(S.command_entropy(F.col("command")), 6).alias("entropy"))


# -- aggregates ----------------------------------------------------------------------

EXACT_MEAN = "CAST(sum(CAST({c} AS DECIMAL(38,2))) AS DOUBLE) / count({c})"


@query("process_metrics",
       f"SELECT count(*) AS total_processes, {EXACT_MEAN.format(c='cpu')} AS avg_cpu, "
       f"{EXACT_MEAN.format(c='memory')} AS avg_memory FROM process", PROC)
def _process_metrics(t):
    # cpu / memory are percentages with two decimals: exact fixed-point means.
    return A.process_metrics(t.process, exact_scale=2)


@query("command_metrics", f"""
    SELECT count(*) AS total_commands, count(*) FILTER (WHERE {THREAT_CMD_SQL} > {rules.HIGH_THREAT_VIEW})
           AS high_threat_commands FROM commands""", CMDS)
def _command_metrics(t):
    return A.command_metrics(t.commands)


@query("command_counts",
       "SELECT command, count(*) AS count FROM commands WHERE command IS NOT NULL GROUP BY command", CMDS)
def _command_counts(t):
    return A.command_counts(t.commands)


@query("top_commands", f"""
    SELECT command, count(*) AS count FROM commands WHERE command IS NOT NULL GROUP BY command
    ORDER BY count DESC, command LIMIT {rules.TOP_N}""", CMDS)
def _top_commands(t):
    return A.top_commands(t.commands)


@query("hour_command_cpu", f"""
    SELECT user_name, CAST(hour(timestamp) AS INTEGER) AS hour, command, {EXACT_MEAN.format(c='cpu')} AS avg_cpu
    FROM process WHERE command IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2, 3""", PROC)
def _hour_command_cpu(t):
    return A.hour_command_cpu(t.process, exact_scale=2)


#: The heat map's columns: every command line of the derived process table.
HEAT_COMMANDS = ["rm -rf /tmp/a", "wget http://x/y", "nmap -sS 10.0.0.0/8", "bash -c curl x", "python3 /script.py", "nginx: worker",
                 "/usr/bin/java -jar a.jar", "chmod 777 /etc", "postgres: writer", "nc -lvnp 4444"]
_HEAT_COLS = ", ".join(
    f"CAST(sum(CAST(cpu AS DECIMAL(38,2))) FILTER (WHERE command = '{c}') AS DOUBLE) / nullif(count(cpu) FILTER (WHERE command = '{c}'), 0)"
    f' AS "{c}"' for c in HEAT_COMMANDS)


@query("hour_command_pivot", f"""
    SELECT user_name, CAST(hour(timestamp) AS INTEGER) AS hour, {_HEAT_COLS}
    FROM process WHERE command IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2""", PROC)
def _hour_command_pivot(t):
    return A.hour_command_pivot(t.process, HEAT_COMMANDS, exact_scale=2)


# -- windows, dedup, joins ---------------------------------------------------------------

@query("command_frequency", """
    SELECT p.*, c.command_frequency FROM process p LEFT JOIN
      (SELECT hashed_command, count(*) AS command_frequency FROM process WHERE hashed_command IS NOT NULL
       GROUP BY hashed_command) c ON p.hashed_command = c.hashed_command""", PROC)
def _command_frequency(t):
    return W.value_frequency(t.process)


def _rolling_sql(cols: list[str]) -> str:
    w = "OVER (PARTITION BY user_name ORDER BY timestamp, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    parts = []
    for c in cols:
        parts.append(f"CASE WHEN user_name IS NOT NULL THEN round(avg({c}) {w}, 6) END AS {c}_rolling_mean")
        parts.append(f"CASE WHEN user_name IS NOT NULL THEN round(stddev_samp({c}) {w}, 6) END AS {c}_rolling_std")
    return ", ".join(parts)


@query("rolling_stats", f"SELECT id, user_name, timestamp, cpu, memory, {_rolling_sql(['cpu', 'memory'])} FROM process",
       PROC)
def _rolling_stats(t):
    p = t.process.select("id", "user_name", "timestamp", "cpu", "memory")
    out = W.rolling_stats(p, ["user_name"], ["cpu", "memory"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if "_rolling_" in c})


@query("dedup_first", """
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY id) AS rn FROM process) x
    WHERE rn = 1""", PROC)
def _dedup_first(t):
    return X.dedup_first(t.process, ["timestamp"], ["id"])


@query("first_seen_commands", """
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY command ORDER BY timestamp, id) AS rn
    FROM commands WHERE command IS NOT NULL) x WHERE rn = 1""", CMDS)
def _first_seen_commands(t):
    return X.first_seen_commands(t.commands)


@query("new_rows_only", """
    SELECT * FROM process p WHERE p.timestamp IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM commands c WHERE c.timestamp = p.timestamp)""", CMDS)
def _new_rows_only(t):
    return J.new_rows_only(t.process, t.commands)


@query("correlate_process_network", f"""
    SELECT p.pid, p.user_name, p.cpu, p.memory, p.virt, p.res, p.shr, p.s, p.time_used, p.command, p.hashed_command,
           p.timestamp AS process_timestamp, n.*
    FROM process p JOIN network n ON n.src_port = p.pid
      AND n.timestamp BETWEEN p.timestamp - INTERVAL {rules.CORRELATION_MINUTES} MINUTES
                          AND p.timestamp + INTERVAL {rules.CORRELATION_MINUTES} MINUTES""", ("process", "network"))
def _correlate(t):
    return J.correlate_process_network(t.process, t.network)


@query("network_behavior_join", f"""
    SELECT p.*, s.src_ip, s.bytes_sent, s.n_dst_ports, s.n_dst_ips, s.c2_risk, s.exfil_risk
    FROM (SELECT *, time_bucket(INTERVAL 5 MINUTES, timestamp) AS time_window FROM process) p
    LEFT JOIN (
      SELECT time_bucket(INTERVAL 5 MINUTES, timestamp) AS time_window, src_ip, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent,
             count(DISTINCT dst_port) AS n_dst_ports, count(DISTINCT dst_ip) AS n_dst_ips,
             max(c2_risk) AS c2_risk, max(exfil_risk) AS exfil_risk
      FROM (SELECT *, {C2_SQL} AS c2_risk,
                   {EXFIL_SQL} AS exfil_risk FROM network) x
      WHERE timestamp IS NOT NULL AND src_ip IS NOT NULL GROUP BY 1, 2) s
    ON p.time_window = s.time_window""", ("process", "network"))
def _network_behavior_join(t):
    stats = A.network_window_stats(D.detect_exfil(D.detect_c2(t.network)))
    return J.network_behavior_join(t.process, stats)


@query("threat_matrix_rule", f"""
    SELECT command, n_dst_ports, max(threat_score) AS max_risk, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent,
           count(DISTINCT pid) AS n_pids
    FROM (SELECT p.command, p.pid, {THREAT_PROC_SQL} AS threat_score,
                 s.n_dst_ports, s.bytes_sent
          FROM (SELECT *, time_bucket(INTERVAL 5 MINUTES, timestamp) AS time_window FROM process) p
          LEFT JOIN (SELECT time_bucket(INTERVAL 5 MINUTES, timestamp) AS time_window, src_ip,
                            CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent, count(DISTINCT dst_port) AS n_dst_ports
                     FROM network WHERE timestamp IS NOT NULL AND src_ip IS NOT NULL GROUP BY 1, 2) s
          ON p.time_window = s.time_window) m
    WHERE command IS NOT NULL AND n_dst_ports IS NOT NULL GROUP BY command, n_dst_ports""", ("process", "network"))
def _threat_matrix_rule(t):
    return A.threat_matrix(*M.rule_risk(t), "threat_score")


@query("risk_density_rule", f"""
    SELECT n_dst_ports, command, avg(threat_score) AS avg_risk
    FROM (SELECT p.command, {THREAT_PROC_SQL} AS threat_score, s.n_dst_ports
          FROM (SELECT *, time_bucket(INTERVAL 5 MINUTES, timestamp) AS time_window FROM process) p
          LEFT JOIN (SELECT time_bucket(INTERVAL 5 MINUTES, timestamp) AS time_window, src_ip,
                            count(DISTINCT dst_port) AS n_dst_ports
                     FROM network WHERE timestamp IS NOT NULL AND src_ip IS NOT NULL GROUP BY 1, 2) s
          ON p.time_window = s.time_window) m
    WHERE command IS NOT NULL AND n_dst_ports IS NOT NULL GROUP BY n_dst_ports, command""", ("process", "network"))
def _risk_density_rule(t):
    return A.risk_density(*M.rule_risk(t), "threat_score")


# -- features -------------------------------------------------------------------------

@query("preprocess_process", """
    SELECT id, timestamp, CAST(hour(timestamp) AS INTEGER) AS hour, CAST(minute(timestamp) AS INTEGER) AS minute,
           CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week,
           CASE WHEN time_used IS NULL THEN 0.0 ELSE
             TRY_CAST(split_part(time_used, ':', 1) AS INTEGER) * 60.0 + TRY_CAST(split_part(time_used, ':', 2) AS DOUBLE)
           END AS time_used_seconds,
           res / (virt + 1e-6) AS mem_ratio,
           CAST(isodow(timestamp) >= 6 AS INTEGER) AS weekend
    FROM process""", PROC)
def _preprocess(t):
    p = M.preprocess_process(t.process)
    return p.select("id", "timestamp", "hour", "minute", "day_of_week", "time_used_seconds",
                    "mem_ratio", S.weekend_flag(F.col("timestamp")).alias("weekend"))


@query("end_time", """
    SELECT id, timestamp, timestamp + to_microseconds(CAST(round((TRY_CAST(split_part(time_used, ':', 1) AS INTEGER) * 60.0
           + TRY_CAST(split_part(time_used, ':', 2) AS DOUBLE)) * 1000000) AS BIGINT)) AS end_time
    FROM process""", PROC)
def _end_time(t):
    p = M.preprocess_process(t.process)
    return p.select("id", "timestamp", S.end_time(F.col("timestamp"), F.col("time_used_seconds")).alias("end_time"))


VOCAB_SQL = """
  SELECT 'user_name' AS feature, label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT user_name AS label FROM process WHERE user_name IS NOT NULL)
  UNION ALL
  SELECT 'command', label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER)
  FROM (SELECT DISTINCT command AS label FROM process WHERE command IS NOT NULL)
  UNION ALL
  SELECT 's', label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER)
  FROM (SELECT DISTINCT s AS label FROM process WHERE s IS NOT NULL)
  UNION ALL
  SELECT 'hashed_command', label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER)
  FROM (SELECT DISTINCT hashed_command AS label FROM process WHERE hashed_command IS NOT NULL)
"""


@query("fit_vocab", VOCAB_SQL, PROC)
def _fit_vocab(t):
    return M.fit_vocab(t.process)


@query("encode_features", f"""
    WITH v AS ({VOCAB_SQL})
    SELECT p.id,
      COALESCE((SELECT code FROM v WHERE feature = 'user_name' AND label = p.user_name), -1) AS user_name_encoded,
      COALESCE((SELECT code FROM v WHERE feature = 'command' AND label = p.command), -1) AS command_encoded,
      COALESCE((SELECT code FROM v WHERE feature = 's' AND label = p.s), -1) AS s_encoded,
      COALESCE((SELECT code FROM v WHERE feature = 'hashed_command' AND label = p.hashed_command), -1)
        AS hashed_command_encoded
    FROM process p""", PROC)
def _encode(t):
    vocab = M.fit_vocab(t.process)
    return M.encode(t.process, vocab).select(
        "id", "user_name_encoded", "command_encoded", "s_encoded", "hashed_command_encoded")


@query("encode_unseen", """
    SELECT p.id, COALESCE(v.code, -1) AS command_encoded
    FROM (SELECT id, command || CASE WHEN hour(timestamp) < 12 THEN '' ELSE ' --new' END AS command FROM process) p
    LEFT JOIN (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code
               FROM (SELECT DISTINCT command AS label FROM process WHERE command IS NOT NULL)) v
    ON p.command = v.label""", PROC)
def _encode_unseen(t):
    vocab = M.fit_vocab(t.process, ["command"])
    later = t.process.select(
        "id", F.concat("command", F.when(F.hour("timestamp") < 12, "").otherwise(" --new")).alias("command"))
    return M.encode(later, vocab, ["command"]).select("id", "command_encoded")


@query("fit_scaler", f"""
    {' UNION ALL '.join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS scale FROM (SELECT *, CASE WHEN time_used IS NULL THEN 0.0 ELSE TRY_CAST(split_part(time_used, ':', 1) AS INTEGER) * 60.0 + TRY_CAST(split_part(time_used, ':', 2) AS DOUBLE) END AS time_used_seconds FROM process) p" for c in rules.SCALED_FEATURES)}
    """, PROC)
def _fit_scaler(t):
    s = M.fit_scaler(M.preprocess_process(t.process))
    return s.select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query("behavior_features", f"""
    SELECT p.id, {', '.join(f"CASE WHEN p.user_name IS NOT NULL THEN round(avg({c}) OVER w, 6) END AS {c}_rolling_mean, CASE WHEN p.user_name IS NOT NULL THEN round(stddev_samp({c}) OVER w, 6) END AS {c}_rolling_std" for c in rules.ROLLING_FEATURES)},
           f.command_frequency
    FROM (SELECT *, CASE WHEN time_used IS NULL THEN 0.0 ELSE TRY_CAST(split_part(time_used, ':', 1) AS INTEGER) * 60.0
                 + TRY_CAST(split_part(time_used, ':', 2) AS DOUBLE) END AS time_used_seconds FROM process) p
    LEFT JOIN (SELECT hashed_command, count(*) AS command_frequency FROM process WHERE hashed_command IS NOT NULL
               GROUP BY 1) f ON p.hashed_command = f.hashed_command
    WINDOW w AS (PARTITION BY user_name ORDER BY timestamp, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", PROC)
def _behavior_features(t):
    b = M.behavior_features(M.preprocess_process(t.process))
    cols = [f"{c}_rolling_{k}" for c in rules.ROLLING_FEATURES for k in ("mean", "std")]
    return b.select("id", *[F.round(c, 6).alias(c) for c in cols], "command_frequency")


PRE_SQL = """(SELECT *, CAST(hour(timestamp) AS INTEGER) AS hour, CAST(minute(timestamp) AS INTEGER) AS minute,
   CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week,
   CASE WHEN time_used IS NULL THEN 0.0 ELSE TRY_CAST(split_part(time_used, ':', 1) AS INTEGER) * 60.0
        + TRY_CAST(split_part(time_used, ':', 2) AS DOUBLE) END AS time_used_seconds,
   res / (virt + 1e-6) AS mem_ratio FROM process)"""


@query("select_features", f"""
    SELECT cpu, memory, virt, res, shr, time_used_seconds, mem_ratio, hour, minute,
           day_of_week FROM {PRE_SQL} p""", PROC)
def _select_features(t):
    return C.select_features(M.preprocess_process(t.process))


@query("scale_features", f"""
    SELECT id, {', '.join(f"round(({c} - (SELECT avg({c}) FROM {PRE_SQL} a)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END FROM {PRE_SQL} b), 6) AS {c}_scaled" for c in rules.SCALED_FEATURES)}
    FROM {PRE_SQL} p""", PROC)
def _scale_features(t):
    p = M.preprocess_process(t.process)
    out = M.scale(p, M.fit_scaler(p))
    return out.select("id", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in rules.SCALED_FEATURES])


@query("retrain_168h")
def _retrain(t):
    from vigil.plans.flagship import retrain

    return retrain(t.process, rules.TRAIN_HOURS).nodes


@query("over_limit_cpu_top10", f"""
    SELECT * FROM (SELECT * FROM process WHERE {LAST_DAY} ORDER BY cpu DESC, id DESC LIMIT 10) x
    WHERE cpu > {rules.OVER_LIMIT_CPU} AND {NOT_WL} AND NOT {EXCL_SQL}""", PROC)
def _over_limit_cpu_top10(t):
    return C.over_limit_candidates(t.process, "cpu", pool=10, minutes=DAY)


@query("over_limit_memory_top10", f"""
    SELECT * FROM (SELECT * FROM process WHERE {LAST_DAY} ORDER BY cpu DESC, id DESC LIMIT 10) x
    WHERE memory > {rules.OVER_LIMIT_MEMORY} AND {NOT_WL} AND NOT {EXCL_SQL}""", PROC)
def _over_limit_memory_top10(t):
    return C.over_limit_candidates(t.process, "memory", pool=10, minutes=DAY)


@query("cpu_histogram", """
    SELECT CAST(floor(cpu / 10.0) * 10.0 AS DOUBLE) AS bin_start, count(*) AS count FROM process
    WHERE cpu IS NOT NULL GROUP BY 1""", PROC)
def _cpu_histogram(t):
    return A.value_histogram(t.process, "cpu", 10.0)
