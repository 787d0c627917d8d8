"""DuckDB twins of the entity adapters, as SQL common table expressions.

These are written independently of the Spark adapters (SQL text here,
DataFrame code there); the correctness gate runs a query's Spark plan and
its SQL oracle side by side on the same parquet tables.
"""

from __future__ import annotations

from vigil import rules

K_EVENTS = "(SELECT *, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events)"

NETWORK = f"""
SELECT event_id AS id, ts AS timestamp,
  CASE user_id % 4 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '192.168.1.' WHEN 2 THEN '172.16.0.' ELSE '203.0.113.' END
    || CAST(user_id % 20 AS VARCHAR) AS src_ip,
  CASE WHEN k % 5 = 0 THEN '{rules.OWN_IP}'
       WHEN k % 5 = 1 THEN '198.51.100.' || CAST(k % 7 AS VARCHAR)
       WHEN k % 5 = 2 THEN '10.0.0.' || CAST(k % 9 AS VARCHAR)
       WHEN k % 50 = 3 THEN 'files.pastebin.com'
       ELSE '203.0.113.' || CAST(k % 11 AS VARCHAR) END AS dst_ip,
  CAST(40000 + CAST(user_id % 10 AS INTEGER) AS INTEGER) AS src_port,
  CAST(CASE (event_id + 3 * k) % 30 WHEN 0 THEN 22 WHEN 1 THEN 23 WHEN 2 THEN 80 WHEN 3 THEN 443
       WHEN 4 THEN 8080 WHEN 5 THEN 4444 WHEN 6 THEN 53 ELSE 1000 + CAST((event_id + 3 * k) % 30 AS INTEGER) END
       AS INTEGER) AS dst_port,
  CASE event_type WHEN 'signup' THEN 'S' WHEN 'view' THEN 'SA' WHEN 'click' THEN 'PA'
       WHEN 'purchase' THEN 'FA' ELSE 'SEC' END AS flags,
  CAST(floor(value * 20000) AS BIGINT) AS bytes_sent,
  CAST(k AS DOUBLE) AS duration,
  CASE k % 4 WHEN 0 THEN 'TCP' WHEN 1 THEN 'DNS' WHEN 2 THEN 'UDP' ELSE 'HTTPS' END AS protocol
FROM {K_EVENTS} e
"""

PROCESS_BASE = f"""
SELECT event_id AS id, ts AS timestamp,
  CAST(40000 + CAST(user_id % 10 AS INTEGER) AS INTEGER) AS pid,
  'user' || CAST(user_id % 10 AS VARCHAR) AS user_name,
  CAST(CASE WHEN value > 100 THEN 100.0 ELSE value END AS DOUBLE) AS cpu,
  CAST(k AS DOUBLE) AS memory,
  CAST(100000 + event_id % 977 AS BIGINT) AS virt,
  CAST(event_id % 977 AS BIGINT) AS res,
  CAST(event_id % 101 AS BIGINT) AS shr,
  CASE event_type WHEN 'error' THEN 'Z' WHEN 'view' THEN 'R' ELSE 'S' END AS s,
  CAST(event_id % 100 AS VARCHAR) || ':' || CASE WHEN k < 10 THEN '0' ELSE '' END
    || CAST(k % 60 AS VARCHAR) || '.25' AS time_used,
  CASE k % 10 WHEN 0 THEN 'rm -rf /tmp/a' WHEN 1 THEN 'wget http://x/y' WHEN 2 THEN 'nmap -sS 10.0.0.0/8'
       WHEN 3 THEN 'bash -c curl x' WHEN 4 THEN 'python3 /script.py' WHEN 5 THEN 'nginx: worker'
       WHEN 6 THEN '/usr/bin/java -jar a.jar' WHEN 7 THEN 'chmod 777 /etc' WHEN 8 THEN 'postgres: writer'
       ELSE 'nc -lvnp 4444' END AS command
FROM {K_EVENTS} e
"""

PROCESS = f"SELECT *, sha256(command) AS hashed_command FROM ({PROCESS_BASE}) pb"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_contains_any(col: str, patterns: list[str]) -> str:
    return "COALESCE(" + " OR ".join(f"contains({col}, {sql_str(p)})" for p in patterns) + ", FALSE)"


def sql_regex_ci(col: str, words: list[str]) -> str:
    return f"COALESCE(regexp_matches({col}, {sql_str('(?i)' + '|'.join(words))}), FALSE)"


def sql_external(col: str) -> str:
    inner = " OR ".join(f"starts_with({col}, {sql_str(p)})" for p in rules.INTERNAL_PREFIXES)
    return f"(NOT COALESCE({inner}, FALSE))"


HIGH_RISK_SQL = sql_contains_any("command", rules.HIGH_RISK_COMMANDS)
WHITELIST_SQL = sql_contains_any("command", rules.WHITELIST)

COMMANDS = f"SELECT id, timestamp, user_name, command, pid FROM process WHERE {HIGH_RISK_SQL}"

CRON = f"""
SELECT event_id AS id, ts AS timestamp, CAST(ts AS DATE) AS snapshot_date,
  '/etc/cron.d/' || event_type AS cron_file, '*/5 * * * * /opt/job' || CAST(k AS VARCHAR) AS job
FROM {K_EVENTS} e
"""

FILES = """
SELECT event_id AS id, ts AS timestamp, '/etc/' || event_type AS file,
  CAST(floor(value * 100) AS BIGINT) AS mtime_s
FROM events
"""

GEO = """
SELECT CAST(3405803776 AS BIGINT) + n_nationkey * 10 AS ip_start,
  CAST(3405803776 AS BIGINT) + n_nationkey * 10 + 9 AS ip_end, n_name AS country
FROM nation
"""

_CTES = {
    "network": NETWORK,
    "process": PROCESS,
    "commands": COMMANDS,
    "cron": CRON,
    "file_ev": FILES,
    "geo": GEO,
}
_DEPS = {"commands": ["process"]}


def with_tables(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it names (dependencies first)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql
    head = "WITH " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in order)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + head[5:] + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return head + ",\n" + body[5:]
    return head + "\n" + body
