"""Entity tables derived from the driver tables (``events``, ``nation``).

The detectors work on four security entities (process snapshots, network
connections, cron lines, file modification times) plus an IP geo table.
These adapters derive them from the given parquet tables with plain column
expressions, so every downstream operator reads data whose size grows with
the input.  The DuckDB twins of the same derivations live in
``vigil.plans.oracle`` and are written independently, as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.rules import OWN_IP


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _with_k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.expr("try_cast(regexp_extract(props, '[0-9]+', 0) AS INT)"))


def _s(c: Column) -> Column:
    return c.cast("string")


def network_from_events(events: DataFrame) -> DataFrame:
    """One network connection per event (FIXTURES.md §2, network)."""
    e = _with_k(events)
    k, uid, eid = F.col("k"), F.col("user_id"), F.col("event_id")
    src_prefix = (
        F.when(uid % 4 == 0, "10.0.0.")
        .when(uid % 4 == 1, "192.168.1.")
        .when(uid % 4 == 2, "172.16.0.")
        .otherwise("203.0.113.")
    )
    dst_ip = (
        F.when(k % 5 == 0, F.lit(OWN_IP))
        .when(k % 5 == 1, F.concat(F.lit("198.51.100."), _s(k % 7)))
        .when(k % 5 == 2, F.concat(F.lit("10.0.0."), _s(k % 9)))
        .when(k % 50 == 3, F.lit("files.pastebin.com"))
        .otherwise(F.concat(F.lit("203.0.113."), _s(k % 11)))
    )
    slot = (eid + 3 * k) % 30
    dst_port = (
        F.when(slot == 0, 22).when(slot == 1, 23).when(slot == 2, 80).when(slot == 3, 443)
        .when(slot == 4, 8080).when(slot == 5, 4444).when(slot == 6, 53)
        .otherwise(1000 + slot.cast("int"))
    ).cast("int")
    flags = (
        F.when(F.col("event_type") == "signup", "S").when(F.col("event_type") == "view", "SA")
        .when(F.col("event_type") == "click", "PA").when(F.col("event_type") == "purchase", "FA")
        .otherwise("SEC")
    )
    protocol = F.when(k % 4 == 0, "TCP").when(k % 4 == 1, "DNS").when(k % 4 == 2, "UDP").otherwise("HTTPS")
    return e.select(
        eid.alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(src_prefix, _s(uid % 20)).alias("src_ip"),
        dst_ip.alias("dst_ip"),
        (F.lit(40000) + (uid % 10).cast("int")).alias("src_port"),
        dst_port.alias("dst_port"),
        flags.alias("flags"),
        F.floor(F.col("value") * 20000).cast("bigint").alias("bytes_sent"),
        k.cast("double").alias("duration"),
        protocol.alias("protocol"),
    )


def process_from_events(events: DataFrame) -> DataFrame:
    """One process snapshot row per event (FIXTURES.md §2, process)."""
    e = _with_k(events)
    k, uid, eid = F.col("k"), F.col("user_id"), F.col("event_id")
    command = (
        F.when(k % 10 == 0, "rm -rf /tmp/a").when(k % 10 == 1, "wget http://x/y")
        .when(k % 10 == 2, "nmap -sS 10.0.0.0/8").when(k % 10 == 3, "bash -c curl x")
        .when(k % 10 == 4, "python3 /script.py").when(k % 10 == 5, "nginx: worker")
        .when(k % 10 == 6, "/usr/bin/java -jar a.jar").when(k % 10 == 7, "chmod 777 /etc")
        .when(k % 10 == 8, "postgres: writer").otherwise("nc -lvnp 4444")
    )
    time_used = F.concat(
        _s(eid % 100), F.lit(":"), F.when(k < 10, "0").otherwise(""), _s(k % 60), F.lit(".25")
    )
    s = F.when(F.col("event_type") == "error", "Z").when(F.col("event_type") == "view", "R").otherwise("S")
    return e.select(
        eid.alias("id"),
        F.col("ts").alias("timestamp"),
        (F.lit(40000) + (uid % 10).cast("int")).alias("pid"),
        F.concat(F.lit("user"), _s(uid % 10)).alias("user_name"),
        F.when(F.col("value") > 100, F.lit(100.0)).otherwise(F.col("value")).cast("double").alias("cpu"),
        k.cast("double").alias("memory"),
        (F.lit(100000) + eid % 977).alias("virt"),
        (eid % 977).alias("res"),
        (eid % 101).alias("shr"),
        s.alias("s"),
        time_used.alias("time_used"),
        command.alias("command"),
        F.sha2(command, 256).alias("hashed_command"),
    )


def commands_from_process(process: DataFrame) -> DataFrame:
    """Suspicious-command events: process rows whose command line matches the
    collector's high-risk list."""
    from vigil.functions.predicates import high_risk_match

    return process.filter(high_risk_match(F.col("command"))).select(
        "id", "timestamp", "user_name", "command", "pid"
    )


def cron_from_events(events: DataFrame) -> DataFrame:
    e = _with_k(events)
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("ts").cast("date").alias("snapshot_date"),
        F.concat(F.lit("/etc/cron.d/"), F.col("event_type")).alias("cron_file"),
        F.concat(F.lit("*/5 * * * * /opt/job"), _s(F.col("k"))).alias("job"),
    )


def file_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("/etc/"), F.col("event_type")).alias("file"),
        F.floor(F.col("value") * 100).cast("bigint").alias("mtime_s"),
    )


def geo_from_nation(nation: DataFrame) -> DataFrame:
    base = F.lit(3405803776).cast("bigint")  # 203.0.113.0
    start = base + F.col("n_nationkey").cast("bigint") * 10
    return nation.select(
        start.alias("ip_start"), (start + 9).alias("ip_end"), F.col("n_name").alias("country")
    )


class Tables:
    """Lazy accessors for the entity frames of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def network(self) -> DataFrame:
        return network_from_events(self.raw("events"))

    @property
    def process(self) -> DataFrame:
        return process_from_events(self.raw("events"))

    @property
    def commands(self) -> DataFrame:
        return commands_from_process(self.process)

    @property
    def cron(self) -> DataFrame:
        return cron_from_events(self.raw("events"))

    @property
    def files(self) -> DataFrame:
        return file_from_events(self.raw("events"))

    @property
    def geo(self) -> DataFrame:
        return geo_from_nation(self.raw("nation"))
