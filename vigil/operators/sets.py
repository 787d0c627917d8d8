"""Deduplication and set operations (DataFrame -> DataFrame)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil import rules
from vigil.functions import scalars as S
from vigil.operators.clean import filter_suspicious_ports


def dedup_first(df: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """First row per key in ``order`` (default: ingest order ``id``).

    ``row_number() = 1`` is planned with a partial WindowGroupLimit: each
    input partition ships at most one row per key into the shuffle, so a hot
    key costs one row per partition."""
    keys = keys or ["timestamp"]
    order = order or ["id"]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def first_seen_commands(commands: DataFrame) -> DataFrame:
    """Each distinct command line once (its first occurrence)."""
    return dedup_first(commands.filter(F.col("command").isNotNull()), ["command"], ["timestamp", "id"])


def first_seen_connections(network: DataFrame) -> DataFrame:
    """Each (src, dst, src_port, dst_port) on a watched port, first time only."""
    keys = ["src_ip", "dst_ip", "src_port", "dst_port"]
    return dedup_first(filter_suspicious_ports(network), keys, ["timestamp", "id"])


def union_events(*parts: DataFrame) -> DataFrame:
    """Stack event frames with differing columns (missing -> NULL)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def recent_events_for_ip(network: DataFrame, commands: DataFrame | None, ip: str,
                         n: int = rules.RECENT_PER_SOURCE) -> DataFrame:
    """Newest ``n`` events per table that mention ``ip``, merged newest first.
    Commands only contribute when they carry an ``ip``/``src_ip`` column."""
    net = (
        network.filter((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))
        .orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)
        .select(F.lit("network").alias("source"), F.col("src_ip").alias("ip"), "dst_ip", "dst_port",
                "flags", "timestamp")
    )
    parts = [net]
    if commands is not None:
        ip_col = "ip" if "ip" in commands.columns else ("src_ip" if "src_ip" in commands.columns else None)
        if ip_col:
            parts.append(
                commands.filter(F.col(ip_col) == ip)
                .orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)
                .select(F.lit("suspicious_command").alias("source"), F.col(ip_col).alias("ip"), "command",
                        "timestamp")
            )
    out = union_events(*parts)
    ties = [F.col(c) for c in ("source", "ip", "dst_ip", "dst_port", "flags", "command") if c in out.columns]
    return out.orderBy(F.col("timestamp").desc(), *ties)


def all_ips(network: DataFrame, commands: DataFrame | None = None, own_ip: str = rules.OWN_IP) -> DataFrame:
    """Distinct addresses seen as source or destination (plus command IPs
    when present) minus our own, empty and NULL; with a numeric sort key.
    ``sorted_ips`` puts them in the list's order (non-IPv4 text last)."""
    parts = [network.select(F.col("src_ip").alias("ip")), network.select(F.col("dst_ip").alias("ip"))]
    if commands is not None:
        for c in ("ip", "src_ip"):
            if c in commands.columns:
                parts.append(commands.select(F.col(c).alias("ip")))
                break
    u = parts[0]
    for p in parts[1:]:
        u = u.union(p)
    u = u.filter(F.col("ip").isNotNull() & (F.col("ip") != "") & (F.col("ip") != own_ip)).distinct()
    return u.withColumn("ip_num", S.ip_to_long(F.col("ip")))


def sorted_ips(ips: DataFrame) -> DataFrame:
    return ips.orderBy(F.col("ip_num").asc_nulls_last(), F.col("ip"))


def report_ips(ips: DataFrame, n: int = rules.TOP_N) -> DataFrame:
    return sorted_ips(ips).limit(n)


def cron_new_jobs(cron: DataFrame) -> DataFrame:
    """Per cron file: jobs of each daily snapshot that were absent from the
    file's previous snapshot (every job of the first snapshot is new)."""
    snap = cron.select("cron_file", "snapshot_date", "job").distinct()
    dates = snap.select("cron_file", "snapshot_date").distinct().withColumn(
        "prev_date", F.lag("snapshot_date").over(Window.partitionBy("cron_file").orderBy("snapshot_date"))
    )
    cur = snap.join(dates, ["cron_file", "snapshot_date"])
    prev = snap.select("cron_file", F.col("snapshot_date").alias("prev_date"), "job")
    return cur.join(prev, ["cron_file", "prev_date", "job"], "left_anti").select(
        "cron_file", "snapshot_date", "job"
    )
