"""Joins: anti (new rows), equi on time bucket, interval, range, lookups.

Scale notes
-----------
* ``correlate_process_network`` is an interval join (``|n.ts - p.ts| <= 5
  min`` and ``n.src_port = p.pid``).  Keyed on the pid alone a hot pid would
  pair every process row with every network row of that pid inside one task.
  Both sides therefore get a 5-minute bucket; each network row (the narrower
  side) is expanded to its three candidate buckets, the equi key becomes (pid,
  bucket) and the exact time bound, two columns of the process row, is the
  residual condition.  Work per key is bounded by local time density, not by
  the key's total rows.
* ``ip_enrich`` is a range join against a geo table of (ip_start, ip_end)
  ranges.  Ranges are expanded to the /16 blocks they cover and joined on the
  block, so neither side has to be broadcast; AQE still broadcasts the geo
  side at run time when it turns out small.
* Broadcasts are only used for sides with a fixed size bound (top-10 rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import rules
from vigil.functions import predicates as P
from vigil.functions import scalars as S


def new_rows_only(new: DataFrame, existing: DataFrame, key: str = "timestamp") -> DataFrame:
    """Rows of ``new`` whose key is not stored yet (left anti join).
    NULL keys never match; callers quarantine them first."""
    return new.filter(F.col(key).isNotNull()).join(existing.select(key), key, "left_anti")


def _epoch_bucket(ts: Column, minutes: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(minutes * 60)).cast("bigint")


def network_behavior_join(process: DataFrame, window_stats: DataFrame,
                          minutes: int = rules.BUCKET_MINUTES) -> DataFrame:
    """Each process row joined to every source's stats of its 5-minute
    bucket (row multiplication intended); no match -> NULL stats."""
    p = process.withColumn("time_window", S.floor_minutes(F.col("timestamp"), minutes))
    return p.join(window_stats, "time_window", "left")


def correlate_process_network(process: DataFrame, network: DataFrame,
                              minutes: int = rules.CORRELATION_MINUTES) -> DataFrame:
    """Process x network pairs with ``n.src_port = p.pid`` and network time
    within +-``minutes`` of the process time (inclusive).  On a name clash
    the network value wins (``id``, ``timestamp``); the process time is kept
    as ``process_timestamp``."""
    width = minutes  # bucket width == window half-width: 3 candidate buckets
    half = F.make_dt_interval(mins=F.lit(minutes))
    # The bounds belong to a row, not to a pair: each is computed once, a pair only compares.
    p = process.withColumns({"_pb": _epoch_bucket(F.col("timestamp"), width),
                             "_lo": F.col("timestamp") - half, "_hi": F.col("timestamp") + half})
    n = network.withColumn("_nb", _epoch_bucket(F.col("timestamp"), width))
    n = n.withColumn("_cand", F.explode(F.array(F.col("_nb") - 1, F.col("_nb"), F.col("_nb") + 1)))
    cond = (
        (F.col("n.src_port") == F.col("p.pid"))
        & (F.col("n._cand") == F.col("p._pb"))
        & (F.col("n.timestamp") >= F.col("p._lo"))
        & (F.col("n.timestamp") <= F.col("p._hi"))
    )
    j = p.alias("p").join(n.alias("n"), cond, "inner")
    pcols = [c for c in process.columns if c not in network.columns]
    return j.select(
        *[F.col(f"p.{c}") for c in pcols],
        F.col("p.timestamp").alias("process_timestamp"),
        *[F.col(f"n.{c}") for c in network.columns],
    )


def related_activity(top_rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows of ``merged`` sharing (pid, timestamp) with one of the top rows.
    ``top_rows`` is a top-k (k fixed, e.g. 10), so broadcasting it is safe."""
    keys = top_rows.select("pid", "timestamp").distinct()
    return merged.join(F.broadcast(keys), ["pid", "timestamp"], "left_semi")


# -- IP enrichment ---------------------------------------------------------------

def _blocks(lo: Column, hi: Column, bits: int = 16) -> Column:
    return F.explode(F.sequence(F.shiftright(lo, bits), F.shiftright(hi, bits)))


def ip_enrich(ips: DataFrame, geo: DataFrame, ip_col: str = "ip", own_ip: str = rules.OWN_IP) -> DataFrame:
    """Attach geo attributes by numeric range lookup.

    status: ``Whitelisted`` (own address, threat score 0), ``Invalid IP
    address`` (not parseable), else ``OK``; attributes default to
    ``Unknown`` when no range matches."""
    x = ips.withColumn("_num", S.ip_to_long(F.col(ip_col))).withColumn("_blk", F.shiftright("_num", 16))
    g = geo.select("ip_start", "ip_end", *[c for c in geo.columns if c not in ("ip_start", "ip_end")])
    g = g.withColumn("_blk", _blocks(F.col("ip_start"), F.col("ip_end")))
    cond = (F.col("x._blk") == F.col("g._blk")) & F.col("x._num").between(F.col("g.ip_start"), F.col("g.ip_end"))
    j = x.alias("x").join(g.alias("g"), cond, "left")
    attrs = ["country", "region", "city", "isp", "asn"]
    valid = P.validate_ip(F.col(f"x.{ip_col}"))
    own = F.col(f"x.{ip_col}") == own_ip
    out = [F.col(f"x.{c}") for c in ips.columns]
    out.append(F.when(own, "Whitelisted").when(~valid, "Invalid IP address").otherwise("OK").alias("status"))
    for a in attrs:
        v = F.col(f"g.{a}") if a in geo.columns else F.lit(None).cast("string")
        out.append(F.when(own | ~valid, F.lit(None).cast("string")).otherwise(F.coalesce(v, F.lit("Unknown"))).alias(a))
    out.append(F.when(~own & ~valid, F.lit(None).cast("int")).otherwise(F.lit(0)).alias("threat_score"))
    out.append(F.when(own | ~valid, F.lit(None).cast("string")).otherwise(F.lit("Unknown")).alias("reputation"))
    return j.select(*out)


def bulk_ip_report(ips: DataFrame, geo: DataFrame, ip_col: str = "ip") -> DataFrame:
    """One row per valid address: IP, Country, ISP, Threat Score and two
    intelligence links; invalid addresses are skipped."""
    e = ip_enrich(ips, geo, ip_col).filter(F.col("status") != "Invalid IP address")
    links = S.intel_links(F.col(ip_col))
    return e.select(
        F.col(ip_col).alias("ip"),
        F.coalesce("country", F.lit("Unknown")).alias("country"),
        F.coalesce("isp", F.lit("Unknown")).alias("isp"),
        F.col("threat_score"),
        links["AbuseIPDB"].alias("abuseipdb"),
        links["VirusTotal"].alias("virustotal"),
    )
