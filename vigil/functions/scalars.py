"""Scalar functions and row scorers as Column expressions.

All of these stay inside whole-stage codegen: literal maps, ``when`` chains,
higher-order array functions.  No Python runs per row.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import rules
from vigil.functions import predicates as P


def _lit_map(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs))


# -- aggregates ----------------------------------------------------------------

def mean_of(c: Column, exact_scale: int | None = None) -> Column:
    """Mean of ``c``.  With ``exact_scale`` the values are summed as
    fixed-point decimals of that scale: the sum is exact, so the mean no
    longer depends on summation order (partitioning, engine) and is the same
    on every run; without it, the usual floating ``avg``."""
    if exact_scale is None:
        return F.avg(c)
    total = F.sum(c.cast(f"decimal(38,{exact_scale})")).cast("double")
    return F.try_divide(total, F.count(c).cast("double"))


# -- threat score ----------------------------------------------------------

def threat_score(columns: list[str] | DataFrame) -> Column:
    """Rule score in [0, 100]; a term applies only if its column exists.

    type words (+70/+50/+90), +60 per command keyword found in the lowered
    command, +40 when CPU and memory are both above 90; capped at 100.
    """
    cols = set(columns.columns if isinstance(columns, DataFrame) else columns)
    terms: list[Column] = []
    if "type" in cols:
        t = F.lower(F.col("type"))
        for word, weight in rules.THREAT_TYPE_WEIGHTS:
            terms.append(F.when(F.coalesce(t.contains(word), F.lit(False)), weight).otherwise(0))
    if "command" in cols:
        c = F.lower(F.col("command"))
        for kw in rules.THREAT_KEYWORDS:
            terms.append(F.when(F.coalesce(c.contains(kw), F.lit(False)), rules.THREAT_KEYWORD_WEIGHT).otherwise(0))
    if "cpu" in cols and "memory" in cols:
        hot = F.coalesce(over(F.col("cpu"), 90) & over(F.col("memory"), 90), F.lit(False))
        terms.append(F.when(hot, rules.THREAT_RESOURCE_WEIGHT).otherwise(0))
    total = sum(terms[1:], terms[0]) if terms else F.lit(0)
    return F.least(total, F.lit(rules.THREAT_CAP)).cast("int")


# -- TCP flags -------------------------------------------------------------

def tcp_flag_text(c: Column) -> Column:
    """Readable TCP flags: exact combination, else per-letter texts joined by
    `` | ``, else ``Uncommon flags: <FLAGS>``; NULL/''/'None' -> 'No flags'."""
    m = _lit_map(rules.TCP_FLAG_TEXT)
    u = F.upper(c)
    letters = F.filter(F.transform(F.split(u, ""), lambda ch: F.try_element_at(m, ch)), lambda x: x.isNotNull())
    per_letter = F.when(F.size(letters) > 0, F.array_join(letters, " | ")).otherwise(
        F.concat(F.lit("Uncommon flags: "), u)
    )
    return (
        F.when(c.isNull() | (c == "") | (c == "None"), F.lit("No flags"))
        .otherwise(F.coalesce(F.try_element_at(m, u), per_letter))
    )


# -- process / IP information ---------------------------------------------

def process_name(c: Column) -> Column:
    """First whitespace token, then its last path component; NULL when the
    text has no token."""
    tok = F.regexp_extract(c, r"^\s*(\S+)", 1)
    return F.when(tok == "", F.lit(None).cast("string")).otherwise(F.element_at(F.split(tok, "/"), -1))


def process_info(c: Column) -> Column:
    """struct(process, description, risk_level, sources map)."""
    name = process_name(c)
    low = F.lower(name)
    known = _lit_map(rules.KNOWN_PROCESSES)
    desc = F.try_element_at(known, low)
    risk = (
        F.when(low.isin(rules.HIGH_RISK_PROCESSES), "High").when(desc.isNotNull(), "Medium").otherwise("Unknown")
    )
    sources = F.create_map(
        *chain.from_iterable(
            (F.lit(label), F.concat(F.lit(tpl.split("{}")[0]), name, F.lit(tpl.split("{}")[1])))
            for label, tpl in rules.PROCESS_INFO_URLS
        )
    )
    unknown = F.struct(
        F.lit("Unknown").alias("process"),
        F.lit("No process information available").alias("description"),
        F.lit("Unknown").alias("risk_level"),
        F.create_map().cast("map<string,string>").alias("sources"),
    )
    found = F.struct(
        name.alias("process"),
        F.coalesce(desc, F.lit("Unknown")).alias("description"),
        risk.alias("risk_level"),
        sources.alias("sources"),
    )
    return F.when(name.isNull(), unknown).otherwise(found)


def intel_links(ip: Column) -> Column:
    """map(source name -> lookup URL for ``ip``)."""
    return F.create_map(
        *chain.from_iterable((F.lit(n), F.concat(F.lit(base), ip)) for n, base in rules.THREAT_INTEL_SOURCES)
    )


def ip_to_long(c: Column) -> Column:
    """Numeric IPv4 address (sort / range key); NULL for anything else."""
    parts = F.split(c, r"\.")
    val = (
        F.element_at(parts, 1).cast("bigint") * 16777216
        + F.element_at(parts, 2).cast("bigint") * 65536
        + F.element_at(parts, 3).cast("bigint") * 256
        + F.element_at(parts, 4).cast("bigint")
    )
    return F.when(P.is_ipv4(c), val)


# -- network risk flags ----------------------------------------------------

def c2_risk(dst_port: Column, dst_ip: Column) -> Column:
    hit = F.coalesce(dst_port.isin(rules.C2_PORTS), F.lit(False)) | P.regex_any_ci(dst_ip, rules.C2_DOMAINS)
    return hit.cast("int")


def c2_risk_extended(dst_port: Column, dst_ip: Column, protocol: Column, ts: Column) -> Column:
    lo, hi = rules.C2_NIGHT_HOURS
    hit = (
        P.regex_any_ci(dst_ip, rules.C2_DOMAINS_EXTENDED)
        | F.coalesce(dst_port.isin(rules.C2_PORTS), F.lit(False))
        | F.coalesce(protocol.isin(rules.C2_PROTOCOLS_EXTENDED), F.lit(False))
        | F.coalesce(F.hour(ts).between(lo, hi), F.lit(False))
    )
    return hit.cast("int")


def transfer_rate(bytes_sent: Column, duration: Column) -> Column:
    return bytes_sent / (duration + F.lit(0.001))


def exfil_risk(dst_ip: Column, bytes_sent: Column, threshold: int = rules.EXFIL_BYTES) -> Column:
    large = F.coalesce(bytes_sent > threshold, F.lit(False))
    return (P.is_external_ip(dst_ip) & large).cast("int")


def periodic_flag(gap_seconds: Column, max_gap: int = rules.BEACON_MAX_GAP_SECONDS) -> Column:
    return F.coalesce((gap_seconds > 0) & (gap_seconds <= max_gap), F.lit(False))


def exfil_risk_extended(dst_ip: Column, bytes_sent: Column, gap_seconds: Column) -> Column:
    large = F.coalesce(bytes_sent > rules.EXFIL_BYTES, F.lit(False))
    return (P.is_external_ip(dst_ip) & (large | periodic_flag(gap_seconds))).cast("int")


# -- time / process features -----------------------------------------------

def day_of_week(ts: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(ts)


def weekend_flag(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def time_used_seconds(c: Column) -> Column:
    """``M:SS.ss`` -> minutes*60 + seconds; NULL input -> 0; malformed -> NULL."""
    parts = F.split(c, ":")
    minutes = F.try_element_at(parts, F.lit(1)).try_cast("int")
    seconds = F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(c.isNull(), F.lit(0.0)).otherwise(minutes.cast("double") * 60 + seconds)


def mem_ratio(res: Column, virt: Column) -> Column:
    return res / (virt + F.lit(1e-6))


def over(value: Column, limit: float) -> Column:
    """value > limit, with NaN over nothing (Spark orders NaN above all)."""
    return (value > limit) & ~F.isnan(value.cast("double"))


def floor_minutes(ts: Column, minutes: int = rules.BUCKET_MINUTES) -> Column:
    return F.window(ts, f"{minutes} minutes").start


def end_time(ts: Column, seconds: Column) -> Column:
    micros = F.round(seconds * 1_000_000).cast("bigint")
    return ts + F.make_dt_interval(secs=micros.cast("decimal(18,6)") / 1_000_000)


def anomaly_risk(score: Column) -> Column:
    """10 - half-even(10*score), unclamped."""
    return (F.lit(10) - F.bround(score * 10, 0)).cast("int")


def hash_command(c: Column) -> Column:
    return F.sha2(c, 256)


def parse_mem_unit(c: Column) -> Column:
    """``top`` memory text to KiB: plain number, or suffix m/g/t (x1024^n)."""
    num = F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([kKmMgGtT]?)\s*$", 1)
    unit = F.lower(F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([kKmMgGtT]?)\s*$", 2))
    mult = (
        F.when(unit == "m", 1024).when(unit == "g", 1024 ** 2).when(unit == "t", 1024 ** 3).otherwise(1)
    )
    return F.when(num != "", F.round(num.cast("double") * mult).cast("bigint"))


def truncate_command(c: Column, n: int = 50) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def cpu_mem_ratio(cpu: Column, memory: Column) -> Column:
    return F.try_divide(cpu, memory)


def command_entropy(c: Column) -> Column:
    """Shannon entropy (bits) of the characters of ``c``; '' -> 0."""
    chars = F.split(c, "")
    n = F.size(chars).cast("double")

    def term(acc, ch):
        p = F.size(F.filter(chars, lambda x: x == ch)).cast("double") / n
        return acc - p * F.log2(p)

    return F.when(c.isNull(), F.lit(None).cast("double")).when(F.length(c) == 0, F.lit(0.0)).otherwise(
        F.aggregate(F.array_distinct(chars), F.lit(0.0), term)
    )


def scan_risk(is_scan: Column) -> Column:
    return F.coalesce(is_scan.cast("int"), F.lit(0))


# -- incident text templates -------------------------------------------------

def text_multi_port(src: Column, n: Column) -> Column:
    return F.concat(src, F.lit(" accessed "), n.cast("string"), F.lit(" different ports"))


def text_syn_flood(src: Column, n: Column) -> Column:
    return F.concat(src, F.lit(" sent "), n.cast("string"), F.lit(" SYN packets"))


def text_high_memory(memory: Column, cmd: Column) -> Column:
    return F.concat(F.lit("Process using "), memory.cast("string"), F.lit("% Memory: "), cmd)


def text_suspicious(cmd: Column) -> Column:
    return F.concat(F.lit("Suspicious command detected: "), cmd)
