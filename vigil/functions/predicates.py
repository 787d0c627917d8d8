"""Row predicates as Column expressions (JVM-side, codegen friendly).

String predicates follow the reproduced semantics exactly: the high-risk list
and the whitelist are case-sensitive substring tests, the incident keywords
and C2 domains are case-insensitive *regular expressions* (so ``.`` in a
domain is a wildcard).  A NULL input never matches (``na=False``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil import rules


def _any(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds)


def contains_any(c: Column, patterns: list[str]) -> Column:
    """True when ``c`` contains any literal; NULL input -> False."""
    return F.coalesce(_any([c.contains(F.lit(p)) for p in patterns]), F.lit(False))


def high_risk_match(c: Column) -> Column:
    """Command line contains any of the collector's high-risk literals.

    Uses the minimal pattern set (same predicate, fewer comparisons)."""
    return contains_any(c, rules.HIGH_RISK_MINIMAL)


def is_whitelisted(c: Column, whitelist: list[str] | None = None) -> Column:
    """NULL/empty -> False, else contains any whitelisted literal."""
    return contains_any(c, whitelist or rules.WHITELIST)


def is_excluded(c: Column) -> Column:
    return contains_any(c, rules.OVER_LIMIT_EXCLUSIONS)


def is_internal_ip(c: Column, prefixes: list[str] | None = None) -> Column:
    return F.coalesce(_any([c.startswith(p) for p in (prefixes or rules.INTERNAL_PREFIXES)]), F.lit(False))


def is_external_ip(c: Column, prefixes: list[str] | None = None) -> Column:
    """Not one of the internal prefixes; NULL counts as external."""
    return ~is_internal_ip(c, prefixes)


def regex_any_ci(c: Column, words: list[str]) -> Column:
    """Case-insensitive regex alternation of ``words`` (not escaped, as in
    the reproduced code); NULL -> False."""
    return F.coalesce(c.rlike("(?i)" + "|".join(words)), F.lit(False))


def suspicious_process(c: Column) -> Column:
    """Incident keyword regex hit and not whitelisted."""
    return regex_any_ci(c, rules.INCIDENT_KEYWORDS) & ~is_whitelisted(c)


def suspicious_port(src_port: Column, dst_port: Column, ports: list[int] | None = None) -> Column:
    ports = ports or rules.COLLECTOR_PORTS
    return F.coalesce(src_port.isin(ports) | dst_port.isin(ports), F.lit(False))


IPV4_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_RE = rf"^{IPV4_OCTET}(\.{IPV4_OCTET}){{3}}$"
# Eight hex groups, or fewer around one "::".
HEXTET = r"[0-9A-Fa-f]{1,4}"
IPV6_FULL = rf"^{HEXTET}(:{HEXTET}){{7}}$"
IPV6_SHORT = rf"^({HEXTET}(:{HEXTET})*)?::({HEXTET}(:{HEXTET})*)?$"


def is_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4_RE), F.lit(False))


def validate_ip(c: Column) -> Column:
    """Address parses as IPv4 (strict dotted quad) or IPv6."""
    return F.coalesce(c.rlike(IPV4_RE) | is_ipv6(c), F.lit(False))


def is_ipv6(c: Column) -> Column:
    """Eight groups, or at most seven around one ``::``; a dotted quad may
    stand for the last two, a scope (``%eth0``) may follow."""
    bare = F.regexp_replace(c, r"%[^%/]+$", "")
    dotted = F.regexp_extract(bare, r":([0-9.]+)$", 1)
    hexed = F.when(dotted.contains(".") & dotted.rlike(IPV4_RE), F.regexp_replace(bare, r"[0-9.]+$", "0:0")).otherwise(bare)
    groups = F.size(F.filter(F.split(hexed, ":"), lambda g: g != ""))
    return F.coalesce(hexed.rlike(IPV6_FULL) | (hexed.rlike(IPV6_SHORT) & (groups <= 7)), F.lit(False))
