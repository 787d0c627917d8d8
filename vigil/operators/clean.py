"""Projection, cleaning and filter operators (DataFrame -> DataFrame).

All of them are narrow transformations: Catalyst pushes the predicates into
the parquet scan (``PushedFilters``) where they touch stored columns and
prunes every column a query does not read.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import rules
from vigil.functions import predicates as P
from vigil.functions import scalars as S


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename present columns (absent names are ignored)."""
    mapping = mapping if mapping is not None else rules.PROCESS_RENAMES
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return df.drop(*(names if names is not None else ["type"]))


def with_defaults(df: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """Add each absent column as a constant (``'now'`` -> current timestamp)."""
    add: dict[str, Column] = {}
    for name, value in defaults.items():
        if name in df.columns:
            continue
        add[name] = F.current_timestamp() if value == "now" else F.lit(value)
    return df.withColumns(add) if add else df


def coerce_timestamp(df: DataFrame, col: str = "timestamp", strict: bool = False) -> DataFrame:
    """Text -> timestamp.  Lenient (default): invalid text becomes NULL.
    Strict: invalid text fails the query.  Timestamp input is unchanged."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return df
    if strict:
        return df.withColumn(col, F.to_timestamp(F.col(col)))
    return df.withColumn(col, F.col(col).try_cast("timestamp"))


def drop_invalid_ts(df: DataFrame, col: str = "timestamp") -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def fetch_window(df: DataFrame, hours: int = rules.DEFAULT_HOURS, as_of: Column | None = None,
                 ts: str = "timestamp") -> DataFrame:
    """Rows of the last ``hours`` hours before ``as_of`` (default: newest row).

    The bound is compared against the bare timestamp column, so parquet
    min/max statistics prune files; a table with ``event_date`` folders gets
    the same bound on the date, which prunes whole folders."""
    as_of = as_of if as_of is not None else df.select(F.max(ts)).scalar()
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    rows = df.filter(F.col(ts) >= since)
    return rows.filter(F.col("event_date") >= F.to_date(since)) if "event_date" in df.columns else rows


def latest_snapshot(process: DataFrame, minutes: int = rules.BUCKET_MINUTES, ts: str = "timestamp") -> DataFrame:
    """Rows of the newest listing: those in the time bucket of the newest row."""
    newest = process.agg(F.max(ts).alias("newest")).select(S.floor_minutes(F.col("newest"), minutes)).scalar()
    return process.filter(F.col(ts) >= newest)


def latest_n(df: DataFrame, n: int = rules.LATEST_N, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """Newest ``n`` rows (ties broken by ``tie`` descending): a top-k, planned
    as TakeOrderedAndProject (per-partition top-n, then a merge of n rows)."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


# -- row filters ---------------------------------------------------------------

def filter_suspicious_ports(network: DataFrame, ports: list[int] | None = None) -> DataFrame:
    return network.filter(P.suspicious_port(F.col("src_port"), F.col("dst_port"), ports))


def match_high_risk_commands(process: DataFrame, col: str = "command") -> DataFrame:
    """Rows whose command line contains any high-risk literal (once per row)."""
    return process.filter(P.high_risk_match(F.col(col)))


def with_whitelist_flag(df: DataFrame, col: str = "command") -> DataFrame:
    return df.withColumn("is_whitelisted", P.is_whitelisted(F.col(col)))


def with_external_flag(df: DataFrame, col: str = "dst_ip") -> DataFrame:
    return df.withColumn("is_external", P.is_external_ip(F.col(col)))


def over_limit_candidates(process: DataFrame, metric: str = "cpu", threshold: float | None = None,
                          pool: int | None = None, minutes: int | None = rules.BUCKET_MINUTES) -> DataFrame:
    """Processes of the latest snapshot over a CPU (default > 30) or memory
    (> 25) limit, not whitelisted and not one of the excluded scripts.
    ``pool=k`` first keeps the k top-CPU rows (the remote listing only shows
    those); ``None`` = all.  ``minutes`` is the width of a snapshot; None
    takes every row.  Emits candidates only; no action is taken."""
    if threshold is None:
        threshold = rules.OVER_LIMIT_CPU if metric == "cpu" else rules.OVER_LIMIT_MEMORY
    rows = latest_snapshot(process, minutes) if minutes else process
    if pool is not None:
        rows = rows.orderBy(F.col("cpu").desc(), F.col("id").desc()).limit(pool)
    cmd = F.col("command")
    return rows.filter(S.over(F.col(metric), threshold) & ~P.is_whitelisted(cmd) & ~P.is_excluded(cmd))


def manager_view(process: DataFrame, pool: int = 10, minutes: int | None = rules.BUCKET_MINUTES) -> DataFrame:
    """Top ``pool`` processes of the latest snapshot by CPU, then whitelist/exclusions removed (the
    limit applies before the exclusion, as in the process manager page)."""
    rows = latest_snapshot(process, minutes) if minutes else process
    top = rows.orderBy(F.col("cpu").desc(), F.col("id").desc()).limit(pool)
    cmd = F.col("command")
    return top.filter(~P.is_whitelisted(cmd) & ~P.is_excluded(cmd)).withColumn(
        "command_short", S.truncate_command(cmd)
    )


def flag_filter(df: DataFrame, flag: str) -> DataFrame:
    """``c2_threats`` / ``exfil_threats`` / ``scan_threats``: rows with flag = 1."""
    return df.filter(F.col(flag) == 1)


def select_features(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Project the model features that exist, in their fixed order."""
    feats = features or rules.MODEL_FEATURES
    return df.select(*[c for c in feats if c in df.columns])


def user_slice(df: DataFrame, user: str, col: str = "user_name") -> DataFrame:
    return df.filter(F.col(col) == user)


def distinct_users(df: DataFrame, col: str = "user_name") -> DataFrame:
    return df.select(col).filter(F.col(col).isNotNull()).distinct()
