"""File sources and sinks: process CSV, event NDJSON, top text, tables.

Readers never fail a whole file on one bad line: malformed rows keep their
raw text in ``_corrupt_record`` and :func:`quarantine` splits them off.
Ingest order (needed for keep-first deduplication) is the file path, the
byte offset of the split and the row position inside the split, taken from
Spark's ``_metadata`` column, so it does not depend on task scheduling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import rules
from vigil.functions import scalars as S
from vigil.sources import schemas

HEX64 = r"^[0-9a-fA-F]{64}$"


def _ingest_order(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "_file": F.col("_metadata.file_path"),
        "_block": F.col("_metadata.file_block_start"),
        "_row": F.monotonically_increasing_id(),
    })


def ingest_order_cols() -> list[str]:
    return ["_file", "_block", "_row"]


# -- process CSV -----------------------------------------------------------------

def parse_process_csv(lines: DataFrame, col: str = "value") -> DataFrame:
    """Unquoted 12-field CSV lines -> typed process rows.

    Fields 1-10 are positional, the last must be a 64-hex hash, and whatever
    lies between is the command (re-joined with ',', since commands may
    contain commas).  Header lines are dropped; short or malformed rows keep
    ``_corrupt_record``."""
    parts = F.split(F.col(col), ",")
    n = F.size(parts)
    last = F.element_at(parts, -1)
    cmd = F.array_join(F.slice(parts, 11, F.greatest(n - 11, F.lit(1))), ",")
    ok = (n >= 12) & last.rlike(HEX64)
    p = [F.try_element_at(parts, F.lit(i)) for i in range(1, 11)]
    rows = lines.filter(~F.coalesce(p[0] == rules.PROCESS_CSV_HEADER[0], F.lit(False)))
    rows = rows.filter(F.trim(F.col(col)) != "")
    out = rows.select(
        "*",
        p[0].try_cast("timestamp").alias("timestamp"),
        p[1].try_cast("int").alias("pid"),
        p[2].alias("user_name"),
        p[3].try_cast("double").alias("cpu"),
        p[4].try_cast("double").alias("memory"),
        S.parse_mem_unit(p[5]).alias("virt"),
        S.parse_mem_unit(p[6]).alias("res"),
        S.parse_mem_unit(p[7]).alias("shr"),
        p[8].alias("s"),
        p[9].alias("time_used"),
        F.when(ok, cmd).alias("command"),
        F.when(ok, last).alias("hashed_command"),
    )
    bad = ~ok | F.col("timestamp").isNull() | F.col("pid").isNull()
    return out.withColumn("_corrupt_record", F.when(bad, F.col(col))).drop(col)


def read_process_csv(spark: SparkSession, path: str) -> DataFrame:
    lines = _ingest_order(spark.read.text(path).select("value", "_metadata"))
    return parse_process_csv(lines).drop("_metadata")


# -- NDJSON events -----------------------------------------------------------------

def parse_ndjson(lines: DataFrame, schema: T.StructType | None = None, col: str = "value") -> DataFrame:
    """Text lines -> envelope rows.  Blank lines are skipped; a line that is
    not a JSON object keeps its raw text in ``_corrupt_record``."""
    schema = schema or schemas.EVENT_ENVELOPE
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = lines.filter(F.trim(F.col(col)) != "")
    parsed = rows.withColumn("_e", F.from_json(F.col(col), schema, opts))
    keep = [c for c in rows.columns if c != col]
    return parsed.select(*keep, "_e.*")


def read_events_ndjson(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON object per line; never fails a file on a bad line."""
    lines = _ingest_order(spark.read.text(path).select("value", "_metadata")).drop("_metadata")
    return parse_ndjson(lines, schema)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows).  Rejected rows keep their raw text."""
    good = df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    bad = df.filter(F.col("_corrupt_record").isNotNull())
    return good, bad


def typed_events(events: DataFrame) -> DataFrame:
    """Envelope rows -> typed timestamp; missing type -> ``unknown``."""
    return events.withColumns({
        "type": F.coalesce(F.col("type"), F.lit("unknown")),
        "timestamp": F.col("timestamp").try_cast("timestamp"),
    })


# -- top text snapshots ---------------------------------------------------------------

def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_top(lines: DataFrame) -> DataFrame:
    """``top -b`` text archived as (snapshot_id, ts, line_no, line) -> rows.

    Per snapshot, the header is the first line containing PID, USER and %CPU;
    following non-blank lines are split on whitespace into at most 12 parts
    (the command keeps its spaces); lines with fewer parts are skipped.  A
    snapshot is one ``top`` output, so the per-snapshot header lookup is a
    small group."""
    is_header = F.col("line").contains("PID") & F.col("line").contains("USER") & F.col("line").contains("%CPU")
    hdr = F.min(F.when(is_header, F.col("line_no"))).over(Window.partitionBy("snapshot_id"))
    body = lines.withColumn("_hdr", hdr).filter(F.col("line_no") > F.col("_hdr"))
    body = body.filter(_strip(F.col("line")) != "")
    parts = F.split(_strip(F.col("line")), r"\s+", 12)
    body = body.withColumn("_p", parts).filter(F.size("_p") >= 12)
    g = [F.col("_p")[i] for i in range(12)]
    return body.select(
        F.col("ts").alias("timestamp"),
        g[0].try_cast("int").alias("pid"),
        g[1].alias("user_name"),
        g[8].try_cast("double").alias("cpu"),
        g[9].try_cast("double").alias("memory"),
        S.parse_mem_unit(g[4]).alias("virt"),
        S.parse_mem_unit(g[5]).alias("res"),
        S.parse_mem_unit(g[6]).alias("shr"),
        g[7].alias("s"),
        g[10].alias("time_used"),
        g[11].alias("command"),
        F.sha2(g[11], 256).alias("hashed_command"),
    )


TOP_HEADER = "    PID USER      PR  NI    VIRT    RES    SHR S  %CPU  %MEM     TIME+ COMMAND"


def top_lines_from_process(process: DataFrame, minutes: int = rules.BUCKET_MINUTES) -> DataFrame:
    """Render process rows as archived ``top`` text: one snapshot per
    5-minute bucket, a header line (line 0) then one line per process."""
    snap = S.floor_minutes(F.col("timestamp"), minutes)
    sid = F.unix_seconds(snap.cast("timestamp"))
    body = process.select(
        sid.alias("snapshot_id"), snap.alias("ts"), F.col("id").alias("line_no"),
        F.format_string("%7d %-9s %3s %3s %7s %6s %6s %s %5s %5s %9s %s",
                        "pid", "user_name", F.lit("20"), F.lit("0"), F.col("virt").cast("string"),
                        F.col("res").cast("string"), F.col("shr").cast("string"), "s",
                        F.col("cpu").cast("string"), F.col("memory").cast("string"), "time_used",
                        "command").alias("line"),
    )
    heads = body.select("snapshot_id", "ts").distinct().select(
        "snapshot_id", "ts", F.lit(-1).cast("bigint").alias("line_no"), F.lit(TOP_HEADER).alias("line"))
    return heads.unionByName(body)


# -- sinks --------------------------------------------------------------------------

def route_events(events: DataFrame, out_dir: str, ingest_date: Column | None = None, fmt: str = "json") -> None:
    """One folder per (type, ingest date); missing type -> ``unknown``."""
    d = ingest_date if ingest_date is not None else F.current_date()
    (events.withColumn("type", F.coalesce(F.col("type"), F.lit("unknown")))
     .withColumn("ingest_date", d)
     .write.mode("append").partitionBy("type", "ingest_date").format(fmt).save(out_dir))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, cast, absent -> NULL."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append_table(df: DataFrame, path: str, schema: T.StructType, ts: str = "timestamp") -> None:
    """Append rows with the table schema enforced, partitioned by event date
    so time-window reads prune whole folders."""
    out = conform(df, schema).withColumn("event_date", F.to_date(F.col(ts)))
    out.write.mode("append").partitionBy("event_date").parquet(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def table_exists(spark: SparkSession, name_or_path: str) -> bool:
    if "/" in name_or_path:
        return path_exists(spark, name_or_path)
    return spark.catalog.tableExists(name_or_path)


def read_table_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Missing table -> empty frame with the table's schema."""
    if table_exists(spark, path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
