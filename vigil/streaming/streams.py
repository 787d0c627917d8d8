"""Structured Streaming operators (S1-S11).

The collector, receiver and loader loops become one streaming pipeline:
file source (S1) -> quarantine -> routing sink (S2) / alerts (S3) ->
keyed first-seen filters (S4) -> idempotent upsert of unseen timestamps (S5),
plus windowed statistics (S6), a stream-stream interval join (S7) and three
stateful sinks (S8 cron diff, S9 file changes, S10 throttle) that run the
batch operators on every micro-batch and carry a small state table.

State is keyed and bounded: per cron file the jobs of its last changed
snapshot, per watched file one timestamp, per throttle key one timestamp.  Exactly-once
output comes from checkpointed offsets plus sinks that are idempotent per
batch id: batch N reads the state of the batches before it alone.
Checkpoints live under the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import rules
from vigil.operators import sets as X
from vigil.session import cut_lineage

DEFAULT_WATERMARK = "10 minutes"


# S1 ----------------------------------------------------------------------------------
def stream_events(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """NDJSON files dropped into ``path`` (each file read once: producers write
    new files).  Bad lines keep ``_corrupt_record``; blank lines are skipped;
    missing ``type`` -> ``unknown``; ``timestamp`` is typed."""
    from vigil.sources.files import parse_ndjson

    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = parse_ndjson(reader.text(path), schema)
    return df.withColumns({
        "type": F.coalesce(F.col("type"), F.lit("unknown")),
        "timestamp": F.col("timestamp").try_cast("timestamp"),
    })


def stream_table(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table as a stream, stored as a folder of part files or as
    one file.  Fails where there is nothing to read; an empty stream would
    look like a finished one.  ``timestamp_ntz`` columns become ``timestamp``
    (watermarks need the zoned type)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    status = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hpath)
    if not status:
        raise FileNotFoundError(path)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if status[0].isDirectory():
        df = reader.parquet(path)
    else:
        folder, _, name = path.rpartition("/")
        df = reader.option("pathGlobFilter", name).parquet(folder)
    zoned = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoned}) if zoned else df


# S2 ----------------------------------------------------------------------------------
def stream_route(events: DataFrame, out_dir: str, checkpoint: str, trigger: dict | None = None, fmt: str = "json"):
    """Route valid events to ``out_dir/batch=N/type=<t>/ingest_date=<d>`` and
    lines that were not JSON to ``out_dir/_quarantine/batch=N``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # Idempotent per batch: a replayed batch rewrites its own folders.
        batch.persist()
        valid = batch.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
        (valid.withColumn("ingest_date", F.current_date())
         .write.mode("overwrite").partitionBy("type", "ingest_date").format(fmt)
         .save(f"{out_dir}/batch={batch_id}"))
        bad = batch.filter(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
        bad.write.mode("overwrite").format("text").save(f"{out_dir}/_quarantine/batch={batch_id}")
        batch.unpersist()

    w = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


# S3 ----------------------------------------------------------------------------------
def alerts(events: DataFrame) -> DataFrame:
    """Suspicious command events, and network events to port 22/23, with the
    alert text."""
    is_cmd = F.col("type") == "suspicious_command"
    is_net = (F.col("type") == "network_event") & F.coalesce(F.col("dst_port").isin(rules.ALERT_PORTS), F.lit(False))
    text = F.when(
        is_cmd, F.concat(F.lit("ALERT: Suspicious command detected - "), F.coalesce(F.col("command"), F.lit("")))
    ).otherwise(F.concat(F.lit("ALERT: Suspicious network activity on port "), F.col("dst_port").cast("string")))
    return events.filter(is_cmd | is_net).withColumn("alert", text)


# S4 ----------------------------------------------------------------------------------
def first_seen(events: DataFrame, keys: list[str], watermark: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Report each key once.  ``watermark=None`` keeps state forever (the
    reproduced behaviour); with a watermark, state older than it is dropped
    and a key may be reported again after that."""
    if watermark:
        return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


# S5 ----------------------------------------------------------------------------------
def with_ids(rows: DataFrame, batch_id: int, order: list[str]) -> DataFrame:
    """``rows`` with ``id``: the batch in the upper bits, below it the row's
    number in ``order``.  Rows are numbered over written ranges (rows of the
    ranges before, then the place in the own one), so ids have no gaps for any
    number of tasks: 2**40 rows a batch, 8 million batches."""
    from pyspark.sql import Window

    from vigil.operators.windows import PART, into_ranges

    x = into_ranges(rows, order, "upsert-rows")
    sizes = x.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))  # one row per range
    before = F.coalesce(F.sum("n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    return (x.join(F.broadcast(sizes.select(PART, before.alias("_before"))), PART)
            .withColumn("id", F.lit(batch_id << 40) + F.col("_before") + place - 1).drop(PART, "_before"))


def stored_ranges(spark: SparkSession, table_path: str, key_type: str) -> DataFrame:
    """(batch_id, lo, hi): the key range of each batch folder of ``upsert_new_rows``, from its index."""
    return spark.read.schema(f"lo {key_type}, hi {key_type}, batch_id long").parquet(f"{table_path}_keys")


def upsert_new_rows(table_path: str, key: str = "timestamp", order: list[str] | None = None,
                    schema: T.StructType | None = None):
    """foreachBatch function: keep the first row per key inside the batch,
    drop keys already stored, append.  A replayed batch overwrites its own
    folder (``batch_id=N``), so the sink is idempotent.

    The batch is written once and read from there.  ``<table>_keys`` beside the
    table holds each folder's range of keys: only folders whose range meets
    the batch's are opened for the anti-join, the others are pruned by their
    number.  With ``schema`` the rows get the table's columns and types; an
    absent ``id`` is numbered in arrival order (batch, then row), and the
    batch's rows are laid out by ``event_date`` so that time windows prune
    folders."""
    from vigil.sources.files import conform, path_exists

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if "_seq" in (order or []) and "_seq" not in batch.columns:
            # Arrival order inside the micro-batch (file split order); only
            # available on the static batch, not on the stream itself.
            batch = batch.withColumn("_seq", F.monotonically_increasing_id())
        batch = cut_lineage(batch.filter(F.col(key).isNotNull()), "upsert-batch")
        firsts = X.dedup_first(batch, [key], order or ["id"])
        lo, hi = batch.agg(F.min(key), F.max(key)).first()
        if lo is not None and path_exists(spark, f"{table_path}_keys"):
            kind = batch.schema[key].dataType.simpleString()
            ranges = stored_ranges(spark, table_path, kind)
            met = [r.batch_id for r in ranges.filter((F.col("batch_id") < batch_id) & (F.col("lo") <= hi) & (F.col("hi") >= lo))
                   .select("batch_id").collect()]
            if met:
                # The folder numbers prune folders, the key range row groups.
                stored = (spark.read.schema(f"`{key}` {kind}, batch_id long").parquet(table_path)
                          .filter(F.col("batch_id").isin(met) & F.col(key).between(lo, hi)))
                firsts = firsts.join(stored.select(key), key, "left_anti")
        writer = None
        if schema is not None:
            if "id" in schema.names and "id" not in firsts.columns:
                firsts = with_ids(firsts, batch_id, ["_seq"] if "_seq" in firsts.columns else [key])
            out = conform(firsts, schema).withColumn("event_date", F.to_date(F.col("timestamp")))
            writer = out.write.mode("overwrite").partitionBy("event_date")
        else:
            writer = firsts.drop("_seq").write.mode("overwrite")
        writer.parquet(f"{table_path}/batch_id={batch_id}")
        # One row a folder.  It covers all keys of the batch, stored before or not; a replay gives the same.
        if lo is not None:
            batch.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).write.mode("overwrite").parquet(f"{table_path}_keys/batch_id={batch_id}")

    return run


# S6 ----------------------------------------------------------------------------------
def window_stats(network: DataFrame, minutes: int = rules.BUCKET_MINUTES, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Tumbling 5-minute per-source stats; distinct counts are HyperLogLog
    (exact distinct is not supported in streaming aggregations)."""
    return (
        network.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", f"{minutes} minutes"), "src_ip")
        .agg(F.sum("bytes_sent").alias("bytes_sent"),
             F.approx_count_distinct("dst_port").alias("n_dst_ports"),
             F.approx_count_distinct("dst_ip").alias("n_dst_ips"),
             F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").alias("time_window"), "src_ip", "bytes_sent", "n_dst_ports", "n_dst_ips",
                "events")
    )


def window_upsert_sink(table_path: str):
    """foreachBatch function for ``window_stats`` in update mode: each batch
    writes the windows it changed to its own folder, so a window is there with
    the first row of it and no window waits for the watermark; a replayed batch
    overwrites its own.  ``latest_windows`` reads the newest version of each."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")

    return run


def latest_windows(spark: SparkSession, table_path: str, keys: list[str] | None = None) -> DataFrame:
    """The newest version of each window of ``window_upsert_sink``: a partial
    aggregate of one row a key, no sort."""
    keys = keys or ["time_window", "src_ip"]
    stored = spark.read.parquet(table_path)
    rest = [c for c in stored.columns if c not in [*keys, "batch_id"]]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def compact_windows(spark: SparkSession, table_path: str, target: str, keys: list[str] | None = None) -> None:
    """A copy of ``table_path`` with only the newest version of each window,
    as batch -1 of ``target``: newer batches may be written beside it."""
    latest_windows(spark, table_path, keys).write.mode("overwrite").parquet(f"{target}/batch_id=-1")


# S7 ----------------------------------------------------------------------------------
def correlate(process: DataFrame, network: DataFrame, minutes: int = rules.CORRELATION_MINUTES,
              watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Stream-stream inner join: network time within +-minutes of the process
    time and src_port = pid.  Watermarks on both sides bound the state.

    As in the batch join, the keys include a time bucket as wide as the
    interval, and the process side takes part in the buckets around its own:
    a hot pid's rows spread over its buckets instead of one state partition."""
    width = f"{minutes} minutes"
    half = F.make_dt_interval(mins=F.lit(minutes))
    bucket = lambda c: F.window(c, width).getField("start")
    p = process.withWatermark("timestamp", watermark)
    p = p.withColumn("_b", F.explode(F.array(*[bucket(F.col("timestamp")) + F.expr(f"INTERVAL {k * minutes} MINUTES")
                                               for k in (-1, 0, 1)]))).alias("p")
    n = network.withWatermark("timestamp", watermark).withColumns(
        {"_b": bucket(F.col("timestamp")), "_lo": F.col("timestamp") - half, "_hi": F.col("timestamp") + half}).alias("n")
    # The bounds belong to a row, not to a pair: each is computed once, a pair only compares.  From bounds made before
    # the join Spark cannot tell how long a row may still match; the numbers, a second wider, say so, and no more.
    apart = F.col("n.timestamp").cast("double"), F.col("p.timestamp").cast("double")
    cond = (
        (F.col("n._b") == F.col("p._b"))
        & (F.col("n.src_port") == F.col("p.pid"))
        & (F.col("n._lo") <= F.col("p.timestamp"))
        & (F.col("n._hi") >= F.col("p.timestamp"))
        & (apart[0] >= apart[1] - F.lit(minutes * 60.0 + 1))
        & (apart[0] <= apart[1] + F.lit(minutes * 60.0 + 1))
    )
    return p.join(n, cond, "inner").select(
        F.col("p.id").alias("process_id"), F.col("p.timestamp").alias("process_timestamp"), "p.pid", "p.command",
        F.col("n.id").alias("id"), F.col("n.timestamp").alias("timestamp"), "n.src_ip", "n.dst_ip", "n.dst_port",
    )


# S8 ----------------------------------------------------------------------------------
def cron_jobs(lines: DataFrame) -> DataFrame:
    """Jobs of a snapshot's lines: a line whose first character is '#' is
    none; the others lose white space at their ends and may be empty."""
    return (lines.filter(~F.startswith("line", F.lit("#")))
            .select("cron_file", "snapshot_ts", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")).alias("job")))


def cron_diff_sink(out_path: str, state_path: str):
    """foreachBatch function: jobs new relative to the last changed snapshot
    go to ``out_path``, the jobs of each file's last changed snapshot of this
    batch to ``state_path``; a file's rows of its newest batch are its state.
    Both folders are per batch, so a replayed batch overwrites its own.  The
    snapshots of a batch are not folded: see ``operators.cron_chain``."""
    from vigil.operators.cron_chain import state_changes
    from vigil.sources.files import path_exists

    schema = "cron_file string, snapshot_ts timestamp, job string, batch_id long"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = (spark.read.schema(schema).parquet(state_path) if path_exists(spark, state_path)
                  else spark.createDataFrame([], schema)).filter(F.col("batch_id") < batch_id)
        newest = stored.groupBy(F.col("cron_file").alias("_f")).agg(F.max("batch_id").alias("_b"))
        known = stored.join(newest, F.col("cron_file").eqNullSafe(F.col("_f")) & (F.col("batch_id") == F.col("_b")), "left_semi")
        added, state = state_changes(cron_jobs(cut_lineage(batch, "cron-batch")), known.select("cron_file", "job"))
        added.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        state.write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}")

    return run


# S9 ----------------------------------------------------------------------------------
def file_changes_sink(out_path: str, state_path: str):
    """foreachBatch function over ``windows.file_mod_changes``: the largest
    modification time of earlier batches enters the batch as an observation
    before all others of its file."""
    from vigil.operators.windows import file_mod_changes
    from vigil.sources.files import path_exists

    schema = "file string, mtime_s long, batch_id long"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("id", "timestamp", "file", "mtime_s").withColumn("_known", F.lit(False))
        if path_exists(spark, state_path):
            known = (spark.read.schema(schema).parquet(state_path).filter(F.col("batch_id") < batch_id)
                     .groupBy("file").agg(F.max("mtime_s").alias("mtime_s")))
            # A null time sorts before every observation.
            rows = rows.unionByName(known.select(
                F.lit(None).cast("long").alias("id"), F.lit(None).cast("timestamp").alias("timestamp"), "file", "mtime_s",
                F.lit(True).alias("_known")))
        changed = file_mod_changes(rows).filter(~F.col("_known")).select("file", "timestamp", "mtime_s")
        changed.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        (batch.filter(F.col("file").isNotNull()).groupBy("file").agg(F.max("mtime_s").cast("long").alias("mtime_s"))
         .write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}"))

    return run


# S10: ``vigil.operators.throttle.throttle_sink`` (one throttle, or one per key with ``by``)


# S11 ---------------------------------------------------------------------------------
def late_rows(query) -> int:
    """Rows dropped as late by watermarked stateful operators so far."""
    n = 0
    for prog in query.recentProgress:
        ops = prog.get("stateOperators", []) if isinstance(prog, dict) else getattr(prog, "stateOperators", [])
        for op in ops or []:
            v = op.get("numRowsDroppedByWatermark", 0) if isinstance(op, dict) else getattr(
                op, "numRowsDroppedByWatermark", 0)
            n += int(v or 0)
    return n


def split_late(on_time, late_path: str, delay: str = DEFAULT_WATERMARK, ts: str = "timestamp", state_path: str | None = None):
    """foreachBatch function that keeps late rows: rows older than the greatest
    time of the batches before less ``delay`` go to ``late_path/batch_id=N``, the
    others to ``on_time(rows, batch_id)``.  On-time and late rows together are
    the input.  The mark of a batch is a row of ``state_path``; it depends on
    earlier batches alone, as a watermark does, so a replayed batch is split
    alike.  Rows without a time are on time."""
    from vigil.sources.files import path_exists

    marks = state_path or f"{late_path}_marks"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut_lineage(batch, "late-batch")
        seen = None
        if path_exists(spark, marks):
            kind = batch.schema[ts].dataType.simpleString()
            seen = (spark.read.schema(f"seen {kind}, batch_id long").parquet(marks)
                    .filter(F.col("batch_id") < batch_id).agg(F.max("seen")).first()[0])
        # A null mark (nothing seen yet) makes no row late.
        mark = F.lit(seen).cast(batch.schema[ts].dataType) - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(ts) < mark, F.lit(False))
        batch.filter(late).write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
        on_time(batch.filter(~late), batch_id)
        batch.agg(F.max(ts).alias("seen")).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")

    return run


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Drive a stream over everything available into a parquet table in the
    shared folder (append: file sink; complete: each batch rewrites the
    table, idempotently; update: versions of changed rows, see
    ``latest_windows``).  Output never goes through the driver."""
    if mode == "complete":
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        w = df.writeStream.outputMode("complete").foreachBatch(write)
    elif mode == "update":
        w = df.writeStream.outputMode("update").foreachBatch(window_upsert_sink(path))
    else:
        w = df.writeStream.format("parquet").option("path", path).outputMode("append")
    q = w.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Drive a stream into an in-driver memory table (small tests only)."""
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
