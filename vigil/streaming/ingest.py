"""Ingestion as one streaming application (lifecycle E1).

    NDJSON files --S1--> envelope rows --+--S2--> routed files (type, ingest date) + quarantine
                                         +--S3--> alert table
                                         +--S5--> tables ``commands``, ``network``, ``cron``
    process CSV files --S1--> process rows --+--> quarantine
                                             +--S5--> table ``process``

The tables hold rows of unseen timestamps with the columns and types of
``schemas`` (``id`` in arrival order, ``user_name``), laid out by event date:
the batch operators read them as they are.

Each sink is its own streaming query with its own checkpoint under the
cluster's shared folder; a restart resumes from the checkpoints and every
sink is idempotent per batch id, so files (with ``growing``, lines) are
processed exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources import schemas
from vigil.sources.files import parse_process_csv
from vigil.streaming import streams as ST
from vigil.streaming.growing import growing_events

#: Event type -> its table and the table's schema.
EVENT_TABLES = {
    "suspicious_command": ("commands", schemas.COMMANDS),
    "network_event": ("network", schemas.NETWORK),
    "cron_event": ("cron", schemas.CRON),
}


@dataclass
class IngestQueries:
    route: object
    alerts: object
    tables: dict = field(default_factory=dict)
    quarantine: object = None


def _typed_rows(events: DataFrame, kind: str) -> DataFrame:
    rows = events.filter((F.col("type") == kind) & F.col("_corrupt_record").isNull())
    return rows.withColumnRenamed("user", "user_name")


def start_ingest(spark: SparkSession, source_dir: str, out_root: str, checkpoint_root: str,
                 trigger: dict | None = None, max_files_per_trigger: int | None = None,
                 process_dir: str | None = None, growing: bool = False) -> IngestQueries:
    """Start the routing, alert and table queries over one NDJSON folder and,
    with ``process_dir``, over one folder of process CSV files.  ``growing``:
    the NDJSON files are appended to and rotated (see ``streaming.growing``)."""
    trig = trigger or {"availableNow": True}
    if growing:
        events = growing_events(spark, source_dir).drop("path", "start")
    else:
        events = ST.stream_events(spark, source_dir, max_files_per_trigger=max_files_per_trigger)
    route = ST.stream_route(events, f"{out_root}/routed", f"{checkpoint_root}/route", trig)
    alert_rows = ST.alerts(events.filter(F.col("_corrupt_record").isNull())).select(
        "type", "timestamp", "command", "dst_port", "alert")
    alerts = (alert_rows.writeStream.format("parquet").option("path", f"{out_root}/alerts")
              .option("checkpointLocation", f"{checkpoint_root}/alerts").trigger(**trig).start())
    started = IngestQueries(route=route, alerts=alerts)

    def table(rows: DataFrame, name: str, schema) -> None:
        started.tables[name] = (rows.writeStream
                                .foreachBatch(ST.upsert_new_rows(f"{out_root}/tables/{name}", order=["_seq"], schema=schema))
                                .option("checkpointLocation", f"{checkpoint_root}/{name}").trigger(**trig).start())

    for kind, (name, schema) in EVENT_TABLES.items():
        table(_typed_rows(events, kind), name, schema)
    if process_dir:
        reader = spark.readStream
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        rows = parse_process_csv(reader.text(process_dir))
        table(rows.filter(F.col("_corrupt_record").isNull()), "process", schemas.PROCESS)
        started.quarantine = (rows.filter(F.col("_corrupt_record").isNotNull()).select(F.col("_corrupt_record").alias("value"))
                              .writeStream.format("text").option("path", f"{out_root}/process_quarantine")
                              .option("checkpointLocation", f"{checkpoint_root}/process_quarantine").trigger(**trig).start())
    return started


def await_all(q: IngestQueries) -> None:
    for s in [q.route, q.alerts, *q.tables.values(), *([q.quarantine] if q.quarantine else [])]:
        s.awaitTermination()
