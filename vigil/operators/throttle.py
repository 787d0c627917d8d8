"""Greedy alert throttle, exact and distributed.

Rule: an alert passes if at least ``gap`` has elapsed since the last alert
of its group that *passed* (not the last alert seen).  Read sequentially this
is a fold over all alerts of a group, so a global throttle would put every
alert in one task.  Instead:

1. **Successor.**  For each alert a, ``nxt(a)`` = the first alert (by time,
   then id) at or after ``ts_a + gap``.  Alerts and these targets are merged
   and cut into sampled ranges of (group, time, kind, id), so a burst fills
   many tasks however dense it is.  Inside a range a running
   ``last(..., ignorenulls)`` over a descending order finds the next alert;
   targets with no alert left in their range take the first alert of the
   group's next non-empty range from a table of one row per group and range.
2. **Chain.**  The passed alerts are a0, nxt(a0), nxt(nxt(a0)), ...
   Pointer doubling finds them with joins only: S_0 = {a0}, J_0 = nxt;
   S_{k+1} = S_k u J_k(S_k), J_{k+1} = J_k o J_k, until S stops growing.
   That takes log2(chain length) rounds.  Pointers that lead nowhere are
   dropped before they are composed.  Both sides of every join are written
   tables, so adaptive execution can split a target many alerts point to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import rules
from vigil.operators.windows import PART, into_ranges
from vigil.session import cut_to, drop_dir, shared_dir


def _us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def successors(alerts: DataFrame, gap_us: int, ts: str = "timestamp", key: str = "id",
               by: list[str] | None = None) -> DataFrame:
    """(id, nxt): the first alert of the group at or after ts + gap, per alert."""
    by = by or []
    kind_of_id = alerts.schema[key].dataType
    a = alerts.select(*by, F.col(key).alias("id"), _us(F.col(ts)).alias("us"))
    none = F.lit(None).cast(kind_of_id)
    points = a.select(*by, F.col("us").alias("t"), F.lit(1).alias("kind"), F.col("id").alias("aid"), none.alias("qid"))
    queries = a.select(*by, (F.col("us") + F.lit(gap_us)).alias("t"), F.lit(0).alias("kind"), none.alias("aid"),
                       F.col("id").alias("qid"))
    # At equal times a target comes before the alerts, which it may take.
    merged = into_ranges(points.unionByName(queries), [*by, "t", "kind", "aid", "qid"], "throttle-points")
    alert_ref = F.when(F.col("kind") == 1, F.struct(F.col("t").alias("us"), F.col("aid").alias("id")))
    before = Window.unboundedPreceding
    w = (Window.partitionBy(*by, PART).orderBy(F.col("t").desc(), F.col("kind").desc(), F.col("aid").desc_nulls_last())
         .rowsBetween(before, Window.currentRow))
    found = merged.withColumn("_nx", F.last(alert_ref, ignorenulls=True).over(w)).filter(F.col("kind") == 0)
    # First alert of any later range: one row per group and range, at most.
    firsts = merged.groupBy(*by, PART).agg(F.min(alert_ref).alias("_first"))
    later = firsts.withColumn("_later", F.last("_first", ignorenulls=True).over(
        Window.partitionBy(*by).orderBy(F.col(PART).desc()).rowsBetween(before, -1))).drop("_first")
    f, r = found.alias("f"), later.alias("r")
    same = F.col(f"f.{PART}") == F.col(f"r.{PART}")
    for c in by:
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"r.{c}"))
    return f.join(r, same, "left").select(F.col("f.qid").alias("id"), F.coalesce(F.col("f._nx.id"), F.col("r._later.id")).alias("nxt"))


def throttle_batch(alerts: DataFrame, hours: float = rules.ALERT_INTERVAL_HOURS, ts: str = "timestamp",
                   key: str = "id", by: list[str] | None = None) -> DataFrame:
    """Rows of ``alerts`` that pass the greedy throttle of their group (all
    rows one group without ``by``).  ``key`` is unique."""
    spark = alerts.sparkSession
    base = shared_dir(spark, "throttle")
    gap_us = int(hours * 3600 * 1_000_000)
    jump = cut_to(successors(alerts, gap_us, ts, key, by).where("nxt is not null"), f"{base}/jump-0")
    earliest = F.min(F.struct(_us(F.col(ts)).alias("us"), F.col(key).alias("id"))).alias("f")
    first = alerts.groupBy(*by).agg(earliest) if by else alerts.agg(earliest)
    chain = cut_to(first.select(F.col("f.id").alias("id")).filter(F.col("id").isNotNull()), f"{base}/chain-0")
    size, k = chain.count(), 0
    while size:
        step = chain.join(jump, "id").select(F.col("nxt").alias("id"))
        grown = cut_to(chain.unionByName(step).distinct(), f"{base}/chain-{k + 1}")
        new_size = grown.count()
        chain, old = grown, f"{base}/chain-{k}"
        drop_dir(spark, old)
        if new_size == size:
            break
        size = new_size
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut_to(a.join(b, F.col("a.nxt") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.nxt").alias("nxt")),
                      f"{base}/jump-{k + 1}")
        drop_dir(spark, f"{base}/jump-{k}")
        k += 1
    return alerts.join(chain.withColumnRenamed("id", key), key, "left_semi")


def throttle_sink(table_path: str, hours: float = rules.ALERT_INTERVAL_HOURS, ts: str = "timestamp",
                  key: str = "id", by: list[str] | None = None):
    """foreachBatch function: passes of each micro-batch given the last
    passed alert of earlier batches (read from the output table), written to
    ``table_path/batch_id=N`` (a replayed batch overwrites its own folder).
    Alerts that arrive after a later pass are judged in arrival order."""
    from vigil.sources.files import path_exists

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        alerts = batch
        if path_exists(spark, table_path):
            # Batches before this one; a newer folder can only be left over from a lost run.
            stored = T.StructType([*batch.schema.fields, T.StructField("batch_id", T.LongType())])
            prev = spark.read.schema(stored).parquet(table_path).filter(F.col("batch_id") < batch_id)
            gap = F.make_dt_interval(secs=F.lit(hours * 3600).cast("decimal(18,6)"))
            if by:
                last = prev.groupBy(*by).agg(F.max(ts).alias("_last"))
                alerts = (alerts.join(last, by, "left").filter(F.col("_last").isNull() | (F.col(ts) >= F.col("_last") + gap))
                          .select(*batch.columns))
            else:
                last = prev.select(F.max(ts)).scalar()
                alerts = alerts.filter(last.isNull() | (F.col(ts) >= last + gap))
        passed = throttle_batch(alerts, hours, ts, key, by)
        passed.write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")

    return run
