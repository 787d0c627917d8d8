"""The cron state rule without a fold: which snapshots change a file's state.

A snapshot replaces the state if it holds a job that the state lacks.  Read in
order that is a fold over a file's snapshots; here it is a chain of pointers.

1. Snapshots are numbered per file, the state from before being number 0.
2. A job that is back at b after it was last seen at a is new to each state
   c with a < c < b.  So each snapshot b is new to an interval of states that
   ends at b - 1, and the state after c is the least b whose interval holds c.
3. Intervals are cut into at most two nodes per level of a binary tree over
   the numbers, and the least b of a node is one aggregate; c asks the nodes
   above it, one per level.  Both sides are equi-joins on (file, level, node).
4. The chain from 0 is found by pointer doubling, log2(length) joins.

No step brings a file's snapshots or jobs into one task: a file with most of
all snapshots is sorted over sampled ranges and joined like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.windows import PART, into_ranges
from vigil.session import cut_lineage, cut_to, drop_dir, shared_dir


def numbered(snapshots: DataFrame) -> DataFrame:
    """(cron_file, snapshot_ts, c): distinct snapshots, numbered from 1 in time order."""
    x = into_ranges(snapshots.select("cron_file", "snapshot_ts").distinct(), ["cron_file", "snapshot_ts"], "cron-snapshots")
    before = Window.partitionBy("cron_file").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # One row per file and range.
    sizes = x.groupBy("cron_file", PART).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("cron_file", PART).orderBy("snapshot_ts"))
    return x.withColumn("_at", place).join(offsets, ["cron_file", PART]).select(
        "cron_file", "snapshot_ts", (F.col("_at") + F.col("_before")).alias("c"))


def last_seen(held: DataFrame) -> DataFrame:
    """``held`` (cron_file, job, c) with ``a``, the snapshot before that held the job, or -1."""
    x = into_ranges(held, ["cron_file", "job", "c"], "cron-jobs")
    own = Window.partitionBy("cron_file", "job", PART).orderBy("c")
    before = Window.partitionBy("cron_file", "job").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ends = x.groupBy("cron_file", "job", PART).agg(F.max("c").alias("_end"))  # one row per job and range
    carried = ends.withColumn("_carried", F.max("_end").over(before)).drop("_end")
    return x.withColumn("_prev", F.lag("c").over(own)).join(carried, ["cron_file", "job", PART]).select(
        "cron_file", "job", "c", F.coalesce("_prev", "_carried", F.lit(-1)).alias("a"))


def next_states(spans: DataFrame, states: DataFrame, levels: int) -> DataFrame:
    """(cron_file, c, nxt): the least ``b`` whose span ``lo`` <= c <= ``hi`` holds c, where there is one."""
    def pieces(k: int) -> list:
        low, high = F.shiftright(F.col("lo") + ((1 << k) - 1), k), F.shiftright(F.col("hi") + 1, k)
        node = lambda x: F.struct(F.lit(k).alias("level"), x.alias("node"))
        return [F.when((low < high) & (low % 2 == 1), node(low)), F.when((low < high) & (high % 2 == 1), node(high - 1))]

    cover = F.explode(F.array_compact(F.array(*[p for k in range(levels) for p in pieces(k)])))
    nodes = spans.select("cron_file", "b", cover.alias("x")).groupBy("cron_file", "x.level", "x.node").agg(F.min("b").alias("b"))
    asked = states.select("cron_file", "c", F.posexplode(F.array(*[F.shiftright("c", k) for k in range(levels)])).alias("level", "node"))
    return asked.join(nodes, ["cron_file", "level", "node"]).groupBy("cron_file", "c").agg(F.min("b").alias("nxt"))


def chain(jump: DataFrame) -> DataFrame:
    """(cron_file, c): what pointers (cron_file, c, nxt) reach from c = 0, 0 included."""
    spark, base = jump.sparkSession, shared_dir(jump.sparkSession, "cron-chain")
    key = ["cron_file", "c"]
    jump = cut_to(jump, f"{base}/jump-0")
    found = cut_to(jump.where("c = 0").select(*key), f"{base}/found-0")
    size, k = found.count(), 0
    while size:
        step = found.join(jump, key).select("cron_file", F.col("nxt").alias("c"))
        grown = cut_to(found.unionByName(step).distinct(), f"{base}/found-{k + 1}")
        drop_dir(spark, f"{base}/found-{k}")
        found, new = grown, grown.count()
        if new == size:
            break
        size = new
        far = jump.select("cron_file", F.col("c").alias("nxt"), F.col("nxt").alias("then"))
        jump = cut_to(jump.join(far, ["cron_file", "nxt"]).select("cron_file", "c", F.col("then").alias("nxt")), f"{base}/jump-{k + 1}")
        drop_dir(spark, f"{base}/jump-{k}")
        k += 1
    return found


def state_changes(jobs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, state) of ``jobs`` (cron_file, snapshot_ts, job) given the jobs of
    each file's state from before, ``known`` (cron_file, job): the jobs that a
    snapshot adds to the state, and the jobs of each file's last changed
    snapshot, both (cron_file, snapshot_ts, job).  Null files are a file,
    null times and null jobs are left out; repeated rows count once."""
    rows = jobs.where("snapshot_ts is not null and job is not null").select(
        F.coalesce(F.concat(F.lit("="), "cron_file"), F.lit("")).alias("cron_file"), "snapshot_ts", "job").distinct()
    at = cut_lineage(numbered(rows), "cron-numbered")
    before = known.select(F.coalesce(F.concat(F.lit("="), "cron_file"), F.lit("")).alias("cron_file"), F.lit(0).cast("long").alias("c"), "job")
    now = rows.join(at, ["cron_file", "snapshot_ts"])
    # States of files that have no new snapshot stay as they are.
    before = before.join(at.select("cron_file").distinct(), "cron_file", "left_semi").distinct()
    held = cut_lineage(now.select("cron_file", "c", "job").unionByName(before), "cron-held")
    back = last_seen(held).where("c > 0 and a < c - 1")
    spans = back.groupBy("cron_file", F.col("c").alias("b")).agg((F.min("a") + 1).alias("lo")).withColumn("hi", F.col("b") - 1)
    states = at.select("cron_file", "c").unionByName(at.select("cron_file", F.lit(0).cast("long").alias("c")).distinct())
    most = at.agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    jump = cut_lineage(next_states(cut_lineage(spans, "cron-spans"), states, int(most).bit_length() + 1), "cron-next")
    path = cut_lineage(chain(jump).join(jump, ["cron_file", "c"]), "cron-path")  # (cron_file, c, nxt)
    new = held.select("cron_file", F.col("c").alias("nxt"), "job").join(path, ["cron_file", "nxt"])
    added = new.join(held, ["cron_file", "c", "job"], "left_anti").select("cron_file", F.col("nxt").alias("c"), "job")
    last = path.groupBy("cron_file").agg(F.max("nxt").alias("c"))

    def named(x: DataFrame) -> DataFrame:
        name = F.when(F.col("cron_file") != "", F.expr("substr(cron_file, 2)")).alias("cron_file")
        return x.join(at, ["cron_file", "c"]).select(name, "snapshot_ts", "job")

    return named(added), named(held.join(last, ["cron_file", "c"], "left_semi"))
