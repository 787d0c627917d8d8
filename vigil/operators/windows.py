"""Window operators that survive hot keys.

A plain ``Window.partitionBy(user)`` sends every row of a user to one task;
if one user (source pair, file ...) holds a third of the data, that task
sorts a third of the data.  The operators here cut the rows into sampled
ranges of (key, time, id) instead, so a hot key fills many tasks whatever
its rows' times are, and carry across range edges exactly the little state
the frame needs from earlier ranges:

* ``lag`` (time since previous event): the newest timestamp of the key's
  previous range, from a per-(key, range) aggregate.
* running max excluding the current row: the max over all previous ranges,
  again from the per-(key, range) aggregate.
* ``rows between P preceding and current row``: the first P rows of a range
  are recomputed with a *halo* of the P rows that precede the range (the
  newest P rows of earlier ranges, found among each range's last P rows).

Ranges come from sampling, so the rows are written once with their range
(shared checkpoint folder) and all passes read that table.  Results are
identical to the plain window; ``ranged=False`` gives the plain window for
small inputs and for tests that compare the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import rules
from vigil.session import cut_lineage

PART = "_part"


def into_ranges(df: DataFrame, order: list[str], name: str = "ranges") -> DataFrame:
    """``df`` with ``_part``, the number of its row's range in ``order``."""
    return cut_lineage(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), name)


def _keys_present(keys: list[str]) -> Column:
    """Rows whose group key has a NULL part belong to no group (pandas
    ``groupby`` drops them): their window results are NULL."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


# -- lag: seconds since the previous event of the key ------------------------

def time_diff(df: DataFrame, keys: list[str] | None = None, ts: str = "timestamp", tie: str = "id",
              out: str = "time_diff", ranged: bool = True) -> DataFrame:
    """Seconds since the previous row of the same key (NULL for the first)."""
    keys = keys or ["src_ip", "dst_ip"]
    order = [F.col(ts), F.col(tie)]
    if not ranged:
        prev = F.lag(ts).over(Window.partitionBy(*keys).orderBy(*order))
        diff = F.timestamp_diff("MICROSECOND", prev, F.col(ts)) / F.lit(1e6)
        return df.withColumn(out, F.when(_keys_present(keys), diff))

    b = PART
    x = into_ranges(df, [*keys, ts, tie])
    in_range = F.lag(ts).over(Window.partitionBy(*keys, b).orderBy(*order))
    x = x.withColumn("_prev", in_range)
    edges = (
        x.groupBy(*keys, b).agg(F.max(ts).alias("_bmax"))
        .withColumn("_carry", F.lag("_bmax").over(Window.partitionBy(*keys).orderBy(b)))
        .select(*keys, b, "_carry")
    )
    x = x.join(edges, [*keys, b], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    diff = F.timestamp_diff("MICROSECOND", prev, F.col(ts)) / F.lit(1e6)
    return x.withColumn(out, F.when(_keys_present(keys), diff)).drop(b, "_prev", "_carry")


def beaconing(df: DataFrame, keys: list[str] | None = None, **kw) -> DataFrame:
    """``time_diff`` plus ``periodic_flag`` (0 < gap <= 3600 s)."""
    from vigil.functions.scalars import periodic_flag

    x = time_diff(df, keys, **kw)
    return x.withColumn("periodic_flag", periodic_flag(F.col("time_diff")))


# -- running max over earlier rows: file modification changes -----------------

def file_mod_changes(files: DataFrame, key: str = "file", mtime: str = "mtime_s", ts: str = "timestamp",
                     tie: str = "id", ranged: bool = True) -> DataFrame:
    """Observations whose modification time exceeds every earlier one of the
    same file; the first observation of a file is the baseline (never
    emitted)."""
    order = [F.col(ts), F.col(tie)]
    if not ranged:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return files.filter(F.col(key).isNotNull()).withColumn("prev_max", F.max(mtime).over(w)).filter(
            F.col(mtime) > F.col("prev_max"))

    b = PART
    x = into_ranges(files.filter(F.col(key).isNotNull()), [key, ts, tie])
    w_in = Window.partitionBy(key, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_in", F.max(mtime).over(w_in))
    carry = (
        x.groupBy(key, b).agg(F.max(mtime).alias("_bmax"))
        .withColumn("_carry", F.max("_bmax").over(
            Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)))
        .select(key, b, "_carry")
    )
    x = x.join(carry, [key, b], "left").withColumn("prev_max", F.greatest(F.col("_in"), F.col("_carry")))
    return x.filter(F.col(mtime) > F.col("prev_max")).drop(b, "_in", "_carry")


# -- rows-frame rolling statistics -------------------------------------------

def _rolling_cols(values: list[str], w) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for v in values:
        out[f"{v}_rolling_mean"] = F.avg(v).over(w)
        out[f"{v}_rolling_std"] = F.stddev_samp(v).over(w)
    return out


def rolling_stats(df: DataFrame, keys: list[str] | None = None, values: list[str] | None = None,
                  rows: int = rules.ROLLING_ROWS, ts: str = "timestamp", tie: str = "id",
                  ranged: bool = True) -> DataFrame:
    """Mean and sample std of the last ``rows`` rows (current included,
    ``min_periods=1``) per key, for each value column."""
    keys = keys or ["user_name"]
    values = values or list(rules.ROLLING_FEATURES)
    P = rows - 1
    order = [F.col(ts), F.col(tie)]
    if not ranged:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-P, 0)
        return _null_for_missing_keys(df.withColumns(_rolling_cols(values, w)), keys, values)

    b = PART
    wk = Window.partitionBy(*keys, b)
    x = into_ranges(df, [*keys, ts, tie])
    x = x.withColumn("_ra", F.row_number().over(wk.orderBy(*order))).withColumn(
        "_rd", F.row_number().over(wk.orderBy(F.col(ts).desc(), F.col(tie).desc()))
    )
    x = x.withColumns(_rolling_cols(values, wk.orderBy(*order).rowsBetween(-P, 0)))

    body = x.filter(F.col("_ra") > P)
    base_cols = df.columns
    heads = x.filter(F.col("_ra") <= P).select(*base_cols, b).withColumn("_halo", F.lit(False))

    # Halo: for each range, the P rows right before it = the newest P rows of
    # the union of earlier ranges' tails.  Tails are P rows per range, so
    # this window per key holds P x (#ranges) rows, not the key's data.
    slim = [*keys, ts, tie, *values]
    tails = x.filter(F.col("_rd") <= P).select(*slim, b, "_ra")
    wt = Window.partitionBy(*keys).orderBy(*order)
    tails = tails.withColumn(
        "_first", F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)) == 1
    ).withColumn("_prev", F.collect_list(F.struct(ts, tie, *values)).over(wt.rowsBetween(-P, -1)))
    halo = (
        tails.filter("_first")
        .select(*keys, b, F.explode("_prev").alias("_h"))
        .select(*keys, b, *[F.col(f"_h.{c}").alias(c) for c in (ts, tie, *values)])
        .withColumn("_halo", F.lit(True))
    )
    fixed = heads.unionByName(halo, allowMissingColumns=True)
    fixed = fixed.withColumns(_rolling_cols(values, wk.orderBy(*order).rowsBetween(-P, 0)))
    fixed = fixed.filter(~F.col("_halo")).drop("_halo")
    keep = [*base_cols, *[c for v in values for c in (f"{v}_rolling_mean", f"{v}_rolling_std")]]
    return _null_for_missing_keys(body.select(*keep).unionByName(fixed.select(*keep)), keys, values)


def _null_for_missing_keys(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    present = _keys_present(keys)
    return df.withColumns({
        c: F.when(present, F.col(c)) for v in values for c in (f"{v}_rolling_mean", f"{v}_rolling_std")
    })


# -- value frequency mapped back ---------------------------------------------

def value_frequency(df: DataFrame, col: str = "hashed_command", out: str = "command_frequency") -> DataFrame:
    """Number of rows sharing ``col`` (NULL for NULL).

    Aggregate (partial, map-side), written as a table, joined back.  Because
    the counts come from a table and not from an exchange on the same key,
    the join has an exchange of its own on either side, and adaptive
    execution can split a hot value's partition."""
    counts = cut_lineage(df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out)), "frequency")
    return df.join(counts, col, "left")


# -- newest rows per group -----------------------------------------------------

def per_group_latest(df: DataFrame, keys: list[str], n: int = rules.RECENT_PER_SOURCE,
                     ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """Newest ``n`` rows per key.  ``row_number() <= n`` is planned with a
    partial WindowGroupLimit before the shuffle, so a hot key ships at most
    n rows per input partition."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
