"""Sharding: a keyed Feistel permutation with cycle walking over global row
numbers.  DataFrame functions only.

Rows are numbered 0..n-1 in id order; the permutation sends a number to its
place in the shuffle; place modulo shards is the shard and place divided by
shards the slot.  Shard sizes therefore differ by one at most (law ``rows``),
slots have no gaps, and both follow from (row number, n, seed) alone;
``row_at`` goes the other way.

The permutation works on a grid of a x b cells, a = ceil(sqrt n) and
b = ceil(n / a): each round adds a hash of one coordinate to the other,
alternately modulo a and b.  The grid has fewer than a cells beyond n, so
few numbers ever land outside; those are permuted again until they land
inside (cycle walking), which keeps the map one to one on 0..n-1.

* Null texts count as empty: size 16, crc32 of nothing.
* Repeated ids are numbered by checksum and size, equal rows in any order.
* Null ids come first.  An empty table gives an empty result.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import Scratch

ROUNDS = 8
#: Steps of the walk written out in the plan.  The chance that a number needs more is below n ** -30; the row fails then.
WALK = 64


def grid(n: int) -> tuple[int, int]:
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _pass(x: Column, a: int, b: int, seed: int, rounds: int, forward: bool) -> Column:
    """One trip through the network: x = r * a + l with l below a, r below b."""
    l0 = F.pmod(x, F.lit(a).cast("long"))
    start = F.struct(l0.alias("l"), F.floor((x - l0) / F.lit(a)).cast("long").alias("r"))
    order = range(rounds) if forward else reversed(range(rounds))
    steps = F.array(*[F.lit(i).cast("long") for i in order])
    sign = 1 if forward else -1

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        hl = F.pmod(F.xxhash64(acc["r"], i, F.lit(seed).cast("long")), F.lit(a).cast("long"))
        hr = F.pmod(F.xxhash64(acc["l"], i, F.lit(seed).cast("long")), F.lit(b).cast("long"))
        return F.struct(F.when(even, F.pmod(acc["l"] + sign * hl, F.lit(a).cast("long"))).otherwise(acc["l"]).alias("l"),
                        F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + sign * hr, F.lit(b).cast("long"))).alias("r"))

    return F.aggregate(steps, start, step, lambda acc: acc["r"] * F.lit(a).cast("long") + acc["l"])


def permute(x: Column, n: int, seed: int = 0, rounds: int = ROUNDS, forward: bool = True) -> Column:
    """The place of row number ``x`` among 0..n-1; with ``forward=False`` the
    row number of place ``x``."""
    a, b = grid(n)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), x.cast("long"),
        lambda acc, i: F.when((i > 1) & (acc < F.lit(n)), acc).otherwise(_pass(acc, a, b, seed, rounds, forward)))
    once = _pass(x.cast("long"), a, b, seed, rounds, forward)
    out = F.when(once < F.lit(n), once).otherwise(walk)
    return F.when(out < F.lit(n), out).otherwise(
        F.raise_error(F.lit("the walk did not come back")).cast("long"))


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int = 0) -> Column:
    """The row number that lies in (shard, slot)."""
    return permute(slot.cast("long") * shards + shard, n, seed, forward=False)


def number_rows(df: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """``df`` with ``_row`` (0..n-1 in ``order``), and n.

    Sampled ranges sort the rows over all tasks; a row's number is the rows in
    the ranges before plus its place in its own.  The sorted rows are written
    once, with range and place taken from ``monotonically_increasing_id``
    (range in the upper bits), so later passes can't see other ranges.
    Without ``order`` the rows are numbered as they lie, without a shuffle."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = scratch.cut(ranged.withColumn("_m", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_m", 33)
    # One row per range: the number of shuffle partitions bounds it, not the data.
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.cut(sizes.select("_p", "_n", before.alias("_before")), "starts")
    n = starts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    rows = placed.withColumn("_p", part).join(F.broadcast(starts.select("_p", "_before")), "_p")
    return rows.withColumn("_row", F.col("_before") + place).drop("_p", "_m", "_before"), n


def shard_rows(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, row_number, shard, slot."""
    scratch = Scratch(docs.sparkSession, "shard")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col).alias("_id"), (F.octet_length(raw).cast("long") + 16).alias("_size"),
                         F.crc32(raw).alias("_crc"))
    rows, n = number_rows(narrow, ["_id", "_crc", "_size"], scratch)
    placed = rows.withColumn("_at", permute(F.col("_row"), max(n, 1), seed))
    return placed.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                         F.col("_row").alias("row_number"), (F.col("_at") % shards).cast("int").alias("shard"),
                         F.floor((F.col("_at") - F.col("_at") % shards) / shards).cast("long").alias("slot"))
