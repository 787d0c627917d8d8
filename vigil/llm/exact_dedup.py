"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare
bytes inside the groups.

DataFrame functions only.  The row with the largest id stays.

* A null text counts as empty.  Texts are compared as they are.
* Rows that repeat an id and a text are one group; one of them stays.
* Null ids are smaller than every other id, so such a row stays only in a
  group without any id; its ``keep_id`` is null.
* An empty table gives an empty result.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, checked_broadcast


def md5_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hash128: Callable[[Column], Column] = md5_key) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Only (row id, id, hash, class) is shuffled to form the groups, pre-aggregated
    before the shuffle.  The byte comparison aggregates the texts of groups of
    two or more on (hash, text): copies collapse before the shuffle, so a group
    of a third of all rows costs one row per task.  Hashes that turn out to
    hold several texts are split by text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    keyed = base.withColumn("_h", hash128(F.col("_text")))

    def rows_of(df: DataFrame, cls: Column) -> DataFrame:
        return scratch.cut(df.select(F.monotonically_increasing_id().alias("_r"), "_id", "_h", cls.alias("_c"),
                                     F.sha2(F.col("_text").cast("binary"), 256).alias("_sha")), "rows")

    def groups_of(rows: DataFrame) -> DataFrame:
        return scratch.cut(rows.groupBy("_h", "_c").agg(
            F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", F.negative("_r").alias("_r"))).alias("_keep")), "groups")

    rows = rows_of(keyed, F.lit(0))
    groups = groups_of(rows)
    multi = scratch.cut(groups.where("_n > 1").select("_h"), "multi")
    # Bytes: several texts under one hash?
    texts = keyed.select("_h", "_text").join(checked_broadcast(multi), "_h", "left_semi").groupBy("_h", "_text").count()
    clash = scratch.cut(texts.groupBy("_h").count().where("count > 1").select("_h"), "clash")
    if not clash.isEmpty():
        # Number the texts of a clashing hash and form the groups again with that number.
        order = F.row_number().over(_by_hash())
        numbered = scratch.cut(texts.join(clash, "_h", "left_semi").select("_h", "_text", order.alias("_no")), "numbered")
        split = keyed.join(numbered, ["_h", "_text"], "left")
        scratch.drop(rows, groups)
        rows = rows_of(split, F.coalesce(F.col("_no"), F.lit(0)))
        groups = groups_of(rows)
        scratch.drop(numbered)
    scratch.drop(multi, clash)
    # Both sides come from written tables: adaptive execution splits a hot group's partition.
    out = rows.join(groups, ["_h", "_c"])
    return out.select(F.col("_id").alias(id_col), F.col("_keep._id").alias("keep_id"), F.col("_n").alias("group_size"),
                      (F.negative("_r") == F.col("_keep._r")).alias("kept"), F.col("_sha").alias("text_sha256"))


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("_h").orderBy("_text")
