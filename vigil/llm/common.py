"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import drop_dir, shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a side of a join is broadcast after it was counted.
BROADCAST_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Scratch:
    """Tables written under the shared checkpoint folder.

    ``cut`` writes a frame and reads it back, which cuts its lineage: later
    passes don't recompute it, and a lost executor doesn't take it along.
    ``drop`` deletes the tables that nothing reads any more; the ones behind a
    returned frame stay until the caller clears the folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = name
        self.paths: dict[int, str] = {}

    def cut(self, df: DataFrame, what: str, *folders: str) -> DataFrame:
        """``folders``: columns by whose values the table is split into folders."""
        path = shared_dir(self.spark, f"{self.name}-{what}")
        df.write.partitionBy(*folders).parquet(path)
        # The written schema is known: reading it back needs no footer job.
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = getattr(self, "_keep", [])
        self._keep.append(out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                drop_dir(self.spark, path)


def checked_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as
    it is: the join then shuffles, and adaptive execution splits hot keys.
    ``df`` should be cheap to count, such as a table made by ``cut``."""
    n = df.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else untouched.  ``lower`` does that for
    texts of ASCII alone and is much faster than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def row_keys(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """``docs`` reduced to (``_k`` long, ``_id``, ``_text``): ``_k`` is unique
    per row and ordered like the id.

    Ids that are unique integers serve as they are.  Otherwise (repeated or
    null ids, other types) the rows are sorted by id and text hash over
    sampled ranges, numbered, and written once: the number of a row is then
    fixed for every later pass.  Null ids come first."""
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    integral = dict(base.dtypes)["_id"] in ("tinyint", "smallint", "int", "bigint")
    if integral:
        odd = base.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or _id is null")
        if odd.isEmpty():
            return base.select(F.col("_id").cast("long").alias("_k"), "_id", "_text")
    keyed = (base.withColumn("_h", F.xxhash64("_text"))
             .repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h")
             .select(F.monotonically_increasing_id().alias("_k"), "_id", "_text"))
    return scratch.cut(keyed, "keyed")


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it (case does not count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_key(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells its rows apart, ordered
    like the id: the id itself where it is unique, else an added number of
    the rows sorted by id and text hash, written once."""
    n, key = unused("n", docs.columns), unused("_row", docs.columns)
    odd = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias(n)).where(F.col(id_col).isNull() | (F.col(n) > 1))
    if odd.isEmpty():
        return docs, id_col
    hashed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    numbered = hashed.repartitionByRange(id_col, key).sortWithinPartitions(id_col, key).withColumn(
        key, F.monotonically_increasing_id())
    return scratch.cut(numbered, "numbered"), key


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): (node, comp) for
    every node of an edge, ``comp`` the smallest node of its component.

    Alternates two star steps: every node hangs its larger neighbours on its
    smallest neighbour, then its smaller ones.  The forest becomes stars of
    the smallest node in a number of rounds that grows with the logarithm of
    the component size.  Each round is one aggregate and one join; both read
    written tables, so adaptive execution can split a hub's edges."""
    def norm(df: DataFrame) -> DataFrame:
        return (df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    cur = scratch.cut(norm(edges), "cc")
    for _ in range(max_rounds):
        # Large star: for every node u with smallest closed neighbour m, hang the larger neighbours on m.
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.cut(both.groupBy("a").agg(F.min("b").alias("m"))
                          .select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "cc-min")
        large = (both.join(low, both.a == low.u).where(both.b > both.a)
                 .select(both.b.alias("a"), low.m.alias("b")))
        step = scratch.cut(norm(large), "cc")
        # Small star: node a hangs itself and its other smaller neighbours on the smallest of them.
        small = scratch.cut(step.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "cc-min")
        nxt = norm(step.join(small, step.a == small.u).select(step.b.alias("a"), small.m.alias("b"))
                   .unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        nxt = scratch.cut(nxt, "cc")
        # Stars: every node has one smaller neighbour, which has none itself.
        several = nxt.groupBy("a").count().where("count > 1").select("a")
        deep = nxt.join(nxt.select(F.col("a").alias("x")).distinct(), F.col("b") == F.col("x"), "left_semi").select("a")
        done = several.unionByName(deep).isEmpty()
        scratch.drop(low, step, small, cur)
        cur = nxt
        if done:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
