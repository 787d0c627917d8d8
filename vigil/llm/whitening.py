"""Embedding whitening with Spark MLlib's distributed block matrices.

Vectors become whole numbers x = floor(64 c) + 1,000,000 and are numbered and
written once.  Their sums are exact, so (n x - S) / n is a centred entry with
one rounding.  The centred rows, indexed 0..n-1, are dealt into the blocks of a
``BlockMatrix`` A; the scatter matrix is A' A, its eigenvectors over the square
roots of the eigenvalues are the whitening matrix W, and A W projects the rows.

A block product brings all blocks of a result together: A' A is one block, and
A W has about sqrt(partitions) of them.  So the rows are cut into slabs of a
fixed number of blocks, and within a slab the inner dimension of A' A is split
over tasks.  A slab is a matrix of its own; scatter matrices of slabs add up
(one small matrix each), projected rows are a union.  No task holds more than
``BLOCKS_A_TASK`` blocks of a slab, whatever the number of rows.

* Vectors that are null or hold a null or non-finite entry are left out, and so
  are vectors whose length is not the one of most (of ties, the longer): they
  have no place in the matrix.
* Rows with equal or null ids are separate rows.  Equal eigenvalues share a
  plane; any orthonormal basis of it serves.
* Directions without variance (eigenvalue within rounding of 0, as with one
  vector, or fewer vectors than dimensions) have no component.  No remaining
  row or no variance at all: an empty result.
* Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Scratch
from vigil.llm.sharding import number_rows

SCALE, SHIFT = 64, 1_000_000
#: Rows and columns of a block, blocks a task, tasks a slab: a slab of 64 dimensions has 4 million rows and 2 GB.
BLOCK_ROWS, BLOCK_COLS, BLOCKS_A_TASK, TASKS_A_SLAB = 4_096, 1_024, 32, 32


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(``_id``, ``_x`` array<long>) of the vectors whose entries are all finite."""
    base = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return base.where(F.col("_v").isNotNull() & finite).select(
        "_id", F.transform("_v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long")).alias("_x"))


def per_entry(table: DataFrame, col: str, agg) -> list:
    """An aggregate of each entry of an array column, in order: as many values as dimensions."""
    exploded = table.select(F.posexplode(col).alias("pos", "x"))
    return [r[1] for r in sorted(exploded.groupBy("pos").agg(agg("x").alias("s")).collect())]


def lits(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


class Slabs:
    """Numbered rows with an array of doubles, as one block matrix a slab."""

    def __init__(self, table: DataFrame, n: int, dims: int):
        self.table, self.dims = table, dims
        self.rows = BLOCK_ROWS * BLOCKS_A_TASK * TASKS_A_SLAB
        self.sizes = [min(self.rows, n - at) for at in range(0, n, self.rows)]

    def matrix(self, k: int) -> BlockMatrix:
        """Slab ``k``.  A product of it has about the square root of its
        partitions, so many for TASKS_A_SLAB tasks if it is a full one."""
        inside = self.table.where(F.col("_slab") == k)
        blocks = -(-self.sizes[k] // BLOCK_ROWS)
        tasks = -(-blocks // BLOCKS_A_TASK)
        rows = inside.select((F.col("_row") - k * self.rows).alias("index"), array_to_vector("_c").alias("vector"))
        dealt = MLUtils.convertVectorColumnsFromML(rows, "vector").repartition(max(4, tasks * tasks))
        indexed = IndexedRowMatrix(dealt, self.sizes[k], self.dims)
        return indexed.toBlockMatrix(BLOCK_ROWS, min(self.dims, BLOCK_COLS))

    def scatter(self) -> np.ndarray:
        """A' A, summed over the slabs."""
        total = np.zeros((self.dims, self.dims))
        for k, size in enumerate(self.sizes):
            a = self.matrix(k)
            splits = max(1, -(-size // (BLOCK_ROWS * BLOCKS_A_TASK)))
            product = _times(a.transpose(), a, splits)
            total += product.toLocalMatrix().toArray()
        return (total + total.T) / 2

    def times(self, right: np.ndarray) -> DataFrame:
        """(``_row``, ``_y`` array<double>): the rows times a local matrix."""
        spark = self.table.sparkSession
        step = min(self.dims, BLOCK_COLS)
        parts = [((i, 0), _dense(right[at:at + step])) for i, at in enumerate(range(0, self.dims, step))]
        local = BlockMatrix(spark.sparkContext.parallelize(parts, 1), step, right.shape[1], *right.shape)
        out = []
        for k in range(len(self.sizes)):
            start = k * self.rows
            rows = _times(self.matrix(k), local, 1).blocks.flatMap(lambda b, start=start: _rows(b, start))
            out.append(spark.createDataFrame(rows, "_row long, _y array<double>", verifySchema=False))
        return reduce(DataFrame.unionAll, out)


def _dense(m: np.ndarray):
    return Matrices.dense(*m.shape, m.ravel(order="F"))


def _rows(block, start: int):
    (i, _), m = block
    return [(start + i * BLOCK_ROWS + r, y) for r, y in enumerate(m.toArray().tolist())]


def _times(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a b with the inner dimension split over tasks (an argument of MLlib's
    ``multiply`` that its Python method does not pass on)."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def whitening_matrix(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance, falling, and unit eigenvectors over their
    roots, as columns; the largest entry of a vector is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    sure = int((e > max(np.trace(v), 0.0) * len(e) * np.finfo(float).eps).sum())
    e, u = e[:min(components, sure)], u[:, :min(components, sure)]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]) if u.size else u
    return e, u / np.sqrt(e)


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per remaining vector and component: id, ``component``, ``n``,
    ``deviation`` (sum of (n x - S)^2, an exact decimal), ``whitened``,
    ``explained`` and ``identity_error``."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "whiten")
    schema = (f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, n long, "
              "deviation decimal(38,0), whitened double, explained double, identity_error double")
    whole = whole_numbers(vectors, id_col, vec_col)
    dims = whole.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None or dims.d == 0:
        return spark.createDataFrame([], schema)
    numbered, n = number_rows(whole.where(F.size("_x") == dims.d), [], scratch)
    sums = per_entry(numbered, "_x", F.sum)
    slab = F.floor(F.col("_row") / (BLOCK_ROWS * BLOCKS_A_TASK * TASKS_A_SLAB)).cast("int")
    apart = F.zip_with("_x", lits(sums, "long"), lambda x, s: F.lit(n).cast("long") * x - s)
    kind = "decimal(38,0)"
    squares = F.aggregate("_d", F.lit(0).cast(kind), lambda acc, d: (
        acc + (d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast(kind)).cast(kind))
    table = scratch.cut(numbered.select("_id", "_row", slab.alias("_slab"), apart.alias("_d")).select(
        "_id", "_row", "_slab", squares.alias("_deviation"), F.transform("_d", lambda d: d / F.lit(float(n))).alias("_c")),
        "centred", "_slab")

    v = Slabs(table, n, dims.d).scatter() / n
    e, w = whitening_matrix(v, components)
    if not len(e):
        return spark.createDataFrame([], schema)
    made = scratch.cut(Slabs(table, n, dims.d).times(w).withColumn("_slab", slab), "whitened", "_slab")
    means = lits(per_entry(made, "_y", F.avg), "double")
    centred = made.select("_row", "_slab", F.zip_with("_y", means, lambda y, m: y - m).alias("_c"))
    error = float(np.abs(Slabs(centred, n, len(e)).scatter() / n - np.eye(len(e))).max())

    both = table.select("_id", "_row", "_deviation").join(made, "_row")
    flat = both.select("_id", "_deviation", F.posexplode("_y").alias("_k", "whitened"))
    return flat.select(F.col("_id").alias(id_col), (F.col("_k") + 1).cast("int").alias("component"),
                       F.lit(n).cast("long").alias("n"), F.col("_deviation").alias("deviation"), "whitened",
                       F.element_at(lits((e / np.trace(v)).tolist(), "double"), F.col("_k") + 1).alias("explained"),
                       F.lit(error).alias("identity_error"))
