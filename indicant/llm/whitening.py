"""Embedding whitening with distributed block matrices.

Entries become whole numbers floor(scale * c).  The fit list holds each distinct vector once;
its centred rows are indexed into the blocks of a BlockMatrix B, the transpose of B times B is
the scatter, and the eigenvectors of that small matrix are found locally.  All rows, centred
too, are a second BlockMatrix, which times the whitening matrix projects them.

The mean is kept as exact sums: a centred entry is (n * x - S) / n with a whole numerator.
What comes to the driver is a number for each partition, a sum for each dimension, the place of each
block and the scatter, whose size is that of the dimension squared.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, prepare, shared_dir, stored

#: Rows and columns of a block; pairs of blocks that one task of the scatter multiplies.
BLOCK_ROWS, BLOCK_COLUMNS, BLOCKS_A_TASK = 4096, 1024, 8
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53
#: Row numbers of a partition, in monotonically_increasing_id().
POSITION = (1 << 33) - 1


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every entry as long; an entry too large for an exact one raises."""
    huge = F.raise_error(F.lit("an entry of a vector is too large for exact arithmetic")).cast("long")
    one = lambda c: F.when(F.abs(c) < EXACT, F.floor(c)).otherwise(huge)
    return F.transform(vector, lambda c: one(c.cast("double") * F.lit(float(scale))))


def is_finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def numbered(rows: DataFrame, where: str, name: str) -> DataFrame:
    """rows, stored, with consecutive numbers ``index`` from 0: its place in its partition after all earlier partitions.

    Only a count for each partition comes to the driver.
    """
    placed = rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(POSITION)).alias("place"))
    kept = stored(placed, where, name)
    before, starts = 0, []
    for r in kept.groupBy("part").count().orderBy("part").collect():
        starts.append((r.part, before))
        before += r["count"]
    known = rows.sparkSession.createDataFrame(starts, "part int, start long")
    return kept.join(F.broadcast(known), "part").withColumn("index", F.col("start") + F.col("place")).drop("part", "start", "place")


class Fit:
    """The exact sums of a fit list."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def numerators(self, x: Column) -> Column:
        """n * x - S by dimension, exact."""
        sums = F.array(*[F.lit(s).cast("long") for s in self.sums])
        return F.transform(x, lambda v, i: v * F.lit(self.n).cast("long") - F.get(sums, i))

    def deviation(self, x: Column) -> Column:
        """The sum of squared numerators, exact: as decimals, and a long at the end."""
        zero = F.lit(0).cast("decimal(38,0)")
        square = lambda v: (v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)")
        return F.aggregate(self.numerators(x), zero, lambda total, v: (total + square(v)).cast("decimal(38,0)")).cast("long")

    def centred(self, x: Column) -> Column:
        return F.transform(self.numerators(x), lambda v: v.cast("double") / F.lit(float(self.n)))


def block_matrix(rows: DataFrame, vector: Column, n: int, dimension: int) -> BlockMatrix:
    """Rows with an ``index`` as blocks; vector is an array of doubles."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(vector).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, dimension).toBlockMatrix(BLOCK_ROWS, min(dimension, BLOCK_COLUMNS))


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix.  The long side is split, so that a task multiplies few pairs of blocks."""
    splits = -(-matrix.numRowBlocks // BLOCKS_A_TASK)
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue, those of no variance left out.

    Of the two directions the one whose largest entry is positive.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    some = values > max(values[0], 0) * len(covariance) * np.finfo(float).eps if len(values) else values > 0
    values, vectors = values[some], vectors[:, some]
    if values.size:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors


def projected(matrix: BlockMatrix, whitening: np.ndarray, spark: SparkSession) -> DataFrame:
    """(index, y): the rows of matrix times whitening."""
    frame = spark.createDataFrame([(k, Vectors.dense(row)) for k, row in enumerate(whitening)], ["index", "vector"])
    factor = IndexedRowMatrix(frame, *whitening.shape).toBlockMatrix(matrix.colsPerBlock, whitening.shape[1])
    product = matrix.multiply(factor).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("y"))


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of y, which is centred again, minus the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = whitened.agg(*[F.covar_pop(F.get("y", i), F.get("y", j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row and each of its first components.

    Rows whose vector is null or holds null or non-finite entries take no part.  Repeated rows
    and null ids give rows as they come; equal vectors count once in the fit.  Directions
    without variance are no components: one distinct vector, vectors without entries and an
    empty table give no rows.  Vectors of several lengths, and entries beyond 2**53 / scale,
    raise.  Other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    where = shared_dir(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    empty = spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    chosen = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v")).filter(is_finite(F.col("v")))
    rows = numbered(chosen.select("id", quantised(F.col("v"), scale).alias("x")), where, "rows")
    size = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if not size.n or not size.most:
        drop_stored(spark, where)
        return empty
    if size.least != size.most:
        drop_stored(spark, where)
        raise ValueError(f"vectors have from {size.least} to {size.most} entries")
    distinct = numbered(rows.groupBy("x").agg(F.count("*").alias("copies")).select("x"), where, "fit")
    total = distinct.agg(F.count("*").alias("n"), *[F.sum(F.get("x", i)).alias(f"s{i}") for i in range(size.most)]).first()
    fit = Fit(total.n, [total[f"s{i}"] for i in range(size.most)])
    centred = fit.centred(F.col("x"))

    around = block_matrix(distinct, centred, fit.n, size.most)
    covariance = scatter(around) / fit.n
    values, directions = principal(covariance, components)
    k = len(values)
    if not k:
        drop_stored(spark, where)
        return empty
    whitening = directions / np.sqrt(values)
    error = identity_error(projected(around, whitening, spark), k)
    found = stored(projected(block_matrix(rows, centred, size.n, size.most), whitening, spark), where, "projected")

    parts = [F.struct(F.lit(j + 1).alias("component"), F.get("y", j).alias("whitened"), F.lit(float(values[j] / np.trace(covariance))).alias("explained")) for j in range(k)]
    each = rows.join(found, "index").select("id", fit.deviation(F.col("x")).alias("deviation"), F.explode(F.array(*parts)).alias("c"))
    result = each.select(F.col("id").alias(id_col), "c.component", F.lit(fit.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))
    kept = stored(result, f"{where}-result", "whitened")
    drop_stored(spark, where)  # only the result stays, for the cluster's cleaner
    return kept
