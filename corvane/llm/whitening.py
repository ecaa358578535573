"""Whitening of embeddings: MLlib's distributed blocks give the scatter matrix and the projections."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.storage import durable

#: Rows of a block, and products of one partial sum of the scatter matrix.
BLOCK_ROWS, BLOCKS_A_SUM = 1024, 16
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Components of less variance than this share of the greatest can't be told from rounding.
LEAST_SHARE = 1e-12


def usable(vector: Column) -> Column:
    """Whether the vector has entries, all of them finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")) + SHIFT)


def _multiplied(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a times b, with the sum over inner blocks split into so many partial ones: else one task would hold them all."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def components_of(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, falling, and their unit eigenvectors as columns; fewer where variance ends."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:k]
    order = order[values[order] > LEAST_SHARE * max(values.max(), 0.0)] if values.max() > 0 else order[:0]
    return values[order], vectors[:, order]


def whiten(rows: DataFrame, vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """rows, one for each component, with component (int, from 1), n, deviation (long), whitened, explained, identity_error (double).

    Rows whose vector is null, empty or holds a null or a number that is not finite take no part, nor do vectors
    of another length than most have (the longer among equally many). The fit list is all others, repeated rows
    too. Vectors become integers x; deviation is the sum of (n * x - S)^2 over dimensions and exact, an error
    where a long can't hold it. Components are those of the covariance of x, of falling variance, with either
    sign; there are fewer than asked for where vectors have fewer dimensions or no more variance, and no row at
    all for an empty table or equal vectors. Columns of rows that bear one of the new names are replaced.

    Rows are numbered and kept in the shared folder; blocks of 1024 centred rows give the scatter matrix by
    partial products that many tasks sum up, and, times the whitening matrix, the projections. The driver holds
    matrices of dimensions x dimensions.
    """
    new = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    spark, row = rows.sparkSession, F.struct(*(rows[c] for c in rows.columns if c.lower() not in new))
    found = rows.where(usable(F.col(vector_col))).select(row.alias("row"), integers(F.col(vector_col)).alias("x"))
    sizes = found.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    schema = T.StructType([f for f in rows.schema.fields if f.name.lower() not in new] + [T.StructField(k, t) for k, t in zip(new, (T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()), strict=True)])
    if not sizes:
        return spark.createDataFrame([], schema)
    d = sizes[0].d
    kept = durable(found.where(F.size("x") == d).select("row", "x", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    begins = kept.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("begin"))
    indexed = kept.join(begins, "part").select("row", "x", (F.col("begin") + F.col("place")).alias("i"))

    sums = kept.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()
    n, s = sums[0].n, [r.s for r in sums]
    centred = F.zip_with("x", F.lit([v / n for v in s]), lambda x, m: x - m)
    deviation = F.aggregate(F.zip_with("x", F.lit(s).cast("array<long>"), lambda x, v: n * x - v), F.lit(0).cast("long"), lambda a, v: a + v * v)

    vectors = MLUtils.convertVectorColumnsFromML(indexed.select(F.col("i").alias("index"), array_to_vector(centred).alias("vector")), "vector")
    blocks = IndexedRowMatrix(vectors, n, d).toBlockMatrix(BLOCK_ROWS, d)
    splits = max(1, -(-n // (BLOCK_ROWS * BLOCKS_A_SUM)))
    scatter = _multiplied(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / (2 * n)
    values, axes = components_of(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    matrix = axes / np.sqrt(values)
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(d, len(values), matrix.T.ravel()))], 1), d, len(values), d, len(values))
    projected = _multiplied(blocks, whitening, 1).toIndexedRowMatrix()
    scores = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    scores = durable(scores.select(F.col("index").alias("_index"), vector_to_array("vector").alias("_w")))

    pairs = [(a, b) for a in range(len(values)) for b in range(a, len(values))]
    got = scores.agg(*(F.covar_pop(F.get("_w", a), F.get("_w", b)).alias(f"c{a}_{b}") for a, b in pairs)).collect()[0]
    error = max(abs(got[f"c{a}_{b}"] - (a == b)) for a, b in pairs)

    met = indexed.select("row", "i", deviation.alias("deviation")).join(scores, F.col("i") == F.col("_index"))
    explained = F.lit([float(v) for v in values / np.trace(covariance)])
    each = met.select("row", "deviation", F.posexplode("_w").alias("at", "whitened"))
    return each.select("row.*", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
