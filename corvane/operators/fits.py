"""Least squares by group: normal equations summed in parallel, many small systems solved by Cholesky."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.streams import streamed


def solved(gram: np.ndarray, moment: np.ndarray, ridge: float) -> np.ndarray | None:
    """(gram + ridge * trace / size * I)^-1 moment; None where that is not positive definite."""
    size = len(moment)
    try:
        low = np.linalg.cholesky(gram + ridge * np.trace(gram) / size * np.eye(size))
    except np.linalg.LinAlgError:
        return None
    return np.linalg.solve(low.T, np.linalg.solve(low, moment))


def ridge_fits(samples: DataFrame, by: Sequence[str], size: int, ridge: float = 1e-3, features: str = "features", target: str = "target") -> DataFrame:
    """Per group of samples (features, an array of `size` numbers, and target): n and coefficients, those of ridge regression without intercept.

    The ridge is relative: ridge times the mean of the Gram matrix's diagonal. Samples with nulls, numbers that
    are not finite, or another number of features don't count; a group without others has no row. Coefficients
    are null where the system can't be solved, as for features that are all 0. Null groups are groups.

    Each batch of samples adds up the outer products of its groups, so that only a matrix for each group and
    batch is shuffled; matrices of a group are streamed and summed. No group's samples ever meet.
    """
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    x, y = F.col(features), F.col(target).cast("double")
    good = samples.where(F.coalesce((F.size(x) == size) & F.forall(x, number) & number(y), F.lit(False))).select(*by, x.cast("array<double>").alias("_x"), y.alias("_y"))
    keys = [good.schema[k] for k in by]
    wide = T.ArrayType(T.DoubleType())
    parts_schema = T.StructType([*keys, T.StructField("_n", T.LongType()), T.StructField("_gram", wide), T.StructField("_moment", wide)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            places: dict = {}
            group = np.array([places.setdefault(k, len(places)) for k in zip(*(batch.column(c).to_pylist() for c in by), strict=True)])
            order = np.argsort(group, kind="stable")
            x, y, ends = x[order], y[order], np.cumsum(np.bincount(group))
            n, gram, moment = [], [], []
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                n.append(int(b - a))
                gram.append((x[a:b].T @ x[a:b]).ravel())
                moment.append(x[a:b].T @ y[a:b])
            columns = [pa.array(list(c), batch.column(k).type) for k, c in zip(by, zip(*places, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gram, pa.list_(pa.float64())), pa.array(moment, pa.list_(pa.float64()))], [*by, "_n", "_gram", "_moment"])

    k = len(by)

    def fitted(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, parts in groupby(rows, key=lambda r: r[:k]):
            n, gram, moment = 0, np.zeros(size * size), np.zeros(size)
            for *_, part, g, m in parts:
                n, gram, moment = n + part, gram + np.array(g), moment + np.array(m)
            found = solved(gram.reshape(size, size), moment, ridge)
            yield *key, n, None if found is None else found.tolist()

    schema = T.StructType([*keys, T.StructField("n", T.LongType()), T.StructField("coefficients", wide)])
    parts = good.mapInArrow(summed, parts_schema).repartition(*by).sortWithinPartitions(*by)
    return parts.mapInArrow(streamed(fitted, schema), schema)


def fit_scores(samples: DataFrame, fits: DataFrame, by: Sequence[str], features: str = "features", target: str = "target") -> DataFrame:
    """Per group dice of two sets: samples of positive target, and those whose fitted value is positive (above 1e-9); 0 where both are empty."""
    named = fits.select(*(F.col(k).alias(f"_{k}") for k in by), F.col("coefficients").alias("_c")).where("_c is not null")
    same = F.lit(True)
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    value = F.aggregate(F.zip_with(F.col(features), F.col("_c"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    met = samples.join(named, same).select(*by, (F.col(target) > 0).alias("_t"), (value > 1e-9).alias("_p"))
    both, either = F.count_if(F.col("_t") & F.col("_p")), F.count_if(F.col("_t")) + F.count_if(F.col("_p"))
    return met.groupBy(*by).agg(F.coalesce(2 * both / F.nullif(either, F.lit(0)), F.lit(0.0)).alias("dice"))
