"""Ranks and running sums over orders that no single task could sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.storage import durable


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums, their own row included, inside each group of `by`; a sum of F.lit(1) is the rank.

    Rows are dealt to as many ranges of (by, order) as there are shuffle partitions, and kept so. Each range is
    summed by itself and begins where the ranges before it end; the only window over a whole group runs over
    one row a range. The order must tell a group's rows apart, else ties are in any order. Null groups are groups.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(rows.withColumns(sums).repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("_range", *by).agg(*(F.sum(k).alias(f"_before_{k}") for k in sums))
    starts = whole.withColumns({f"_before_{k}": F.coalesce(F.sum(f"_before_{k}").over(before), F.lit(0)) for k in sums})
    starts = starts.withColumnsRenamed({"_range": "_start", **{k: f"_by_{k}" for k in by}})
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_range") == F.col("_start")
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    met = dealt.withColumns({k: F.sum(k).over(inside) for k in sums}).join(starts, same)
    return met.withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in sums}).drop("_range", "_start", *(f"_by_{k}" for k in by), *(f"_before_{k}" for k in sums))


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """rows numbered from 1 in this order, which must tell them apart."""
    return running_sums(rows, [], order, {name: F.lit(1).cast("long")})


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group of `by` exact quantiles of a column, between two values in proportion; a column for each name in shares.

    Nulls don't count, and a group without a value has no row. Equal values are counted first, so that a value
    goes through the shuffle once a task; distinct ones are ranked by ranges, and only those at the ranks that are
    asked for meet in one task.
    """
    one = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    counted = one.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = durable(running_sums(counted, by, ["_v"], {"_r": F.col("_c")}))
    sizes = ranked.groupBy(*by).agg(F.max("_r").alias("_n")).withColumnsRenamed({k: f"_by_{k}" for k in by})
    asked = F.array(*(F.struct(F.lit(k).alias("name"), ((F.col("_n") - 1) * F.lit(float(q))).alias("at")) for k, q in shares.items()))
    wanted = sizes.select(*(f"_by_{k}" for k in by), F.explode(asked).alias("_a")).select("*", "_a.*").select("*", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("_k"))
    same = (F.col("_k") < F.col("_r")) & (F.col("_k") >= F.col("_r") - F.col("_c"))
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    weight = F.when(F.floor("at") == F.ceil("at"), 1.0).otherwise(1 - F.abs(F.col("at") - F.col("_k")))
    found = ranked.join(wanted, same).groupBy(*by, "name").agg(F.sum(weight * F.col("_v")).alias("_q"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == k, F.col("_q"))).alias(k) for k in shares))
