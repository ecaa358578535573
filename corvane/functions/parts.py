"""How finely rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

#: Partitions of a fine shuffle for each one of an ordinary shuffle.
FINER = 8


def finely(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """rows shuffled by the keys to FINER times as many partitions as other shuffles have, so that a task holds fewer.

    Adaptive execution leaves this number as it is. It merges partitions by their shuffled bytes, which says
    little where few of them become many rows, sorted or hashed, in the task.
    """
    return rows.repartition(FINER * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
