"""Gates: rows that stop a job instead of passing on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def refused(rows: DataFrame, bad: Column, why: Column | str) -> DataFrame:
    """rows as they are; the job that reads them fails with `why` at the first row for which `bad` holds. A null doesn't hold.

    The check runs where the rows are, in the job that uses them; nothing is counted or collected for it.
    """
    told = why if isinstance(why, Column) else F.lit(why)
    return rows.where(F.when(bad, F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))
