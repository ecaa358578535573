"""The duplicate gate as a stream: arriving fingerprints against those already known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.audit import hamming_pairs


def fresh(arriving: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A stream without rows whose sha has come before within the delay."""
    return arriving.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha"])


def gate(arriving: DataFrame, known: DataFrame, out: str, checkpoint: str, distance: int = 5) -> StreamingQuery:
    """Writes each batch's near duplicates of known files to out, as left_file, right_file and hamming."""

    def check(batch: DataFrame, number: int) -> None:
        hamming_pairs(batch, known, distance=distance).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
