"""Structured Streaming over day files: a file source, exact de-duplication, and the batch pipeline per micro-batch.

The minute axis folds auctions and lunch and is closed on the right, so it is no tumbling window of the streaming engine;
minutes are the same Column as in batch. Late rows do not fix a minute in place: they add to it when the day is rebuilt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.functions.axis import minute_code_unchecked


def tick_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def deduplicated(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Rows whose keys were not seen within ``delay`` of event time; state older than that is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def minute_sums(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Volume and count per (trade_date, symbol, minute_code, hour window): emitted once the watermark has passed the hour."""
    coded = stream.withColumn("minute_code", minute_code_unchecked(F.col("time_ms"))).where("minute_code >= 0").withWatermark(event_time, delay)
    return coded.groupBy(F.window(event_time, "1 hour"), "trade_date", "symbol", "minute_code").agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"))


def append_days(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Appends partial minute sums of every micro-batch under its batch number, so that a repeated batch replaces itself.

    Runs over what is available and stops. Readers add the partial sums (``read_sums``); they are exact since every row is in
    exactly one batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        coded = batch.withColumn("minute_code", minute_code_unchecked(F.col("time_ms"))).where("minute_code >= 0")
        sums = coded.groupBy("trade_date", "symbol", "minute_code").agg(F.sum(F.col("volume").cast("long")).alias("volume"), F.count(F.lit(1)).alias("n"))
        sums.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_sums(spark: SparkSession, target: str) -> DataFrame:
    parts = spark.read.parquet(target)
    return parts.groupBy("trade_date", "symbol", "minute_code").agg(F.sum("volume").alias("volume"), F.sum("n").alias("n"))
