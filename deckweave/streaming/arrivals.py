"""New artifacts as a stream: what arrived since the last run is worked on once, and then the run ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1000) -> DataFrame:
    """JSON files that land in a folder, as a stream with the path each row came from."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    return reader.json(folder).withColumn("source_path", F.input_file_name())


def run_once(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, state: str) -> StreamingQuery:
    """Puts all that is new through ``work`` and appends it to a parquet table; files already seen are in ``state``.

    A batch is written to a folder of its own number, so one that is run again after a failure replaces itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()


def late_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key in windows of event time; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).count().select(F.col("window.start").alias("start"), key, "count")
