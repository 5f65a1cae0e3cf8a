"""Event-time windows over Parquet folders, run to the end of what is there (``availableNow``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import truncated


def event_stream(spark: SparkSession, folder: str, name: str, time: str = "ts") -> DataFrame:
    """A stream of the Parquet files ``name`` in ``folder``, with the event time as a zoned timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(stream: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and keys; rows later than ``late`` are left out."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    windows = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key)
    return windows.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def monthly_series(stream: DataFrame, time: str, value: str) -> DataFrame:
    """The dashboard's series, kept up to date."""
    return stream.groupBy(truncated("month", F.col(time)).alias("period")).agg(F.sum(value).alias("value"))


def run_to_end(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run until all present input is processed; the result as a table of the session."""
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.table(name)
