"""Structured Streaming ingestion of gauge rows: an extension, not part of the batch feature set.

Late rows are bounded by a watermark; hourly means are emitted once their window closes, so the
batch operators can run on the sink table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.io import HOURLY


def read_gauges(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """CSV rows (port, datetime_ist, height_m) as they arrive in a folder; event time with a zone, as watermarks need."""
    schema = HOURLY.replace("TIMESTAMP_NTZ", "TIMESTAMP_LTZ")
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(path)


def hourly_means(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    hour = F.window("datetime_ist", "1 hour")
    return stream.withWatermark("datetime_ist", late).groupBy("port", hour.alias("w")).agg(F.avg("height_m").alias("height_m")).select("port", F.col("w.start").cast("timestamp_ntz").alias("datetime_ist"), "height_m")


def write_hourly(hourly: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    out = hourly.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="1 minute")).start()
