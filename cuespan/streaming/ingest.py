"""Structured Streaming ingest (an extension: the source system has no streams).

Files that arrive are appended once for each video, and sliding windows can be counted
with a watermark. Both run to the end of what is there and stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import new_keys


def stream_rows(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def ingest_once(rows: DataFrame, path: str, checkpoint: str, key: str = "video_id") -> StreamingQuery:
    """Append the rows of videos that the table at ``path`` does not have. A batch that is
    replayed after a failure finds its own rows and adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.schema(batch.schema).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = spark.createDataFrame([], batch.schema)
        new_keys(batch, stored, key).write.mode("append").partitionBy(key).parquet(path)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliding_counts(rows: DataFrame, time: str = "ts", late: str = "2 minutes", window: str = "45 seconds", slide: str = "35 seconds") -> DataFrame:
    """Events in overlapping windows; windows that begin before the epoch are left out."""
    counted = rows.withWatermark(time, late).groupBy(F.window(time, window, slide)).agg(F.count("*").alias("n"))
    return counted.filter(F.col("window.start") >= F.lit("1970-01-01").cast("timestamp")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
