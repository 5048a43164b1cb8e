"""The same operators over streams: narrow normalisation, watermarked de-duplication and a rate window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pipeline
from ..operators.normalize import Normalization


def normalize_stream(stream: DataFrame, norm: Normalization, kind: str = "type", text: str = "text") -> DataFrame:
    """A stream with the column result; stateless."""
    return stream.withColumn("result", norm.column(F.col(kind), F.col(text)))


def write_stream(spark: SparkSession, utterances: DataFrame, norm: Normalization | None = None) -> DataFrame:
    """The utterance pipeline over a stream: all its steps are narrow, so it needs no state and no watermark."""
    return pipeline.write(spark, utterances, norm)


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def rate(stream: DataFrame, key: str, time: str, window: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and their sum of ``value`` per key and window."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, late).groupBy(key, w).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def replay(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now, into a table at path."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
