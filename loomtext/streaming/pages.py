"""The page operators on streams, and counter series of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.article import extract_articles

PAGE = "page_id long, url string, html string"


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def article_stream(pages: DataFrame, **options) -> DataFrame:
    """Articles as pages arrive: stateless, each page by itself."""
    return extract_articles(pages, **options)


def counter_series(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type, start, n, value: tumbling counts; on a stream a window closes
    once the watermark has passed it. State is one row for each type and open window."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy("event_type", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("event_type", F.col("w.start").alias("start"), "n", "value")
