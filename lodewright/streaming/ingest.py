"""Incremental ingestion: new annotation files become regions and chunks, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import Ingest
from ..operators import regions as R

PAGES = "key string, width int, height int, payload string"


def pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, settings: Ingest = Ingest()):  # noqa: B008
    """Parse what has arrived since the last run and append its regions; returns the finished query."""
    query = (
        R.parse(pages(spark, path), settings)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by tumbling window and type, closed by a watermark (an extension beside the batch operators)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
