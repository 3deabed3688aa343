"""Incremental processing as a stream: new raw files are cleaned and merged batch by batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from yakamoz.operators.tables import read_table, skip_known, upsert
from yakamoz.plans.pipeline import processed_rows
from yakamoz.runtime import exists


def stream_posts(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, run_at: datetime) -> StreamingQuery:
    """Read raw posts from a folder until it is drained. Posts that come again are dropped by the merge, which knows all earlier ones
    and keeps no state, so a batch that runs again changes nothing and late posts aren't lost to a watermark. A batch reads the
    target's keys and rewrites only the buckets that its own posts fall into."""
    new = spark.readStream.schema(schema).parquet(source)

    def merge(batch: DataFrame, _: int) -> None:
        x = processed_rows(batch, run_at)
        if exists(spark, target):
            x = skip_known(x, read_table(spark, target), "post_id")
        upsert(spark, x, target, ["post_id"], ["created_at"])

    return new.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by window and key; on a stream with a watermark for late ones."""
    x = events.withWatermark(time, late) if events.isStreaming else events
    g = x.groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), by, "n")
