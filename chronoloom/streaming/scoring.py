"""Streams of events as windows of series, scored against a fixed gallery.

An addition for continuous use: event-time windows are collected under a watermark, their statistics are
aggregates, and each finished window is compared with a gallery in a stream-static plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import knn
from ..schema import RetrieverConfig

#: Features of a window, in the order of its vector.
WINDOW_FEATURES = ("mean", "std", "min", "max", "count")


def window_vectors(events: DataFrame, *, ts: str = "ts", key: str = "user_id", value: str = "value", size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(query_id, sample_id, start, vector) of each key and tumbling window. Works on streams and tables; timestamps
    without a zone are read in the session's zone, as watermarks need."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    v = F.col(value).cast("double")
    agg = rows.groupBy(F.window("__ts", size).alias("w"), F.col(key).cast("string").alias("k")).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).cast("double").alias("count")
    )
    return agg.select(
        F.concat("k", F.lit("@"), F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss")).alias("query_id"), F.col("k").alias("sample_id"), F.col("w.start").alias("start"), F.array(*WINDOW_FEATURES).alias("vector")
    )


def score_stream(events: DataFrame, gallery: DataFrame, config: RetrieverConfig, path: str, checkpoint: str, **windows):
    """A streaming query that appends the neighbours of finished windows to ``path``, each batch in its own folder, so that
    a batch that runs again replaces its rows."""

    def batch(df: DataFrame, number: int) -> None:
        knn(df, gallery, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = window_vectors(events, **windows).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).foreachBatch(batch).start()
