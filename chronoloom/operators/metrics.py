"""Scores of retrieval: by query, by channel and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import positive


def query_metrics(truth: DataFrame, neighbours: DataFrame, k: int, *, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``by``, top_k_accuracy (1 if the true label is among the first k) and precision_at_k (matches over k, even if
    fewer were found). ``truth``: ``by`` and label; a query without neighbours scores 0."""
    positive(k, "k")
    keys = list(by)
    found = neighbours.where(F.col("rank") <= k).select(*keys, F.col("label").cast("string").alias("__found"))
    joined = truth.select(*keys, F.col("label").cast("string").alias("__true")).join(found, keys, "left")
    match = F.coalesce((F.col("__found") == F.col("__true")).cast("int"), F.lit(0))
    return joined.groupBy(*keys).agg(F.max(match).cast("double").alias("top_k_accuracy"), (F.sum(match) / k).alias("precision_at_k"))


def batch_metrics(per_query: DataFrame) -> DataFrame:
    """One row: the means over queries, null without any, and num_query."""
    return per_query.agg(F.avg("top_k_accuracy").alias("top_k_accuracy"), F.avg("precision_at_k").alias("precision_at_k"), F.count("*").alias("num_query"))


def macro_metrics(per_channel: DataFrame) -> DataFrame:
    """By query, the unweighted means over channels. ``per_channel``: query_id, channel_id and both scores."""
    return per_channel.groupBy("query_id").agg(F.avg("top_k_accuracy").alias("top_k_accuracy"), F.avg("precision_at_k").alias("precision_at_k"), F.count("*").alias("num_channels"))


def zscores(rows: DataFrame, names: dict[str, str], tiny: float = 1e-12) -> DataFrame:
    """The rows with (x - mean) / sample deviation of columns, under the names they are mapped to; 0 where the deviation is
    at most ``tiny`` or there is one row. The statistics of all columns are one row, made in one pass and sent to all."""
    own = {c: (f"__mean_{i}", f"__sd_{i}") for i, c in enumerate(names)}
    stats = rows.agg(*(x for c, (m, s) in own.items() for x in (F.avg(c).alias(m), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(s))))
    z = {names[c]: F.when(F.col(s) <= tiny, F.lit(0.0)).otherwise((F.col(c) - F.col(m)) / F.nullif(F.col(s), F.lit(0.0))) for c, (m, s) in own.items()}
    return rows.crossJoin(F.broadcast(stats)).withColumns(z).drop(*(x for pair in own.values() for x in pair))
