"""The gallery: building, filtering, summaries, vectors and persistence."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import ordered_vector
from ..schema import GALLERY

VIEWS = ("statistic_view", "ts_view", "summary_view")


def build_gallery(series: DataFrame, *, task_type: str = "classification", dataset: str | None = None) -> DataFrame:
    """An entry for each row of a series table with a ``statistic_view``: entry_id ``<sample_id>__ch<channel>``."""
    has = set(series.columns)
    view = lambda name, kind: F.col(name) if name in has else F.lit(None).cast(kind)
    entries = series.select(
        F.concat("sample_id", F.lit("__ch"), F.col("channel_id").cast("string")).alias("entry_id"),
        "sample_id",
        "channel_id",
        F.lit(task_type).alias("task_type"),
        F.col("label").cast("string").alias("label"),
        view("statistic_view", "map<string,double>").alias("statistic_view"),
        (F.col("ts_view") if "ts_view" in has else F.lit(None).cast("array<double>")).alias("ts_view"),
        view("summary_view", "string").alias("summary_view"),
        F.map_from_arrays(F.array(F.lit("dataset"), F.lit("split")), F.array(F.lit(dataset or ""), F.coalesce("split", F.lit("")))).alias("metadata"),
        F.col("sample_index").cast("long").alias("ord"),
    )
    none = F.coalesce(*[F.col(v).isNotNull() for v in VIEWS[:1]], F.lit(False)) | F.col("ts_view").isNotNull() | F.col("summary_view").isNotNull()
    return entries.withColumn("entry_id", F.when(none, F.col("entry_id")).otherwise(F.raise_error(F.concat(F.lit("an entry has no view: "), F.col("entry_id"))).cast("string")))


def check_unique(gallery: DataFrame) -> DataFrame:
    """The gallery; a repeated entry_id is an error."""
    twice = gallery.groupBy("entry_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated entries: {[r.entry_id for r in twice]}")
    return gallery


def filter_gallery(
    gallery: DataFrame,
    *,
    task_type: str | None = None,
    label: str | None = None,
    channel_id: int | None = None,
    channel_ids: list[int] | None = None,
    exclude_sample_id: str | None = None,
    exclude_sample_ids: list[str] | None = None,
    has_view: str | None = None,
) -> DataFrame:
    """Entries that meet all given conditions; the conditions reach the scan."""
    if has_view is not None and has_view not in VIEWS:
        raise ValueError(f"unknown view {has_view!r}")
    out = gallery
    if task_type is not None:
        out = out.where(F.col("task_type") == str(task_type))
    if label is not None:
        out = out.where(F.col("label") == str(label))
    if channel_id is not None:
        out = out.where(F.col("channel_id") == channel_id)
    if channel_ids is not None:
        out = out.where(F.col("channel_id").isin(list(channel_ids)))
    if exclude_sample_id is not None:
        out = out.where(F.col("sample_id") != exclude_sample_id)
    if exclude_sample_ids:
        out = out.where(~F.col("sample_id").isin(list(exclude_sample_ids)))
    return out.where(F.col(has_view).isNotNull()) if has_view else out


def get_entry(gallery: DataFrame, entry_id: str):
    """The entry; KeyError if there is none."""
    if (row := gallery.where(F.col("entry_id") == entry_id).first()) is None:
        raise KeyError(entry_id)
    return row


def entries_of_sample(gallery: DataFrame, sample_id: str) -> DataFrame:
    return gallery.where(F.col("sample_id") == sample_id)


def summarize(gallery: DataFrame) -> DataFrame:
    """(kind, key, n): entries, distinct samples and channels, entries by task, by channel and with each view."""
    whole = gallery.agg(
        F.count("*").alias("entries"), F.countDistinct("sample_id").alias("samples"), F.countDistinct("channel_id").alias("channels"), *[F.count(v).alias(v) for v in VIEWS]
    )
    rows = F.array(
        *[F.struct(F.lit("total").alias("kind"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in ("entries", "samples", "channels")],
        *[F.struct(F.lit("view").alias("kind"), F.lit(v).alias("key"), F.col(v).alias("n")) for v in VIEWS],
    )
    out = whole.select(F.inline(rows))
    for kind, col in (("task_type", "task_type"), ("channel", "channel_id")):
        out = out.unionByName(gallery.groupBy(F.col(col).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n"))
    return out


def group_entries(gallery: DataFrame, by: str) -> DataFrame:
    """(key, entry_ids in the order of insertion) by ``sample_id`` or ``channel_id``."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "entry_id")))
    return gallery.groupBy(by).agg(F.transform(ordered, lambda e: e["entry_id"]).alias("entry_ids"))


def feature_order(gallery: DataFrame) -> list[str]:
    """The sorted feature names of the first entry that has statistics."""
    first = gallery.where("statistic_view is not null").orderBy("ord", "entry_id").select(F.array_sort(F.map_keys("statistic_view"))).first()
    if first is None:
        raise ValueError("no entry has a statistic view")
    return list(first[0])


def gallery_vectors(gallery: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Entries with statistics and their ``vector`` in the order of the names; a missing name is an error."""
    order = order or feature_order(gallery)
    return gallery.where("statistic_view is not null").withColumn("vector", ordered_vector("statistic_view", order)), order


def save_gallery(gallery: DataFrame, path: str) -> None:
    gallery.select(*[f.name for f in GALLERY.fields]).write.mode("overwrite").parquet(path)


def load_gallery(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GALLERY).parquet(path)


def save_gallery_json(gallery: DataFrame, path: str) -> None:
    gallery.select(*[f.name for f in GALLERY.fields]).write.mode("overwrite").json(path)


def load_gallery_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GALLERY).json(path)


def save_index(gallery: DataFrame, path: str) -> dict:
    """The vectors as a table and what describes them beside it; returns that."""
    vectors, order = gallery_vectors(gallery)
    seen = Observation()  # the writing job counts
    vectors = vectors.select("entry_id", "sample_id", "label", "channel_id", "ord", "vector").observe(seen, F.count(F.lit(1)).alias("n"))
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    meta = {"feature_order": order, "dim": len(order), "num_entries": seen.get["n"]}
    _put(gallery.sparkSession, f"{path}/meta", meta)
    return meta


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/vectors"), json.loads(spark.read.text(f"{path}/meta", wholetext=True).first()[0])


def _put(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)
