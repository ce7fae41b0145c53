"""Univariate classification files: comma separated, the label first, a line for each series."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import numeric_label_map, remap_labels
from ..operators.series import cap_per_split
from .files import both_splits, splits_of
from .ordered import ordered_lines


@dataclass
class Dataset:
    """A loaded dataset: the series of both splits and, if labels were mapped, the map."""

    name: str
    series: DataFrame
    label_map: DataFrame | None = None

    def split(self, name: str) -> DataFrame:
        return self.series.where(F.col("split") == name)

    def as_dict(self) -> dict:
        """The dataset as a dictionary of frames, for callers that know no ``Dataset``."""
        return {"dataset_name": self.name, "train": self.split("train"), "test": self.split("test"), "label_map": self.label_map}


def list_ucr(root: str | Path) -> list[str]:
    return splits_of(root)


def scan_ucr(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The series of one file, or of a folder of parts, numbered in the order of the lines, by as many tasks as it has blocks.
    A value that isn't a number is an error."""
    rows = ordered_lines(spark, path).withColumnRenamed("line_no", "sample_index")
    parts = F.transform(F.split("line", ","), lambda x: F.trim(x).cast("double"))
    return rows.select(
        F.concat(F.lit(f"{split}_"), F.col("sample_index").cast("string")).alias("sample_id"),
        F.lit(split).alias("split"),
        F.col("sample_index").cast("long").alias("sample_index"),
        F.lit(0).alias("channel_id"),
        F.slice(parts, F.lit(2), F.size(parts) - 1).alias("values"),
        F.get(parts, 0).cast("string").alias("label"),
    )


def load_ucr(spark: SparkSession, name: str, base_dir: str | Path, *, remap_labels_: bool = True, max_samples_per_split: int | None = None) -> Dataset:
    """Both splits; they are capped before labels are mapped, so the map covers what is kept."""
    paths = both_splits(spark, base_dir, name)
    series = scan_ucr(spark, paths["train"], "train").unionByName(scan_ucr(spark, paths["test"], "test"))
    series = cap_per_split(series, max_samples_per_split)
    if not remap_labels_:
        return Dataset(name.strip(), series)
    label_map = numeric_label_map(series)
    mapped = remap_labels(series, label_map, numeric=True)
    return Dataset(name.strip(), mapped.withColumn("label", F.col("class_id").cast("string")).drop("class_id"), label_map)
