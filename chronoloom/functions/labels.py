"""Labels of windows and sequences from labels of points, and label maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LabelRule


def point_label(points: Column | str, rule: str = "any", threshold: float = 0.1) -> Column:
    """1 or 0. ``any``: a point above 0; ``all``: every point above 0; ``ratio``: at least the threshold's share."""
    points = F.col(points) if isinstance(points, str) else points
    rule = LabelRule(rule)
    if rule is LabelRule.ANY:
        found = F.exists(points, lambda x: x > 0)
    elif rule is LabelRule.ALL:
        found = F.forall(points, lambda x: x > 0)
    else:
        found = F.size(F.filter(points, lambda x: x > 0)) / F.nullif(F.size(points), F.lit(0)) >= threshold
    return F.when(F.size(points) == 0, F.raise_error(F.lit("no point labels")).cast("int")).otherwise(found.cast("int"))


def numeric_label_map(*frames: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, class_id): the distinct numeric labels of all frames in increasing order, from 0. The label
    set is small; the rows aren't, so labels are made distinct before they are ranked."""
    labels = frames[0].select(F.col(label_col).cast("double").alias("label"))
    for f in frames[1:]:
        labels = labels.unionByName(f.select(F.col(label_col).cast("double").alias("label")))
    from pyspark.sql import Window

    return labels.where("label is not null").distinct().withColumn("class_id", F.row_number().over(Window.orderBy("label")).cast("long") - 1)


def declared_label_map(spark, class_values: list[str]) -> DataFrame:
    """(label, class_id) in the declared order."""
    if len(set(class_values)) != len(class_values):
        raise ValueError("class values must be unique")
    return spark.createDataFrame(list(zip(class_values, range(len(class_values)), strict=True)), "label string, class_id long")


def first_seen_label_map(rows: DataFrame, *, order: list[str], label_col: str = "label") -> DataFrame:
    """(label, class_id) by first appearance in the order of the columns."""
    from pyspark.sql import Window

    first = rows.groupBy(F.col(label_col).cast("string").alias("label")).agg(F.min(F.struct(*order)).alias("first"))
    return first.select("label", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("class_id"))


def remap_labels(rows: DataFrame, label_map: DataFrame, *, label_col: str = "label", numeric: bool = False) -> DataFrame:
    """The rows with ``class_id`` added; a label that isn't in the map is an error."""
    key = F.col(label_col).cast("double" if numeric else "string")
    names = label_map.select(F.col("label").alias("__label"), F.col("class_id"))
    joined = rows.withColumn("__key", key).join(F.broadcast(names), F.col("__key") == F.col("__label"), "left")
    checked = F.when(F.col("class_id").isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col("__key").cast("string"), F.lit("null")))).cast("long"))
    return joined.withColumn("class_id", checked.otherwise(F.col("class_id"))).drop("__key", "__label")
