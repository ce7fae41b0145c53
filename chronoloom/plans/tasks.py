"""Queries of a task, and what its outputs mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TaskSpec, TaskType


def build_queries(series: DataFrame, spec: TaskSpec) -> DataFrame:
    """The series with query_id ``<task type>:<sample id>``, task_type, sequence_length, n_channels, channel_ids (of the sample, ascending), data_mode, has_ground_truth
    and these as ``metadata``, a map of text."""
    per = series.groupBy("sample_id", "split").agg(
        F.count("*").alias("n_channels"), F.max(F.size("values")).alias("sequence_length"), F.array_sort(F.collect_set("channel_id")).alias("channel_ids")
    )
    rows = series.join(per, ["sample_id", "split"]).withColumns(
        {
            "query_id": F.concat(F.lit(f"{spec.task_type}:"), "sample_id"),
            "task_type": F.lit(str(spec.task_type)),
            "data_mode": F.when(F.col("n_channels") == 1, "univariate").otherwise("multivariate"),
            "has_ground_truth": F.col("label").isNotNull(),
        }
    )
    told = ("task_type", "sequence_length", "n_channels", "data_mode", "has_ground_truth")
    return rows.withColumn("metadata", F.create_map(*[x for c in told for x in (F.lit(c), F.col(c).cast("string"))]))


def normalize_label(label: Column | str, spec: TaskSpec) -> Column:
    """The label without outer spaces; of a task with a label space, one that isn't in it is an error."""
    text = F.trim((F.col(label) if isinstance(label, str) else label).cast("string"))
    if not spec.label_space:
        return text
    return F.when(text.isin(list(spec.label_space)), text).otherwise(F.raise_error(F.concat(F.lit("label is not in the label space: "), F.coalesce(text, F.lit("null")))).cast("string"))


def parse_output(raw: Column | str, spec: TaskSpec) -> Column:
    """The label of an output: ``prediction`` or else ``decision`` of a JSON object, or the text itself."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    field = F.coalesce(F.get_json_object(raw, "$.prediction"), F.get_json_object(raw, "$.decision"))
    is_object = F.trim(raw).startswith("{")
    checked = F.when(is_object & field.isNull(), F.raise_error(F.lit("output has neither prediction nor decision")).cast("string"))
    return normalize_label(checked.when(is_object, field).otherwise(raw), spec)


def prompt_target(spec: TaskSpec) -> str:
    """A sentence that says what is to be predicted."""
    if spec.task_type is TaskType.CLASSIFICATION:
        space = f" Choose one of: {', '.join(spec.label_space)}." if spec.label_space else ""
        return "Classify the time series." + space
    if spec.task_type is TaskType.PREDICTION:
        return "Predict the next values of the time series."
    unit = "window" if spec.task_type is TaskType.ANOMALY_WINDOW else "sequence"
    return f"Decide whether the {unit} is anomalous."
