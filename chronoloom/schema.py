"""The data model: table schemas, enumerations and configuration values with their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import StrEnum
from typing import Any

from pyspark.sql import types as T

#: One row per (sample, channel). ``sample_index`` is the position in its split.
SERIES = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("sample_index", T.LongType()),
        T.StructField("channel_id", T.IntegerType()),
        T.StructField("values", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.StringType()),
    ]
)
#: One row per point-labelled sequence; ``channels`` holds an array for each feature column.
SEQUENCES = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("feature_columns", T.ArrayType(T.StringType())),
        T.StructField("channels", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("point_labels", T.ArrayType(T.IntegerType())),
    ]
)
#: One row per memory entry; ``ord`` keeps the order of insertion.
GALLERY = T.StructType(
    [
        T.StructField("entry_id", T.StringType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("channel_id", T.IntegerType()),
        T.StructField("task_type", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("statistic_view", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("ts_view", T.ArrayType(T.DoubleType())),
        T.StructField("summary_view", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ord", T.LongType()),
    ]
)


class TaskType(StrEnum):
    CLASSIFICATION = "classification"
    PREDICTION = "prediction"
    ANOMALY_SEQUENCE = "anomaly_sequence"
    ANOMALY_WINDOW = "anomaly_window"


class RepresentationType(StrEnum):
    TS = "ts"
    SUMMARY = "summary"
    STATISTIC = "statistic"


class DataMode(StrEnum):
    UNIVARIATE = "univariate"
    MULTIVARIATE = "multivariate"


class Distance(StrEnum):
    COSINE = "cosine"
    L2 = "l2"
    WEIGHTED_L2 = "weighted_l2"


class Normalization(StrEnum):
    NONE = "none"
    ZSCORE = "zscore"
    ROBUST = "robust"
    LOG1P_ROBUST = "log1p_robust"


class LabelRule(StrEnum):
    ANY = "any"
    ALL = "all"
    RATIO = "ratio"


def non_empty(value: Any, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a non-empty string")
    return value


def positive(value: Any, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer")
    return value


def non_negative(value: Any, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{name} must be a non-negative integer")
    return value


def finite(value: Any, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise ValueError(f"{name} must be finite")
    return float(value)


def vector_1d(value: Any, name: str) -> list[float]:
    """The numbers of a sequence or array of one axis that isn't empty."""
    out = value.tolist() if hasattr(value, "tolist") else list(value) if isinstance(value, list | tuple) else None
    if not isinstance(out, list) or not out or any(isinstance(x, bool) or not isinstance(x, int | float) for x in out):
        raise ValueError(f"{name} must be numbers along one axis")
    return [float(x) for x in out]


def non_empty_items(value: Any, name: str) -> list:
    """The items of anything that can be gone through, at least one; a text isn't taken apart."""
    if isinstance(value, str | bytes) or not hasattr(value, "__iter__") or not (out := list(value)):
        raise ValueError(f"{name} must have items")
    return out


def existing_path(spark, path: Any, name: str) -> str:
    """The path, of any store that Spark reaches, of a file or folder that is there."""
    from .sources.store import Store

    if not str(path).strip() or not Store(spark, path).exists():
        raise FileNotFoundError(f"{name}: {path}")
    return str(path)


@dataclass(frozen=True)
class TaskSpec:
    """What is asked: type, unique labels, granularity and a description."""

    task_type: TaskType
    label_space: tuple[str, ...] = ()
    granularity: str = "sample"
    description: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "task_type", TaskType(self.task_type))
        object.__setattr__(self, "label_space", tuple(non_empty(x, "label").strip() for x in self.label_space))
        if len(set(self.label_space)) != len(self.label_space):
            raise ValueError("label_space has repeated labels")


@dataclass(frozen=True)
class RetrieverConfig:
    """How neighbours are found."""

    distance: Distance = Distance.COSINE
    normalize: Normalization = Normalization.NONE
    top_k: int = 1
    weights: tuple[float, ...] | None = None
    enabled: bool = True
    by_channel: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "distance", Distance(self.distance))
        object.__setattr__(self, "normalize", Normalization(self.normalize))
        positive(self.top_k, "top_k")
        if self.distance is Distance.WEIGHTED_L2:
            if not self.weights or any(w < 0 or not math.isfinite(w) for w in self.weights):
                raise ValueError("weighted_l2 needs non-negative weights")


@dataclass(frozen=True)
class SelectorConfig:
    """How channels are ranked."""

    top_k: int = 1
    max_len: int | None = None
    z_norm: bool = True
    alpha: float = 0.5
    nn_eval: int = 200
    diversity: float | None = None
    seed: int = 42

    def __post_init__(self) -> None:
        positive(self.top_k, "top_k")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be between 0 and 1")


@dataclass(frozen=True)
class WindowConfig:
    """Sliding windows and their labels."""

    size: int = 60
    stride: int = 10
    rule: LabelRule = LabelRule.ANY
    threshold: float = 0.1
    metadata: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        positive(self.size, "size")
        positive(self.stride, "stride")
        object.__setattr__(self, "rule", LabelRule(self.rule))
