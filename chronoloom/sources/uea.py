"""Multivariate classification files (``.ts``): a header of @-lines, then a line for each sample with its
dimensions and its label separated by colons."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import declared_label_map, numeric_label_map, remap_labels
from ..operators.series import cap_per_split
from .files import both_splits, splits_of
from .ordered import ordered_lines
from .store import Store
from .ucr import Dataset


@dataclass(frozen=True)
class Header:
    problem_name: str | None
    dimensions: int
    equal_length: bool
    univariate: bool
    class_values: tuple[str, ...] | None
    series_length: int | None = None
    missing: bool | None = None
    time_stamps: bool | None = None


def _flag(tag: str, value: str) -> bool:
    if value.lower() not in ("true", "false"):
        raise ValueError(f"{tag} must be true or false, not {value!r}")
    return value.lower() == "true"


def parse_header(text: str) -> Header:
    """The header of a file's text up to @data. Tags are read in any case; ``#`` begins a comment line."""
    found: dict[str, str] = {}
    for line in (x.strip() for x in text.splitlines()):
        if not line or line.startswith("#"):
            continue
        if line.lower().startswith("@data"):
            break
        if line.startswith("@"):
            tag, _, value = line[1:].partition(" ")
            found[tag.lower()] = value.strip()
    else:
        raise ValueError("Missing @data section")
    if absent := [t for t in ("dimensions", "equallength", "classlabel", "univariate") if t not in found]:
        raise ValueError(f"Missing required header fields: {absent}")
    try:
        dimensions = int(found["dimensions"])
        length = int(found["serieslength"]) if "serieslength" in found else None
    except ValueError:
        raise ValueError("dimensions and seriesLength must be integers") from None
    if dimensions <= 0:
        raise ValueError("dimensions must be positive")
    univariate = _flag("univariate", found["univariate"])
    if univariate != (dimensions == 1):
        raise ValueError("univariate and dimensions disagree")
    first, *values = found["classlabel"].split() or [""]
    classes = None
    if _flag("classLabel", first):
        if not values:
            raise ValueError("classLabel true requires explicit class values")
        if len(set(values)) != len(values):
            raise ValueError("class values must be unique")
        classes = tuple(values)
    flags = {k: _flag(k, found[k]) if k in found else None for k in ("missing", "timestamps")}
    return Header(found.get("problemname"), dimensions, _flag("equalLength", found["equallength"]), univariate, classes, length, flags["missing"], flags["timestamps"])


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The lines up to @data: only these are read."""
    at = Store(spark, path)
    if at.is_dir():
        at = at / min((n for n in at.names(folders=False) if n[0] not in "._"), key=lambda n: (len(n), n), default="")
    if (found := at.head(re.compile(r"^\s*@data", re.I))) is None:
        raise ValueError("Missing @data section")
    return found


def list_uea(root: str | Path) -> list[str]:
    return splits_of(root, ".ts")


def _check(ok: Column, message: str, out: Column, kind: str) -> Column:
    return F.when(ok | F.col("line").isNull(), out).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.col("line"))).cast(kind))


def scan_uea(spark: SparkSession, path: str, split: str, header: Header) -> DataFrame:
    """The samples of a file, or of a folder of parts that begins with the header: sample_id, split, sample_index, ``channels`` (dimension x time) and label."""
    if header.class_values is None:
        raise ValueError("classLabel must be true")
    if not header.equal_length:
        raise ValueError("Variable-length series are not supported")
    before = sum(1 for x in read_header(spark, path) if x.strip() and not x.lstrip().startswith("#"))
    # the header's lines are null, not only left out: filters that follow from the checks below may be met first
    line = F.when(F.col("line_no") >= before, F.col("line"))
    rows = ordered_lines(spark, path, comment="#").where(F.col("line_no") >= before).select((F.col("line_no") - before).alias("sample_index"), line.alias("line"))
    parts = F.split("line", ":")
    d = header.dimensions
    tokens = F.transform(F.slice(parts, 1, d), lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))
    rows = rows.select("sample_index", "line", parts.alias("parts"), tokens.alias("tokens"))
    rows = rows.withColumn("tokens", _check(F.size("parts") == d + 1, "dimension mismatch", F.col("tokens"), "array<array<string>>"))
    rows = rows.withColumn("tokens", _check(F.forall("tokens", lambda c: F.size(c) > 0), "empty channel", F.col("tokens"), "array<array<string>>"))
    numbers = F.transform("tokens", lambda c: F.transform(c, lambda x: x.try_cast("double")))
    bad = F.exists(F.flatten(numbers), lambda x: x.isNull())
    length = F.size(F.get("tokens", 0))
    rows = rows.withColumn("channels", _check(~bad, "non-numeric value", numbers, "array<array<double>>"))
    rows = rows.withColumn("channels", _check(~F.exists(F.flatten("channels"), lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "NaN/Inf value", F.col("channels"), "array<array<double>>"))
    rows = rows.withColumn("channels", _check(F.forall("channels", lambda c: F.size(c) == length), "unequal channel lengths", F.col("channels"), "array<array<double>>"))
    if header.series_length is not None:
        rows = rows.withColumn("channels", _check(length == header.series_length, "seriesLength mismatch", F.col("channels"), "array<array<double>>"))
    label = F.trim(F.get("parts", d))
    label = _check(label.isin(list(header.class_values)), "Observed labels not declared", label, "string")
    return rows.select(
        F.concat(F.lit(f"{split}_"), F.col("sample_index").cast("string")).alias("sample_id"),
        F.lit(split).alias("split"),
        F.col("sample_index").cast("long").alias("sample_index"),
        "channels",
        label.alias("label"),
    )


def load_uea_samples(spark: SparkSession, name: str, base_dir: str | Path) -> tuple[DataFrame, Header]:
    """The samples of both splits, after checks that they agree."""
    paths = both_splits(spark, base_dir, name, ".ts")
    headers = {split: parse_header("\n".join(read_header(spark, path))) for split, path in paths.items()}
    if headers["train"].class_values != headers["test"].class_values:
        raise ValueError("class label declaration mismatch between splits")
    samples = [scan_uea(spark, paths[s], s, headers[s]) for s in ("train", "test")]
    shapes = samples[0].unionByName(samples[1]).groupBy("split").agg(
        *[f(x).alias(f"{k}_{n}") for n, x in (("c", F.size("channels")), ("t", F.size(F.get("channels", F.lit(0))))) for k, f in (("low", F.min), ("high", F.max))],
        F.max("label"),
    ).collect()
    if not shapes:
        raise ValueError("no samples")
    for r in shapes:
        if r.low_t != r.high_t:
            raise ValueError("series of a split differ in length")
    if len({(r.low_c, r.low_t) for r in shapes}) > 1 or headers["train"].dimensions != headers["test"].dimensions:
        raise ValueError("shape mismatch between splits")
    return samples[0].unionByName(samples[1]), headers["train"]


def _numeric(values: tuple[str, ...]) -> bool:
    try:
        return bool([float(v) for v in values])
    except ValueError:
        return False


def explode_channels(samples: DataFrame) -> DataFrame:
    """One row per sample and channel."""
    rest = [c for c in samples.columns if c != "channels"]
    return samples.select(*rest, F.posexplode("channels").alias("channel_id", "values")).select("sample_id", "split", "sample_index", "channel_id", "values", "label", *[c for c in rest if c not in ("sample_id", "split", "sample_index", "label")])


def load_uea(spark: SparkSession, name: str, base_dir: str | Path, *, remap_labels_: bool = True, max_samples_per_split: int | None = None) -> Dataset:
    """Numeric labels are mapped in increasing order of those kept, others in the declared order."""
    samples, header = load_uea_samples(spark, name, base_dir)
    series = cap_per_split(explode_channels(samples), max_samples_per_split)
    if not remap_labels_:
        return Dataset(name.strip(), series)
    numeric = _numeric(header.class_values)
    label_map = numeric_label_map(series) if numeric else declared_label_map(spark, list(header.class_values))
    mapped = remap_labels(series, label_map, numeric=numeric)
    return Dataset(name.strip(), mapped.withColumn("label", F.col("class_id").cast("string")).drop("class_id"), label_map)
