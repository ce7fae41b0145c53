"""Series tables written as the files that the loaders read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store


def _ordered(rows: DataFrame, path: str, one_file: bool) -> str:
    """Rows (place, line), in the order of ``place``, as lines: of a folder of parts, written by many tasks by ranges, or of one file,
    which one task writes. It appears by a rename when it is whole."""
    spark = rows.sparkSession
    parts = Store(spark, f"{path}.parts")
    dealt = rows.repartition(1) if one_file else rows.repartitionByRange("place")
    dealt.sortWithinPartitions("place").select("line").write.mode("overwrite").text(parts.path)
    if one_file:
        (parts / next(n for n in parts.names(folders=False) if n.startswith("part-"))).move(Store(spark, path))
        parts.delete()
    else:
        parts.move(Store(spark, path))
    return path


def _numbers(values) -> Column:
    return F.concat_ws(",", F.transform(values, lambda x: x.cast("string")))


def write_ucr(series: DataFrame, name: str, base_dir: str, *, one_file: bool = False) -> dict[str, str]:
    """``<base_dir>/<name>/<name>_TRAIN`` and ``_TEST`` from a series table of one channel, by ``sample_index``.
    Labels must be numbers. Each is a folder of parts unless it is to be ``one_file``."""
    rows = series.select("split", F.col("sample_index").alias("place"), F.concat_ws(",", "label", _numbers("values")).alias("line"))
    return {s: _ordered(rows.where(F.col("split") == s), f"{base_dir}/{name}/{name}_{s.upper()}", one_file) for s in ("train", "test")}


def write_uea(samples: DataFrame, name: str, base_dir: str, *, dimensions: int, class_values: Sequence[str], one_file: bool = False) -> dict[str, str]:
    """``<base_dir>/<name>/<name>_TRAIN.ts`` and ``_TEST.ts`` from samples (split, sample_index, channels, label) of
    equal length. Labels must be among ``class_values``, which are declared in the order given. Each is a folder of parts unless it is to be ``one_file``."""
    header = "\n".join(
        [
            f"@problemName {name}",
            f"@univariate {str(dimensions == 1).lower()}",
            f"@dimensions {dimensions}",
            "@equalLength true",
            f"@classLabel true {' '.join(class_values)}",
            "@data",
        ]
    )
    line = F.concat_ws(":", F.transform("channels", _numbers), F.col("label"))
    first = samples.sparkSession.range(1).select(F.lit(-1).cast("long").alias("place"), F.lit(header).alias("line"))
    rows = samples.select("split", F.col("sample_index").alias("place"), line.alias("line"))
    return {s: _ordered(first.unionByName(rows.where(F.col("split") == s).drop("split")), f"{base_dir}/{name}/{name}_{s.upper()}.ts", one_file) for s in ("train", "test")}


def write_sensors(points: DataFrame, base_dir: str, *, key: str, order: Sequence[str], sep: str = ";") -> str:
    """A file, in a folder of its own under ``base_dir``, for each value of ``key``, with the other columns by ``order``."""
    points.repartition(key).sortWithinPartitions(key, *order).write.mode("overwrite").partitionBy(key).csv(base_dir, sep=sep, header=True)
    return base_dir
