"""Spectra of series that are tables of points, of any length: a sum over segments, which merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.native import FS
from .series import point_windows


def welch_density(points: DataFrame, *, by: list[str], value: str = "value", at: str = "t", size: int = 256, fs: float = FS) -> DataFrame:
    """(the columns ``by``, k, frequency, power): Welch's density of each series over its deviation, as the features of a whole series have it: Hann
    windows of ``size`` values, half overlapped, each centred, their powers' mean. Points are at 0, 1, ... of ``at``; a null value is an error; a series of fewer than ``size``
    points has no rows. No row or task holds a series; what is shuffled of a segment is its powers' sums.
    """
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    checked = F.when(F.col(value).isNull(), F.raise_error(F.lit("a point has no value")).cast("double")).otherwise(F.col(value).cast("double"))
    points = points.select(*by, F.col(at).alias("__t"), checked.alias("__v"))

    @F.pandas_udf("array<double>")
    def powers(batch: pd.Series) -> pd.Series:
        x = np.stack(batch.to_numpy())
        p = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
        return pd.Series(list(p))

    segments = point_windows(points, size=size, stride=size - size // 2, values=["__v"], by=by, at="__t").select(*by, F.posexplode(powers("__v")).alias("__k", "__p"))
    mean = segments.groupBy(*by, "__k").agg(F.avg("__p").alias("__p"))
    out = mean.join(points.groupBy(*by).agg(F.var_pop("__v").alias("__var")), by)
    double = F.when((F.col("__k") == 0) | (F.col("__k") * 2 == size), 1.0).otherwise(2.0)
    scale = F.when(F.col("__var") == 0, 1.0).otherwise(F.col("__var"))
    frequency, power = F.col("__k") * (1 / (size * (1 / fs))), F.col("__p") * double / scale / float(fs * (window**2).sum())
    return out.select(*by, F.col("__k").cast("long").alias("k"), frequency.alias("frequency"), power.alias("power"))
