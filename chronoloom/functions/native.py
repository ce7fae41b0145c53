"""Features of a series as Catalyst expressions over ``values``, an array of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import let, mean, total

#: Samples a second, for features that have a time axis.
FS = 100.0


def _quantile(s: Column, n: Column, p: float) -> Column:
    """Of a sorted array, with linear interpolation."""
    h = (n - 1) * F.lit(p)
    low = F.floor(h).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, n - 1))
    return a + (h - low) * (b - a)


def _squares(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def _count(x: Column) -> Column:
    return F.size(x).cast("double")


def _moment(x: Column, m: Column, k: int) -> Column:
    def power(v: Column, m: Column) -> Column:
        out = v - m
        for _ in range(k - 1):
            out = out * (v - m)
        return out

    return let(m, lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + power(v, m))) / F.nullif(F.size(x), F.lit(0))


def _runs_entropy(s: Column, n: Column) -> Column:
    """Shannon entropy of the frequencies of equal values, over log2(n), from runs of the sorted array."""
    state = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("acc"))

    def gain(run: Column) -> Column:
        return F.when(run > 0, run * F.log2(F.greatest(run, F.lit(1.0)))).otherwise(0.0)

    def step(a: Column, v: Column) -> Column:
        same = a["last"] == v
        return F.struct(
            v.alias("last"),
            F.when(same, a["run"] + 1).otherwise(1.0).alias("run"),
            F.when(same, a["acc"]).otherwise(a["acc"] + gain(a["run"])).alias("acc"),
        )

    summed = F.aggregate(s, state, step, lambda a: a["acc"] + gain(a["run"]))
    return F.when(n <= 2, F.lit(0.0)).otherwise((F.log2(n.cast("double")) - summed / n) / F.log2(n.cast("double")))


def _peaks(v: Column, n: Column, near: int = 10) -> Column:
    inside = F.when(n > 2 * near, F.sequence(F.lit(near), n - near - 1)).otherwise(F.array().cast("array<int>"))
    higher = lambda i: F.forall(F.sequence(F.lit(1), F.lit(near)), lambda k: (F.get(v, i) > F.get(v, i - k)) & (F.get(v, i) > F.get(v, i + k)))
    return _count(F.filter(inside, higher))


def _pairs(x: Column, test: Callable[[Column, Column], Column]) -> Column:
    """How many neighbours pass the test."""
    n = F.size(x)
    first = F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0)))
    second = F.slice(x, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return _count(F.filter(F.zip_with(first, second, test), lambda t: t))


def _slope(v: Column, n: Column) -> Column:
    centre = (n - 1) / F.lit(2.0)
    top = total(F.transform(v, lambda x, i: (i - centre) * x))
    return top / F.nullif(n.cast("double") * (n.cast("double") * n - 1) / 12.0, F.lit(0.0))


def _median_deviation(c: dict[str, Column]) -> Column:
    apart = let(_quantile(c["s"], c["n"], 0.5), lambda m: F.array_sort(F.transform(c["v"], lambda x: F.abs(x - m))))
    return let(apart, lambda s: _quantile(s, c["n"], 0.5))


#: Of the prepared columns v (values), n, s (sorted), m (mean), d (differences), ds (sorted differences), q (sum of squares) and var.
FEATURES: dict[str, Callable[[dict[str, Column]], Column]] = {
    "0_Interquartile range": lambda c: _quantile(c["s"], c["n"], 0.75) - _quantile(c["s"], c["n"], 0.25),
    "0_Kurtosis": lambda c: _moment(c["v"], c["m"], 4) / F.nullif(c["var"] * c["var"], F.lit(0.0)) - 3,
    "0_Max": lambda c: F.get(c["s"], c["n"] - 1),
    "0_Mean": lambda c: c["m"],
    "0_Mean absolute deviation": lambda c: let(c["m"], lambda m: mean(F.transform(c["v"], lambda x: F.abs(x - m)))),
    "0_Mean absolute diff": lambda c: mean(F.transform(c["d"], F.abs)),
    "0_Mean diff": lambda c: mean(c["d"]),
    "0_Median": lambda c: _quantile(c["s"], c["n"], 0.5),
    "0_Median absolute deviation": lambda c: _median_deviation(c),
    "0_Median absolute diff": lambda c: let(F.array_sort(F.transform(c["d"], F.abs)), lambda s: _quantile(s, c["n"] - 1, 0.5)),
    "0_Median diff": lambda c: _quantile(c["ds"], c["n"] - 1, 0.5),
    "0_Min": lambda c: F.get(c["s"], 0),
    "0_Skewness": lambda c: _moment(c["v"], c["m"], 3) / F.nullif(F.pow(c["var"], F.lit(1.5)), F.lit(0.0)),
    "0_Standard deviation": lambda c: F.sqrt(c["var"]),
    "0_Sum absolute diff": lambda c: total(F.transform(c["d"], F.abs)),
    "0_Variance": lambda c: c["var"],
    "0_Negative turning points": lambda c: _pairs(c["d"], lambda a, b: (a < 0) & (b > 0)),
    "0_Positive turning points": lambda c: _pairs(c["d"], lambda a, b: (a > 0) & (b < 0)),
    "0_Neighbourhood peaks": lambda c: _peaks(c["v"], c["n"]),
    "0_Zero crossing rate": lambda c: _pairs(c["v"], lambda a, b: F.signum(a) != F.signum(b)),
    "0_Absolute energy": lambda c: c["q"],
    "0_Area under the curve": lambda c: total(F.zip_with(F.slice(c["v"], 1, F.greatest(c["n"] - 1, F.lit(0))), F.slice(c["v"], 2, F.greatest(c["n"] - 1, F.lit(0))), lambda a, b: (a + b) / 2)) / FS,
    "0_Entropy": lambda c: _runs_entropy(c["s"], c["n"]),
    "0_Root mean square": lambda c: F.sqrt(c["q"] / c["n"]),
    "0_Signal distance": lambda c: total(F.transform(c["d"], lambda x: F.sqrt(1 + x * x))),
    "0_Slope": lambda c: _slope(c["v"], c["n"]),
    "0_Peak to peak distance": lambda c: F.abs(F.get(c["s"], c["n"] - 1) - F.get(c["s"], 0)),
    "0_Average power": lambda c: c["q"] / F.nullif((c["n"] - 1) / FS, F.lit(0.0)),
    "0_Centroid": lambda c: total(F.transform(c["v"], lambda x, i: i / FS * x * x)) / F.nullif(c["q"], F.lit(0.0)),
}
for _k, _p in enumerate((0.2, 0.8)):
    FEATURES[f"0_ECDF Percentile Count_{_k}"] = lambda c, p=_p: F.floor(c["n"] * F.lit(p)).cast("double")
    FEATURES[f"0_ECDF Percentile_{_k}"] = lambda c, p=_p: F.get(c["s"], F.greatest(F.floor(c["n"] * F.lit(p)).cast("int") - 1, F.lit(0)))
for _k in range(10):
    FEATURES[f"0_ECDF_{_k}"] = lambda c, k=_k: F.when(c["n"] > k, F.lit(k + 1.0) / c["n"])
    FEATURES[f"0_Histogram_{_k}"] = lambda c, k=_k: _count(F.filter(c["bins"], lambda b: b == k))


def prepare(series: DataFrame, values: str = "values") -> tuple[DataFrame, dict[str, Column]]:
    """The frame with what several features share, each computed once."""
    v, n = F.col(values), F.col("__n")
    df = series.withColumn("__n", F.size(values))
    df = df.withColumns({"__s": F.array_sort(v), "__m": mean(v), "__q": _squares(v), "__d": F.zip_with(F.slice(v, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: a - b)})
    ends = F.struct(F.get("__s", F.lit(0)).alias("low"), F.get("__s", n - 1).alias("high"))

    def binned(e: Column) -> Column:
        place = lambda x: F.least(F.floor((x - e["low"]) * 10 / F.nullif(e["high"] - e["low"], F.lit(0.0))).cast("int"), F.lit(9))
        return F.when(e["low"] == e["high"], F.transform(v, lambda x: F.lit(5))).otherwise(F.transform(v, place))

    bins = let(ends, binned)
    df = df.withColumns({"__ds": F.array_sort("__d"), "__var": _moment(v, F.col("__m"), 2), "__bins": bins})
    return df, {"v": v} | {k: F.col(f"__{k}") for k in ("n", "s", "m", "q", "d", "ds", "var", "bins")}


PREPARED = ("__n", "__s", "__m", "__q", "__d", "__ds", "__var", "__bins")
