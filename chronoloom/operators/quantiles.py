"""Exact quantiles of many dimensions, with bounded memory.

A quantile is one or two order statistics. A mergeable sketch bounds where they can be; a scan counts what lies below and
within; the bracket, by then a small share of the values, is sketched again, until so few are left that they can be ranked. What is counted is exact,
so the sketch's error costs a round at most, never the result. Equal values are counted together and take one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Values of a bracket that are ranked; points of a sketch that a bracket is cut at, and the sketch's accuracy.
FEW, GRID, ACCURACY = 20_000, 256, 10_000


@dataclass(frozen=True)
class Bracket:
    """Ranks ``first`` to ``last``, from 0, of a dimension lie in [low, high]: ``below`` values are less than low, ``n`` are within."""

    dim: object
    q: int
    first: int
    last: int
    low: float
    high: float
    below: int
    n: int


def _frame(long: DataFrame, brackets: list[Bracket]) -> DataFrame:
    fields = [StructField("dim", long.schema["dim"].dataType), StructField("q", LongType()), *(StructField(c, LongType()) for c in ("first", "last")), *(StructField(c, DoubleType()) for c in ("low", "high")), *(StructField(c, LongType()) for c in ("below", "n"))]
    return long.sparkSession.createDataFrame([tuple(b.__dict__.values()) for b in brackets], StructType(fields))


def _narrowed(long: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    """Each bracket cut to some 1/64 of its values, by a sketch and a count."""
    held = long.join(_frame(long, brackets), "dim").where(F.col("x").between(F.col("low"), F.col("high")))
    points = [i / GRID for i in range(GRID + 1)]
    told = {(r.dim, r.q): r.g for r in held.groupBy("dim", "q").agg(F.percentile_approx("x", points, ACCURACY).alias("g")).collect()}
    tried = []
    for b in brackets:
        grid = told[b.dim, b.q]
        lo, hi = (GRID * (r - b.below) / b.n for r in (b.first, b.last))
        tried.append(replace(b, low=max(b.low, grid[max(0, math.floor(lo) - 2)]), high=min(b.high, grid[min(GRID, math.ceil(hi) + 2)])))
    counts = long.join(_frame(long, tried), "dim").groupBy("dim", "q").agg(F.count_if(F.col("x") < F.col("low")).alias("lt"), F.count_if(F.col("x") <= F.col("high")).alias("le"))
    out = []
    sums = {(r.dim, r.q): (r.lt, r.le) for r in counts.collect()}
    for b, t in zip(brackets, tried, strict=True):
        lt, le = sums[b.dim, b.q]
        low, below = (t.low, lt) if lt <= b.first else (b.low, b.below)
        high, upto = (t.high, le) if b.last < le else (b.high, b.below + b.n)
        out.append(replace(b, low=low, high=high, below=below, n=upto - below))
    return out


def exact_quantiles(long: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(dim, q, value): for each value of ``dim`` and each probability (``q``: its place), the quantile of ``x``, with linear interpolation between
    order statistics, as ``percentile`` has it. Nulls don't count and NaN is above all numbers; a dimension without values has no
    rows. The driver holds a few numbers for each dimension and probability.
    """
    long = long.select("dim", F.col("x").cast("double").alias("x")).where("x is not null")
    inf = float("inf")
    brackets, done = [], []
    totals = {r.dim: r for r in long.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.isnan("x")).alias("nan")).collect()}
    for dim, r in totals.items():
        for q, p in enumerate(probabilities):
            at = p * (r.n - 1)
            first, last = math.floor(at), math.ceil(at)
            n = r.n - r.nan
            high, n = (inf, n) if last < n else (float("nan"), r.n)
            brackets.append(Bracket(dim, q, first, last, -inf, high, 0, n))
    while brackets:
        wide = [b for b in brackets if b.n > FEW and b.low < b.high]
        done += [b for b in brackets if not (b.n > FEW and b.low < b.high)]
        if not wide:
            break
        brackets = []
        for old, new in zip(wide, _narrowed(long, wide), strict=True):
            # many equal values leave a bracket as it is: then few different ones are left
            (brackets if new.n <= old.n // 2 else done).append(new)
    if not done:
        empty = StructType([long.schema["dim"], StructField("q", LongType()), StructField("value", DoubleType())])
        return long.sparkSession.createDataFrame([], empty)
    held = long.join(_frame(long, done), "dim").where((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
    values = held.groupBy("dim", "q", "first", "last", "below", "x").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("dim", "q").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("upto", F.col("below") + F.sum("m").over(upto))
    holds = lambda r: F.max(F.when((F.col("upto") > F.col(r)) & (F.col("upto") - F.col("m") <= F.col(r)), F.col("x")))
    found = ranked.groupBy("dim", "q", "first", "last").agg(holds("first").alias("a"), holds("last").alias("b"))
    shares = {(dim, q): probabilities[q] * (r.n - 1) for dim, r in totals.items() for q in range(len(probabilities))}
    fields = StructType([long.schema["dim"], StructField("q", LongType()), StructField("at", DoubleType())])
    places = long.sparkSession.createDataFrame([(dim, q, at) for (dim, q), at in shares.items()], fields)
    value = F.when(F.col("first") == F.col("last"), F.col("a")).otherwise((F.col("last") - F.col("at")) * F.col("a") + (F.col("at") - F.col("first")) * F.col("b"))
    return found.join(places, ["dim", "q"]).select("dim", "q", value.alias("value"))
