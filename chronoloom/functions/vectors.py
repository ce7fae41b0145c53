"""Column functions on arrays of doubles: distances, norms, scaling and resampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Distance


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column | str) -> Column:
    return F.aggregate(_col(x), F.lit(0.0), lambda a, v: a + v)


def mean(x: Column | str) -> Column:
    """0 for an empty array."""
    x = _col(x)
    return F.when(F.size(x) == 0, F.lit(0.0)).otherwise(total(x) / F.size(x))


def squares_about(x: Column | str, centre: Column) -> Column:
    x = _col(x)
    return let(centre, lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)))


def stddev(x: Column | str, ddof: int = 0) -> Column:
    """0 where there are no more than ``ddof`` values."""
    x = _col(x)
    n = F.size(x)
    square = squares_about(x, mean(x))
    return F.when(n <= ddof, F.lit(0.0)).otherwise(F.sqrt(square / F.nullif(n - ddof, F.lit(0))))


def dot(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(_col(x), _col(y), lambda a, b: a * b))


def l2_norm(x: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(x), F.lit(0.0), lambda a, v: a + v * v))


def _same_size(x: Column, y: Column, out: Column) -> Column:
    """``zip_with`` pads with nulls, so lengths are compared first."""
    return F.when(F.size(x) == F.size(y), out).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def squared_euclidean(x: Column | str, y: Column | str) -> Column:
    x, y = _col(x), _col(y)
    return _same_size(x, y, total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def l2_distance(x: Column | str, y: Column | str) -> Column:
    return F.sqrt(squared_euclidean(x, y))


def weighted_l2_distance(x: Column | str, y: Column | str, weights: Column | str) -> Column:
    x, y, w = _col(x), _col(y), _col(weights)
    bad = F.exists(w, lambda v: v < 0) | (F.size(w) != F.size(x))
    squares = F.zip_with(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), w, lambda a, b: a * b)
    return F.when(bad, F.raise_error(F.lit("weights must be non-negative, one for each value")).cast("double")).otherwise(
        F.sqrt(_same_size(x, y, total(squares)))
    )


def cosine_distance(x: Column | str, y: Column | str) -> Column:
    """1 where either norm is zero. Never negative, so that a confidence of 1/(1+d) is at most 1."""
    x, y = _col(x), _col(y)
    norms = l2_norm(x) * l2_norm(y)
    return _same_size(x, y, F.when(norms == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - dot(x, y) / F.nullif(norms, F.lit(0.0)))))


def cosine_similarity(x: Column | str, y: Column | str, tiny: float = 1e-12) -> Column:
    """0 where a norm is at most ``tiny``."""
    x, y = _col(x), _col(y)
    a, b = l2_norm(x), l2_norm(y)
    return F.when((a <= tiny) | (b <= tiny), F.lit(0.0)).otherwise(dot(x, y) / F.nullif(a * b, F.lit(0.0)))


def signed_log1p(x: Column | str) -> Column:
    x = _col(x)
    return F.signum(x) * F.log1p(F.abs(x))


def confidence(distance: Column | str) -> Column:
    return 1 / (1 + F.greatest(F.lit(0.0), _col(distance)))


def rounded(x: Column | str, places: int = 6) -> Column:
    """To so many decimals, halves away from zero, as DuckDB has it: a negative number that rounds to zero is -0.0, where Spark's ``round`` gives 0.0."""
    x, m = _col(x), 10.0**places
    y = x * m
    low = F.floor(F.abs(y)).cast("double")
    return F.when(F.abs(y) < 2.0**52, F.signum(y) * (low + (F.abs(y) - low >= 0.5).cast("double")) / m).otherwise(x)


def downsample(x: Column | str, max_len: int | None) -> Column:
    """The values at positions i * (n - 1) / (max_len - 1), halves rounded to even. Shorter arrays, and any
    array where there is no positive ``max_len``, stay; a single value is the first."""
    x = _col(x)
    if not max_len or max_len <= 0:
        return x
    if max_len == 1:
        return F.when(F.size(x) <= 1, x).otherwise(F.slice(x, 1, 1))
    last = F.size(x) - 1
    picked = F.transform(
        F.sequence(F.lit(0), F.lit(max_len - 1)),
        lambda i: F.get(x, F.bround(i.cast("double") * last / (max_len - 1), 0).cast("int")),
    )
    return F.when(F.size(x) <= max_len, x).otherwise(picked)


def znorm(x: Column | str, tiny: float = 1e-12) -> Column:
    """Centred, and divided by the population deviation unless the variance is at most ``tiny``."""
    x = _col(x)
    stats = F.struct(mean(x).alias("m"), (squares_about(x, mean(x)) / F.nullif(F.size(x), F.lit(0))).alias("var"))

    def scaled(st: Column) -> Column:
        scale = F.when(st["var"] <= tiny, F.lit(1.0)).otherwise(F.sqrt(st["var"]))
        return let(F.struct(st["m"].alias("m"), scale.alias("s")), lambda b: F.transform(x, lambda v: (v - b["m"]) / b["s"]))

    return F.when(F.size(x) == 0, x).otherwise(let(stats, scaled))


def ordered_vector(features: Column | str, order: list[str]) -> Column:
    """The values of a map in the order of the names; a missing name is an error, others are ignored."""
    features = _col(features)
    names = F.array(*[F.lit(n) for n in order])
    missing = F.filter(names, lambda n: F.element_at(features, n).isNull())
    return F.when(
        F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing features: "), F.array_join(missing, ", "))).cast("array<double>")
    ).otherwise(F.transform(names, lambda n: F.element_at(features, n)))


def pair_score(x: Column | str, y: Column | str, distance: str, weights: Column | str | None = None) -> Column:
    """The distance of two vectors as they are, without a normalization."""
    distance = Distance(distance)
    if distance is Distance.WEIGHTED_L2:
        if weights is None:
            raise ValueError("weighted_l2 needs weights")
        return weighted_l2_distance(x, y, weights)
    return cosine_distance(x, y) if distance is Distance.COSINE else l2_distance(x, y)


def payload_vector(order: list[str], *, vector: Column | None = None, features: Column | None = None, kept_features: Column | None = None, kept_vector: Column | None = None) -> Column:
    """The first that isn't null of a given vector, given features, and the features and vector kept with a sample."""
    options = [
        vector,
        None if features is None else F.when(features.isNotNull(), ordered_vector(features, order)),
        None if kept_features is None else F.when(kept_features.isNotNull(), ordered_vector(kept_features, order)),
        kept_vector,
    ]
    if not (given := [o for o in options if o is not None]):
        raise ValueError("no payload")
    return F.coalesce(*given)
