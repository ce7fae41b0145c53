"""Features of series: only what is asked for is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native, spectral
from .groups import PRUNED_PREFIX, resolve, snake


def feature_columns(series: DataFrame, groups: list[str] | None = None, *, values: str = "values") -> tuple[DataFrame, dict[str, Column]]:
    """A frame to select from, and the column of each feature by name. Features that are Catalyst
    expressions stay in the JVM; the rest come from one vectorised function for all of them. A null or empty
    series gives nulls."""
    names = resolve(groups)
    df, prepared = native.prepare(series, values)
    other = [n for n in names if n in spectral.FEATURES]
    if other:
        df = df.withColumn("__spectral", spectral.spectral_array(values, other))
    some = F.col("__n") > 0
    out = {}
    for n in names:
        col = native.FEATURES[n](prepared) if n in native.FEATURES else F.get("__spectral", other.index(n))
        out[n] = F.when(some, col)
    return df, out


def with_features(series: DataFrame, groups: list[str] | None = None, *, values: str = "values") -> DataFrame:
    """The rows with a column for each feature, named for SQL."""
    df, columns = feature_columns(series, groups, values=values)
    return df.select(*[F.col(f"`{c}`") for c in series.columns], *[c.alias(snake(n)) for n, c in columns.items()])


def statistic_view(series: DataFrame, groups: list[str] | None = None, *, values: str = "values", prune_fft: bool = True, column: str = "statistic_view") -> DataFrame:
    """The rows with a map of features by their names. Features that can't be computed (of constant or too
    short series) are left out of the map, and an empty or null series has a null map with ``error`` set."""
    df, columns = feature_columns(series, groups, values=values)
    if prune_fft:
        columns = {n: c for n, c in columns.items() if not n.startswith(PRUNED_PREFIX)}
    entries = F.array(*[F.struct(F.lit(n).alias("key"), c.cast("double").alias("value")) for n, c in columns.items()])
    view = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & ~F.isnan(e["value"])))
    some = F.coalesce(F.size(values), F.lit(0)) > 0
    return df.select(
        *[F.col(f"`{c}`") for c in series.columns],
        F.when(some, view).alias(column),
        F.when(~some, F.lit("empty series")).alias("error"),
    )


def representation_records(series: DataFrame, groups: list[str] | None = None, *, names: str | None = None, save_path: str | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """The rows with ``record``: rep_type ``statistic``, the features as ``payload``, and ``metadata``: sample_id, channel_id, feature_groups, num_features and what is given. ``names``: a
    column of names that stand for sample ids. A null or empty series has a null record. With ``save_path`` the records are written there as Parquet and read again."""
    rows = statistic_view(series, groups)
    told = {
        "sample_id": F.col(names or "sample_id").cast("string"), "channel_id": F.col("channel_id").cast("string"),
        "feature_groups": F.lit(",".join(groups) if groups else "all"), "num_features": F.size("statistic_view").cast("string"), **{k: F.lit(v) for k, v in (metadata or {}).items()},
    }
    record = F.struct(F.lit("statistic").alias("rep_type"), F.col("statistic_view").alias("payload"), F.create_map(*[x for k, v in told.items() for x in (F.lit(k), v)]).alias("metadata"))
    out = rows.select(*[F.col(f"`{c}`") for c in series.columns], F.when(F.col("statistic_view").isNotNull(), record).alias("record"))
    if save_path:
        out.write.mode("overwrite").parquet(save_path)
        out = series.sparkSession.read.schema(out.schema).parquet(save_path)
    return out


def batch_features(series: DataFrame, groups: list[str] | None = None, *, names: str = "sample_id", save_path: str | None = None) -> DataFrame:
    """(name, channel_id, a column for each feature, error): series without features have nulls and say why, instead of being left out. ``names``: a column of
    names, null in no row. With ``save_path`` the table is written there as Parquet and read again."""
    name = F.when(F.col(names).isNull(), F.raise_error(F.lit("a series has no name")).cast("string")).otherwise(F.col(names).cast("string"))
    df, columns = feature_columns(series, groups)
    error = F.when(F.coalesce(F.size("values"), F.lit(0)) <= 0, F.lit("empty series"))
    out = df.select(name.alias("name"), "channel_id", *[c.alias(snake(n)) for n, c in columns.items()], error.alias("error"))
    if save_path:
        out.write.mode("overwrite").parquet(save_path)
        out = series.sparkSession.read.schema(out.schema).parquet(save_path)
    return out
