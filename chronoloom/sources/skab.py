"""Point-labelled sensor files: semicolon separated, with a header, a column of point labels and one
column for each channel."""

from __future__ import annotations

from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import point_label
from ..functions.text import sample_id_of_path
from ..operators.series import point_windows, prefix_split
from .ordered import ordered_lines, place_of
from .store import Store
from .ucr import Dataset


def list_files(spark: SparkSession, base_dir: str | Path, *, csv_glob: str = "*.csv", subdirs: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """(rel, seq_index): the files under ``base_dir``, in the order of their paths' parts. Of ``subdirs`` only files whose first folder is
    named are kept; ``max_files`` is counted after that."""
    names = sorted(p for p in map(PurePosixPath, Store(spark, base_dir).walk()) if p.match(csv_glob))
    if subdirs is not None:
        names = [p for p in names if len(p.parts) > 1 and p.parts[0] in set(subdirs)]
    names = names[:max_files]
    if not names:
        raise FileNotFoundError(f"no files {csv_glob} in {base_dir}")
    return spark.createDataFrame([(str(p), i) for i, p in enumerate(names)], "rel string, seq_index long")


def scan_points(
    spark: SparkSession,
    base_dir: str | Path,
    files: DataFrame,
    *,
    label_col: str = "anomaly",
    time_col: str | None = "datetime",
    changepoint_col: str | None = "changepoint",
    drop_columns: tuple[str, ...] = (),
    sep: str = ";",
) -> DataFrame:
    """One row per point of ``files`` (rel, and what else they have): the files' columns, sample_id, feature_columns, ``t`` (from 0, in the order
    of the lines), ``values`` (a number for each feature column) and ``point_label``. A file is read by as many tasks as it has blocks."""
    root = Store(spark, base_dir)
    rels = sorted({r.rel for r in files.select("rel").collect()})  # a file may be in both splits
    lines = ordered_lines(spark, [f"{root}/{rel}" for rel in rels], by_file=True)
    lines = lines.withColumn("rel", place_of("path", root.full)).drop("path")
    dropped = [label_col, *[c for c in (time_col, changepoint_col) if c], *drop_columns]

    def fail(test: Column, message: str, out: Column) -> Column:
        return F.when(test, F.raise_error(F.concat(F.lit(message), F.col("rel"))).cast("array<string>")).otherwise(out)

    # a row for each file
    heads = lines.where("line_no = 0").select("rel", F.transform(F.split("line", sep), lambda x: F.trim(x)).alias("header"))
    heads = heads.join(lines.groupBy("rel").agg(F.max("line_no").alias("points")), "rel").join(files, "rel")
    heads = heads.withColumn("header", fail(F.array_position("header", label_col) == 0, f"no column {label_col} in ", F.col("header")))
    heads = heads.withColumn("header", fail(F.col("points") == 0, "no rows in ", F.col("header")))
    heads = heads.withColumn("feature_columns", F.filter("header", lambda h: ~h.isin(dropped)))
    heads = heads.withColumn("feature_columns", fail(F.size("feature_columns") == 0, "no feature columns in ", F.col("feature_columns")))
    places = F.transform("feature_columns", lambda h: F.array_position("header", h).cast("int") - 1)
    heads = heads.withColumns({"places": places, "label_place": F.array_position("header", label_col).cast("int") - 1}).drop("header", "points")
    # from the files' side, so that the error of a file without rows is met
    points = heads.join(lines.where("line_no > 0"), "rel", "left").withColumn("cells", F.split("line", sep))
    return points.select(
        *files.columns,
        sample_id_of_path("rel").alias("sample_id"),
        "feature_columns",
        (F.col("line_no") - 1).alias("t"),
        F.transform("places", lambda p: F.get("cells", p).cast("double")).alias("values"),
        F.get("cells", F.col("label_place")).cast("double").cast("int").alias("point_label"),
    )


def _channels(values: Column) -> Column:
    """From an array of points' values an array for each channel."""
    return F.transform(F.sequence(F.lit(0), F.size("feature_columns") - 1), lambda j: F.transform(values, lambda v: F.get(v, j)))


def _sequences(points: DataFrame) -> DataFrame:
    by = [c for c in points.columns if c not in ("t", "values", "point_label")]
    whole = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", "values", "point_label"))).alias("__points"))
    rest = [c for c in by if c not in ("sample_id", "seq_index", "feature_columns", "rel")]
    return whole.select(
        "sample_id", "seq_index", "feature_columns", _channels(F.col("__points.values")).alias("channels"), F.col("__points.point_label").alias("point_labels"), *rest
    )


_LISTED = ("csv_glob", "subdirs", "max_files")


def _listed(spark: SparkSession, base_dir: str | Path, options: dict) -> tuple[DataFrame, dict]:
    files = list_files(spark, base_dir, **{k: v for k, v in options.items() if k in _LISTED})
    return files, {k: v for k, v in options.items() if k not in _LISTED}


def scan_sequences(spark: SparkSession, base_dir: str | Path, **options) -> DataFrame:
    """One row per file under ``base_dir``: sample_id (its path), seq_index (its place in the order of the paths'
    parts), feature_columns, channels and point_labels. Options are those of ``list_files`` and ``scan_points``. A row holds a file's numbers."""
    files, scan = _listed(spark, base_dir, options)
    return _sequences(scan_points(spark, base_dir, files, **scan))


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("sample_id", "split", "sample_index", F.posexplode("channels").alias("channel_id", "values"), F.col("label").cast("string").alias("label"))


def _split_points(spark: SparkSession, base_dir: str | Path, train_ratio: float, options: dict) -> DataFrame:
    """Points with ``split`` and the ``place`` of their file in it: files are split, so that no file is on both sides."""
    files, scan = _listed(spark, base_dir, options)
    files = prefix_split(files, train_ratio, order="seq_index")
    first = files.groupBy("split").agg(F.min("seq_index").alias("first"))
    files = files.join(first, "split").select("rel", "seq_index", "split", (F.col("seq_index") - F.col("first")).alias("place"))
    return scan_points(spark, base_dir, files, **scan)


def load_skab_sequences(spark: SparkSession, base_dir: str | Path, *, train_ratio: float = 0.5, rule: str = "any", threshold: float = 0.1, max_samples_per_split: int | None = None, **scan) -> Dataset:
    """A sample for each file, labelled from its points."""
    rows = _sequences(_split_points(spark, base_dir, train_ratio, scan)).withColumnRenamed("place", "sample_index")
    rows = rows.withColumn("label", point_label("point_labels", rule, threshold))
    if max_samples_per_split:
        rows = rows.where(F.col("sample_index") < max_samples_per_split)
    return Dataset("skab_sequence", _long(rows))


def load_skab_windows(spark: SparkSession, base_dir: str | Path, *, train_ratio: float = 0.5, window_size: int = 60, stride: int = 10, rule: str = "any", threshold: float = 0.1, max_samples_per_split: int | None = None, **scan) -> Dataset:
    """A sample for each window of points, labelled from them and numbered through the files of its split. Neither a task nor a row
    holds a file; a file shorter than a window gives none."""
    points = _split_points(spark, base_dir, train_ratio, scan)
    by = ["split", "place", "sample_id", "feature_columns"]
    wins = point_windows(points, size=window_size, stride=stride, values=["values", "point_label"], by=by)
    # a row for each file
    n = points.groupBy("split", "place").agg(F.max("t").alias("last")).withColumn("n", F.greatest(F.lit(0), F.floor((F.col("last") + 1 - window_size) / stride) + 1))
    before = Window.partitionBy("split").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("split", "place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    wins = wins.join(n, ["split", "place"]).withColumn("sample_index", (F.col("before") + F.col("start") / stride).cast("long"))
    name = F.concat("sample_id", F.lit("__w"), F.col("start").cast("string"), F.lit("_"), F.col("end").cast("string"))
    wins = wins.withColumns({"channels": _channels(F.col("values")), "label": point_label("point_label", rule, threshold), "sample_id": name})
    if max_samples_per_split:
        wins = wins.where(F.col("sample_index") < max_samples_per_split)
    return Dataset("skab_window", _long(wins))
