"""Series: caps, splits, channels, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import point_label
from ..schema import non_negative, positive
from .positions import with_positions


def cap_per_split(series: DataFrame, n: int | None) -> DataFrame:
    """Samples whose position in their split is below ``n``; None keeps all."""
    return series if n is None else series.where(F.col("sample_index") < positive(n, "n"))


#: Rows that one task may rank; more are ranked by ranges.
RANK_IN_ONE = 100_000


def prefix_split(rows: DataFrame, ratio: float, *, order: str) -> DataFrame:
    """The rows with ``split``: the first int(n * ratio) by order are train, at least one and not all. A
    single row is in both splits, as two rows."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must be between 0 and 1")
    n = rows.count()
    if n <= 1:
        train = rows.withColumn("split", F.lit("train"))
        return train.unionByName(rows.withColumn("split", F.lit("test"))) if n else train
    cut = min(max(1, int(n * ratio)), n - 1)
    ranked = with_position(rows, order, n)
    return ranked.withColumn("split", F.when(F.col("__position") <= cut, "train").otherwise("test")).drop("__position")


def with_position(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The rows with ``__position``, from 1, by a column of any type. Few rows are ranked in one task, more by ranges."""
    if n > RANK_IN_ONE:
        return with_positions(rows, [order], name="__position").withColumn("__position", F.col("__position") + 1)
    return rows.withColumn("__position", F.row_number().over(Window.orderBy(order)).cast("long"))


def pick_channel(series: DataFrame, channel_id: int) -> DataFrame:
    """The rows of one channel. Samples with a single channel give it for any ``channel_id``; for others, a
    channel that isn't there is an error."""
    non_negative(channel_id, "channel_id")
    if "n_channels" not in series.columns:
        series = series.join(series.groupBy("sample_id", "split").agg(F.count("*").alias("n_channels")), ["sample_id", "split"])
    wanted = F.when(F.col("n_channels") == 1, F.lit(True)).otherwise(F.col("channel_id") == channel_id)
    beyond = (F.col("n_channels") > 1) & (F.lit(channel_id) >= F.col("n_channels"))
    checked = F.when(beyond, F.raise_error(F.concat(F.lit("no such channel in "), F.col("sample_id"))).cast("boolean")).otherwise(wanted)
    return series.where(checked)


def starts(length: Column, size: int, stride: int) -> Column:
    """0, stride, … as far as a whole window fits; none for a shorter series."""
    positive(size, "size")
    positive(stride, "stride")
    return F.when(length >= size, F.sequence(F.lit(0), length - size, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def sliding_windows(sequences: DataFrame, *, size: int, stride: int, rule: str = "any", threshold: float = 0.1) -> DataFrame:
    """Windows of point-labelled sequences with their labels: sample_id ``<id>__w<start>_<end>``, start, end,
    channels, point_labels, label and what other columns there were. A sequence without labels is an error."""
    point_label(F.lit(None).cast("array<int>"), rule, threshold)
    length = F.size("point_labels")
    missing = F.col("point_labels").isNull()
    checked = F.when(missing, F.raise_error(F.concat(F.lit("no point labels: "), F.col("sample_id"))).cast("array<int>")).otherwise(starts(length, size, stride))
    rest = [c for c in sequences.columns if c not in ("sample_id", "channels", "point_labels")]
    out = sequences.select(*rest, F.col("sample_id").alias("sequence_id"), "channels", "point_labels", F.explode(checked).alias("start"))
    cut = lambda x: F.slice(x, F.col("start") + 1, F.lit(size))
    return out.select(
        F.concat("sequence_id", F.lit("__w"), F.col("start").cast("string"), F.lit("_"), (F.col("start") + size).cast("string")).alias("sample_id"),
        "sequence_id",
        "start",
        (F.col("start") + size).alias("end"),
        F.transform("channels", cut).alias("channels"),
        cut(F.col("point_labels")).alias("point_labels"),
        *rest,
    ).withColumn("label", point_label("point_labels", rule, threshold))


#: Points of a chunk, in windows and at least, besides those that the windows that start in it need of the next one. Each window's row is cut from a copy of its chunk.
CHUNK_WINDOWS, CHUNK = 2, 512


def _chunks(points: DataFrame, *, size: int, stride: int, values: list[str], by: list[str], at: str) -> tuple[DataFrame, int]:
    """(``by``, __chunk, __points in their order), and how many points lie between the starts of two chunks."""
    length = max(1, max(CHUNK, CHUNK_WINDOWS * size) // stride) * stride
    chunk = F.floor(F.col(at) / length)
    reach = -(-size // length)  # chunks that a window may reach into
    homes = F.filter(F.sequence(F.greatest(chunk - reach, F.lit(0)), chunk), lambda c: (c == chunk) | (F.col(at) - c * length < length - stride + size))
    dealt = points.select(*by, F.explode(homes).alias("__chunk"), F.struct(F.col(at).alias("__at"), *values).alias("__point"))
    return dealt.groupBy(*by, "__chunk").agg(F.array_sort(F.collect_list("__point")).alias("__points")), length


def point_windows(points: DataFrame, *, size: int, stride: int, values: list[str], by: list[str], at: str = "t") -> DataFrame:
    """Windows of series that are tables of points, at positions 0, 1, ... of ``at`` for each value of the columns ``by``: those columns, start, end and, for each
    of the columns ``values``, an array of the window's points. A series shorter than a window has none.

    Points are dealt into chunks, each with the first points of the next, so that a series needn't fit a row or a task: a row holds
    some windows' points.
    """
    positive(size, "size")
    positive(stride, "stride")
    held, length = _chunks(points, size=size, stride=stride, values=values, by=by, at=at)
    offsets = F.sequence(F.lit(0), F.least(F.size("__points") - size, F.lit(length - stride)), F.lit(stride))
    fits = F.size("__points") >= size
    out = held.where(fits).select(*by, "__chunk", "__points", F.explode(offsets).alias("__off"))
    window = F.slice("__points", F.col("__off") + 1, F.lit(size))
    start = F.col("__chunk") * length + F.col("__off")
    return out.select(*by, start.alias("start"), (start + size).alias("end"), *[window.getField(v).alias(v) for v in values])


def windows_1d(series: DataFrame, *, size: int, stride: int, values: str = "values") -> DataFrame:
    """Windows of plain series: the rows with start and the window's values. A series shorter than a window is an error."""
    length = F.size(values)
    short = F.when(length < size, F.raise_error(F.lit("series is shorter than the window")).cast("array<int>")).otherwise(starts(length, size, stride))
    rest = [F.col(f"`{c}`") for c in series.columns if c != values]
    out = series.select(*rest, F.col(values).alias("__values"), F.explode(short).alias("start"))
    return out.withColumn(values, F.slice("__values", F.col("start") + 1, F.lit(size))).drop("__values")


def feature_columns_of(columns: list[str], drop: tuple[str, ...]) -> list[str]:
    """The columns that aren't dropped, in their order; none left is an error."""
    if not (kept := [c for c in columns if c not in set(drop)]):
        raise ValueError("no feature columns left")
    return kept


def collate(series: DataFrame) -> DataFrame:
    """One row per sample: ``channels`` (channel x time, by channel) and the label. Bounded by a sample's channels."""
    return series.groupBy("sample_id", "split", "sample_index", "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("channel_id", "values"))), lambda c: c["values"]).alias("channels")
    )


def describe_modes(series: DataFrame) -> DataFrame:
    """Of each sample: number of channels, length and whether it is univariate."""
    return series.groupBy("sample_id", "split").agg(
        F.count("*").alias("n_channels"),
        F.max(F.size("values")).alias("length"),
        F.when(F.count("*") == 1, "univariate").otherwise("multivariate").alias("data_mode"),
    )
