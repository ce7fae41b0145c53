"""Text files whose order of lines has a meaning, read by many tasks.

Spark's reader cuts files into blocks at line ends, so one file is read by as many tasks as it has blocks, from any store. A task
reads a block's lines one after the other; how many lines the blocks before have is a sum over a table of blocks. Lines are written once, with
block and place, before they are counted: numbers can't change with how a later scan would be cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def numbered(lines: DataFrame, *, block: list[str], within: list[str], label: str) -> DataFrame:
    """The rows with ``line_no``, from 0, in place of ``at``. ``lines`` have ``at``, ascending by one within each ``block`` (columns that sort as blocks follow
    each other); numbers begin anew for each value of the columns ``within``. Written to the shared folder first."""
    spark = lines.sparkSession
    folder = f"{shared_folder(spark, label)}/lines"
    lines.write.parquet(folder)
    held = spark.read.schema(lines.schema).parquet(folder)
    blocks = held.groupBy(*block).agg(F.min("at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy(*[c for c in block if c not in within]).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each block: some hundred thousand in 100 TB
    starts = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    out = held.join(starts, block)
    return out.withColumn("line_no", F.col("__before") + F.col("at") - F.col("__first")).drop("__before", "__first", "at")


def ordered_lines(spark: SparkSession, paths: str | list[str], *, by_file: bool = False, comment: str | None = None) -> DataFrame:
    """(path, line_no, line): the lines that aren't blank, nor begin with ``comment``, numbered from 0: through all files as one, in the order of their
    names, or for each file. A folder is read as its files."""
    paths = [paths] if isinstance(paths, str) else paths
    read = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    kept = read.where(F.trim("line") != "")
    if comment:
        kept = kept.where(~F.ltrim("line").startswith(comment))
    kept = kept.withColumns({"at": F.monotonically_increasing_id(), "size": F.length("path")})
    # names of parts grow with their number
    out = numbered(kept, block=["size", "path", "block"], within=["size", "path"] if by_file else [], label="lines")
    return out.select("path", "line_no", "line")


def place_of(path: Column | str, root: str) -> Column:
    """The part of a file's name, as Spark tells it, after ``root``, without escapes."""
    path = F.col(path) if isinstance(path, str) else path
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    plain, root = (F.regexp_replace(x, "^([a-z0-9]+):/+", r"$1:/") for x in (plain, F.lit(root.rstrip("/") + "/")))
    return F.substring(plain, F.length(root) + 1, F.length(plain))
