"""Positions in a global order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ordered import numbered


def with_positions(rows: DataFrame, order: Sequence[str], *, by: Sequence[str] = (), name: str = "position", partitions: int | None = None) -> DataFrame:
    """The rows with their position, from 0, by ``order`` (columns of any type that sorts), for each value of ``by``. Nulls come first. Rows that are equal
    there are told apart by two hashes of all columns, so that neither ties nor a value that most rows have make one task long; rows
    that are equal in all columns are dealt positions arbitrarily.

    Rows are dealt by ranges, sorted, and written; a position is the number of rows in the ranges before and the place in its own.
    """
    keys = [*by, *order]
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    ties = rows.withColumns({"__one": F.xxhash64(whole), "__two": F.hash(whole)})
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ties.repartitionByRange(n, *[F.col(f"`{c}`") for c in keys], "__one", "__two").sortWithinPartitions(*[F.col(f"`{c}`") for c in keys], "__one", "__two")
    ranged = ranged.drop("__one", "__two").withColumn("at", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("at", 33))
    out = numbered(ranged, block=["__range"], within=[], label="positions").drop("__range")
    if by:
        first = out.groupBy(*by).agg(F.min("line_no").alias("__from"))
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
        on = same[0]
        for more in same[1:]:
            on = on & more
        out = out.alias("l").join(first.alias("r"), on).select("l.*", (F.col("line_no") - F.col("__from")).alias("__no")).withColumn("line_no", F.col("__no")).drop("__no")
    return out.withColumnRenamed("line_no", name)

