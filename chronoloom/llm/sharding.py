"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of one text are a group, and groups are what is placed: in descending order of their greatest share, each where the dot product of
its (bytes, tokens, rows) with what a shard has left of them is highest. Three rounds do that, so that no task sees all groups:

1. groups of a large share of any measure, of which there are a bounded number, on the driver; a group of more than a
   quarter of a shard is cut into pieces by the ids of its rows, since no shard could hold it;
2. all others in cells, dealt by a hash of the text, each on its own with its share of what the first round left;
3. a small part that the second round leaves out, against what the shards really hold by then, which levels what the cells'
   roundings add up to.

Rows carry a few numbers here and never their text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import Scratch, column, utf8

#: Rows of a cell while there are fewer than MAX_CELLS, and rows of the last round.
CELL_ROWS, LAST_ROWS = 8192, 8192
MAX_CELLS = 16_384
MEASURES = ("size", "tokens", "rows")
BITS = 20
#: Weights of the measures in the last round: sizes are what is promised to be near equal.
LAST = np.array([8.0, 1.0, 1.0])


def place(vectors: np.ndarray, left: np.ndarray, weights: np.ndarray | float = 1.0) -> np.ndarray:
    """The shard of each vector. ``vectors``: (n, measures); ``left``: (shards, measures), what each shard may still take. Both are
    in shares of the totals; ``weights`` of the measures in the dot product. Ties go to the lower shard; vectors of the same greatest share keep their order."""
    left = left.copy()
    out = np.zeros(len(vectors), dtype=np.int64)
    weighted = vectors * weights
    for i in np.argsort(-vectors.max(axis=1), kind="stable").tolist() if len(vectors) else ():
        v = vectors[i]
        s = int((left @ weighted[i]).argmax())
        left[s] -= v
        out[i] = s
    return out


def _placer(schema: StructType, unit: np.ndarray, left: np.ndarray, whole: bool) -> Callable[[pa.Table], pa.Table]:
    """Shards and numbers within them of the rows of a cell. Rows that have a shard keep it. ``left``: what the shards may take
    of all such cells together, or, if ``whole``, of this one."""
    room = np.maximum(left, 0)
    room = room / np.maximum(room.sum(axis=0), 1e-300)

    def of(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("group", "ascending"), (cell.column_names[0], "ascending")])
        group = cell["group"].to_numpy()
        fixed = pc.fill_null(cell["fixed"], -1).to_numpy().astype(np.int64)
        values = np.stack([cell["size"].to_numpy(), cell["tokens"].to_numpy(), np.ones(cell.num_rows)], axis=1) / unit
        free = np.flatnonzero(fixed < 0)
        shard = fixed.copy()
        if len(free):
            first = np.flatnonzero(np.diff(group[free], prepend=group[free][0] - 1))
            vectors = np.add.reduceat(values[free], first)
            mine = left if whole else room * vectors.sum(axis=0)
            shard[free] = np.repeat(place(vectors, mine, LAST if whole else 1.0), np.diff(np.append(first, len(free))))
        order = np.argsort(shard, kind="stable")
        sizes = np.bincount(shard)
        at = np.empty(len(shard), dtype=np.int64)
        at[order] = np.arange(len(shard)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = cell.select([n for n in schema.names if n not in ("shard", "at")])
        return kept.append_column("shard", pa.array(shard.astype(np.int32))).append_column("at", pa.array(at)).select(schema.names)

    return of


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``size`` (UTF-8 bytes and 1), ``tokens`` (runs of anything but white space), ``crc`` and ``group`` (a 64-bit hash of the text; two texts with one
    hash would only be kept together). A null text has no bytes."""
    text = F.coalesce(utf8(text_col), F.lit(b""))
    return docs.select(
        column(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.coalesce(F.regexp_count(column(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("group"),
    )


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))


def _vectors(rows: list) -> np.ndarray:
    return np.array([[r["size"] or 0, r["tokens"] or 0, r["rows"] or 0] for r in rows], dtype=float).reshape(-1, 3)


def _large(total: np.ndarray, share: float) -> Column:
    """Whether a group has more than this share of any measure."""
    over = F.lit(False)
    for name, whole in zip(MEASURES, total.tolist(), strict=True):
        over = over | (F.col(name) > whole * share)
    return over


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16) -> DataFrame:
    """A row per document: its id, ``size``, ``tokens``, ``text_crc32``, ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (0, 1, ... in its shard).

    Bytes, tokens and rows of the shards are nearly equal: as near as single documents allow. Equal texts share a shard unless they are
    more than a quarter of one. Null and empty texts are one group of size 1 each; rows with null ids and repeated
    rows are placed like others (rows of one id and text together); other columns are ignored; an empty table gives an empty result.

    Only numbers are shuffled: once by the text's hash to find large groups, after partial sums, and once into cells.
    The driver gets at most ``3 * n_shards * MAX_CELLS`` sums of large groups, fewer than one for each 100 rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    rows = scratch.write(measured(docs, id_col, text_col), "measured")
    id_type = docs.schema[id_col].dataType
    placed = StructType([StructField("id", id_type), *(StructField(c, LongType()) for c in ("size", "tokens", "crc")), StructField("cell", LongType()), StructField("shard", IntegerType()), StructField("at", LongType())])
    total = _vectors(_sums(rows).collect())[0]
    n = int(total[2])
    unit = np.maximum(total, 1)
    cells = min(MAX_CELLS, max(1, -(-n // CELL_ROWS)))

    # 1: large groups, cut where no shard could hold them
    large = _sums(rows, "group").where(_large(total, 1 / (n_shards * cells)))
    large = large.withColumn("pieces", F.ceil(F.greatest(*(F.col(c) / float(u) for c, u in zip(MEASURES, unit, strict=True))) * (4 * n_shards)))
    large = scratch.write(large.withColumn("pieces", F.when(F.col("rows") > 1, F.least("pieces", "rows")).otherwise(1).cast("long")), "large")
    piece = F.pmod(F.xxhash64("id"), "pieces").alias("piece")
    cut = _sums(rows.join(F.broadcast(large.where("pieces > 1").select("group", "pieces")), "group").select("*", piece), "group", "piece")
    pieces = sorted(large.where("pieces = 1").select("group", F.lit(0).cast("long").alias("piece"), *MEASURES).unionByName(cut).collect())
    level = np.tile(total / unit / n_shards, (n_shards, 1))
    vectors = _vectors(pieces) / unit
    chosen = place(vectors, level)
    left = level - np.stack([np.bincount(chosen, vectors[:, k], n_shards) for k in range(3)], axis=1) if pieces else level
    fixed = spark.createDataFrame(
        [(r.group, r.piece, s) for r, s in zip(pieces, chosen.tolist(), strict=True)], StructType([StructField("group", LongType()), StructField("piece", LongType()), StructField("fixed", IntegerType())])
    )

    # 2: the others, but for a part, in cells; rows of large groups are spread over them to be numbered
    of = rows.join(F.broadcast(large.select("group", "pieces")), "group", "left").withColumn("piece", piece)
    of = of.join(F.broadcast(fixed), ["group", "piece"], "left").select("id", "size", "tokens", "crc", "group", "fixed")
    share = int(min(1 / 4, LAST_ROWS / max(n, 1)) * (1 << BITS)) or 1
    later = F.col("fixed").isNull() & (F.pmod(F.xxhash64("group", F.lit("last")), F.lit(1 << BITS)) < share)
    cell = F.when(later, F.lit(cells)).otherwise(F.pmod(F.when(F.col("fixed").isNull(), F.xxhash64("group", F.lit("cell"))).otherwise(F.xxhash64("id")), F.lit(cells)))
    of = of.withColumn("cell", cell.cast("long"))
    first = scratch.write(of.where(F.col("cell") < cells).groupBy("cell").applyInArrow(_placer(placed, unit, left, False), placed), "first")

    # 3: the part left out, against what the shards hold
    held = {r.shard: r for r in _sums(first, "shard").collect()}
    none = {c: 0 for c in MEASURES}
    left = level - _vectors([held.get(s, none) for s in range(n_shards)]) / unit
    last = scratch.write(of.where(F.col("cell") == cells).groupBy("cell").applyInArrow(_placer(placed, unit, left, True), placed), "last")

    every = first.unionByName(last)
    # a row for each cell and shard: at most 16 * MAX_CELLS with 16 shards
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = every.groupBy("cell", "shard").agg(F.count("*").alias("n")).select("cell", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start"))
    out = every.join(F.broadcast(starts), ["cell", "shard"])
    return out.select(F.col("id").alias(id_col), "size", "tokens", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("at")).alias("slot"))


def shard_report(docs: DataFrame, **options) -> DataFrame:
    """``shard_documents`` with the law that its shards keep, ``bytes``: sizes are near equal."""
    found = shard_documents(docs, **options)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
