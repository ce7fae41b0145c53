"""Exact neighbours of many queries, with blocks of the gallery left out by their distances to pivots.

Some gallery vectors are pivots. Each entry belongs to the block of its nearest pivot (and channel), and a block keeps the least and
greatest distance of its entries to the pivot. By the triangle inequality a query is at least d(query, pivot) - greatest, and least - d(query, pivot), from all of
a block; and the plane between two pivots parts their entries. Each query is compared with its nearest block first; its k-th distance there then says which other blocks can hold a neighbour,
and only with those is it compared. Cosine distances are bounded on unit vectors, whose distance squared is twice the cosine distance.

Blocks stay what a task holds: a cell of too many entries is several blocks, and the queries of a block that too many ask are dealt out, with a
copy of the block for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Distance
from ..session import shared_folder

if TYPE_CHECKING:
    from .retrieval import Search

#: At most so many pivots; blocks for each block that the gallery's size asks for.
PIVOTS, FINER = 2048, 4
#: Vectors of at most so many dimensions have blocks of so many entries of a channel: few of them are near a query.
LOW, FEW_ENTRIES = 16, 512
#: By what bounds and distances may be off.
SLACK = 4e-9
ENTRY = ["entry_id", "sample_id", "label", "channel_id", "ord", "v"]
ASKED = ["query_id", "sample_id", "channel_id", "v"]


def _points(search: Search, vectors: list | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Points whose distances can be bounded, and which vectors have none (of length 0, for cosines)."""
    x = search.prepare(vectors)
    if not np.isfinite(x).all():
        raise ValueError("a distance is not finite")
    if search.config.distance is not Distance.COSINE:
        return x, np.zeros(len(x), dtype=bool)
    norm = np.linalg.norm(x, axis=1)
    return np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0), norm == 0


def _apart(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all points to all pivots, by a matrix product about the pivots' middle, and by how much they may be off for each point."""
    middle = pivots.mean(axis=0)
    x, p = x - middle, pivots - middle
    xx, pp = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", p, p)
    out = np.empty((len(x), len(p)))
    for lo in range(0, len(x), 256):
        out[lo : lo + 256] = np.sqrt(np.maximum(xx[lo : lo + 256, None] + pp[None] - 2 * x[lo : lo + 256] @ p.T, 0))
    return out, 2 * np.sqrt(2.3e-16 * (x.shape[1] + 4)) * (np.sqrt(xx) + np.sqrt(pp.max()))


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession, 'pivots')}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Blocks:
    """The gallery dealt into blocks, and what bounds them."""

    def __init__(self, gallery: DataFrame, search: Search, chunk: int):
        spark, self.search, self.chunk = gallery.sparkSession, search, chunk
        self.known = None
        sizes = [r["count"] for r in gallery.groupBy("channel_id").count().collect()]
        most = max(1, min(PIVOTS, chunk // search.width))
        wanted = -(-max(sizes) // FEW_ENTRIES) if search.width <= LOW else 0
        wanted = min(most, max(1, wanted, -(-sum(sizes) * search.width * FINER // chunk)))
        chosen = gallery.where("v is not null").orderBy(F.xxhash64("entry_id"), "ord").select("v").limit(wanted).collect()
        points, none = _points(search, [r.v for r in chosen])
        self.pivots = points[~none] if (~none).any() else np.zeros((1, search.width))
        cells = "entry_id string, sample_id string, label string, channel_id int, ord long, v array<double>, cell int, low double, high double"

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, none_ = _points(search, b.column(5))
                d, off = _apart(x, pivots)
                cell, r = np.where(none_, -1, d.argmin(axis=1)), d.min(axis=1)
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(b.column(i).cast(t) for i, t in enumerate(kinds)), pa.array(cell.astype(np.int32)), pa.array(r - off), pa.array(r + off)], names=[*ENTRY, "cell", "low", "high"])

        pivots = self.pivots
        dealt = _kept(gallery.select(*ENTRY).mapInArrow(deal, cells), "gallery")
        # a row for each cell and channel
        stats = dealt.groupBy(F.coalesce("channel_id", F.lit(-1)).alias("channel"), "cell").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("channel", "cell").collect()
        self.channel = np.array([s.channel for s in stats], dtype=np.int64)
        self.cell = np.array([s.cell for s in stats], dtype=np.int64)
        self.low, self.high = (np.array([s[c] for s in stats], dtype=float) for c in ("low", "high"))
        self.n = np.array([s.n for s in stats], dtype=np.int64)
        self.parts = np.array([-(-s.n * search.width // chunk) for s in stats], dtype=np.int64)
        places = spark.createDataFrame([(int(s.channel), int(s.cell), i, int(p)) for i, (s, p) in enumerate(zip(stats, self.parts, strict=True))], "channel int, of int, block int, parts int")
        key = F.coalesce(dealt.channel_id, F.lit(-1))
        self.entries = dealt.join(places, (key == places.channel) & (dealt.cell == places.of)).select(*ENTRY, "block", F.pmod(F.xxhash64("entry_id"), F.col("parts")).cast("int").alias("part"))

    def bounds(self, asked: pa.RecordBatch) -> np.ndarray:
        """For rows (query_id, sample_id, channel_id, vector): the least distance, in the points' space, to each block; infinite for blocks of other channels. Blocks of
        entries without a point, and all blocks for queries without one, are at 0."""
        x, none = _points(self.search, asked.column(3))
        d, off = _apart(x, self.pivots)
        between, beyond = self._between()
        home = d.argmin(axis=1)
        named = pc.fill_null(asked.column(2).cast(pa.int32()), -1).to_numpy(zero_copy_only=False) if self.search.config.by_channel else np.full(len(x), -1)
        out = np.full((len(x), len(self.cell)), np.inf)
        for c in np.unique(named):
            rows, cols = np.flatnonzero(named == c), np.arange(len(self.cell)) if c < 0 else np.flatnonzero(self.channel == c)
            cell, h = np.maximum(self.cell[cols], 0), home[rows]
            to, own, o = d[np.ix_(rows, cell)], d[rows, h][:, None], off[rows][:, None]
            ring = np.maximum(to - self.high[cols] - o, self.low[cols] - to - o)
            # entries of another cell are no nearer to the pivot of the query's cell than to their own
            apart = between[np.ix_(h, cell)]
            slack = 4 * (o + beyond[cols]) * (to + own + 2 * np.abs(self.high[cols]) + apart)
            half = np.divide(to * to - own * own - slack, 2 * apart, out=np.zeros_like(to), where=apart > 0)
            low = np.maximum(np.maximum(ring, half * (1 - 1e-9) - 1e-12), 0)
            low[:, self.cell[cols] < 0] = 0
            low[none[rows]] = 0
            out[np.ix_(rows, cols)] = low
        return out

    def _between(self) -> tuple[np.ndarray, np.ndarray]:
        """Distances of pivots to each other, and by how much those of a block's entries to pivots may be off."""
        if self.known is None:
            p = self.pivots - self.pivots.mean(axis=0)
            far = np.sqrt(np.einsum("ij,ij->i", p, p))
            apart, off = _apart(self.pivots, self.pivots)
            at = np.maximum(self.cell, 0)
            # shorter ones may be nothing but errors
            self.known = np.where(apart > 1e3 * off.max(), apart, 0), 2 * np.sqrt(2.3e-16 * (p.shape[1] + 4)) * (far[at] + np.abs(self.high) + far.max())
        return self.known

    def near(self, distance: np.ndarray) -> np.ndarray:
        """Distances as those of points, not less."""
        return np.sqrt(2 * distance + SLACK) + SLACK if self.search.config.distance is Distance.COSINE else distance + SLACK * (1 + distance)


def _pairs(asked: DataFrame, blocks: Blocks, first: bool) -> DataFrame:
    """(query_id, block): the nearest block of each query (``asked``: ASKED); or, given ``kth`` (null where there are fewer) and ``home`` too, all
    others that can hold something nearer."""
    light = _Light(blocks)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), dtype=object)
            for lo in range(0, b.num_rows, 1024):
                some = b.slice(lo, 1024)
                bound = light.bounds(some)
                if first:
                    # the nearest of those with entries enough, if there is one
                    full = np.where((light.n > light.search.config.top_k) & (light.cell >= 0), bound, np.inf)
                    home = np.where(np.isfinite(full.min(axis=1)), full.argmin(axis=1), bound.argmin(axis=1))
                    found = np.flatnonzero(np.isfinite(bound.min(axis=1)))
                    cols = home[found]
                else:
                    kth = np.array([np.inf if v is None else v for v in some.column(4).to_pylist()])
                    home = np.array([-1 if v is None else v for v in some.column(5).to_pylist()])
                    reach = np.where(np.isfinite(kth), light.near(np.where(np.isfinite(kth), kth, 0)), np.inf)
                    found, cols = np.nonzero((bound <= reach[:, None]) & np.isfinite(bound) & (np.arange(bound.shape[1])[None] != home[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + found].tolist(), pa.string()), pa.array(cols.astype(np.int32))], names=["query_id", "block"])

    return _kept(asked.mapInArrow(choose, "query_id string, block int"), "pairs")


class _Light:
    """What of the blocks goes to the workers."""

    def __init__(self, blocks: Blocks):
        for name in ("search", "pivots", "channel", "cell", "low", "high", "n"):
            setattr(self, name, getattr(blocks, name))
        self.known = None

    bounds, near, _between = Blocks.bounds, Blocks.near, Blocks._between


def _meet(pairs: DataFrame, asked: DataFrame, blocks: Blocks) -> DataFrame:
    """The best of each pair of query and block."""
    from .retrieval import FOUND, Asked

    search = blocks.search
    counts = pairs.groupBy("block").agg(F.ceil(F.count("*") * search.width / blocks.chunk).cast("int").alias("turns"))
    turn = F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int").alias("lt")
    parts = blocks.entries.groupBy("block").agg((F.max("part") + 1).alias("n"))
    dealt = pairs.join(counts, "block").join(parts, "block").select("query_id", F.col("block").alias("lb"), turn, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("lp"))
    left = dealt.join(asked.select(*[F.col(c).alias(f"q{i}") for i, c in enumerate(ASKED)]), F.col("query_id") == F.col("q0")).drop("query_id")
    right = blocks.entries.join(counts, "block").select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(ENTRY)], F.col("block").alias("rb"), F.col("part").alias("rp"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("rt"))

    def meet(left_: pa.Table, right_: pa.Table) -> pa.Table:
        found = []
        if left_.num_rows and right_.num_rows:
            best = Asked(search, left_.select([f"q{i}" for i in range(4)]))
            for batch in right_.select([f"g{i}" for i in range(6)]).to_batches():
                best.meet(batch)
            found = best.result()
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64()]
        return pa.Table.from_batches(found, pa.schema(list(zip(["query_id", *ENTRY[:5], "distance"], kinds, strict=True))))

    return left.groupBy("lb", "lp", "lt").cogroup(right.groupBy("rb", "rp", "rt")).applyInArrow(meet, FOUND)


def pruned_neighbours(asked: DataFrame, gallery: DataFrame, search: Search, *, chunk: int, told: dict | None = None) -> DataFrame:
    """The best of each query among the blocks that can hold them (``FOUND``, before ranks). ``told`` gets the number of ``blocks`` and the frames of
    pairs of the two rounds."""
    blocks = Blocks(gallery, search, chunk)
    asked = asked.select(F.col("query_id").cast("string").alias("query_id"), *ASKED[1:3], F.col("v").cast("array<double>").alias("v"))
    asked = _kept(asked, "asked")
    home = _pairs(asked, blocks, True)
    found = _kept(_meet(home, asked, blocks), "found")
    k = search.config.top_k
    nearest = F.sort_array(F.collect_list("distance"))  # k for each part of a block
    kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.get(nearest, F.lit(k - 1))).alias("kth"))
    more = asked.join(kth, "query_id", "left").join(home.withColumnRenamed("block", "home"), "query_id", "left")
    rest = _pairs(more.select(*ASKED, "kth", "home"), blocks, False)
    if told is not None:
        told.update(blocks=len(blocks.cell), first=home, second=rest)
    return found.unionByName(_meet(rest, asked, blocks))
