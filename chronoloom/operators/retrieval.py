"""Nearest neighbours: normalization statistics, exact top-k, confidence.

Queries meet the gallery in blocks. A bounded set of queries goes to all workers, each keeps the best k of its part of the
gallery, and only those are shuffled; the gallery is not moved. More queries meet, in blocks, those blocks of the gallery that can hold a neighbour
(``pivots``). No frame of all pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import confidence, signed_log1p
from ..schema import Distance, Normalization, RetrieverConfig
from .quantiles import exact_quantiles

#: Values of the queries that are sent to the workers, and of a block of queries or gallery that a task holds: 32 MB.
CHUNK_VALUES = 4_000_000
#: Rows that are compared at a time.
ROWS = 512
#: Neighbours that a task holds, besides the best of each query, before it drops what can't be among these.
PENDING = 500_000
#: Distances are compared to so many places, so that ties don't hang on the order of a sum.
PLACES = 9


@dataclass(frozen=True)
class Scaling:
    """(x - centre) / scale for each dimension, after a signed logarithm if asked."""

    centre: tuple[float, ...] | None = None
    scale: tuple[float, ...] | None = None
    log: bool = False

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.log:
            x = np.sign(x) * np.log1p(np.abs(x))
        return x if self.centre is None else (x - np.array(self.centre)) / np.array(self.scale)

    def column(self, vector: Column | str) -> Column:
        v = F.col(vector) if isinstance(vector, str) else vector
        if self.log:
            v = F.transform(v, signed_log1p)
        if self.centre is None:
            return v
        pairs = F.zip_with(v, F.array(*[F.lit(c) for c in self.centre]), lambda x, c: x - c)
        return F.zip_with(pairs, F.array(*[F.lit(s) for s in self.scale]), lambda x, s: x / s)


def norm_stats(vectors: DataFrame, normalize: str, *, vector: str = "vector") -> DataFrame:
    """(dim, centre, scale): mean and population deviation, or median and interquartile range with linear
    interpolation. A scale of 0 is 1."""
    normalize = Normalization(normalize)
    v = F.col(vector)
    if normalize is Normalization.LOG1P_ROBUST:
        v = F.transform(v, signed_log1p)
    long = vectors.select(F.posexplode(v).alias("dim", "x"))
    if normalize is Normalization.ZSCORE:
        out = long.groupBy("dim").agg(F.avg("x").alias("centre"), F.stddev_pop("x").alias("scale"))
    elif normalize in (Normalization.ROBUST, Normalization.LOG1P_ROBUST):
        value = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
        out = exact_quantiles(long, (0.25, 0.5, 0.75)).groupBy("dim").agg(value(1).alias("centre"), (value(2) - value(0)).alias("scale"))
    else:
        raise ValueError("no statistics without a normalization")
    return out.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def fit_scaling(vectors: DataFrame, normalize: str, *, vector: str = "vector") -> Scaling:
    """The scaling of a gallery; its size is the vectors' length."""
    normalize = Normalization(normalize)
    if normalize is Normalization.NONE:
        return Scaling()
    rows = sorted(norm_stats(vectors, normalize, vector=vector).collect())
    if any(r.centre != r.centre or r.scale != r.scale for r in rows):
        raise ValueError("the gallery has NaN values")
    return Scaling(tuple(r.centre for r in rows), tuple(r.scale for r in rows), normalize is Normalization.LOG1P_ROBUST)


def _nearest(q: np.ndarray, g: np.ndarray, apart: np.ndarray, ord_: np.ndarray, distance: Distance, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of g, distance) of the ``k`` nearest of each row of q among those that are ``apart``. A matrix product says
    which can be among them, with the error it can have; their distances are computed exactly, and ties go by ``ord_``."""
    if distance is Distance.COSINE:
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(g, axis=1)[None]
        rough = 1 - np.divide(q @ g.T, norms, out=np.zeros((len(q), len(g))), where=norms > 0)
        slack = np.full((len(q), 1), 1e-9)
    else:
        qq, gg = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", g, g)
        rough = qq[:, None] + gg[None] - 2 * (q @ g.T)
        slack = 1e-12 * (qq[:, None] + gg.max(initial=0)) + 1e-9
    if not np.isfinite(rough[apart]).all():
        raise ValueError("a distance is not finite")
    rough = np.where(apart, rough, np.inf)
    if rough.shape[1] > k:
        # places are rounded in distances, which makes ties of squares that differ by up to so much
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
        near = 2 * slack if distance is Distance.COSINE else 2 * slack + 4 * 10.0**-PLACES * np.sqrt(np.maximum(np.where(np.isfinite(kth), kth, 0), 0) + slack)
        rows, cols = np.nonzero(apart & (rough <= kth + near))
    else:
        rows, cols = np.nonzero(apart)
    if distance is Distance.COSINE:
        exact = np.maximum(rough[rows, cols], 0.0)
    else:
        exact = np.empty(len(rows))
        for at in range(0, len(rows), 65536):
            d = g[cols[at : at + 65536]] - q[rows[at : at + 65536]]
            exact[at : at + 65536] = np.sqrt(np.einsum("ij,ij->i", d, d))
    order = np.lexsort((ord_[cols], np.round(exact, PLACES), rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    kept = rank < k
    return rows[kept], cols[kept], exact[kept]


#: What a part of the gallery has to tell of its neighbours, before ranks.
FOUND = "query_id string, entry_id string, sample_id string, label string, channel_id int, ord long, distance double"


@dataclass(frozen=True)
class Search:
    """How vectors are prepared and compared; sent to the workers."""

    width: int
    scaling: Scaling
    weights: np.ndarray | None
    config: RetrieverConfig

    def prepare(self, vectors: list | np.ndarray | pa.Array) -> np.ndarray:
        if isinstance(vectors, pa.Array):
            lengths = vectors.value_lengths()
            if lengths.null_count or (len(lengths) and (lengths.to_numpy(zero_copy_only=False) != self.width).any()):
                raise ValueError("vectors differ in length")
            vectors = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, self.width)
        elif not isinstance(vectors, np.ndarray):
            if any(v is None or len(v) != self.width for v in vectors):
                raise ValueError("vectors differ in length")
            vectors = np.array(vectors, dtype=float).reshape(len(vectors), self.width)
        x = self.scaling.apply(vectors)
        return x * self.weights if self.config.distance is Distance.WEIGHTED_L2 else x


class Asked:
    """Queries (query_id, sample_id, channel_id, vector) as arrays, and the best of the parts of the gallery (entry_id, sample_id, label, channel_id, ord,
    vector) that they have met: a task holds the best k of each query and about ``PENDING`` more, however many entries it reads."""

    def __init__(self, search: Search, asked: pa.Table | pa.RecordBatch):
        self.search, self.k = search, search.config.top_k
        one = lambda i: asked.column(i).combine_chunks() if isinstance(asked, pa.Table) else asked.column(i)
        self.ids = one(0).cast(pa.string())
        samples = one(1).cast(pa.string())
        self.known = samples.unique()
        self.samples = pc.index_in(samples, self.known).to_numpy(zero_copy_only=False).astype(np.int64)
        self.channels = pc.fill_null(one(2).cast(pa.int32()), -1).to_numpy(zero_copy_only=False)
        self.q = search.prepare(one(3))
        self.kth = np.full(len(self.q), np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]] = []
        self.rows = 0

    def meet(self, b: pa.RecordBatch) -> None:
        config = self.search.config
        for at in range(0, b.num_rows, 2048):
            some = b.slice(at, 2048)
            g = self.search.prepare(some.column(5))
            sample = pc.fill_null(pc.index_in(some.column(1).cast(pa.string()), self.known), -1).to_numpy(zero_copy_only=False)
            channel = pc.fill_null(some.column(3).cast(pa.int32()), -1).to_numpy(zero_copy_only=False)
            ord_ = some.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            told = pa.RecordBatch.from_arrays([some.column(i).cast(t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["entry_id", "sample_id", "label", "channel_id", "ord"])
            # a query that names a channel is compared with that channel's entries only
            for c in np.unique(channel) if config.by_channel else [None]:
                mine = np.arange(len(g)) if c is None else np.flatnonzero(channel == c)
                theirs = np.arange(len(self.q)) if c is None else np.flatnonzero((self.channels == c) | (self.channels < 0))
                for lo in range(0, len(theirs), ROWS):
                    those = theirs[lo : lo + ROWS]
                    rows, cols, dist = _nearest(self.q[those], g[mine], self.samples[those, None] != sample[mine][None], ord_[mine], config.distance, self.k)
                    near = dist <= self.kth[those[rows]] + 2 * 10.0**-PLACES
                    if near.any():
                        self.found.append((those[rows[near]], dist[near], told.take(pa.array(mine[cols[near]], pa.int64()))))
                        self.rows += int(near.sum())
                if self.rows > len(self.q) * self.k + PENDING:
                    self.best()

    def best(self) -> None:
        """Keeps the best k of each query."""
        if not self.found:
            return
        row, dist = (np.concatenate([f[i] for f in self.found]) for i in range(2))
        told = pa.Table.from_batches([f[2] for f in self.found]).combine_chunks()
        order = np.lexsort((told.column("ord").to_numpy(), np.round(dist, PLACES), row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        kept = rank < self.k
        row, order = row[kept], order[kept]
        dist = dist[order]
        last = rank[kept] == self.k - 1
        self.kth[row[last]] = dist[last]
        self.found = [(row, dist, told.take(pa.array(order)).combine_chunks().to_batches()[0])]
        self.rows = len(row)

    def result(self) -> list[pa.RecordBatch]:
        self.best()
        return [pa.RecordBatch.from_arrays([self.ids.take(pa.array(row)), *told.columns, pa.array(dist, pa.float64())], names=["query_id", *told.schema.names, "distance"]) for row, dist, told in self.found]


def knn(
    queries: DataFrame,
    gallery: DataFrame,
    config: RetrieverConfig,
    *,
    vector: str = "vector",
    scaling: Scaling | None = None,
    by_pivots: bool | None = None,
) -> DataFrame:
    """(query_id, rank, entry_id, sample_id, label, channel_id, distance): the ``top_k`` nearest of each query.

    ``queries``: query_id, sample_id, vector and, with ``by_channel``, channel_id. ``gallery``: entry_id, sample_id, label,
    channel_id, ord, vector. Entries of the query's own sample are left out. The scaling is fit on the gallery unless
    given. Ties go to the smaller ``ord``. A query without other entries gets no rows; a vector of another
    length, a null vector, or a distance that isn't finite is an error. ``by_pivots``: whether blocks that can't hold a neighbour are
    left out by their distances to pivots, which is the same rows; None does so where queries are too many to be sent to all.
    """
    if not config.enabled:
        raise RuntimeError("the retriever is disabled")
    spark = queries.sparkSession
    scaling = scaling if scaling is not None else fit_scaling(gallery, config.normalize, vector=vector)
    first = gallery.select(F.size(vector).alias("n")).first()
    cols = ["query_id", "sample_id", "channel_id", vector]
    asked = queries.select(*[c if c in queries.columns else F.lit(None).cast("int").alias(c) for c in cols])
    if first is None:
        return _ranked(spark.createDataFrame([], FOUND), config.top_k)
    if not (width := first.n or 0) > 0:
        raise ValueError("vectors differ in length")
    few = max(1, CHUNK_VALUES // width)
    # queries that go to all are gathered anyway; one more says that there are too many
    asked = asked.withColumn(vector, F.col(vector).cast("array<double>"))
    some = None if by_pivots else asked.limit(few + 1).toArrow()
    if some is not None and not some.num_rows:
        return _ranked(spark.createDataFrame([], FOUND), config.top_k)
    weights = np.sqrt(np.array(config.weights)) if config.weights else None
    if weights is not None and config.distance is Distance.WEIGHTED_L2 and len(weights) != width:
        raise ValueError("one weight is needed for each dimension")
    gallery = gallery.select("entry_id", "sample_id", "label", "channel_id", "ord", F.col(vector).cast("array<double>").alias("v"))

    search = Search(width, scaling, weights, config)
    if some is None or (by_pivots is None and some.num_rows > few):
        from .pivots import pruned_neighbours

        return _ranked(pruned_neighbours(asked.withColumnRenamed(vector, "v"), gallery, search, chunk=CHUNK_VALUES), config.top_k)

    held = spark.sparkContext.broadcast(some if some.num_rows <= few else asked.toArrow())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if batch.num_rows:
                best = best or Asked(search, held.value)
                best.meet(batch)
        if best:
            yield from best.result()

    return _ranked(gallery.mapInArrow(scan, FOUND), config.top_k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of the parts' best; Spark prunes the window's groups before it sorts."""
    w = Window.partitionBy("query_id").orderBy(F.round("distance", PLACES), "ord", "entry_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieved_sets(neighbours: DataFrame) -> DataFrame:
    """One row per query: its neighbours in order, as an array of structs."""
    item = F.struct("rank", "entry_id", "sample_id", "label", "channel_id", "distance")
    return neighbours.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("examples"))


def topk_of(sets: DataFrame, k: int) -> DataFrame:
    return sets.withColumn("examples", F.slice("examples", 1, k))


def top_predictions(neighbours: DataFrame) -> DataFrame:
    """(query_id, prediction, confidence) of the nearest neighbour."""
    return neighbours.where("rank = 1").select("query_id", F.col("label").alias("prediction"), confidence("distance").alias("confidence"))
