"""Channel selection: how well each channel's series separate the classes.

Prototype margin and leave-one-out accuracy are computed by channel as aggregates, fused as z-scores and
ranked; channels whose class centroids resemble those of a better one can be left out.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import downsample, l2_distance, znorm
from ..schema import Distance, RetrieverConfig, SelectorConfig
from ..session import shared_folder
from ..sources.files import read_json, write_json
from .metrics import zscores
from .pivots import LOW
from .retrieval import PLACES, ROWS, _nearest, knn


def prepare_channels(series: DataFrame, config: SelectorConfig) -> DataFrame:
    """(channel_id, idx, label, x): the series, shortened and normalised as configured. ``idx`` is the sample's position."""
    x = downsample(F.col("values").cast("array<double>"), config.max_len)
    if config.z_norm:
        x = znorm(x)
    label = F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("no label: "), F.col("sample_id"))).cast("int")).otherwise(F.col("label").cast("int"))
    return series.select("channel_id", F.col("sample_index").cast("long").alias("idx"), label.alias("label"), x.alias("x"))


def class_centroids(prepared: DataFrame) -> DataFrame:
    """(channel_id, label, centroid, n): element-wise means."""
    long = prepared.select("channel_id", "label", "idx", F.posexplode("x").alias("pos", "v"))
    means = long.groupBy("channel_id", "label", "pos").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy("channel_id", "label").agg(F.transform(ordered, lambda p: p["m"]).alias("centroid"), F.max("n").alias("n"))


def prototype_margin(prepared: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """(channel_id, within, between, score_b): the mean distance between class centroids over the mean, over classes,
    of the mean distance to the own centroid. 0 with a single class. Centroids are joined as their size has it."""
    centroids = class_centroids(prepared) if centroids is None else centroids
    near = prepared.join(centroids.select("channel_id", "label", "centroid"), ["channel_id", "label"])
    by_class = near.groupBy("channel_id", "label").agg(F.avg(l2_distance("x", "centroid")).alias("d"))
    within = by_class.groupBy("channel_id").agg(F.avg("d").alias("within"), F.count("*").alias("classes"))
    a, b = (centroids.select("channel_id", F.col("label").alias(f"l{s}"), F.col("centroid").alias(f"c{s}")) for s in "ab")
    between = a.join(b, "channel_id").where("la < lb").groupBy("channel_id").agg(F.avg(l2_distance("ca", "cb")).alias("between"))
    joined = within.join(between, "channel_id", "left")
    score = F.when(F.col("classes") <= 1, F.lit(0.0)).otherwise(F.col("between") / (F.col("within") + 1e-8))
    return joined.select("channel_id", "within", F.coalesce("between", F.lit(0.0)).alias("between"), score.alias("score_b"))


def probe_ids(n: int, channel_id: int, config: SelectorConfig) -> list[int] | None:
    """The positions that are probed; None for all. Drawn by the standard generator seeded with seed + channel."""
    if not 0 < config.nn_eval < n:
        return None
    return random.Random(config.seed + channel_id).sample(range(n), config.nn_eval)


#: Rows of a channel that are compared with as many others in a task, and values that they have at most.
BLOCK_ROWS, BLOCK_VALUES = 4096, 4_000_000
#: Segments whose means bound distances, of longer series, and the share of pairs from which on all are computed.
SEGMENTS, LONG, MANY = (8, 32), 64, 0.2
#: Short series of more samples than this in a channel are dealt into cells, so that a sample meets only those that can hold its neighbour.
CELLS_FROM = 4096
_BEST = "channel_id int, idx long, label int, distance double, other long, other_label int"


def segment_means(x: np.ndarray, n: int) -> np.ndarray:
    """Means of ``n`` segments, weighted so that their distances are at most those of the rows."""
    edges = np.linspace(0, x.shape[1], n + 1).astype(int)
    return np.add.reduceat(x, edges[:-1], axis=1) / np.sqrt(np.diff(edges))


def nearest_by_segments(q: np.ndarray, g: np.ndarray, apart: np.ndarray, ord_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row of q, row of g, distance) of the nearest, of those that are ``apart``, and how many distances were computed. What is nearest by means of
    segments gives an upper bound; pairs whose lower bound, by coarse and then by fine segments, is above it are left. Ties go by ``ord_``."""
    some = np.flatnonzero(apart.any(axis=1))
    bound = np.where(apart, _lower(q, g, SEGMENTS[0]), np.inf)
    first = bound[some].argmin(axis=1)
    reach = np.full(len(q), -np.inf)
    reach[some] = np.sqrt(((q[some] - g[first]) ** 2).sum(axis=1)) + 2 * 10.0**-PLACES
    rows, cols = np.nonzero(bound <= reach[:, None])
    for n in SEGMENTS[1:]:
        fine = np.concatenate([np.sqrt(((x - y) ** 2).sum(axis=1)) for x, y in _gathered(segment_means(q, n), segment_means(g, n), rows, cols)] or [np.zeros(0)])
        near = fine * (1 - 1e-9) <= reach[rows]
        rows, cols = rows[near], cols[near]
    if len(rows) > MANY * apart.size:
        return *_nearest(q, g, apart, ord_, Distance.L2, 1), int(apart.sum())
    exact = np.concatenate([np.sqrt(((x - y) ** 2).sum(axis=1)) for x, y in _gathered(q, g, rows, cols)] or [np.zeros(0)])
    order = np.lexsort((ord_[cols], np.round(exact, PLACES), rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    top = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[top], cols[top], exact[top], len(rows) + len(some)


def _lower(q: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    a, b = segment_means(q, n), segment_means(g, n)
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    slack = 1e-12 * (aa[:, None] + bb.max(initial=0)) + 1e-12
    return np.sqrt(np.maximum(aa[:, None] + bb[None] - 2 * (a @ b.T) - slack, 0))


def _gathered(q: np.ndarray, g: np.ndarray, rows: np.ndarray, cols: np.ndarray):
    step = max(1, BLOCK_VALUES // max(1, q.shape[1]))
    for lo in range(0, len(rows), step):
        yield q[rows[lo : lo + step]], g[cols[lo : lo + step]]


def _compare(group: pa.Table) -> pa.Table:
    """The nearest, in the other block, of each probed row of a pair of blocks; in a block itself, of another row."""
    one, two = group["i"][0].as_py(), group["j"][0].as_py()
    lengths = group["x"].combine_chunks().value_lengths()
    width = lengths[0].as_py()
    if lengths.null_count or not width or pc.min_max(lengths)["max"].as_py() != width or pc.min_max(lengths)["min"].as_py() != width:
        raise ValueError("series of a channel differ in length")
    x = group["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if not np.isfinite(x).all():
        raise ValueError("a distance is not finite")
    block, idx, label, probe = (group[c].to_numpy() for c in ("block", "idx", "label", "probe"))
    found = []
    for mine, theirs in [(one, two)] if one == two else [(one, two), (two, one)]:
        asked, held = np.flatnonzero((block == mine) & probe), np.flatnonzero(block == theirs)
        if not len(held):
            continue
        for lo in range(0, len(asked), ROWS):
            some = asked[lo : lo + ROWS]
            apart = idx[some][:, None] != idx[held][None]
            if width >= LONG:
                rows, cols, d, _ = nearest_by_segments(x[some], x[held], apart, idx[held])
            else:
                rows, cols, d = _nearest(x[some], x[held], apart, idx[held], Distance.L2, 1)
            found.append((idx[some][rows], label[some][rows], d, idx[held][cols], label[held][cols]))
    columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(5)]
    kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int32())
    arrays = [pa.array(np.full(len(columns[0]), group["channel_id"][0].as_py()), pa.int32()), *(pa.array(c).cast(t) for c, t in zip(columns, kinds, strict=True))]
    return pa.Table.from_arrays(arrays, names=["channel_id", "idx", "label", "distance", "other", "other_label"])


def _hits_by_pairs(rows: DataFrame) -> DataFrame:
    """(channel_id, hits) of the probes, by pairs of blocks."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("idx"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("channel_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "idx", "label", "probe", "x")
    found = dealt.groupBy("channel_id", "i", "j").applyInArrow(_compare, _BEST)
    best = found.groupBy("channel_id", "idx", "label").agg(F.min(F.struct(F.round("distance", PLACES).alias("d"), "other", F.col("other_label").alias("l"))).alias("best"))
    return best.groupBy("channel_id").agg(F.sum((F.col("best.l") == F.col("label")).cast("int")).alias("hits"))


def _hits_by_cells(rows: DataFrame) -> DataFrame:
    """(channel_id, hits) of the probes, by cells of the channels' samples. Samples at the same position are not each other's neighbours."""
    idx, label = F.col("idx").cast("string"), F.col("label").cast("string")
    gallery = rows.select(idx.alias("entry_id"), idx.alias("sample_id"), label.alias("label"), "channel_id", F.col("idx").alias("ord"), F.col("x").alias("vector"))
    asked = rows.where("probe").select(F.concat_ws("#", "channel_id", idx, label).alias("query_id"), idx.alias("sample_id"), "channel_id", F.col("x").alias("vector"))
    near = knn(asked, gallery, RetrieverConfig("l2", "none", 1), by_pivots=True)
    told = F.split("query_id", "#")
    return near.groupBy(told[0].cast("int").alias("channel_id")).agg(F.sum((F.col("label") == told[2]).cast("int")).alias("hits"))


def one_nn_accuracy(prepared: DataFrame, config: SelectorConfig) -> DataFrame:
    """(channel_id, score_c): the share of probed samples whose nearest other sample has their label; the lower
    position wins ties. Probes are ``nn_eval`` of a channel, or all of them. Many short series are looked up among cells (``pivots``); else blocks of a channel's
    samples meet in pairs, a pair a task, and only the nearest of each pair leaves it. A sample without others counts as missed."""
    spark = prepared.sparkSession
    # a row for each channel
    counts = prepared.groupBy("channel_id").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.min(F.size("x")).alias("least")).collect()
    sizes = [(r.channel_id, max(1, -(-r.n // max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, r.width or 1)))))) for r in counts]
    drawn = [(r.channel_id, i) for r in counts for i in (probe_ids(r.n, r.channel_id, config) or ())]
    rows = prepared.join(spark.createDataFrame(sizes, "channel_id int, blocks int"), "channel_id")
    if drawn:
        named = spark.createDataFrame(drawn, "channel_id int, idx long").withColumn("drawn", F.lit(True))
        whole = {r.channel_id for r in counts} - {c for c, _ in drawn}
        rows = rows.join(named, ["channel_id", "idx"], "left").withColumn("probe", F.coalesce("drawn", F.col("channel_id").isin(*whole) if whole else F.lit(False)))
    else:
        rows = rows.withColumn("probe", F.lit(True))
    widths = {w for r in counts for w in (r.width, r.least)}
    if len(widths) == 1 and None not in widths and 0 < max(widths) <= LOW and max((r.n for r in counts), default=0) > CELLS_FROM:
        hits = _hits_by_cells(rows)
    else:
        hits = _hits_by_pairs(rows)
    probes = [(r.channel_id, len(probe_ids(r.n, r.channel_id, config) or range(r.n))) for r in counts]
    asked = spark.createDataFrame(probes, "channel_id int, probes long")
    return asked.join(hits, "channel_id", "left").select("channel_id", (F.coalesce("hits", F.lit(0)) / F.col("probes")).alias("score_c"))


def fuse_scores(scores: DataFrame, alpha: float = 0.5) -> DataFrame:
    """The rows (channel_id, score_b, score_c) with their z-scores, the fused score and the rank; ties by channel."""
    from pyspark.sql import Window

    # a row for each channel: collected once, so that their lineage isn't run again for the statistics
    known = scores.sparkSession.createDataFrame(scores.collect(), scores.schema)
    z = zscores(known, {"score_b": "z_b", "score_c": "z_c"})
    fused = z.withColumn("fused", F.lit(alpha) * F.col("z_b") + F.lit(1 - alpha) * F.col("z_c"))
    return fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("fused", 9)), "channel_id")))


def prune_similar(ranked: list[tuple[int, list[list[float]]]], k: int, threshold: float | None) -> list[int]:
    """Channels in their order, without those whose stacked centroids have a cosine above the threshold with one
    that was taken; at most k. Without a threshold above 0: the first k."""
    if not threshold or threshold <= 0:
        return [c for c, _ in ranked[:k]]
    kept: list[tuple[int, np.ndarray]] = []
    for channel, stack in ranked:
        v = np.concatenate([np.asarray(s, dtype=float) for s in stack])
        n = np.linalg.norm(v)
        if all((v @ u / (n * np.linalg.norm(u)) if n > 1e-12 and np.linalg.norm(u) > 1e-12 else 0.0) <= threshold for _, u in kept):
            kept.append((channel, v))
        if len(kept) == k:
            break
    return [c for c, _ in kept]


def select_channels(series: DataFrame, config: SelectorConfig) -> DataFrame:
    """(channel_id, score_b, score_c, z_b, z_c, fused, rank, selected, selection_applied). ``series`` are the training
    samples, all of the same channels: samples with fewer, or univariate beside multivariate ones, are an error. A single channel is selected as it
    is, with scores of 1."""
    # a row for each channel
    told = series.groupBy("channel_id").agg(F.count("*").alias("n"), F.countDistinct("sample_index").alias("samples")).orderBy("channel_id").collect()
    channels = [r.channel_id for r in told]
    if not channels:
        raise ValueError("no series")
    if len({r.samples for r in told}) > 1 or any(r.n != r.samples for r in told):
        raise ValueError("samples differ in their channels")
    spark = series.sparkSession
    if len(channels) == 1:
        return spark.createDataFrame(
            [(channels[0], 1.0, 1.0, 1.0, 1.0, 1.0, 1, True, False)],
            "channel_id int, score_b double, score_c double, z_b double, z_c double, fused double, rank int, selected boolean, selection_applied boolean",
        )
    # shortened and normalised once: centroids, margins and neighbours all read it
    kept = f"{shared_folder(spark, 'channels')}/prepared"
    prepare_channels(series, config).write.parquet(kept)
    prepared = spark.read.parquet(kept)
    centroids = class_centroids(prepared)
    scores = prototype_margin(prepared, centroids).join(one_nn_accuracy(prepared, config), "channel_id")
    ranked = fuse_scores(scores.select("channel_id", "score_b", "score_c"), config.alpha)
    if config.diversity and config.diversity > 0:
        stacks = centroids.groupBy("channel_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "centroid"))), lambda c: c["centroid"]).alias("stack"))
        rows = ranked.join(stacks, "channel_id").orderBy("rank").select("channel_id", "stack").collect()
        kept = prune_similar([(r[0], r[1]) for r in rows], config.top_k, config.diversity)
        chosen = F.col("channel_id").isin(kept)
    else:
        chosen = F.col("rank") <= config.top_k
    return ranked.withColumn("selected", chosen).withColumn("selection_applied", F.lit(True))


def save_selection(selection: DataFrame, path: str, *, metadata: dict | None = None) -> dict:
    """The chosen channels, in their order, and all scores, as JSON; a channel is a row of the selection."""
    rows = selection.orderBy("rank").collect()
    scores = ("score_b", "score_c", "z_b", "z_c", "fused")
    out = {
        "selected_channel_ids": [r.channel_id for r in rows if r.selected],
        "scores": {r.channel_id: r.fused for r in rows},
        "details": {r.channel_id: {s: r[s] for s in scores} for r in rows},
        "metadata": metadata or {},
    }
    write_json(path, out)
    return out


def load_selection(path: str) -> dict:
    """What ``save_selection`` wrote, with channels as numbers again."""
    told = read_json(path)
    if not isinstance(told, dict) or not isinstance(told.get("selected_channel_ids"), list):
        raise ValueError(f"{path} has no list of selected channels")
    for k in ("scores", "details"):
        if not isinstance(told.get(k, {}), dict):
            raise ValueError(f"{k} of {path} must be an object")
        told[k] = {int(c): v for c, v in told.get(k, {}).items()}
    told["selected_channel_ids"] = [int(c) for c in told["selected_channel_ids"]]
    return told
