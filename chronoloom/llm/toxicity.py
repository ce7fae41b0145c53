"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Grades are ordered 0..K. One weight vector is shared by all thresholds:
P(grade > k) = sigmoid(w.x - threshold_k). The features are the distinct words of the whole text
and their beginnings, as 32-bit hashes; those associated with the labels in the training sample get
weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, utf8, whole_row, with_id, words_of

#: Labelled rows that training sees at most: those with the smallest hash of their id.
MAX_TRAINING_ROWS = 8000
#: Features that get a weight at most, and the G statistic that each needs.
MAX_FEATURES, MIN_G = 2048, 25.0
#: Beginnings of words, in characters, that are features besides the words.
PREFIXES = (3, 4, 5, 6)


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature hash and increasing thresholds."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def exceed(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold k."""
        return _sigmoid(eta[:, None] - np.array(self.thresholds)[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, *, l2: float = 1e-5, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood. Features are (row, col) pairs of value 1.
    Thresholds are a first one and positive gaps, so that they stay ordered."""
    n, k = len(grades), max(1, int(grades.max(initial=0)))
    shares = np.clip([(grades > t).mean() if n else 0.5 for t in range(k)], 1e-3, 1 - 1e-3)
    first = -np.log(shares / (1 - shares))
    start = np.concatenate([np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    at = np.arange(n)
    split = lambda p: (p[:n_features], np.cumsum(np.concatenate([p[n_features : n_features + 1], np.exp(p[n_features + 1 :])])))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, theta = split(p)
        eta = np.bincount(rows, w[cols], n)
        cum = np.concatenate([np.ones((n, 1)), _sigmoid(eta[:, None] - theta), np.zeros((n, 1))], axis=1)
        like = np.maximum(cum[at, grades] - cum[at, grades + 1], 1e-12)
        slope = cum * (1 - cum)
        up, down = slope[at, grades] / like, slope[at, grades + 1] / like
        g_theta = np.array([(up[grades == t + 1].sum() - down[grades == t].sum()) / n for t in range(k)])
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, ((down - up) / n)[rows], n_features) + l2 * w, tail[:1], tail[1:] * np.exp(p[n_features + 1 :])])
        return float(-np.log(like).mean() + l2 / 2 * (w @ w)), g

    return split(minimise(loss, start, steps))


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], p: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(g).max(initial=0) < 1e-7:
            break
        d, coefficients = g.copy(), []
        for s, y, r in reversed(past):
            coefficients.append(r * (s @ d))
            d -= coefficients[-1] * y
        if past:
            s, y, _ = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y, r), c in zip(past, reversed(coefficients), strict=True):
            d += (c - r * (y @ d)) * s
        step, slope = (1.0 if past else 1.0 / max(1.0, np.linalg.norm(g))), g @ d
        while step > 1e-12:
            q = p - step * d
            new, h = loss(q)
            if new <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = q - p, h - g
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        p, value, g = q, new, h
    return p


def _word_features(word: bytes) -> list[int]:
    s = word.decode("utf-8", "replace")
    return [zlib.crc32(word), *(zlib.crc32(f"{s[:k]}*".encode()) for k in PREFIXES if len(s) >= k)]


class _Known:
    """The features of a text that are in ``index``, with those of each word remembered."""

    def __init__(self, index: dict[int, int] | None, most: int = 200_000):
        self.index, self.most = index, most
        self.words: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: bytes | None) -> set[int]:
        out: set[int] = set()
        for w in set(words_of(text)):
            f = self.words.get(w)
            if f is None:
                if len(self.words) >= self.most:
                    self.words.clear()
                f = _word_features(w)
                f = self.words[w] = tuple(f) if self.index is None else tuple(self.index[x] for x in f if x in self.index)
            if f:
                out.update(f)
        return out


def _g(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """The G statistic of presence (a of n_a, b of n_b rows)."""
    total = 0.0
    for seen, of in ((a, n_a), (b, n_b), (n_a - a, n_a), (n_b - b, n_b)):
        both = a + b if seen is a or seen is b else n_a + n_b - a - b
        expected = both * of / (n_a + n_b)
        total = total + np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    return 2 * total


def cross_fitted(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, n_features: int) -> np.ndarray:
    """A score for each row, by weights fit on the labels of the rows of the other half."""
    half, out = np.arange(len(labels)) % 2, np.zeros(len(labels))
    for k in range(2):
        train = np.flatnonzero(half != k)
        place = np.full(len(labels), -1)
        place[train] = np.arange(len(train))
        own = place[rows] >= 0
        w, _ = fit_ordinal(place[rows[own]], cols[own], np.minimum(labels[train], 1), n_features, l2=1e-3)
        out += np.where(half == k, np.bincount(rows, w[cols], len(labels)), 0.0)
    return out


def deal_grades(scores: np.ndarray, labels: np.ndarray, levels: int) -> np.ndarray:
    """Grades 1 to ``levels`` of the rows of label 1, by quantiles of their scores; fewer where scores tie."""
    steps = np.quantile(scores[labels > 0], np.arange(1, levels) / levels)
    grades = np.where(labels > 0, 1 + np.searchsorted(steps, scores, side="left"), 0)
    return np.searchsorted(np.unique(grades), grades)


def train_severity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "toxic",
    max_rows: int = MAX_TRAINING_ROWS,
    severity_levels: int = 2,
) -> OrdinalModel:
    """Fit on at most ``max_rows`` labelled documents.

    Labels above 1 are used as grades. Where the labels are only 0 and 1, rows of label 1 are
    dealt into ``severity_levels`` grades by quantiles of a score from weights that were fit on the labels
    of the other half of the rows. Labels, ids and texts that are null are not used; of rows that repeat an
    id one is. Without two different labels the model predicts grade 0 for every text.
    """
    scratch = Scratch(docs.sparkSession, "severity")
    chosen = (
        labels.select(column(label_id_col).alias("__label_id"), column(label_col).cast("int").alias("__grade"))
        .where("__label_id is not null and __grade is not null and __grade >= 0")
        .orderBy(F.xxhash64("__label_id"), "__label_id", "__grade")
        .limit(max_rows)
    )
    texts = docs.select(column(id_col).alias("__id"), utf8(text_col).alias("__text")).where("__text is not null")
    labelled = texts.join(F.broadcast(chosen), F.col("__id") == F.col("__label_id"))
    one = labelled.groupBy("__id").agg(F.max(F.struct(F.xxhash64("__text"), F.col("__grade").alias("grade"), F.col("__text").alias("text"))).alias("best"))
    sample = scratch.write(one.select("best.grade", "best.text", F.xxhash64("__id").alias("h")), "sample")
    sizes = {r.grade: r.n for r in sample.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    n_none, n_some = sizes.get(0, 0), sum(n for g, n in sizes.items() if g)
    if not n_none or not n_some:
        scratch.drop(sample)
        return OrdinalModel({}, (40.0,))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = (Counter(), Counter()), _Known(None)
        for batch in batches:
            for grade, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[grade > 0].update(known(text.as_py()))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), *(pa.array([c[f] for f in names], pa.int64()) for c in (seen[1], seen[0]))], names=["f", "a", "b"]
        )

    counted = sample.mapInArrow(count, "f long, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b >= 5")
    share = n_some / (n_none + n_some)
    # only features whose counts can reach MIN_G are sent to the driver
    counts = counted.where(F.abs(F.col("a") - share * (F.col("a") + F.col("b"))) > 2 * F.sqrt(share * (1 - share) * (F.col("a") + F.col("b")))).toArrow()
    a, b = (counts[c].to_numpy().astype(float) for c in "ab")
    g = _g(a, b, n_some, n_none)
    order = np.lexsort((counts["f"].to_numpy(), -g))[:MAX_FEATURES]
    order = order[g[order] >= MIN_G]
    names = counts["f"].to_numpy()[order].astype(np.int64)
    index = {int(f): i for i, f in enumerate(names)}
    own = docs.sparkSession.sparkContext.broadcast(index)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(own.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sorted(known(t)) for t in texts], pa.list_(pa.int32())), batch.column(2)], names=["grade", "features", "h"]
            )

    rows = sample.mapInArrow(narrow, "grade int, features array<int>, h long").collect()
    scratch.drop(sample)
    rows.sort(key=lambda r: (r.h, r.grade, r.features))
    grades = np.array([r.grade for r in rows], dtype=int)
    cols = np.array([f for r in rows for f in r.features], dtype=int)
    at = np.repeat(np.arange(len(rows)), [len(r.features) for r in rows])
    if grades.max() == 1 and severity_levels > 1:
        grades = deal_grades(cross_fitted(at, cols, grades, len(names)), grades, severity_levels)
    w, theta = fit_ordinal(at, cols, grades, len(names))
    return OrdinalModel({int(f): float(x) for f, x in zip(names, w, strict=True)}, tuple(map(float, theta)))


def score_severity(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """One row per document: its id, ``severity`` (the expected grade), ``grade`` (the most
    probable), ``p_toxic`` (of a grade above 0) and ``toxic`` (``p_toxic`` at least
    ``reject_at``). Null and empty texts have no features and so the score of the thresholds
    alone. Whole texts are read; repeated rows give repeated results; other columns are ignored; an empty table
    gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        names = list(own.weights)
        weights = [own.weights[f] for f in names]
        known = _Known({f: i for i, f in enumerate(names)})
        for batch in batches:
            eta = [sum(weights[i] for i in sorted(known(text))) for text in batch.column(1).to_pylist()]
            over = own.exceed(np.array(eta)) if eta else np.zeros((0, len(own.thresholds)))
            cum = np.concatenate([np.ones((len(eta), 1)), over, np.zeros((len(eta), 1))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(over.sum(axis=1), pa.float64()),
                    pa.array((cum[:, :-1] - cum[:, 1:]).argmax(axis=1), pa.int32()),
                    pa.array(over[:, 0], pa.float64()),
                    pa.array(over[:, 0] >= reject_at, pa.bool_()),
                ],
                names=[id_col, "severity", "grade", "p_toxic", "toxic"],
            )

    return docs.select(column(id_col), utf8(text_col).alias("__text")).mapInArrow(scan, with_id(docs, id_col, "severity double,grade int,p_toxic double,toxic boolean"))


def drop_toxic(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """The documents, all columns as they were, that are not toxic. Null and empty texts have no features; they go only if
    the thresholds alone say so. Each of repeated rows, and rows with null ids, are judged by their text. An empty table
    stays empty."""
    packed = docs.select(whole_row(docs), utf8(text_col).alias("__text"))
    return score_severity(packed, model, id_col="row", text_col="__text", reject_at=reject_at).where("not toxic").select("row.*")
