"""Periodic runs of words by Crochemore's partition refinement.

Positions are in one class of level l where equal factors of l words start. Going from level l to l + 1,
a class is split by the classes that its successors are in, and only the smaller halves of the classes that
the last level split are looked at: a position is touched as often as its class at least halves. Members of a class are
linked in the order of the text; those whose neighbour is exactly l words on start a square of period l whose
root is primitive, and squares that start at consecutive words are one run.

The first levels, in which every document has classes, are refined for many documents at once. A run of three
periods needs a class of three members at each level up to its period, so a document without one is done.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import column, utf8

#: Levels that documents are refined through together, and words of the documents taken together.
TOGETHER, WORDS = 8, 300_000
RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def _halves(classes: list[list[int]], level: int, last: int) -> Iterator[tuple[int, int]]:
    """(period, start) of the squares of one document from ``level`` to ``last``. ``classes``: the positions, ascending, of
    each class of factors of ``level`` words with several members."""
    of: dict[int, int] = {}
    after: dict[int, int] = {}
    before: dict[int, int] = {}
    size: dict[int, int] = {}
    near: dict[int, list[int]] = defaultdict(list)  # distance: positions that had their next member there

    def link(k: int, members: list[int]) -> None:
        size[k] = len(members)
        for i in members:
            of[i] = k
        for i, j in zip(members, members[1:]):
            after[i], before[j] = j, i
            near[j - i].append(i)

    def unlink(i: int) -> None:
        p, q = before.pop(i, None), after.pop(i, None)
        if p is not None and q is not None:
            after[p], before[q] = q, p
            near[q - p].append(p)
        elif p is not None:
            del after[p]
        elif q is not None:
            del before[q]

    for k, members in enumerate(classes):
        link(k, members)
    made = len(classes)
    triples = sum(n > 2 for n in size.values())
    splitters = [i + 1 for i in of]
    while triples and level <= last:
        for i in set(near.pop(level, ())):
            if after.get(i) == i + level:
                yield level, i
        parts: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for j in splitters:
            k = of.get(j - 1)
            if k is not None:
                parts[k][of.get(j, -j)].append(j - 1)  # a position alone in its class is told apart by itself
        splitters = []
        for k, by in parts.items():
            leaving = list(by.values())
            rest = size[k] - sum(map(len, leaving))
            largest = max(leaving, key=len)
            if rest < len(largest):
                leaving = [x for x in leaving if x is not largest]
                if rest:
                    told = {i for x in by.values() for i in x}
                    leaving.append([i for i in _members(largest[0], after, before) if i not in told])
            if not leaving:
                continue
            triples -= size[k] > 2
            for members in leaving:
                members.sort()
                for i in members:
                    unlink(i)
                size[k] -= len(members)
                splitters += members
                if len(members) > 1:
                    link(made, members)
                    made += 1
                    triples += len(members) > 2
                else:
                    del of[members[0]]
            triples += size[k] > 2
        level += 1


def _members(at: int, after: dict[int, int], before: dict[int, int]) -> Iterator[int]:
    """The members of the class that ``at`` is in."""
    yield at
    for step in (after, before):
        i = step.get(at)
        while i is not None:
            yield i
            i = step.get(i)


def _squares(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(periods, starts) of the squares in documents that lie one behind the other, each followed by one
    position with a negative code; ``ends``: those positions. A word's code tells its document too."""
    periods, starts = [], []
    number = np.zeros(len(codes), dtype=np.int64)  # of a position's class; 0: alone
    at = np.flatnonzero(codes >= 0)
    key = codes[at]
    for level in range(1, TOGETHER + 1):
        if level > 1:
            succ = number[at + 1]
            at, key = at[succ > 0], number[at[succ > 0]] * (len(codes) + 1) + succ[succ > 0]
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1)) if len(key) else np.zeros(1, dtype=np.int64)
        n = np.diff(edge)
        shared = np.repeat(n > 1, n)
        number[:] = 0
        members, of = at[order][shared], np.repeat(np.arange(1, len(n) + 1), n)[shared]
        number[members] = of
        if level < TOGETHER:
            found = members[:-1][(np.diff(members) == level) & (np.diff(of) == 0)]
            starts.append(found)
            periods.append(np.full(len(found), level))
            at = np.sort(members)
    # documents with a class of three go on one by one; a class lies in one document
    cut = np.flatnonzero(np.diff(of)) + 1
    groups = np.split(members, cut) if len(members) else []
    by_doc = defaultdict(list)
    for g, d in zip(groups, np.searchsorted(ends, [g[0] for g in groups]).tolist(), strict=True):
        by_doc[d].append(g.tolist())
    for d, classes in by_doc.items():
        if max(map(len, classes)) > 2:
            first = int(ends[d - 1]) + 1 if d else 0
            found = np.array(list(_halves(classes, TOGETHER, (int(ends[d]) - first) // 3)), dtype=np.int64).reshape(-1, 2)
            periods.append(found[:, 0])
            starts.append(found[:, 1])
    return np.concatenate(periods), np.concatenate(starts)


def runs_of(texts: list[list[bytes]], min_length: int, min_periods: int) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), by start and period."""
    known: dict[tuple[int, bytes], int] = {}
    codes: list[int] = []
    ends = []
    for d, words in enumerate(texts):
        known.clear()
        base = len(codes)  # codes of different documents differ: a word's code is where it stood first
        for i, w in enumerate(words, base):
            codes.append(known.setdefault(w, i))
        ends.append(len(codes))
        codes.append(-1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    last = np.array(ends, dtype=np.int64)
    periods, starts = _squares(np.array(codes, dtype=np.int64), last)
    by = np.lexsort((starts, periods))
    periods, starts = periods[by], starts[by]
    new = np.flatnonzero((np.diff(periods, prepend=-1) != 0) | (np.diff(starts, prepend=-9) != 1))
    if not len(new):
        return out
    final = np.append(new[1:], len(starts)) - 1
    q, s = periods[new], starts[new]
    length = starts[final] - s + 2 * q
    long = length >= np.maximum(min_length, min_periods * q)
    owner = np.searchsorted(last, s)
    for d, start, n, period in sorted(zip(*(x[long].tolist() for x in (owner, s, length, q)), strict=True)):
        out[d].append((start - (ends[d - 1] + 1 if d else 0), n, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of any run's repeats, joined by spaces: of a run its first period stays."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find_runs(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 24,
    min_periods: int = 3,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """A row per document: its id, ``n_words`` (runs of anything but ASCII white space), ``runs`` (start, length and smallest period, in words,
    of every maximal repetition of at least ``min_length`` words and ``min_periods`` periods, by start and
    period) and ``collapsed`` (the text with only the first period of each run, words joined by one space).

    ``rewrite(id, words)`` may replace a document's words first. ``min_periods`` is 3 at least. Null and empty texts have no words and no runs;
    rows with null ids and repeated rows are treated like others; other columns are ignored; an empty table
    gives an empty result. A text of any length is taken whole: its time grows as n log n, its memory with its words. Nothing is shuffled.
    """
    if min_periods < 3:
        raise ValueError("min_periods must be 3 or more")
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", BinaryType())])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))

    def rows(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of(texts, min_length, min_periods)
        told = pa.array([[dict(zip(RUN.names, r, strict=True)) for r in x] for x in runs], kind)
        return pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in texts], pa.int64()), told, pa.array([collapse(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary())], names=schema.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, first, n = batch.column(0), [], 0, 0
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or b"").split()
                held.append(rewrite(ids[i].as_py(), words) if rewrite else words)
                n += len(held[-1])
                if n >= WORDS:
                    yield rows(ids.slice(first, len(held)), held)
                    held, first, n = [], i + 1, 0
            if held:
                yield rows(ids.slice(first, len(held)), held)

    found = docs.select(column(id_col), utf8(text_col).alias("__text")).mapInArrow(scan, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: str | Column) -> Column:
    """Of an array of runs the one of greatest exact length / period; of equal ones the first."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def run_report(docs: DataFrame, **options) -> DataFrame:
    """``find_runs`` with counts, the strongest run and digests instead of lists and texts."""
    found = find_runs(docs, **options)
    line = lambda r: F.concat(*(x for c in RUN.names for x in (r[c].cast("string"), F.lit("\n" if c == "period" else ","))))
    best = found.withColumn("best", strongest("runs"))
    return best.select(
        column(found.columns[0]),
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in RUN.names),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
