"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows. Words are the symbols: a block is
``block`` consecutive words. A shift table says how far the search may jump when
the block under its right end stands nowhere, or only further left, in any window;
where the shift is zero, the bucket of that suffix block lists the windows that end
with it, a prefix word rules most of them out, and direct comparison confirms the
rest. Windows of one length share a table.

A benchmark of more windows than a worker should hold is dealt into blocks. Each is sent to the workers in a scan of
its own and released after it; what a scan finds, spans of words by text, is written, and the spans of all blocks are joined.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, utf8, whole_row, with_id, words_of

#: Documents whose words a worker holds at a time.
ROWS = 256
SCHEMA = "n_words long,n_hit long,items array<string>"


def windows_of(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    """Every run of ``size`` words; a shorter text, but not an empty one, is one window."""
    if words:
        for at in range(max(1, len(words) - size + 1)):
            yield tuple(words[at : at + size])


class WuManber:
    """Search tables for (item id, words) pairs."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int, block: int = 3):
        owners: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item_id, words in items:
            for pattern in windows_of(words, window):
                owners[pattern].add(item_id)
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for pattern in owners:
            by_length[len(pattern)].append(pattern)
        self.owners = owners
        self.tables = [self._table(m, min(block, m), by_length[m]) for m in sorted(by_length)]

    @staticmethod
    def _table(m: int, b: int, patterns: list[tuple[bytes, ...]]):
        shift: dict[tuple[bytes, ...], int] = {}
        bucket: dict[tuple[bytes, ...], dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for pattern in patterns:
            for end in range(b, m + 1):
                key = pattern[end - b : end]
                shift[key] = min(shift.get(key, m), m - end)
            bucket[pattern[m - b :]][pattern[0]].append(pattern)
        return m, b, shift, {k: dict(v) for k, v in bucket.items()}

    def search(self, words: list[bytes], marks: bytearray, found: set) -> None:
        """Mark the words inside any occurrence and gather the items that occur."""
        n = len(words)
        for m, b, shift, bucket in self.tables:
            jump, end, done = m - b + 1, m, b"\x01" * m
            look = shift.get
            while end <= n:
                key = tuple(words[end - b : end])
                step = look(key, jump)
                if step:
                    end += step
                    continue
                for pattern in bucket[key].get(words[end - m], ()):
                    if tuple(words[end - m : end]) == pattern:
                        marks[end - m : end] = done
                        found |= self.owners[pattern]
                end += 1


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block: int = 3,
    max_windows: int = 200_000,
) -> DataFrame:
    """One row per document: its id, ``n_words``, ``n_hit`` (words inside any occurrence of
    a window), ``items`` (sorted ids, as strings, of the items with occurring windows).

    Only the benchmark is sent to the workers, at most about ``max_windows`` windows at a time. Where it has no more,
    one scan does and documents are neither shuffled nor gathered. Where it has more, there is a scan for each block,
    and only spans of documents with hits are shuffled, by id and digest of the text.

    Null and empty texts have no words. Null items match nothing; an item with a null id marks
    words but is not listed. Repeated rows give repeated results; repeated items are
    listed once. Other columns are ignored. An empty benchmark hits nothing; an empty table gives an empty result.
    """
    items = benchmark.select(column(item_col).cast("string").alias("i"), utf8(item_text_col).alias("t"))
    total = items.agg(F.sum(F.greatest(F.lit(1), F.octet_length("t") / 2))).first()[0] or 0
    n_blocks = int(total // max_windows) + 1
    rows = docs.select(column(id_col), utf8(text_col).alias("__text"))
    if n_blocks == 1:
        held = _send(items)
        return rows.mapInArrow(_searcher(held, window, block, _whole), with_id(docs, id_col, SCHEMA))
    # a text of many documents is told apart by its digest; a null text has none and no hits
    rows = rows.select(column(id_col).alias("id"), "__text", F.unhex(F.sha2("__text", 256)).alias("sha"))
    scratch = Scratch(docs.sparkSession, "decontamination")
    found = []
    for k in range(n_blocks):
        held = _send(items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == k))
        keyed = rows.select(F.struct("id", "sha").alias("key"), "__text")
        spans = keyed.mapInArrow(_searcher(held, window, block, _spans), with_id(keyed, "key", "starts array<long>,ends array<long>,items array<string>"))
        found.append(scratch.write(spans.dropDuplicates(["key"]), "spans"))
        held.unpersist()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    told = every.groupBy("key").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items"))).select("key.*", *_joined())
    words = rows.mapInArrow(_counter, with_id(rows, "id", "sha binary,n_words long"))
    out = words.join(told.withColumnsRenamed({"id": "__id", "sha": "__sha"}), F.col("id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")), "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def _send(items: DataFrame):
    """A block of the benchmark, to all workers."""
    return items.sparkSession.sparkContext.broadcast([(r.i, words_of(bytes(r.t))) for r in items.collect() if r.t])


def _searcher(held, window: int, block: int, rows_of: Callable) -> Callable:
    """A scan of (key, text, ...) that searches for the windows of the block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = WuManber(held.value, window, block)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [words_of(t) for t in batch.column(1).to_pylist()]
                marks = [bytearray(len(w)) for w in texts]
                found: list[set] = [set() for _ in texts]
                for w, m, f in zip(texts, marks, found, strict=True):
                    tables.search(w, m, f)
                yield rows_of(batch, texts, marks, found)

    return scan


def _whole(batch: pa.RecordBatch, texts: list, marks: list[bytearray], found: list[set]) -> pa.RecordBatch:
    values = [pa.array([len(w) for w in texts], pa.int64()), pa.array([m.count(1) for m in marks], pa.int64()), pa.array([sorted(f - {None}) for f in found], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([batch.column(0), *values], names=[batch.schema.names[0], "n_words", "n_hit", "items"])


def _spans(batch: pa.RecordBatch, texts: list, marks: list[bytearray], found: list[set]) -> pa.RecordBatch:
    """Of the texts with hits: where runs of hit words start and end."""
    rows = [i for i, m in enumerate(marks) if 1 in m]
    runs = [[x.span() for x in re.finditer(rb"\x01+", marks[i])] for i in rows]
    lists = [pa.array([[s[k] for s in r] for r in runs], pa.list_(pa.int64())) for k in range(2)]
    items = pa.array([sorted(found[i] - {None}) for i in rows], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *lists, items], names=["key", "starts", "ends", "items"])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(words_of(t.as_py())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["id", "sha", "n_words"])


def _joined() -> list[Column]:
    """``n_hit``, the words in any of the spans (starts, ends), and ``items``, sorted and once each."""
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["ends"] - F.greatest(s["starts"], a["end"]))).alias("n"), F.greatest(a["end"], s["ends"]).alias("end"))
    return [F.aggregate(spans, begin, step)["n"].alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items")]


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``find_contamination`` with the items counted and digested, and a verdict."""
    found = find_contamination(docs, benchmark, **options)
    return found.select(
        found.columns[0],
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_of_benchmark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", max_windows: int = 200_000, **options) -> DataFrame:
    """The documents, all columns as they were, in which no benchmark window occurs. Null and empty texts have no words and
    stay, as do rows with null ids and repeated rows whose text is clean. An empty table stays empty."""
    packed = docs.select(whole_row(docs), utf8(text_col).alias("__text"))
    found = find_contamination(packed, benchmark, id_col="row", text_col="__text", max_windows=max_windows, **options)
    return found.where("n_hit = 0").select("row.*")


def digest_of(items: list[str]) -> str:
    """The digest in ``contamination_report`` of sorted item ids."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
