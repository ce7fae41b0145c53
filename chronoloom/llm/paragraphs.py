"""Repeated passages: MinHash banding of paragraphs, exact verification, and removal by components.

A paragraph is a line. Bands are tuned so that a pair at the threshold meets with at least the
recall asked for; colliding paragraphs are verified by the Jaccard index of their word n-grams or by
the edit distance of their words; of each component the first paragraph stays. An edit distance bounds the
Jaccard index of sets of words, not of n-grams, so there bands are of words and tuned to that bound.

Passages that repeat inside longer lines, or run over several short ones, are found apart from lines: of
each PASSAGE words in a row the run of RUN words with the smallest hash is a unit, so that equal passages
give an equal unit wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, utf8, whole_row, with_id, words_of
from .exact_dedup import bitmap_filter, passes_filter
from .near import WORDS, NearLinks, Shingler, slices, tune_bands

#: Paragraphs with fewer words are too common to be called repeats, and stay.
MIN_WORDS = 20
RECALL, MOST_HASHES = 0.99, 24
#: Any two equal passages of PASSAGE words share a unit of RUN words.
RUN, PASSAGE = 20, 50


def edit_similarity(a: bytes, b: bytes, least: float) -> float:
    """1 - edits / words of the longer, or 0 if that is less than ``least``. Only the band of the table
    that can reach it is filled."""
    x, y = words_of(a), words_of(b)
    n = max(len(x), len(y))
    if not n:
        return 0.0
    most = int((1 - least) * n + 1e-9)
    if abs(len(x) - len(y)) > most:
        return 0.0
    far = most + 1
    row = {j: j for j in range(min(len(y), most) + 1)}
    for i, w in enumerate(x, 1):
        new = {}
        for j in range(max(0, i - most), min(len(y), i + most) + 1):
            best = min(row.get(j, far) + 1, new.get(j - 1, far) + 1)
            if j:
                best = min(best, row.get(j - 1, far) + (w != y[j - 1]))
            else:
                best = min(best, i)
            new[j] = min(best, far)
        row = new
    edits = row.get(len(y), far)
    return 0.0 if edits > most else 1 - edits / n


def split_paragraphs(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, text) of the long enough paragraphs; ``id`` is (document's id, number of the paragraph)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, numbers, texts = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    for k, line in enumerate((text or b"").split(b"\n")):
                        if len(line) >= 2 * min_words - 1 and len(words_of(line)) >= min_words:
                            rows.append(i)
                            numbers.append(k)
                            texts.append(line)
                ids = part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.int64()), pa.array(texts, pa.binary())], names=["doc", "no", "text"])

    rows = docs.select(column(id_col).alias("doc"), utf8(text_col).alias("text"))
    return rows.mapInArrow(scan, with_id(rows, "doc", "no long,text binary")).select(F.struct("doc", "no").alias("id"), "text")


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, *, min_words: int, hashes: int, shingle: int, ordered: bool) -> DataFrame:
    """Both kinds of candidates from one scan. A row for each paragraph that is long enough: ``doc``, ``no``, and ``fp``, ``n``, ``sig`` of its
    words. A row with a null ``no`` for each document with units: their hashes ``keys``, each once, and numbers of first words ``at``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle, ordered=ordered)
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for start, end in slices(lengths, 6 * WORDS):
                rows, numbers, lines, words, taken = [], [], [], [], []
                sizes = []
                for i, text in enumerate(batch.column(1).slice(start, end - start).to_pylist()):
                    sizes.append(0)
                    for k, line in enumerate((text or b"").split(b"\n")):
                        own = words_of(line)
                        words += own
                        sizes[-1] += len(own)
                        if len(own) >= min_words:
                            rows.append(i)
                            numbers.append(k)
                            lines.append(len(own))
                            taken.append(len(words))
                h = shingler.words(words)
                long = np.array(lines, dtype=np.int64)
                spot = np.repeat(np.array(taken, dtype=np.int64) - np.cumsum(long), long) + np.arange(long.sum())
                fps, n, sigs = shingler.sketches(h[spot], long, hashes)
                text, at, keys = run_units(h, np.array(sizes, dtype=np.int64))
                _, first = np.unique(_mixed(keys, text), return_index=True)  # a document's first unit of each hash
                first.sort()
                text, at, keys = text[first], at[first], keys[first]
                some, begins = np.unique(text, return_index=True)
                edges = pa.array(np.append(begins, len(text)), pa.int32())
                ids = batch.column(0).slice(start, end - start)
                no = pa.array([*numbers, *[None] * len(some)], pa.int64())
                pad = [None] * len(some)
                lists = [pa.concat_arrays([pa.nulls(len(rows), pa.list_(pa.int64())), pa.ListArray.from_arrays(edges, pa.array(x.view(np.int64)))]) for x in (keys, at)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([*rows, *some.tolist()], pa.int64())), no, pa.array([*fps, *pad], pa.binary()), pa.array([*n, *pad], pa.int32()), pa.array([*sigs, *pad], pa.binary()), *lists],
                    names=["doc", "no", "fp", "n", "sig", "keys", "at"],
                )

    rows = docs.select(column(id_col).alias("doc"), utf8(text_col).alias("text"))
    return rows.mapInArrow(scan, with_id(rows, "doc", "no long,fp binary,n int,sig binary,keys array<long>,at array<long>"))


def _mixed(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    return (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _over(x: np.ndarray, n: int, best: Callable) -> np.ndarray:
    """``best`` of each value and the n - 1 after it, of which there are fewer at the end."""
    out, done = x.copy(), 1
    while done < n:
        step = min(done, n - done)
        if step < len(out):
            out[:-step] = best(out[:-step], out[step:])
        done += step
    return out


def run_units(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' hashes of several texts: (text, number of the first word, hash) of the chosen runs of RUN words."""
    spot = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    runs, got = np.zeros(len(h), dtype=np.uint64), 0
    grown, length = h.copy(), 1
    while True:
        if RUN & length:
            if got < len(h):
                runs[: len(h) - got] = (runs[: len(h) - got] ^ (runs[: len(h) - got] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + grown[got:]
            got += length
        if 2 * length > RUN:
            break
        next_ = np.zeros_like(grown)
        next_[:-length] = grown[length:]
        grown = (grown ^ (grown >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + next_
        length *= 2
    runs ^= runs >> np.uint64(32)
    runs = runs * np.uint64(0x165667B19E3779F9) | np.uint64(1)
    least = _over(runs, PASSAGE - RUN + 1, np.minimum)
    least[spot + PASSAGE > np.repeat(sizes, sizes)] = 0
    most = _over(least[::-1], PASSAGE - RUN + 1, np.maximum)[::-1]
    at = np.flatnonzero(most == runs)
    return np.repeat(np.arange(len(sizes)), sizes)[at], spot[at], runs[at]


def repeated_passages(sketched: DataFrame, scratch: Scratch) -> DataFrame:
    """(__in, n_passages, passages, passage_docs) of the documents with units that other documents hold too. A filter of
    bounded size on the shared units leaves the others where they are."""
    units = sketched.where("no is null and doc is not null")
    each = units.select("doc", F.explode("keys").alias("key"))
    # a run that repeats within one document only isn't shared
    shared = each.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("key", "first")
    shared = scratch.write(shared, "shared")
    blocks, bits = bitmap_filter(shared, "key", shared.count())
    each = units.select("doc", F.explode(F.arrays_zip("keys", "at")).alias("u")).select("doc", F.col("u.keys").alias("key"), F.col("u.at").alias("at"))
    near = passes_filter(each, F.col("key"), blocks, bits).where("__hit").select("doc", "key", "at")
    return near.join(scratch.again(shared), "key").groupBy(F.col("doc").alias("__in")).agg(
        F.size(F.collect_set("key")).cast("long").alias("n_passages"), F.array_sort(F.collect_set("at")).alias("passages"), F.array_sort(F.collect_set("first")).alias("passage_docs")
    )


class RepeatedParagraphs:
    """Clusters of paragraphs."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, min_words: int = MIN_WORDS, recall: float = RECALL, most_hashes: int = MOST_HASHES, verify: str = "jaccard"):
        if verify not in ("jaccard", "edit"):
            raise ValueError(f"verify must be 'jaccard' or 'edit', not {verify!r}")
        ordered = verify == "edit"
        if ordered:  # edits of a share of the words leave at least this Jaccard index of the sets of words
            shingle = 1
        bands, rows = tune_bands(threshold / (2 - threshold) if ordered else threshold, recall, most_hashes)

        def collide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a == b).reshape(len(a), bands, rows).all(axis=2).any(axis=1)

        def edits(a: bytes, b: bytes) -> float:
            return edit_similarity(a, b, threshold)

        scratch = Scratch(docs.sparkSession, "paragraphs")
        self.sketched = scratch.write(
            sketch_documents(docs, id_col, text_col, min_words=min_words, hashes=bands * rows, shingle=shingle, ordered=ordered), "sketched"
        )
        self.near = near = NearLinks(
            split_paragraphs(docs, id_col, text_col, min_words), scratch=scratch, bands=bands, band_rows=rows, rule=collide, threshold=threshold, shingle=shingle,
            sketches=self.sketched.where("no is not null").select(F.struct("doc", "no").alias("id"), "fp", "n", "sig"), similar=edits if ordered else None,
        )
        groups = near.sketches.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("first"))
        many = groups.join(near.parts, "fp", "left").where("n > 1 or component is not null")
        many = near.scratch.write(many.withColumn("component", F.coalesce("component", "fp")), "many")
        clusters = near.scratch.again(many).groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("size"))
        labels = many.join(clusters.withColumnRenamed("first", "keep"), "component").select("fp", "keep", "size")
        #: A row for each paragraph of a cluster: document, number, the paragraph that stays, size, removed.
        self.rows = near.scratch.write(
            near.sketches.select("id", "fp").join(labels, "fp").select("id.doc", "id.no", "keep", "size", (F.col("id") != F.col("keep")).alias("removed")), "repeats"
        )


def find_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: its id; whatever its lines are, ``n_passages`` counts the units of RUN words that other documents hold
    too, ``passages`` has the numbers of their first words and ``passage_docs`` the first documents that hold them: an equal passage of
    PASSAGE words is always found, a shorter one of RUN words or more if its unit was chosen; ``drop_repeats`` leaves them.
    Of its lines, ``n_repeated`` are paragraphs that belong to a cluster of two or more, ``n_removed`` those that aren't the first of
    their cluster, by document id and number, ``removed`` their numbers, ``cluster_docs`` the ids of the documents whose paragraphs
    stay for its own, and ``n_lines`` all of them.

    Paragraphs of fewer than ``min_words`` words are left alone. Null and empty texts have no paragraphs and
    one. Rows that repeat an id are taken as one document in counts of repeats. Null ids are not
    matched with their repeats. Other columns are ignored. An empty table gives an empty result.
    """
    repeats = RepeatedParagraphs(docs, id_col=id_col, text_col=text_col, **options)
    found = repeats.rows.groupBy(F.col("doc").alias("__doc")).agg(
        F.countDistinct("no").alias("n_repeated"),
        F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("no")))).alias("removed"),
        F.array_sort(F.collect_set("keep.doc")).alias("cluster_docs"),
    )
    base = docs.select(column(id_col).alias("__id"), F.when(column(text_col).isNull(), 0).otherwise(F.size(F.split(column(text_col), "\n", -1))).cast("long").alias("n_lines"))
    passages = repeated_passages(repeats.sketched, repeats.near.scratch)
    out = base.join(found, F.col("__id") == F.col("__doc"), "left").join(passages, F.col("__id") == F.col("__in"), "left")
    none = F.array().cast("array<long>")
    return out.select(
        F.col("__id").alias(id_col),
        F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"),
        F.coalesce("passages", none).alias("passages"),
        F.coalesce("passage_docs", F.array().cast(passages.schema["passage_docs"].dataType)).alias("passage_docs"),
        F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
        F.coalesce("removed", none).alias("removed"),
        F.coalesce("cluster_docs", F.array().cast(found.schema["cluster_docs"].dataType)).alias("cluster_docs"),
        "n_lines",
    )


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns as they were but for the text, without the paragraphs that ``find_repeats`` removes.
    Documents that lose nothing stay where they are. A null or empty text stays as it is; of repeated rows each loses the
    same paragraphs; rows with a null id lose nothing; an empty table stays empty."""
    repeats = RepeatedParagraphs(docs, id_col=id_col, text_col=text_col, **options)
    lost = repeats.near.scratch.write(repeats.rows.where("removed").groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("no").alias("__no")), "lost")
    ids = lost.select("__doc")
    blocks, bits = bitmap_filter(ids, "__doc", ids.count())
    packed = docs.select(whole_row(docs), column(id_col).alias("__id"))
    told = passes_filter(packed, F.col("__id"), blocks, bits)
    hit = told.where("__hit").join(lost, F.col("__id") == F.col("__doc"), "left")
    own = F.col("row").getField(text_col)
    left = F.filter(F.transform(F.split(own, "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col("__no"), s["i"].cast("long")))
    text = F.when(F.col("__no").isNull(), own).otherwise(F.array_join(F.transform(left, lambda s: s["x"]), "\n"))
    cleaned = hit.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
    return told.where("not __hit").select("row.*").unionByName(cleaned)
