"""N-gram Jaccard join with Bayesian candidate pruning.

Candidates share a band of MinHash values. Their values are compared a few at a time; after
each step a pair is dropped if, given the matches so far and a uniform prior, the posterior
probability that its similarity reaches the threshold is below the tolerance. The rest is
verified exactly on whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Scratch, column, utf8, whole_row
from .exact_dedup import bitmap_filter, passes_filter
from .near import NearLinks, Shingler, tune_bands

#: Candidates at the threshold meet with at least this probability; a signature has so many values at most.
RECALL, MOST_HASHES = 0.999, 64


def fewest_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches of ``n`` values with which P(similarity >= threshold) is at least the
    tolerance. The posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum."""
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def bayes_rule(threshold: float, tolerance: float, hashes: int, step: int = 8) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Of two arrays of signatures, row by row: which pairs remain."""
    needs = [(n, fewest_matches(n, threshold, tolerance)) for n in range(step, hashes + 1, step)]

    def rule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        alive = np.arange(len(a))
        matches = np.zeros(len(a), dtype=np.int64)
        for n, least in needs:
            matches[alive] += (a[alive, n - step : n] == b[alive, n - step : n]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        kept = np.zeros(len(a), dtype=bool)
        kept[alive] = True
        return kept

    return rule


def near_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, tolerance: float = 1e-4, shingle: int = 5, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> NearLinks:
    bands, band_rows = tune_bands(threshold, recall, most_hashes)
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    rule = bayes_rule(threshold, tolerance, bands * band_rows)
    return NearLinks(rows, scratch=Scratch(docs.sparkSession, "near-join"), bands=bands, band_rows=band_rows, rule=rule, threshold=threshold, shingle=shingle)


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: its id, ``class_id`` (the smallest id that links lead to),
    ``class_size`` (documents), ``same_id`` (the smallest id with the same set of word n-grams)
    and ``n_links`` (other sets found within the threshold, in buckets of any size).

    Similarity is the Jaccard index of the sets of ``shingle`` consecutive lower-cased words; a
    shorter text is one n-gram. Texts without words (null, empty) are linked with nothing. Repeated
    rows are of one class. Null ids take part and give way to others as a class's id. Other
    columns are ignored. An empty table gives an empty result.
    """
    near = near_links(docs, id_col=id_col, **options)
    known = (
        near.classes.select("fp", F.col("id").alias("same_id"))
        .join(near.parts, "fp", "left")
        .join(near.degrees(), "fp", "left")
        .withColumn("component", F.coalesce("component", "fp"))
    )
    copies = near.sketches.where("fp is not null").groupBy("fp").agg(F.count("*").alias("copies"))
    known = near.scratch.write(known.join(copies, "fp"), "known")
    groups = known.groupBy("component").agg(F.min("same_id").alias("class_id"), F.sum("copies").alias("class_size"))
    labels = known.join(groups, "component").select("fp", "same_id", "class_id", "class_size", "n_links")
    out = near.sketches.select("id", "fp").join(labels, "fp", "left")
    alone = F.col("fp").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.when(alone, F.col("id")).otherwise(F.col("same_id")).alias("same_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, **options) -> DataFrame:
    """The documents, all columns as they were, with one of each class: that with the smallest id, and of
    repeated rows one. Texts without words (null, empty) stay. A null id gives way to others. An empty table stays
    empty. A filter of bounded size on the ids of classes with several documents leaves all other documents
    where they are."""
    near = near_links(docs, id_col=id_col, text_col=text_col, shingle=shingle, **options)
    grouped = near.sketches.where("fp is not null").groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("best"), F.count("*").alias("n"))
    grouped = near.scratch.write(
        grouped.join(near.parts, "fp", "left").select("fp", "best", "n", F.coalesce("component", "fp").alias("component")), "grouped"
    )
    stay = grouped.groupBy("component").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    stay = near.scratch.write(stay.select("component", "n", F.col("best.id").alias("__keep"), F.col("best.fp").alias("__fp")), "stay")
    many = stay.where("n > 1").select("component")
    ids = near.scratch.write(
        near.sketches.join(grouped.join(many, "component").select("fp"), "fp").select("id").distinct(), "ids"
    )
    blocks, bits = bitmap_filter(ids, "id", ids.count())
    packed = docs.select(whole_row(docs), column(id_col).alias("__id"), utf8(text_col).alias("__text"))
    told = passes_filter(packed, F.col("__id"), blocks, bits)
    hit = told.where("__hit").select("row", "__id", "__text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            fps = [shingler.key(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], names=["row", "own_id", "own_fp"])

    keyed = hit.mapInArrow(scan, StructType([hit.schema["row"], StructField("own_id", hit.schema["__id"].dataType), StructField("own_fp", BinaryType())]))
    kept = keyed.join(stay, keyed["own_id"].eqNullSafe(stay["__keep"]) & (keyed["own_fp"] == stay["__fp"])).dropDuplicates(["own_id", "own_fp"])
    return told.where("not __hit").select("row.*").unionByName(kept.select("row.*")).unionByName(keyed.where("own_fp is null").select("row.*"))
