"""Ranked lexical search over a tiered index.

The index is made in one scan: every few thousand documents become a segment of their own, with the postings of
each of its terms. A posting's impact, how much its document scores for the term, is fixed when it is written, and a term's postings are dealt to
tiers by falling impact. With each tier the segment keeps, by term, the greatest impact of the lower tiers: the residual bound.

A search reads the first tier of all segments. What a document has there is a lower bound of its score; with the
residual bounds of the item's terms that it wasn't seen with, an upper one. An item is proven when no document whose score is still open can reach its k-th
best lower bound. Items without that proof fall through: the next tier is read for them alone, down to the last, where every score is known.

Segments are searched independently; a task sends the best k of its segments by item, so postings are never shuffled.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import WORD_TABLE, column, utf8

#: Terms (with repeats) and documents after which a segment is closed.
SEGMENT_TERMS, SEGMENT_DOCS = 1_000_000, 4096
#: Of a term's postings in a segment, the shares (and least numbers) that end in the tiers before the last.
TIERS = ((1 / 16, 32), (1 / 4, 128))
LEVELS = len(TIERS) + 1
#: What a posting scores at most, and the two constants of the score.
SCALE, SATURATION, NORM = 1_000_000_000, 8, 75
#: Rows are some megabytes, and a task takes whole row groups: these are kept small, and their size looked at after each row.
WRITE = {"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: (item, term) entries searched for at a time.
ENTRIES = 500_000


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What postings score for one unit of their term's weight: ``tf`` occurrences in a document of ``n`` terms, in a
    corpus of ``n_docs`` documents with terms and ``n_terms`` terms."""
    # 75 * n * N div L, in two steps that don't leave 64 bits: n = a * L + b, and N is at most L
    whole, part = np.divmod(n, n_terms)
    product = [NORM * int(b) * n_docs // n_terms for b in part] if n_docs and NORM * int(part.max(initial=0)) > (1 << 62) // n_docs else NORM * part * n_docs // n_terms
    m = 100 - NORM + NORM * whole * n_docs + np.asarray(product, dtype=np.int64)
    return (SCALE * tf) // (1000 * tf + SATURATION * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Segment:
    """Postings of some documents, by tier. ``terms``: distinct, in the order of ``starts``."""

    def __init__(self, texts: list[list[bytes]], n_docs: int, n_terms: int):
        n = np.array([len(w) for w in texts], dtype=np.int64)
        coded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
        self.terms = coded.dictionary
        self.df = np.zeros(len(self.terms), dtype=np.int64)
        self.tiers: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        owner = np.repeat(np.arange(len(texts)), n)
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(texts) + owner, return_counts=True)
        term, doc = np.divmod(key, max(1, len(texts)))
        impact = impacts(tf.astype(np.int64), n[doc], n_docs, max(1, n_terms))
        self.df = np.bincount(term, minlength=len(self.terms))
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        first = np.cumsum(self.df) - self.df
        rank = np.arange(len(term)) - np.repeat(first, self.df)
        ends = [np.minimum(self.df, np.maximum(least, np.ceil(self.df * share).astype(np.int64))) for share, least in TIERS] + [self.df]
        begin = np.zeros_like(self.df)
        for end in ends:
            mine = (rank >= np.repeat(begin, self.df)) & (rank < np.repeat(end, self.df))
            rest = np.zeros(len(self.df), dtype="<u4")
            open_ = end < self.df
            rest[open_] = impact[(first + end)[open_]]
            starts = np.concatenate([[0], np.cumsum(end - begin)])
            self.tiers.append((starts.astype("<u4"), doc[mine].astype("<u2"), impact[mine].astype("<u4"), rest))
            begin = end


def _columns(tier: int) -> list[str]:
    return [f"{c}{tier}" for c in ("starts", "docs", "impacts", "rest")]


def _index_schema(id_field: StructField) -> StructType:
    tiers = [StructField(c, BinaryType()) for k in range(LEVELS) for c in _columns(k)]
    return StructType([StructField("segment", LongType()), StructField("ids", ArrayType(id_field.dataType)), StructField("terms", ArrayType(BinaryType())), StructField("df", BinaryType()), *tiers])


def _words(text: pa.Scalar) -> list[bytes]:
    held = text.as_py()
    return held.translate(WORD_TABLE).split() if held else []


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with terms, and terms."""
    docs = terms = 0
    for batch in batches:
        for text in batch.column(0):
            n = len(_words(text))
            docs += n > 0
            terms += n
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])


class TieredIndex:
    """A kept index: Parquet segments in ``path`` (a folder that driver and executors share) and what they add up to."""

    def __init__(self, spark: SparkSession, path: str, n_docs: int, n_terms: int):
        self.spark, self.path, self.n_docs, self.n_terms = spark, path, n_docs, n_terms

    @classmethod
    def build(cls, docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> TieredIndex:
        """Index whole texts of all documents. Two scans: counts of documents and terms, then the segments. Nothing is shuffled.

        Null texts have no terms, nor have texts without letters or digits; they are never found. Rows with null ids and repeated rows are
        indexed like others; other columns are ignored; an empty table makes an empty index.
        """
        spark = docs.sparkSession
        counted = docs.select(utf8(text_col)).mapInArrow(_counts, "docs long, terms long").agg(F.sum("docs").alias("d"), F.sum("terms").alias("t")).first()
        n_docs, n_terms = counted.d or 0, counted.t or 0
        schema = _index_schema(docs.schema[id_col])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32

            def row(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
                made = Segment(texts, n_docs, n_terms)
                values = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.ListArray.from_arrays(pa.array([0, len(made.terms)], pa.int32()), made.terms)]
                packed = [made.df.astype("<u4"), *(x for tier in made.tiers for x in tier)]
                return pa.RecordBatch.from_arrays([*values, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=schema.names)

            ids: list[pa.Array] = []
            texts: list[list[bytes]] = []
            n = 0
            for batch in batches:
                for i, text in enumerate(batch.column(1)):
                    words = _words(text)
                    if not words:
                        continue
                    ids.append(batch.column(0).slice(i, 1))
                    texts.append(words)
                    n += len(words)
                    if n >= SEGMENT_TERMS or len(texts) == SEGMENT_DOCS:
                        yield row(pa.concat_arrays(ids), texts)
                        number += 1
                        ids, texts, n = [], [], 0
            if texts:
                yield row(pa.concat_arrays(ids), texts)

        made = docs.select(column(id_col), utf8(text_col).alias("__text")).mapInArrow(scan, schema)
        made.write.options(**WRITE).parquet(f"{path}/segments")
        spark.createDataFrame([(json.dumps({"n_docs": n_docs, "n_terms": n_terms}),)], "held string").coalesce(1).write.text(f"{path}/totals")
        return cls(spark, path, n_docs, n_terms)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TieredIndex:
        held = json.loads(spark.read.text(f"{path}/totals").first()[0])
        return cls(spark, path, held["n_docs"], held["n_terms"])

    def segments(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments")

    def weights(self, terms: list[bytes]) -> dict[bytes, int]:
        """Of the terms that occur, by term. A row a term is gathered."""
        wanted = self.spark.sparkContext.broadcast(terms)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = pa.array(wanted.value, pa.binary())
            total = np.zeros(len(held), dtype=np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    at = pc.index_in(held, value_set=batch.column(0)[i].values)
                    found = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                    total[found] += np.frombuffer(batch.column(1)[i].as_py(), dtype="<u4")[at.drop_null().to_numpy()]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([held.take(pa.array(some)), pa.array(total[some])], names=["term", "df"])

        found = self.segments().select("terms", "df").mapInArrow(scan, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        out = {bytes(r.term): weight(self.n_docs, r.df) for r in found.collect()}
        wanted.unpersist()
        return out

    def search(self, items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
        """For each item its ``k`` documents of highest score above 0 (all, if fewer): the item's id, ``rank`` (from 1, unique), ``doc_id``, ``score``
        and ``tier``, the last tier that its proof took. Equal scores go to the lower id, null ids last.

        An item's terms count as often as they occur. Items with null or empty texts, or none of the corpus's terms, find nothing;
        repeated items give repeated results; an empty table of items or an empty index gives an empty result. Other columns are ignored.
        Items are sent to the workers, ``ENTRIES`` of their terms at a time.
        """
        id_field = items.schema[item_col]
        doc_type = self.segments().schema["ids"].dataType.elementType
        schema = StructType([StructField("item", LongType()), StructField("doc_id", doc_type), StructField("score", LongType()), StructField("rest", LongType())])
        named = items.select(column(item_col).alias("item_id"), utf8(text_col).alias("t")).where("t is not null")
        out = None
        for block in _blocks(named):
            terms = sorted({t for _, counted in block for t in counted})
            weights = self.weights(terms)
            place = {t: i for i, t in enumerate(terms)}
            entries = [(np.array([place[t] for t in c if weights.get(t)], dtype=np.int64), np.array([n * weights[t] for t, n in c.items() if weights.get(t)], dtype=np.int64)) for _, c in block]
            left = [i for i, (t, _) in enumerate(entries) if len(t)]
            rows: list[tuple] = []
            floor: dict[int, int] = {}
            for level in range(LEVELS):
                if not left:
                    break
                told = self._level(terms, entries, left, floor, level, k, schema)
                proven = []
                for i in left:
                    best, ceiling = told.get(i, ([], 0))
                    floor[i] = max(1, best[k - 1][1] if len(best) >= k else 1)
                    if ceiling < floor[i]:
                        proven.append(i)
                        rows += [(block[i][0], rank, d, s, level) for rank, (d, s) in enumerate(best, 1)]
                left = [i for i in left if i not in set(proven)]
            found = self.spark.createDataFrame(rows, _result(id_field, item_col, doc_type))
            out = found if out is None else out.unionByName(found)
        return out if out is not None else self.spark.createDataFrame([], _result(id_field, item_col, doc_type))

    def _level(self, terms: list[bytes], entries: list, left: list[int], floor: dict[int, int], level: int, k: int, schema: StructType) -> dict[int, tuple[list[tuple], int]]:
        """Of the items ``left``, with the tiers down to ``level``: the best k (document, lower bound) and the highest upper bound
        of a document whose score isn't known. At most k + 1 rows an item leave a task, and as many reach the driver."""
        held = self.spark.sparkContext.broadcast((terms, {i: entries[i] for i in left}, floor))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms_, wanted, least = held.value
            asked = pa.array(terms_, pa.binary())
            best: dict[int, tuple] = {}
            ceiling: dict[int, int] = {}
            for batch in batches:
                for row in range(batch.num_rows):
                    ids = batch.column(0)[row].values
                    at = pc.fill_null(pc.index_in(asked, value_set=batch.column(1)[row].values), -1).to_numpy()
                    tiers = [[np.frombuffer(batch.column(2 + 4 * t + c)[row].as_py(), dtype=d) for c, d in enumerate(("<u4", "<u2", "<u4", "<u4"))] for t in range(level + 1)]
                    for i, (numbers, weights) in wanted.items():
                        lower, rest, top = _scores(at[numbers], weights, tiers, len(ids), least.get(i, 1))
                        if lower is None:
                            continue
                        ceiling[i] = max(ceiling.get(i, 0), top)
                        best[i] = _keep(best.get(i), ids, lower, k)
            items_, docs_, scores_, rest_ = [], [], [], []
            for i, (ids, lower) in best.items():
                items_ += [i] * len(lower)
                docs_.append(ids)
                scores_ += lower.tolist()
                rest_ += [None] * len(lower)
            if docs_:
                found = pa.concat_arrays(docs_)
                yield pa.RecordBatch.from_arrays([pa.array(items_, pa.int64()), found, pa.array(scores_, pa.int64()), pa.array(rest_, pa.int64())], names=schema.names)
                tops = [(i, c) for i, c in ceiling.items() if c]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in tops], pa.int64()), pa.nulls(len(tops), found.type), pa.nulls(len(tops), pa.int64()), pa.array([c for _, c in tops], pa.int64())], names=schema.names)

        columns = ["ids", "terms", *(c for t in range(level + 1) for c in _columns(t))]
        found = self.segments().select(*columns).mapInArrow(scan, schema)
        by = Window.partitionBy("item", F.col("rest").isNull()).orderBy(F.desc("rest"), F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= F.when(F.col("rest").isNull(), k).otherwise(1)).orderBy("item", "rank")
        out: dict[int, tuple[list, int]] = {}
        for r in top.collect():
            best, ceiling = out.setdefault(r.item, ([], 0))
            if r.rest is None:
                best.append((r.doc_id, r.score))
            else:
                out[r.item] = (best, r.rest)
        held.unpersist()
        return out


def _result(id_field: StructField, item_col: str, doc_type) -> StructType:
    return StructType([StructField(item_col, id_field.dataType), StructField("rank", IntegerType()), StructField("doc_id", doc_type), StructField("score", LongType()), StructField("tier", LongType())])


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items and the counts of their terms, some at a time."""
    held: list[tuple] = []
    n = 0
    for r in items.toLocalIterator():
        counted = Counter(bytes(r.t).translate(WORD_TABLE).split())
        held.append((r.item_id, counted))
        n += len(counted)
        if n >= ENTRIES:
            yield held
            held, n = [], 0
    if held:
        yield held


def _scores(at: np.ndarray, weights: np.ndarray, tiers: list, n: int, least: int) -> tuple:
    """Lower bounds of the ``n`` documents' scores, what may be missing from each, and the highest upper bound of those with
    something missing. ``at``: the terms' places in the segment, -1 where it doesn't hold one. None if no document can reach ``least``."""
    some = at >= 0
    at, weights = at[some], weights[some]
    last = tiers[-1][3][at].astype(np.int64) * weights
    if not len(at):
        return None, None, 0
    lower, seen = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for t, (w, r) in enumerate(zip(weights.tolist(), last.tolist(), strict=True)):
        for starts, docs, impact, _ in tiers:
            a, b = starts[at[t]], starts[at[t] + 1]
            if a < b:
                mine = docs[a:b]
                lower[mine] += impact[a:b].astype(np.int64) * w
                if r:
                    seen[mine] += r
    rest = int(last.sum()) - seen
    upper = lower + rest
    if int(upper.max(initial=0)) < least:
        return None, None, 0
    return lower, rest, int(upper[rest > 0].max(initial=0))


def _keep(held: tuple | None, ids: pa.Array, lower: np.ndarray, k: int) -> tuple:
    """The best k of those held and those of a segment, by bound and id."""
    some = np.flatnonzero(lower)
    if len(some) > k:
        floor = np.partition(lower[some], -k)[-k]
        some = some[lower[some] >= floor]  # with all that tie for the last place
    ids, lower = ids.take(pa.array(some, pa.int64())), lower[some]
    if held:
        ids, lower = pa.concat_arrays([held[0], ids]), np.concatenate([held[1], lower])
    order = pc.sort_indices(pa.table({"s": lower, "i": ids}), sort_keys=[("s", "descending"), ("i", "ascending")], null_placement="at_end").slice(0, k)
    return ids.take(order), lower[order.to_numpy()]


def search(docs: DataFrame, items: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Index the documents in ``path`` and rank all of them for each item. See ``TieredIndex``."""
    return TieredIndex.build(docs, path, id_col=id_col, text_col=text_col).search(items, **options)
