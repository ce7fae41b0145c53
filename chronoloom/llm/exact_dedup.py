"""Exact deduplication over a log-structured merge index of text digests.

Memtables are the rows that a task holds while it scans; each is sorted by digest and flushed as a file. The files
of one table are merged into a run: sorted, a row per digest with how many texts have it and the identifier to keep,
and a bitmap filter beside it. Runs are on levels; as soon as a level has ``fanout`` of them they are compacted into one of
the next. A lookup asks each run's filter first and joins only what passes. Texts whose digests are met twice are compared
byte by byte; a filter of those digests lets all other texts pass without being moved. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, whole_row

#: A bitmap block of Spark's bitmap functions: 4 KB.
BLOCK_BITS = 32768
#: The filter has at most so many bits, and so 4 MB, for any input.
MAX_FILTER_BITS = 1 << 25
#: Runs of a level that are compacted into one of the next.
FANOUT = 8


def _best(keep: str) -> Column:
    """The row that stays: null identifiers last, then the smallest or largest, then the
    smallest or largest sequence number among repeated rows."""
    if keep == "smallest":
        return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "seq"))
    if keep == "largest":
        return F.max(F.struct(F.col("id").isNotNull().alias("some"), "id", "seq"))
    raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")


def _position(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap_filter(keys: DataFrame, key: str, expected: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """A bitmap of the keys' hashes, as rows (block, bits), and its size in bits: a power of
    two that doesn't exceed MAX_FILTER_BITS. More keys make it less selective, never wrong."""
    bits = min(MAX_FILTER_BITS, max(BLOCK_BITS, 1 << math.ceil(math.log2(max(1, expected) * bits_per_key))))
    at = keys.select(_position(F.col(key), bits).alias("at"))
    blocks = at.groupBy(F.expr(f"at div {BLOCK_BITS}").alias("__block")).agg(
        F.bitmap_construct_agg(F.col("at") % BLOCK_BITS).alias("__bits")
    )
    return blocks, bits


def passes_filter(rows: DataFrame, key: Column, blocks: DataFrame, bits: int) -> DataFrame:
    """The rows with an added ``__hit``: false only if the key is surely not in the filter."""
    at = rows.withColumn("__at", _position(key, bits)).withColumn("__block", F.expr(f"__at div {BLOCK_BITS}"))
    joined = at.join(F.broadcast(blocks), "__block", "left")
    byte = f"conv(hex(substring(__bits, cast((__at % {BLOCK_BITS}) div 8 as int) + 1, 1)), 16, 10)"
    hit = F.expr(f"(cast({byte} as int) & shiftleft(1, cast(__at % 8 as int))) != 0")
    return joined.withColumn("__hit", F.coalesce(hit, F.lit(False))).drop("__at", "__block", "__bits")


@dataclass(frozen=True)
class Run:
    """A sorted run of an index: its level, its folder, its digests, and the bits of the filter beside it."""

    level: int
    path: str
    n: int
    bits: int


class DigestIndex:
    """A persistent index in a folder that driver and executors share. ``append`` adds the digests of a table; ``lookup``
    says which digests are known. The newest manifest names the runs that count, so an append or a compaction that is cut
    off leaves the index as it was."""

    def __init__(self, spark: SparkSession, root: str, *, keep: str = "smallest", fanout: int = FANOUT):
        self.spark, self.root, self.keep, self.fanout = spark, root.rstrip("/"), keep, fanout
        self.version, self.runs = self._open()

    def _files(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _open(self) -> tuple[int, list[Run]]:
        fs, path = self._files(self.root)
        names = [str(x.getPath().getName()) for x in fs.listStatus(path)] if fs.exists(path) else []
        done = sorted(n for n in names if n.startswith("manifest-") and fs.exists(self._files(f"{self.root}/{n}/_SUCCESS")[1]))
        if not done:
            return 0, []
        rows = self.spark.read.parquet(f"{self.root}/{done[-1]}").collect()
        return int(done[-1].removeprefix("manifest-")), [Run(*r) for r in sorted(rows)]

    def _save(self, runs: list[Run]) -> None:
        """Write the next manifest, and then delete what only older ones name."""
        gone = [r for r in self.runs if r not in runs]
        told = self.spark.createDataFrame([(r.level, r.path, r.n, r.bits) for r in runs], "level int, path string, n long, bits long")
        told.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest-{self.version + 1:08d}")
        old = f"{self.root}/manifest-{self.version:08d}"
        self.version, self.runs = self.version + 1, runs
        for path in [*(p for r in gone for p in (r.path, f"{r.path}-filter")), old]:
            fs, found = self._files(path)
            fs.delete(found, True)

    def table(self, run: Run) -> DataFrame:
        return self.spark.read.parquet(run.path)

    def _write(self, merged: DataFrame, level: int) -> Run:
        path = f"{self.root}/run-{level}-{uuid.uuid4().hex}"
        merged.sortWithinPartitions("digest").write.parquet(path)
        n = self.spark.read.parquet(path).count()
        blocks, bits = bitmap_filter(self.spark.read.parquet(path), "digest", n)
        blocks.write.parquet(f"{path}-filter")
        return Run(level, path, n, bits)

    def append(self, flushed: DataFrame) -> Run:
        """Merge the flushed files of a table (id, digest, seq) into a run of the first level, and compact levels that are
        full. Equal digests of a file meet before the shuffle, so copies of one text never meet in a task."""
        run = self._write(flushed.groupBy("digest").agg(F.count("*").alias("n"), _best(self.keep).alias("best")).select("digest", "n", "best.id", "best.seq"), 0)
        self._save([*self.runs, run])
        while full := [r for r in self.runs if sum(x.level == r.level for x in self.runs) >= self.fanout]:
            level = min(r.level for r in full)
            mine = [r for r in self.runs if r.level == level]
            self._save([*(r for r in self.runs if r.level != level), self._write(self.merged(mine), level + 1)])
        return run

    def merged(self, runs: list[Run] | None = None) -> DataFrame:
        """(digest, n, id, seq): a row for each digest of the runs, of all if none are named."""
        tables = [self.table(r) for r in (self.runs if runs is None else runs)]
        if len(tables) == 1:
            return tables[0]
        every = tables[0]
        for t in tables[1:]:
            every = every.unionByName(t)
        return every.groupBy("digest").agg(F.sum("n").alias("n"), _best(self.keep).alias("best")).select("digest", "n", "best.id", "best.seq")

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, n, id) of those of ``digests`` that are in the index. Each run's filter is asked first, and only what
        it lets pass is joined with the run."""
        digests = digests.select("digest").distinct()
        found = []
        for run in self.runs:
            passed = passes_filter(digests, F.col("digest"), self.spark.read.parquet(f"{run.path}-filter"), run.bits).where("__hit").select("digest")
            found.append(passed.join(self.table(run), "digest"))
        if not found:
            return digests.select("digest", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("id")).limit(0)
        every = found[0]
        for t in found[1:]:
            every = every.unionByName(t)
        return every.groupBy("digest").agg(F.sum("n").alias("n"), _best(self.keep).alias("best")).select("digest", "n", "best.id")


class Copies:
    """The copies within one table of texts, by an index of it."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, keep: str, digest_bytes: int = 32):
        self.scratch = Scratch(docs.sparkSession, "digest-index")
        self.digest_bytes = digest_bytes
        self.keep = keep
        self.texts = digested(docs, id_col, text_col)
        self.index = DigestIndex(docs.sparkSession, self.scratch.path("index"), keep=keep)
        self.rows = flush(self.texts, self.scratch, digest_bytes)
        self.hits = self.index.table(self.index.append(self.rows)).where("n > 1")
        self.n_hits = self.hits.count()
        self.filter, self.bits = bitmap_filter(self.hits, "digest", self.n_hits)

    def key(self) -> Column:
        return F.substring("sha", 1, self.digest_bytes)

    def collisions(self) -> DataFrame:
        """Byte verification: digests whose texts are not all the same. Only texts that the filter
        hits are compared; the smallest and largest of a digest are equal only if all are."""
        texts = self.texts.select(self.key().alias("digest"), "text")
        hit = passes_filter(texts, F.col("digest"), self.filter, self.bits).where("__hit")
        found = hit.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
        return found.where("a <> b").select("digest")

    def resolve(self) -> DataFrame:
        """A row for each document: id, seq, sha, keep_id, keep_seq, n."""
        clash = self.scratch.write(self.collisions(), "collisions")
        rows, hits = self.rows, self.hits
        other = None
        if not clash.isEmpty():  # texts of one digest that differ: they are told apart by their bytes
            rows, hits = (x.join(clash, "digest", "left_anti") for x in (rows, hits))
            split = self.scratch.write(
                self.texts.withColumn("digest", self.key())
                .join(clash, "digest", "left_semi")
                .select("id", "text", "sha", F.monotonically_increasing_id().alias("seq")),
                "split",
            )
            best = split.groupBy("text").agg(F.count("*").alias("n"), _best(self.keep).alias("best"))
            other = split.join(best, "text").select(
                "id", "seq", "sha", F.col("best.id").alias("keep_id"), F.col("best.seq").alias("keep_seq"), "n"
            )
        twice = hits.select("digest", "n", F.col("id").alias("k_id"), F.col("seq").alias("k_seq"))
        out = rows.join(twice, "digest", "left").select(
            "id",
            "seq",
            "sha",
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("k_id")).alias("keep_id"),
            F.coalesce("k_seq", "seq").alias("keep_seq"),
            F.coalesce("n", F.lit(1)).alias("n"),
        )
        return out if other is None else out.unionByName(other)


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, sha); a null text counts as empty."""
    texts = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    return texts.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def flush(texts: DataFrame, scratch: Scratch, digest_bytes: int = 32) -> DataFrame:
    """(id, sha, seq, digest): each task's rows, sorted by digest, are a file."""
    rows = texts.select("id", "sha").withColumn("seq", F.monotonically_increasing_id()).sortWithinPartitions("sha")
    written = scratch.write(rows, "memtables")
    out = written.withColumn("digest", F.substring("sha", 1, digest_bytes))
    out._scratch_path = written._scratch_path
    return out


def known_copies(docs: DataFrame, index: DigestIndex, earlier: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, known_id): the documents whose text one of ``earlier`` has, which were appended to the index before. The index's
    hits are verified byte by byte against the earlier text. Null texts count as empty; repeated rows give a row each; other
    columns are ignored; of an empty table or index there are none."""
    scratch = Scratch(docs.sparkSession, "known-copies")
    rows = flush(digested(docs, id_col, text_col), scratch)
    known = scratch.write(index.lookup(rows).select("digest", F.col("id").alias("known_id")), "known")
    blocks, bits = bitmap_filter(known, "digest", known.count())
    mine = passes_filter(digested(docs, id_col, text_col), F.col("sha"), blocks, bits).where("__hit").select("id", "text", "sha")
    old = digested(earlier, id_col, text_col).select(F.col("id").alias("old_id"), F.col("text").alias("old"), F.col("sha").alias("old_sha"))
    old = old.join(known, (F.col("old_sha") == F.col("digest")) & F.col("old_id").eqNullSafe(F.col("known_id")), "left_semi").dropDuplicates(["old_sha"])
    return mine.join(old, F.col("sha") == F.col("old_sha")).where("text = old").select(F.col("id").alias(id_col), F.col("old_id").alias("known_id"))


def append_documents(docs: DataFrame, index: DigestIndex, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Add the texts of a table to the index."""
    scratch = Scratch(docs.sparkSession, "append")
    rows = flush(digested(docs, id_col, text_col), scratch)
    index.append(rows)
    scratch.drop(rows)


def find_exact_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    digest_bytes: int = 32,
) -> DataFrame:
    """One row per document: its id, ``keep_id`` (of the row of its group that stays),
    ``group_size``, ``kept`` and ``text_sha256``. Texts are equal when their bytes are.

    A null text counts as empty. Of repeated rows (same id, same text) exactly one is
    kept. Null ids are kept only if their group has no other. Other columns are ignored.
    An empty table gives an empty result.
    """
    index = Copies(docs, id_col, text_col, keep, digest_bytes)
    return index.resolve().select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("seq") == F.col("keep_seq")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    digest_bytes: int = 32,
) -> DataFrame:
    """The documents, all columns as they were, without those that ``find_exact_copies`` drops.
    Texts that the index's filter doesn't hit stay where they are; the others are matched with the
    rows to keep by digest and id, so that the copies of a text are dealt evenly. Of rows that share id and text but differ in other columns one
    is kept, whichever: ids that are to tell rows apart must be unique. An empty table stays empty."""
    index = Copies(docs, id_col, text_col, keep, digest_bytes)
    rows = docs.select(whole_row(docs), column(id_col).alias("__id"), F.coalesce(column(text_col), F.lit("")).alias("__text"))
    sha = F.unhex(F.sha2(F.col("__text").cast("binary"), 256))
    told = passes_filter(rows.withColumn("__sha", sha), F.substring("__sha", 1, digest_bytes), index.filter, index.bits)
    clean = told.where("not __hit").select("row.*")
    stay = index.resolve().where("seq = keep_seq").select(F.col("id").alias("__keep"), F.col("sha").alias("__stay"))
    hit = told.where("__hit")
    kept = hit.join(stay, hit["__id"].eqNullSafe(stay["__keep"]) & (hit["__sha"] == stay["__stay"]))
    return clean.unionByName(kept.dropDuplicates(["__sha", "__id"]).select("row.*"))
