"""What the near-duplicate operators share: shingle sets, MinHash, banding, verification
and components, for texts keyed by the fingerprint of their shingle set.

Texts with the same shingle set are one class and are compared once. Buckets of at most
SMALL_BUCKET classes give all their pairs. Larger buckets are linked to hubs first, which
grows with their size and not its square; afterwards members that are still outside the
bucket's main component are compared, in blocks, with all others, so that no link between
components is lost. Where links are counted, all members of large buckets are compared with each
other, in blocks within workers, and only counts leave them. Nothing is collected to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, utf8, with_id, words_of
from .exact_dedup import bitmap_filter, passes_filter

SMALL_BUCKET = 24
HUBS = 4
#: Rows and shingles of a block of a large bucket, when its rest is compared.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000

_MULT = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(20240301).integers(0, 2**63, 256, dtype=np.uint64)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class Shingler:
    """Distinct 64-bit hashes, sorted, of the runs of ``size`` words of a text; a text of fewer
    words, but not none, is one run. ``ordered``: texts are equal if their words are, not their sets of runs."""

    def __init__(self, size: int = 5, most: int = 300_000, ordered: bool = False):
        self.size, self.most, self.ordered = size, most, ordered
        self.known: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def runs(self, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words' hashes of several texts, with the number of words of each: the hash of each run, and
        how many runs each text has."""
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(h))
        total = np.zeros(len(h), dtype=np.uint64)
        for k in range(min(self.size, int(sizes.max(initial=0)))):
            x = h[k:] * _PLACE[k % 5] + np.uint64(k)
            x = (x ^ (x >> np.uint64(29))) * _PLACE[(k + 2) % 5]
            x[room[: len(x)] <= k] = 0
            total[: len(x)] += x
        begins = room >= self.size
        begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        total = total[begins]
        total ^= total >> np.uint64(32)
        return total * _PLACE[0], np.where(sizes > 0, np.maximum(1, sizes - self.size + 1), 0)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = words_of(text)
        return np.unique(self.runs(self.words(words), np.array([len(words)]))[0])

    def key(self, text: bytes | None) -> bytes | None:
        """What equal texts share; None without words."""
        words = words_of(text)
        if not words:
            return None
        h = self.words(words)
        return fingerprint(h if self.ordered else np.unique(self.runs(h, np.array([len(words)]))[0]))

    def sketches(self, h: np.ndarray, sizes: np.ndarray, k: int) -> tuple[list, list[int], list]:
        """Of the words' hashes of several texts: keys, numbers of distinct runs, and signatures of ``k`` values of
        32 bits. None, 0 and None without words."""
        runs, counts = self.runs(h, sizes)
        live = np.flatnonzero(counts)
        keys: list = [None] * len(sizes)
        sigs: list = [None] * len(sizes)
        n = [0] * len(sizes)
        if not len(live):
            return keys, n, sigs
        starts = (np.cumsum(counts) - counts)[live]
        best = np.empty((len(live), k), dtype=np.uint32)
        for j in range(k):
            best[:, j] = np.minimum.reduceat(runs * _MULT[j] + _ADD[j], starts) >> np.uint64(32)
        word = np.cumsum(sizes) - sizes
        for row, (i, at) in enumerate(zip(live.tolist(), starts.tolist(), strict=True)):
            own = np.sort(runs[at : at + counts[i]])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            keys[i] = fingerprint(h[word[i] : word[i] + sizes[i]] if self.ordered else own)
            n[i], sigs[i] = len(own), best[row].tobytes()
        return keys, n, sigs


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` words."""
    start = n = 0
    for at, size in enumerate(sizes, 1):
        n += size
        if n >= most:
            yield start, at
            start, n = at, 0
    if start < len(sizes):
        yield start, len(sizes)


def fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: Words that are hashed at a time.
WORDS = 50_000


def sketch(rows: DataFrame, *, hashes: int, shingle: int = 5) -> DataFrame:
    """Of rows (id, text): id, fp, n (shingles) and sig. Texts without words have a null fp."""
    if not 0 < hashes <= len(_MULT):
        raise ValueError(f"there are 1 to {len(_MULT)} hashes")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for start, end in slices(lengths, 6 * WORDS):
                words = [words_of(t) for t in batch.column(1).slice(start, end - start).to_pylist()]
                sizes = np.array([len(w) for w in words], dtype=np.int64)
                fps, n, sigs = shingler.sketches(shingler.words([w for ws in words for w in ws]), sizes, hashes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(fps, pa.binary()), pa.array(n, pa.int32()), pa.array(sigs, pa.binary())], names=["id", "fp", "n", "sig"]
                )

    return rows.select("id", utf8("text").alias("text")).mapInArrow(scan, with_id(rows, "id", "fp binary,n int,sig binary"))


def tune_bands(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): of those with at most ``most`` values in all that reach the recall at the
    threshold, the most selective, with as many bands as fit. Where none does, that is an error."""
    if not 0 < most <= len(_MULT):
        raise ValueError(f"there are 1 to {len(_MULT)} hashes")
    for rows in range(most, 0, -1):
        bands = most // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    raise ValueError(f"{most} hashes don't reach a recall of {recall} at {threshold}")


def band_members(classes: DataFrame, scratch: Scratch, *, bands: int, rows: int) -> DataFrame:
    """Of classes (fp, sig): (bk, band, fp, g) for each bucket of at least two, with its size."""
    width = 4 * rows
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(bands)])
    banded = classes.select("fp", F.posexplode(keys).alias("band", "bk"))
    sizes = banded.groupBy("bk").agg(F.count("*").alias("g")).where("g > 1")
    return scratch.write(banded.join(sizes, "bk"), "members")


def candidate_pairs(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct (a, b, g): all pairs of small buckets, with g = 1; hub and member in large ones. The hubs of
    a bucket are the members of smallest hash in each of a few parts."""
    small = members.where(F.col("g") <= SMALL_BUCKET).groupBy("bk").agg(F.array_sort(F.collect_list("fp")).alias("l"))
    pair = F.expr(
        "flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> named_struct('a', x, 'b', y))))"
    )
    near = small.select(F.explode(pair).alias("p")).select("p.a", "p.b", F.lit(1).cast("long").alias("g"))
    part, rank = F.pmod(F.xxhash64("fp"), F.lit(HUBS)), F.struct(F.xxhash64("fp").alias("h"), "fp")
    heads = (
        scratch.again(members)
        .where(F.col("g") > SMALL_BUCKET)
        .groupBy("bk", part.alias("part"))
        .agg(F.min(rank).alias("head"))
        .select(F.col("bk").alias("hb"), F.col("head.fp").alias("a"))
    )
    large = members.where(F.col("g") > SMALL_BUCKET)
    star = large.join(heads, large["bk"] == heads["hb"]).where("a <> fp").select("a", F.col("fp").alias("b"), "g")
    return near.unionByName(star).groupBy("a", "b").agg(F.when(F.min("g") == 1, 1).otherwise(F.max("g")).cast("long").alias("g"))


def prune_pairs(pairs: DataFrame, classes: DataFrame, rule: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float) -> DataFrame:
    """The pairs (a, b, g) whose signatures the rule lets pass and whose sets differ in size by a factor of ``least`` at most: the
    Jaccard index can't exceed it."""
    sig = classes.select("fp", "sig", "n")
    both = (
        pairs.join(sig.select(F.col("fp").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b")), "b")
        .join(sig.select(F.col("fp").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a")), "a")
        .where(F.greatest("n_a", "n_b") * F.lit(least - 1e-9) <= F.least("n_a", "n_b"))
        .select("a", "b", "g", "sig_a", "sig_b")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for i in (3, 4))
                kept = batch.filter(pa.array(rule(a, b)))
                yield pa.RecordBatch.from_arrays([kept.column(i) for i in range(3)], names=["a", "b", "g"])

    return both.mapInArrow(scan, "a binary, b binary, g long")


def texts_of(rows: DataFrame, fps: DataFrame, ids: DataFrame, shingle: int, ordered: bool = False) -> DataFrame:
    """One text (fp, text) for each of ``fps``. Rows are (id, text); ``ids`` has an id of each fp. A
    filter of bounded size on the ids keeps the other texts where they are."""
    blocks, bits = bitmap_filter(ids, "id", ids.count())
    near = passes_filter(rows.select("id", "text"), F.col("id"), blocks, bits).where("__hit").select(utf8("text").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle, ordered=ordered)
        for batch in batches:
            fps = [shingler.key(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), batch.column(0)], names=["fp", "text"])

    keyed = near.mapInArrow(scan, "fp binary, text binary")
    return keyed.join(fps, "fp", "left_semi").dropDuplicates(["fp"])


def verify_pairs(pairs: DataFrame, texts: DataFrame, similar: Callable[[bytes, bytes], float] | None, *, threshold: float, shingle: int = 5) -> DataFrame:
    """The links (a, b, similarity) of at least ``threshold``, from whole texts. The text of ``a`` comes
    first and those of its partners follow, streamed; the partners of a hub are dealt by a salt."""
    salted = pairs.select("a", "b", F.expr("cast(pmod(xxhash64(b), 1 + g div 64) as int)").alias("salt"))
    partner = salted.join(texts.select(F.col("fp").alias("b"), "text"), "b").select("a", "salt", "b", "text")
    own = (
        salted.select("a", "salt").distinct().join(texts.select(F.col("fp").alias("a"), "text"), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "text")
    )
    stream = own.unionByName(partner).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        left = None
        for batch in batches:
            out: list[tuple] = []
            a_s, b_s, texts_ = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for i, (a, b) in enumerate(zip(a_s, b_s, strict=True)):
                text = texts_[i].as_py()
                if b is None:
                    left = (a, shingler(text), text)
                    continue
                s = similar(left[2], text) if similar else jaccard(left[1], shingler(text))
                if s >= threshold:
                    out.append((a, b, s))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

    return stream.mapInArrow(scan, "a binary, b binary, similarity double")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, component) for each linked key: the smallest key that links lead to. Alternating large
    and small stars; each round is written to the shared folder, and ends when nothing changes."""
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written first: then both sides of the join are dealt for it, and Spark can split a hub's edges
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "low")
        large = both.join(low, both["u"] == low["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.where("u <> v").distinct(), "large")
        scratch.drop(low)
        low = scratch.write(scratch.again(large).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "low")
        joined = large.join(low, large["u"] == low["k"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        after = scratch.write(small.where("u <> v").distinct(), "small")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges, large, low)
        edges = after
        if tuple(state) == before:
            break
        before = tuple(state)
    root = edges.select(F.col("v").alias("fp"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("component")).unionByName(root)


def rest_links(rows: DataFrame, members: DataFrame, parts: DataFrame, classes: DataFrame, scratch: Scratch, rule: Callable[[np.ndarray, np.ndarray], np.ndarray], similar: Callable[[bytes, bytes], float] | None, *, bands: int, threshold: float, shingle: int) -> DataFrame | None:
    """The links that are missing in large buckets of more than one component: each member outside the bucket's
    main component is compared with all members of other components, in blocks of bounded size within a worker.
    A pair is compared in the first band that it shares, and verified if its signatures pass the rule and it
    isn't joined by then; only links leave the worker. None if there is nothing to compare."""
    large = members.where(F.col("g") > SMALL_BUCKET).select("bk", "band", "fp", "g")
    told = scratch.write(large.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "told")
    sizes = told.groupBy("bk", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bk").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), (F.sum("n") - F.max("n")).alias("rest"))
    mixed = scratch.write(told.join(main.where("parts > 1"), "bk").join(classes.select("fp", "id", "n", "sig"), "fp"), "mixed")
    if mixed.isEmpty():
        return None
    involved = scratch.write(mixed.groupBy("fp").agg(F.min("id").alias("id")), "mixed-ids")
    texts = scratch.write(texts_of(rows, involved.select("fp"), involved.select("id"), shingle, similar is not None), "mixed-texts")
    bulk = mixed.groupBy("bk").agg(F.max("n").alias("most"))

    def side(frame: DataFrame) -> DataFrame:
        # a block has at most about BLOCK_SHINGLES shingles, however long the texts are
        each = F.expr(f"greatest(1, least({BLOCK}, {BLOCK_SHINGLES} div greatest(most, 1)))")
        sized = frame.join(scratch.again(texts), "fp").join(bulk, "bk").withColumn("each", each)
        return sized.withColumns({"blocks": F.expr("cast(g div each as int)"), "chunks": F.expr("cast(rest div each as int)")})

    block = F.expr("cast(pmod(xxhash64(fp, 1), 1 + blocks) as int)")
    chunk = F.expr("cast(pmod(xxhash64(fp, 2), 1 + chunks) as int)")
    keys, payload = ["bk", "block", "chunk"], ["fp", "band", "component", "sig", "text"]
    all_ = side(mixed).select("bk", *payload, block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks"))).alias("chunk"))
    out = side(scratch.again(mixed)).where("component <> main").select("bk", *payload, F.explode(F.sequence(F.lit(0), F.col("blocks"))).alias("block"), chunk.alias("chunk"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got: list[tuple] = []
        if len(left) and len(right):
            shingler, root, held = Shingler(shingle), {}, {}

            def find(x: bytes) -> bytes:
                while root.get(x, x) != x:
                    root[x] = x = root.get(root[x], root[x])
                return x

            def hashes(side: str, i: int, text: bytes) -> np.ndarray:
                if (side, i) not in held:
                    held[side, i] = shingler(text)
                return held[side, i]

            sigs = np.frombuffer(b"".join(right["sig"]), dtype=np.uint32).reshape(len(right), -1)
            part = right["component"].to_numpy()
            band, width = int(left["band"].iloc[0]), sigs.shape[1] // bands
            for k, (fp, comp, sig, text) in enumerate(zip(left["fp"], left["component"], left["sig"], left["text"], strict=True)):
                mine = np.frombuffer(sig, dtype=np.uint32)
                near = np.flatnonzero(part != comp)
                shared = (sigs[near, : bands * width] == mine[: bands * width]).reshape(len(near), bands, width).all(axis=2)
                near = near[shared.argmax(axis=1) == band]
                near = near[rule(np.broadcast_to(mine, (len(near), len(mine))), sigs[near])]
                for i in near:
                    if (a := find(comp)) == (b := find(part[i])):
                        continue
                    other = right["text"].iloc[i]
                    s = similar(text, other) if similar else jaccard(hashes("l", k, text), hashes("r", i, other))
                    if s >= threshold:
                        root[a] = b
                        got.append((fp, right["fp"].iloc[i], s))
        return pd.DataFrame(got, columns=["a", "b", "similarity"])

    found = out.groupBy(*keys).cogroup(all_.groupBy(*keys)).applyInPandas(compare, "a binary, b binary, similarity double")
    links = scratch.write(found, "rest")
    scratch.drop(told, mixed, involved, texts)
    return links


def large_degrees(rows: DataFrame, members: DataFrame, classes: DataFrame, scratch: Scratch, rule: Callable[[np.ndarray, np.ndarray], np.ndarray], similar: Callable[[bytes, bytes], float] | None, *, bands: int, threshold: float, shingle: int) -> DataFrame | None:
    """(fp, n): with how many others each is linked of which it shares large buckets only. All members of a large
    bucket are compared, block against block within workers; a pair counts in the first band that it shares, if its
    signatures pass the rule and its texts the threshold. None if there are no large buckets."""
    large = members.where(F.col("g") > SMALL_BUCKET).select("bk", "band", "fp", "g")
    mask = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.when(F.array_contains("wide", b), "1").otherwise("0"))
    told = large.groupBy("fp").agg(F.collect_set("band").alias("wide")).select("fp", F.array_join(mask, "").alias("wide"))
    told = scratch.write(told.join(classes.select("fp", "id", "n", "sig"), "fp"), "large")
    if told.isEmpty():
        return None
    texts = scratch.write(texts_of(rows, told.select("fp"), told.select("id"), shingle, similar is not None), "large-texts")
    bulk = large.join(told.select("fp", "n"), "fp").groupBy("bk").agg(F.max("n").alias("most"))
    each = F.expr(f"greatest(1, least({BLOCK}, {BLOCK_SHINGLES} div greatest(most, 1)))")
    full = large.join(scratch.again(told).select("fp", "wide", "sig"), "fp").join(texts, "fp").join(bulk, "bk")
    full = full.withColumn("blocks", F.floor(F.col("g") / each).cast("int"))
    full = full.withColumn("block", F.expr("cast(pmod(xxhash64(fp, 1), 1 + blocks) as int)"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks"))))
    full = full.select("bk", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "wide", "sig", "text")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        one, two = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        group = group.sort_values("block", kind="stable")
        fps, texts_ = group["fp"].to_list(), group["text"].to_list()
        wide = np.frombuffer("".join(group["wide"]).encode(), dtype=np.uint8).reshape(len(group), bands) == ord("1")
        split = int((group["block"] == one).sum())
        sigs = np.frombuffer(b"".join(group["sig"]), dtype=np.uint32).reshape(len(group), -1)
        band, width = int(group["band"].iloc[0]), sigs.shape[1] // bands
        shingler = Shingler(shingle)
        sets = [shingler(t) for t in texts_]
        sizes = np.array([len(x) for x in sets])
        found, code = np.unique(np.concatenate(sets), return_inverse=True)
        sets = np.split(code, np.cumsum(sizes)[:-1])
        marked = np.zeros(len(found), dtype=bool)
        counts = np.zeros(len(group), dtype=np.int64)
        for k in range(split):
            start = k + 1 if one == two else split
            shared = (sigs[start:, : bands * width] == sigs[k, : bands * width]).reshape(-1, bands, width).all(axis=2)
            narrow = ~wide[k]
            near = start + np.flatnonzero((shared.argmax(axis=1) == band) & shared[:, band] & ~shared[:, narrow].any(axis=1))
            near = near[rule(np.broadcast_to(sigs[k], (len(near), sigs.shape[1])), sigs[near])]
            if not len(near):
                continue
            marked[sets[k]] = True
            ends = np.cumsum(sizes[near])
            both = np.add.reduceat(marked[np.concatenate([sets[i] for i in near])], ends - sizes[near], dtype=np.int64)
            marked[sets[k]] = False
            linked = both / (sizes[k] + sizes[near] - both) >= threshold
            if similar:
                linked = np.array([similar(texts_[k], texts_[i]) >= threshold for i in near])
            counts[near[linked]] += 1
            counts[k] += int(linked.sum())
        out = pd.DataFrame({"fp": fps, "n": counts})
        return out[out["n"] > 0]

    found = full.groupBy("bk", "i", "j").applyInPandas(compare, "fp binary, n long")
    counted = scratch.write(found.groupBy("fp").agg(F.sum("n").alias("n")), "counted")
    scratch.drop(told, texts)
    return counted


class NearLinks:
    """Links and components of the texts of rows (id, text)."""

    def __init__(self, rows: DataFrame, *, scratch: Scratch, bands: int, band_rows: int, rule: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float, shingle: int = 5, sketches: DataFrame | None = None, similar: Callable[[bytes, bytes], float] | None = None):
        self.scratch = scratch
        self.sketches = sketches if sketches is not None else scratch.write(sketch(rows, hashes=bands * band_rows, shingle=shingle), "sketches")
        self.classes = scratch.write(
            self.sketches.where("fp is not null").groupBy("fp").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sig").alias("sig")), "classes"
        )
        self.members = members = band_members(self.classes, scratch, bands=bands, rows=band_rows)
        links = self._links(rows, candidate_pairs(members, scratch), rule, threshold, shingle, similar)
        self.parts = scratch.write(components(links, scratch), "parts")
        if not members.where(F.col("g") > SMALL_BUCKET).isEmpty():
            more = rest_links(rows, members, self.parts, self.classes, scratch, rule, similar, bands=bands, threshold=threshold, shingle=shingle)
            if more is not None and not more.isEmpty():
                links = links.unionByName(more)
                self.parts = scratch.write(components(links, scratch), "parts")
        self.links = links
        self._large = lambda: large_degrees(rows, members, self.classes, scratch, rule, similar, bands=bands, threshold=threshold, shingle=shingle)

    def _links(self, rows: DataFrame, pairs: DataFrame, rule, threshold: float, shingle: int, similar) -> DataFrame:
        scratch = self.scratch
        self.pairs = pairs = scratch.write(prune_pairs(pairs, self.classes, rule, 0.0 if similar else threshold), "pairs")
        fps = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        involved = scratch.write(self.classes.select("fp", "id").join(fps, "fp"), "involved")
        texts = scratch.write(texts_of(rows, involved.select("fp"), involved.select("id"), shingle, similar is not None), "texts")
        links = scratch.write(verify_pairs(pairs, texts, similar, threshold=threshold, shingle=shingle), "links")
        scratch.drop(texts, involved)
        return links

    def degrees(self) -> DataFrame:
        """(fp, n_links): how many classes each is linked with. Pairs of small buckets are among the links;
        those that share large buckets only are compared and counted now."""
        once = self.links.join(self.pairs.where("g = 1").select("a", "b"), ["a", "b"], "left_semi").select("a", "b").distinct()
        ends = once.select(F.col("a").alias("fp")).unionByName(once.select(F.col("b").alias("fp"))).withColumn("n", F.lit(1).cast("long"))
        counted = self._large()
        if counted is not None:
            ends = ends.unionByName(counted)
        return ends.groupBy("fp").agg(F.sum("n").alias("n_links"))
