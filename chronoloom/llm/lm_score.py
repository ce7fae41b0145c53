"""Cross-entropy difference of documents under matched bigram models of a target and a background corpus.

Both models share one vocabulary, all words of the background and one more for the rest, and one estimator:
P(x | v) = (c(v x) + MU * u(x)) / (c(v) + MU) with u(x) = (c(x) + 1) / (T + V). A document ends in a mark, which also
stands before its first word. Each token's loss under the target less its loss under the background, averaged, scores a
document. A document's own counts are left out of the models that score it.

Nothing is cut by frequency, and no tables of words or bigrams are sent to the workers but those of the most frequent
ones, which have a bound that doesn't depend on the input. What a frequent bigram adds is known where the document is.
The others are dealt by their second word, and those that end
in a frequent word by both; so whoever has all bigrams that end in a word also has that word's count, and can say what
each occurrence adds to the loss of its document. Bigrams travel in packed arrays, and what comes back are sums by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import Scratch, column, utf8, with_id, words_of

#: Weight of the unigrams, in counts.
MU = 32.0
#: Words with this share of all tokens are frequent, and so are bigrams that have it in the blocks where they have it: at
#: most 10,000 of each, and no other bigram has twice this share.
FREQUENT = 1e-4
#: Tokens of a block of documents, bigrams that are counted at a time, and tasks that count.
BLOCK, COUNTED, TASKS = 400_000, 2_000_000, 20_000
#: Target ids are sent to all workers up to this number, some 70 bytes each, and joined by a shuffle beyond.
MAX_BROADCAST_IDS = 500_000
#: Losses are summed as whole multiples of this, so that sums don't depend on their order.
UNIT = 2.0**-24
#: The mark before and after a document.
MARK = np.uint64(0)


@dataclass(frozen=True)
class Totals:
    """What is known of both corpora (0: target, 1: background): tokens with marks, words in the vocabulary, and the
    counts of frequent words and of frequent bigrams, sorted by key."""

    tokens: tuple[int, int]
    vocabulary: int
    keys: np.ndarray
    counts: np.ndarray  # word x 2
    pairs: np.ndarray
    pair_counts: np.ndarray  # bigram x 2


def word_keys(words: list[list[bytes]], known: dict[bytes, int]) -> np.ndarray:
    """63 bits of each word's hash, never 0; ``known`` remembers them."""
    out = []
    for w in (x for ws in words for x in ws):
        k = known.get(w)
        if k is None:
            k = known[w] = xxhash.xxh3_64_intdigest(w) >> 1 or 1
        out.append(k)
    return np.array(out, dtype=np.uint64)


def flag_documents(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, flags): 3 if the id is among ``targets``, else 2. Targets are sent to all workers only up to
    a fixed number of ids."""
    ids = targets.select(column(targets.columns[0]).alias("__target")).where("__target is not null").distinct()
    many = ids.count() > MAX_BROADCAST_IDS
    rows = docs.select(column(id_col).alias("id"), utf8(text_col).alias("text"))
    joined = rows.join(ids if many else F.broadcast(ids), rows["id"] == ids["__target"], "left")
    return joined.select("id", "text", F.when(F.col("__target").isNull(), 2).otherwise(3).alias("flags"))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list[list[bytes]], np.ndarray]]:
    """Ids, words and flags of runs of documents of about ``most`` words."""
    for batch in batches:
        texts, flags = batch.column(1), batch.column(2).to_numpy()
        at = start = n = 0
        words: list[list[bytes]] = []
        while at < batch.num_rows:
            words.append(words_of(texts[at].as_py()))
            n += len(words[-1])
            at += 1
            if n >= most or at - start == 65536 or at == batch.num_rows:
                yield batch.column(0).slice(start, at - start), words, flags[start:at]
                words, start, n = [], at, 0


def count_words(rows: DataFrame) -> Totals:
    """Totals of rows (id, text, flags). Words are summed on each worker before they are shuffled. Keys of bigrams that may
    be frequent are less than 0, those of words are not."""
    rate = FREQUENT

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held: dict[str, list[np.ndarray]] = {"key": [], "n0": [], "n1": []}

        def emit() -> pa.RecordBatch:
            keys, back = np.unique(np.concatenate([*held["key"], np.zeros(0, np.uint64)]), return_inverse=True)
            sums = [np.bincount(back, np.concatenate([*held[c], np.zeros(0)]), len(keys)).astype(np.int64) for c in ("n0", "n1")]
            for h in held.values():
                h.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, sums)], names=["key", "n0", "n1"])

        n = 0
        for _, words, flags in _blocks(batches, BLOCK):
            if len(known) > 300_000:
                known.clear()
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            read = word_keys(words, known)
            pairs, often = np.unique(pair_keys(*bigrams_of(read, sizes)[:2]), return_counts=True)
            some = often >= rate * often.sum()
            held["key"].append(pairs[some])
            held["n0"].append(np.zeros(some.sum()))
            held["n1"].append(often[some].astype(float))
            n += int(some.sum())
            keys, back = np.unique(read, return_inverse=True)
            for name, value in (("key", keys), *((f"n{k}", np.bincount(back, np.repeat(flags >> k & 1, sizes), len(keys))) for k in range(2))):
                held[name].append(value)
            some = sizes > 0
            held["key"].append(np.array([MARK]))
            for k in range(2):
                held[f"n{k}"].append(np.array([(flags[some] >> k & 1).sum()], dtype=float))
            n += len(keys)
            if n > 1_000_000:
                yield emit()
                n = 0
        yield emit()

    counted = rows.mapInArrow(scan, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n1 > 0")
    counted = Scratch(rows.sparkSession, "lm-words").write(counted, "words")
    n0, n1, size = counted.where("key >= 0").agg(F.sum("n0"), F.sum("n1"), F.count("*")).first()
    often = counted.where(F.col("n1") >= rate * (n1 or 0)).select("key", "n0", "n1").toArrow().sort_by("key")
    keys, counts = often["key"].to_numpy(), np.stack([often[c].to_numpy() for c in ("n0", "n1")], axis=1)
    pairs = keys[keys < 0].view(np.uint64)
    return Totals((n0 or 0, n1 or 0), size + 1, keys[keys >= 0].astype(np.uint64), counts[keys >= 0], pairs, count_pairs(rows, pairs))


def count_pairs(rows: DataFrame, pairs: np.ndarray) -> np.ndarray:
    """How often each of ``pairs``, sorted keys, stands in either corpus of rows (id, text, flags). Each task sends its sums."""
    out = np.zeros((len(pairs), 2), dtype=np.int64)
    if not len(pairs):
        return out
    held = rows.sparkSession.sparkContext.broadcast(pairs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        wanted = held.value
        sums = np.zeros((len(wanted), 2), dtype=np.int64)
        for _, words, flags in _blocks(batches, BLOCK):
            if len(known) > 300_000:
                known.clear()
            x, v, doc = bigrams_of(word_keys(words, known), np.array([len(w) for w in words], dtype=np.int64))
            spot, hit = _found(wanted, pair_keys(x, v))
            for k in range(2):
                sums[:, k] += np.bincount(spot[hit & (flags[doc] >> k & 1 == 1)], minlength=len(wanted))
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(sums[some, k]) for k in range(2))], names=["at", "n0", "n1"])

    counted = rows.mapInArrow(scan, "at long, n0 long, n1 long").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    for k in range(2):
        out[counted["at"].to_numpy(), k] = counted[f"n{k}"].to_numpy()
    return out


def bigrams_of(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of several documents: each word, and the mark at a document's end; what stands before it; its document."""
    live = np.flatnonzero(sizes)
    n = sizes[live] + 1
    ends = np.cumsum(n)
    x = np.zeros(n.sum(), dtype=np.uint64)
    x[np.delete(np.arange(len(x)), ends - 1)] = keys
    v = np.empty_like(x)
    v[1:] = x[:-1]
    v[ends - n] = MARK
    return x, v, np.repeat(live, n)


def pair_keys(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Keys of bigrams: 63 bits of a hash under a leading 1."""
    return _mix(x, v) | np.uint64(1 << 63)


def _found(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in a sorted array, and whether it is there."""
    if not len(held):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    spot = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    return spot, held[spot] == wanted


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values in sorted columns."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, n))


def _squeeze(*columns: np.ndarray) -> bytes:
    """Arrays, one after the other, compressed."""
    import zstandard

    body = b"".join(np.uint32(len(c)).tobytes() + c.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(body)


def _spread(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    body, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        n = int(np.frombuffer(body, "<u4", 1, at)[0])
        out.append(np.frombuffer(body, kind, n, at + 4))
        at += 4 + n * np.dtype(kind).itemsize
    return out


#: Word keys, their events, document, own bigrams, own words of each; then each document's number, tokens and flags.
EVENTS = ("<u8", "<u4", "<u2", "<u4", "<u4", "<u2", "<u2", "<u2", "<u4", "u1")


def bigram_events(words: list[list[bytes]], flags: np.ndarray, known: dict[bytes, int], totals: Totals, parts: int, mu: float) -> Iterator[tuple[int, bytes]]:
    """First (-1, packed sums) of a block of documents: their sizes, and what frequent bigrams add to their losses, in units.
    Then (part, packed events): each other bigram of each document once, with how often the document has it and its second word."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    x, v, doc = bigrams_of(word_keys(words, known), sizes)
    order = np.lexsort((v, doc, x))
    x, v, doc = x[order], v[order], doc[order]
    at, own_word = _runs(x, doc)
    own_word = np.repeat(own_word, own_word)
    at, own = _runs(x, doc, v)
    x, v, doc, own_word = x[at], v[at], doc[at], own_word[at]
    spot, frequent = _found(totals.keys, x)
    pair, hot = _found(totals.pairs, pair_keys(x, v))
    hot &= frequent
    sums = []
    for k in range(2):
        inside = flags[doc[hot]].astype(np.int64) >> k & 1
        units = losses(own[hot], own_word[hot], inside, totals.pair_counts[pair[hot], k], totals.counts[spot[hot], k], sizes[doc[hot]] + 1, totals, k, mu)
        sums.append(np.bincount(doc[hot], units, len(sizes)).astype(np.int64))
    yield -1, _squeeze(sizes.astype("<u4"), *sums)
    x, v, doc, own, own_word, frequent = (a[~hot] for a in (x, v, doc, own, own_word, frequent))
    if not len(x):
        return
    part = (_mix(x, np.where(frequent, v, np.uint64(0))) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    starts, counts = _runs(part[order])
    for start, count in zip(starts, counts, strict=True):
        mine = order[start : start + count]
        first, run = _runs(x[mine])
        docs = np.unique(doc[mine])
        low = v[mine]
        yield int(part[mine[0]]), _squeeze(
            x[mine][first], run.astype("<u4"), np.searchsorted(docs, doc[mine]).astype("<u2"), own[mine].astype("<u4"), own_word[mine].astype("<u4"),
            *((low >> np.uint64(16 * k)).astype("<u2") for k in range(2)), docs.astype("<u2"), (sizes[docs] + 1).astype("<u4"), flags[docs].astype("u1"),
            (low >> np.uint64(32)).astype("<u2"),
        )


def losses(own: np.ndarray, own_word: np.ndarray, inside: np.ndarray, pair: np.ndarray, word: np.ndarray, tokens: np.ndarray, totals: Totals, k: int, mu: float) -> np.ndarray:
    """What bigrams add to the losses of documents, in units: ``own`` times in a document of ``tokens``, its second word ``own_word`` times; counts
    of both in corpus k, of which the document is a part or not."""
    word = word - own_word * inside
    unigram = (word + 1) / (totals.tokens[k] - tokens * inside + totals.vocabulary)
    return np.rint(own * (np.log(word + mu) - np.log(pair - own * inside + mu * unigram)) / UNIT)


def event_losses(blobs: list[bytes], totals: Totals, mu: float) -> list[bytes]:
    """For blobs that have all events of their words, or of their bigrams where the word is frequent: each document's
    number, and what they add to its losses, in units."""
    got = [_spread(b, *EVENTS, "<u2") for b in blobs]
    x = np.concatenate([np.repeat(g[0], g[1]) for g in got])
    v = np.concatenate([g[5].astype(np.uint64) | g[6].astype(np.uint64) << np.uint64(16) | g[10].astype(np.uint64) << np.uint64(32) for g in got])
    own, own_word = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in (3, 4))
    flags, tokens = (np.concatenate([g[k][g[2]] for g in got]).astype(np.int64) for k in (9, 8))
    order = np.lexsort((v, x))
    pair_at, pair_run = _runs(x[order], v[order])
    word_at, word_run = _runs(x[order])
    words = x[order][word_at]
    spot, often = _found(totals.keys, words)
    units = np.empty((len(x), 2), dtype=np.int64)
    for k in range(2):
        mine = own * (flags >> k & 1)
        pair = np.empty(len(x))
        pair[order] = np.repeat(np.add.reduceat(mine[order], pair_at), pair_run)
        count = np.add.reduceat(mine[order], word_at)
        count[often] = totals.counts[spot[often], k]
        word = np.empty(len(x))
        word[order] = np.repeat(count, word_run)
        units[:, k] = losses(own, own_word, flags >> k & 1, pair, word, tokens, totals, k, mu)
    out, at = [], 0
    for g in got:
        n = len(g[2])
        out.append(_squeeze(g[7], *(np.bincount(g[2], units[at : at + n, k], len(g[7])).astype(np.int64) for k in range(2))))
        at += n
    return out


def score_documents(rows: DataFrame, totals: Totals, id_col: str, id_type, *, mu: float = MU, counted: int = COUNTED) -> DataFrame:
    """The scores of rows (id, text, flags). Bit 0 of the flags: in the target, bit 1: in the background; rows with neither
    are only scored."""
    subs = max(1, -(-totals.tokens[1] // counted))
    tasks = min(TASKS, max(subs, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    held = rows.sparkSession.sparkContext.broadcast(totals)
    kinds = "sub long,block long,kind int,data binary"
    schema = StructType([*with_id(rows, "id", kinds).fields[1:], StructField("ids", ArrayType(id_type))])

    def batch_of(sub: int, block: int, kind: int, data: bytes, ids: pa.Array) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([sub]), pa.array([block]), pa.array([kind], pa.int32()), pa.array([data], pa.binary()), lists], names=schema.names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        block = TaskContext.get().partitionId() << 32
        for ids, words, flags in _blocks(batches, BLOCK):
            if len(known) > 300_000:
                known.clear()
            none = ids.slice(0, 0)
            for sub, data in bigram_events(words, flags, known, held.value, subs, mu):
                yield batch_of(block % subs, block, 0, data, ids) if sub < 0 else batch_of(sub, block, 1, data, none)
            block += 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by ``sub``; those of one are held at a time."""
        now, blocks, blobs, none = None, [], [], None

        def emit() -> Iterator[pa.RecordBatch]:
            for block, data in zip(blocks, event_losses(blobs, held.value, mu) if blobs else [], strict=True):
                yield batch_of(0, block, 1, data, none)
            blocks.clear()
            blobs.clear()

        for batch in batches:
            none = batch.column(4).values.slice(0, 0)
            for i, (sub, block, kind) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if sub != now:
                    yield from emit()
                    now = sub
                if kind:
                    blocks.append(block)
                    blobs.append(batch.column(3)[i].as_py())
                else:
                    yield batch.slice(i, 1)
        yield from emit()

    def add(group: pa.Table) -> pa.Table:
        """One block: the row that has its documents, and sums for them."""
        group = group.combine_chunks()
        first = group["kind"].to_pylist().index(0)
        sizes, *known = _spread(group["data"][first].as_py(), "<u4", "<i8", "<i8")
        sizes, sums = sizes.astype(np.int64), np.stack(known, axis=1)
        for kind, data in zip(group["kind"].to_pylist(), group["data"], strict=True):
            if kind:
                docs, *more = _spread(data.as_py(), "<u2", "<i8", "<i8")
                for k in range(2):
                    sums[docs, k] += more[k]
        h = [pa.array(sums[:, k] * UNIT / np.maximum(sizes + 1, 1), mask=sizes == 0) for k in range(2)]
        return pa.table([group["ids"][first].values, pa.array(sizes), *h], names=["id", "n_tokens", "h0", "h1"])

    asked = rows.mapInArrow(ask, schema).withColumn("task", F.pmod("sub", F.lit(tasks)).cast("int"))
    answered = asked.repartitionById(tasks, F.col("task")).drop("task").sortWithinPartitions("sub").mapInArrow(answer, schema)
    summed = answered.groupBy("block").applyInArrow(add, with_id(rows, "id", "n_tokens long,h0 double,h1 double"))
    return summed.select(F.col("id").alias(id_col), "n_tokens", F.col("h1").alias("h_background"), F.col("h0").alias("h_target"), (F.col("h0") - F.col("h1")).alias("score"))


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, *, others: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, counted: int = COUNTED) -> DataFrame:
    """One row per document: its id, ``n_tokens``, ``h_background`` and ``h_target`` (nats a token, the end included) and ``score``,
    h_target less h_background: lower is closer to the target. The target is the documents whose ids are in ``targets``, the
    background all of ``docs``. A document's own counts don't take part in its scores; ``others`` (same columns) are scored too
    and not counted.

    Counts are over whole texts of all rows. Texts without words (null, empty) have null losses and no part in the models.
    Repeated rows count each and give each its result. Null ids are no targets. Other columns are ignored. Without targets the
    target model is uniform; an empty table gives an empty result. ``docs`` is read three times.
    """
    flagged = flag_documents(docs, targets, id_col, text_col)
    totals = count_words(flagged)
    if others is not None:
        flagged = flagged.unionByName(others.select(column(id_col).alias("id"), utf8(text_col).alias("text"), F.lit(0).alias("flags")))
    return score_documents(flagged, totals, id_col, docs.schema[id_col].dataType, mu=mu, counted=counted)
