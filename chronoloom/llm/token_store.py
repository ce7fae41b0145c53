"""Training-order materialisation of token sequences as binary shards.

Texts are tokenized once; the ids are kept, compressed, in the shared folder while the sequences are counted.
A keyed Feistel permutation with cycle-walking gives each sequence's number a global slot. Slots are dealt
to shards by range, and each shard is one file of fixed-stride records, so that any position of the training
order is a seek. A shard's checksum is written after it; shards that have theirs are not written again when an interrupted write is repeated.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import Scratch, column, utf8, with_id
from .packing import default_tokenizer, encoder

SCHEMA = "seq_no long, slot long, shard long, offset long, n_tokens long, ids_crc32 long"


class Feistel:
    """A keyed permutation of 0..n-1: a balanced Feistel network on the smallest even number of bits
    that covers n, walked until the value is below n."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        seeds = np.random.SeedSequence(key).generate_state(rounds, np.uint64)
        self.keys = [np.uint64(s) for s in seeds]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._round(right, key)
        return (left << np.uint64(self.half)) | right

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self._once(np.asarray(x, dtype=np.uint64))
        while len(far := np.flatnonzero(out >= self.n)):
            out[far] = self._once(out[far])
        return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """What a reader needs to know; kept in index.json beside the shards."""

    sequences: int
    length: int
    width: int
    shard_slots: int
    key: int
    pad_id: int
    check: int  # of all sequences' ids in their order

    @property
    def stride(self) -> int:
        return self.length * self.width

    def slots_of(self, shard: int) -> int:
        return min(self.shard_slots, self.sequences - shard * self.shard_slots)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def check_name(shard: int) -> str:
    return f"shard-{shard:08d}.crc32"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


#: Texts tokenized at a time, sequences dealt to shards at a time, and the level of compression between.
TEXTS, DEALT, LEVEL = 256, 16384, 3
#: Tasks that write shards: of more shards, each writes a range, one after the other.
MAX_TASKS = 20_000


def _pack(x: np.ndarray | bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL).compress(x if isinstance(x, bytes) else x.tobytes())


def _unpack(x: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


def tokenized(docs: DataFrame, *, id_col: str, text_col: str, tokenizer: str | None, end_id: int, width: int, length: int) -> DataFrame:
    """A row for every few documents: ``part`` and ``first`` (number of its first sequence in that part), ``n``
    (sequences), ``ids`` (the documents'), ``sizes`` (tokens of each), ``tokens`` and ``crc`` (of each sequence)."""
    end = end_id.to_bytes(4, "little")
    schema = StructType([*with_id(docs, id_col, "part long,first long,n long,sizes binary,tokens binary,crc binary").fields[1:], StructField("ids", ArrayType(docs.schema[id_col].dataType))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or default_tokenizer()).encode
        part, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                whole = [x + end for x in encode(some.column(1).to_pylist())]
                sizes = np.array([len(x) // 4 for x in whole], dtype="<u4")
                crc = np.array([zlib.crc32(x[k : k + 4 * length]) for x in whole for k in range(0, len(x), 4 * length)], dtype="<u4")
                tokens = np.frombuffer(b"".join(whole), dtype="<u4").astype(f"<u{width}")
                ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0))
                row = [part, first, len(crc), _pack(sizes), _pack(tokens), _pack(crc)]
                yield pa.RecordBatch.from_arrays([*(pa.array([x]) for x in row), ids], names=schema.names)
                first += len(crc)

    return docs.select(column(id_col), utf8(text_col).alias("__text")).mapInArrow(scan, schema)


def write_training_order(
    docs: DataFrame,
    out_dir: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    vocabulary: int = 49408,
    end_id: int = 1,
    pad_id: int = 0,
    length: int = 256,
    key: int = 20240601,
    shard_slots: int = 32768,
) -> DataFrame:
    """Write the shards to ``out_dir`` (a URI that driver and executors share) when the result is
    computed. A row for each sequence: the document's id, ``seq_no`` in it, ``slot``, ``shard``, ``offset`` (bytes in
    the shard), ``n_tokens`` (without padding) and ``ids_crc32`` (of its ids as unsigned 32-bit values).

    Null and empty texts are their end id. Repeated rows and null ids are written like others; other
    columns are ignored; an empty table writes an index without shards. A shard appears when it is whole,
    by a rename, so a task that runs again replaces it with the same bytes. Where ``out_dir`` has the index of
    the same sequences in the same order, shards that are there in full length, with the checksum of just these records, are left as they are;
    any other index, of other documents or of the same in another order, and all of its shards are replaced.
    """
    spark = docs.sparkSession
    width = 2 if vocabulary <= 1 << 16 else 4
    scratch = Scratch(spark, "token-store")
    told = scratch.write(tokenized(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, end_id=end_id, width=width, length=length), "tokens")

    sums = told.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.crc32(F.concat(F.concat_ws(",", "part", "first", F.lit("")).cast("binary"), "crc"))).alias("check"))
    starts, total, check = {}, 0, 0
    for r in sorted(sums.collect()):  # a row for each partition of the scan
        starts[r.part] = total
        total += r.n
        check += r.check
    layout = Layout(total, length, width, shard_slots, key, pad_id, check)
    fs, path = _open(out_dir)
    fs.create_dir(path, recursive=True)
    if _layout(fs, path) != layout:
        for old in fs.get_file_info(pyarrow.fs.FileSelector(path)):
            if old.is_file and old.base_name.endswith((".bin", ".crc32")):
                fs.delete_file(old.path)
        with fs.open_output_stream(f"{path}/index.json") as f:
            f.write(json.dumps(layout.__dict__).encode())
    order = Feistel(total, key)
    id_type = docs.schema[id_col].dataType
    kinds = "shard int,slots binary,seq_no binary,n_tokens binary,crc binary,tokens binary"
    dealt = StructType([*with_id(docs, id_col, kinds).fields[1:], StructField("ids", ArrayType(id_type))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sequences of a few rows, by shard."""
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            slots, seq_no, n_tokens, crc, starts_ = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4, 5))
            tokens = np.concatenate([h[6] for h in held])
            held.clear()
            by = np.argsort(slots, kind="stable")
            shards = slots[by] // shard_slots
            columns: list[list] = [[] for _ in dealt.names]
            for mine in np.split(by, np.flatnonzero(np.diff(shards)) + 1):
                ends = np.cumsum(n_tokens[mine])
                at = np.arange(ends[-1]) + np.repeat(starts_[mine] - (ends - n_tokens[mine]), n_tokens[mine])
                values = (int(slots[mine[0]] // shard_slots), _pack(slots[mine]), _pack(seq_no[mine]), _pack(n_tokens[mine].astype("<u4")), _pack(crc[mine]), _pack(tokens[at]), ids.take(pa.array(mine)))
                for c, v in zip(columns, values, strict=True):
                    c.append(v)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, columns[-1])]), pa.int32()), pa.concat_arrays(columns[-1]))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:-1]), lists], names=dealt.names)

        n = size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, here = (batch.column(k)[i].as_py() for k in range(3))
                sizes = _unpack(batch.column(3)[i].as_py(), "<u4").astype(np.int64)
                parts = -(-sizes // length)
                seq_no = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                n_tokens = np.minimum(length, np.repeat(sizes, parts) - seq_no * length)
                start = size + np.repeat(np.cumsum(sizes) - sizes, parts) + seq_no * length
                ids = batch.column(6)[i].values.take(pa.array(np.repeat(np.arange(len(sizes)), parts)))
                slots = order(np.arange(starts[part] + first, starts[part] + first + here))
                held.append((ids, slots, seq_no, n_tokens, _unpack(batch.column(5)[i].as_py(), "<u4"), start, _unpack(batch.column(4)[i].as_py(), f"<u{width}")))
                n += here
                size += len(held[-1][6])
                if n >= DEALT:
                    yield emit()
                    n = size = 0
        if held:
            yield emit()

    def record(fs: pyarrow.fs.FileSystem, path: str, shard: int, got: list[list]) -> pa.RecordBatch:
        """One shard: as many records as it has slots are held, and written in order unless they are there."""
        slots, seq_no, n_tokens, crc = (np.concatenate([_unpack(g[k], t) for g in got]) for k, t in ((0, "<i8"), (1, "<i8"), (2, "<u4"), (3, "<u4")))
        if not np.array_equal(np.sort(slots), np.arange(layout.slots_of(shard)) + shard * shard_slots):
            raise ValueError(f"shard {shard} has {len(slots)} records")
        tokens = np.concatenate([_unpack(g[4], f"<u{width}") for g in got])
        n = n_tokens.astype(np.int64)
        out = np.full((len(slots), length), pad_id, dtype=f"<u{width}")
        spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(slots % shard_slots, n), spot] = tokens
        whole = out.tobytes()
        name, told_ = f"{path}/{shard_name(shard)}", f"{path}/{check_name(shard)}"
        there, sum_ = fs.get_file_info(name), b"%08x" % zlib.crc32(whole)
        if not (there.is_file and there.size == len(whole) and _content(fs, told_) == sum_):
            attempt = TaskContext.get().taskAttemptId()
            if fs.get_file_info(told_).is_file:
                fs.delete_file(told_)  # first, so that it never stands beside other records
            for held, content in ((name, whole), (told_, sum_)):
                part = f"{path}/.{held.rsplit('/', 1)[1]}.{attempt}"
                with fs.open_output_stream(part) as f:
                    f.write(content)
                fs.move(part, held)
        columns = [pa.array(x.astype(np.int64)) for x in (seq_no, slots, np.full(len(slots), shard), slots % shard_slots * layout.stride, n_tokens, crc)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([g[5] for g in got]), *columns], names=out_schema.names)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range of shards, whose rows come one shard after the other."""
        fs, path = _open(out_dir)
        shard, got = -1, []
        for batch in batches:
            for i in range(batch.num_rows):
                mine = batch.column(0)[i].as_py()
                if mine != shard and got:
                    yield record(fs, path, shard, got)
                    got = []
                shard = mine
                got.append([batch.column(k)[i].as_py() for k in range(1, 6)] + [batch.column(6)[i].values])
        if got:
            yield record(fs, path, shard, got)

    shards = max(1, -(-total // shard_slots))
    each = -(-shards // MAX_TASKS)
    out_schema = with_id(docs, id_col, SCHEMA)
    by_shard = told.mapInArrow(deal, dealt).repartitionById(-(-shards // each), (F.col("shard") / each).cast("int"))
    if each > 1:
        by_shard = by_shard.sortWithinPartitions("shard")
    return by_shard.mapInArrow(store, out_schema)


def _content(fs: pyarrow.fs.FileSystem, path: str) -> bytes | None:
    try:
        with fs.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def _layout(fs: pyarrow.fs.FileSystem, path: str) -> Layout | None:
    """The layout of an earlier write, if there is one that can be read."""
    try:
        with fs.open_input_stream(f"{path}/index.json") as f:
            return Layout(**json.loads(f.read()))
    except (FileNotFoundError, ValueError, TypeError):
        return None


def read_training_order(uri: str, start: int = 0) -> Iterator[np.ndarray]:
    """The sequences from slot ``start`` on, in training order, with their padding."""
    fs, path = _open(uri)
    with fs.open_input_stream(f"{path}/index.json") as f:
        layout = Layout(**json.loads(f.read()))
    for shard in range(start // layout.shard_slots, -(-layout.sequences // layout.shard_slots)):
        first = max(0, start - shard * layout.shard_slots)
        with fs.open_input_file(f"{path}/{shard_name(shard)}") as f:
            f.seek(first * layout.stride)
            for _ in range(first, layout.slots_of(shard)):
                yield np.frombuffer(f.read(layout.stride), dtype=f"<u{layout.width}")
