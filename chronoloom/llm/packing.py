"""Harmonic packing of token pieces into sequences.

A piece of length l is of class j = capacity // l: at most 1/j of the capacity and more than
1/(j+1). A bin of class j takes exactly j pieces and is then full. Each worker fills its own
bins in one scan, so nothing is shuffled. Documents are cut so that the pieces of a class
nearly fill its bins; bins that are open when a worker ends are refilled from end to end, and
the last one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import column, utf8, with_id

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bytes of a token id.
WIDTH = 4


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A punctuation mark between an ASCII letter and white space: the tokenizer separates it from both.
_MARK = re.compile(rb"[.,;:!?](?<=[a-z].)(?=\s|\Z)")


class _Chunks(dict):
    """The ids of a chunk of text, as bytes. Chunks of up to LONG bytes are remembered, until they and
    their ids take ``room`` bytes."""

    LONG, ENTRY = 64, 170

    def __init__(self, tokenizer, room: int):
        self.tokenizer, self.room = tokenizer, room

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode(errors="replace")
        if chunk.isalpha():  # one word, which normalisation and splitting leave as it is
            ids = [t.id for t in self.tokenizer.model.tokenize(text)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        out = array("I", ids).tobytes()
        if len(chunk) <= self.LONG and self.room > 0:
            self[chunk] = out
            self.room -= len(chunk) + len(out) + self.ENTRY
        return out


def _plain_letters(told: dict) -> bool:
    """Whether the tokenizer lower-cases, drops white space and splits letters from the rest."""
    kinds = {x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])}
    splits = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return "Lowercase" in kinds and bool(splits) and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True


class Encoder:
    """Token ids, as little-endian unsigned 32-bit values, of whole texts, for tokenizers that
    lower-case, drop white space and split punctuation from letters: what stands between spaces, or is
    a mark after a letter, is encoded once and remembered. Added tokens are matched before letters are
    lower-cased, so a text with one, in whatever case, is encoded as a whole. Bytes that aren't UTF-8
    are read as U+FFFD."""

    def __init__(self, path: str, room: int = 130_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if not _plain_letters(told):
            raise ValueError(f"{path} doesn't lower-case and drop white space; its ids depend on more than chunks")
        self.known = _Chunks(self.tokenizer, room)
        self.added = [x["content"].lower().encode() for x in told.get("added_tokens", [])]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        return [self._ids(t) if t else b"" for t in texts]

    def _ids(self, text: bytes) -> bytes:
        low, known = text.lower(), self.known
        for token in self.added:
            if token in low:
                return array("I", self.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids).tobytes()
        return b"".join([known[c] for c in _MARK.sub(rb" \g<0>", low).split()])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def cuts(length: int, capacity: int, tolerance: float) -> list[int]:
    """Lengths of a document's pieces: whole sequences first; then, as long as the bins of the
    rest's class would stay emptier than ``tolerance``, the largest exact share below it."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        j = capacity // rest
        if capacity - j * rest <= tolerance * capacity:
            out.append(rest)
            break
        share = capacity // (j + 1)
        out.append(share)
        rest -= share
    return out


class Packer:
    """The bins of one worker. Rows: document, start, length, crc32, tokens, sequence, offset."""

    def __init__(self, capacity: int, tolerance: float, worker: int):
        self.capacity, self.tolerance = capacity, tolerance
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.next_id = worker << 33

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // WIDTH
            yield doc, start, n, zlib.crc32(ids), total, self.next_id, offset
            offset += n
        self.next_id += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // WIDTH, 0
        for n in cuts(total, self.capacity, self.tolerance):
            j = self.capacity // n
            bin_ = self.open[j]
            bin_.append((doc, start, ids[start * WIDTH : (start + n) * WIDTH], total))
            if len(bin_) == j:
                yield from self._close(self.open.pop(j))
            start += n

    def end(self) -> Iterator[tuple]:
        pieces = [p for j in sorted(self.open) for p in self.open[j]]
        self.open.clear()
        left = sum(len(p[2]) // WIDTH for p in pieces)
        sizes = [self.capacity] * (left // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if (left % self.capacity) >> b & 1]
        at = iter(pieces)
        piece = next(at, None)
        for room in sizes:
            taken = []
            while room:
                doc, start, ids, total = piece
                n = min(room, len(ids) // WIDTH)
                taken.append((doc, start, ids[: n * WIDTH], total))
                room -= n
                piece = (doc, start + n, ids[n * WIDTH :], total) if n * WIDTH < len(ids) else next(at, None)
            yield from self._close(taken)


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int | None = 1,
    capacity: int = 2048,
    tolerance: float = 1 / 64,
) -> DataFrame:
    """A row for each piece: the document's id, ``start`` (its document's ids before it),
    ``length``, ``ids_crc32`` (of its ids as unsigned 32-bit values), ``doc_tokens``,
    ``sequence_id`` and ``offset`` in it. ``tokenizer`` is the path of a tokenizers file, the
    same on every worker; None finds the public one there.

    A null or empty text is its end id alone (nothing without one); bytes that aren't UTF-8 count as U+FFFD. Repeated rows and null ids are
    packed like others. Other columns are ignored. An empty table gives an empty result.
    A worker remembers a bounded number of chunks and at most one open bin for each class.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = b"" if end_id is None else end_id.to_bytes(WIDTH, "little")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or default_tokenizer()).encode
        packer = Packer(capacity, tolerance, TaskContext.get().partitionId())
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kind: list[pa.DataType] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            arrays = [pa.array(columns[0], kind[0])] + [pa.array(c, pa.int64()) for c in columns[1:]]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            kind[:] = [batch.schema.field(0).type]
            rows: list[tuple] = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                part = texts.slice(at, 256).to_pylist()
                for doc, got in zip(ids[at : at + 256], encode(part), strict=True):
                    rows.extend(packer.add(doc, got + end))
            yield batch_of(rows)
        if kind:
            yield batch_of(list(packer.end()))

    return docs.select(column(id_col), utf8(text_col).alias("__text")).mapInArrow(scan, with_id(docs, id_col, SCHEMA))
