"""Packing: an exact round trip through the pieces."""

import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronoloom.llm.packing import cuts, default_tokenizer, encoder, pack


def ids_of(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, capacity=2048):
    """``rows``: pieces; by document they make up its ids, by sequence they leave no gap."""
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, total)


def test_round_trip(spark):
    texts = ["", None, "A b c.", "naïve é ＡＢ Σας x y z\x1cq", "it's we'll 12345 <|endoftext|>x", "w" * 5000, "the cat " * 9000]
    texts += [f"word{i} " * (i * 37 % 900) for i in range(150)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "dup", "x"), (2, "A b c.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(2)
    out = pack(docs).collect()
    assert check(out) < 0.03
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = ids_of(t)
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        if i == 2:
            assert len(pieces) == 2 * len({r.start for r in pieces})
            continue
        at = 0
        for r in pieces:
            part = ids[at : at + r.length]
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r.length
        assert at == len(ids)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 1290, 2047, 2048, 2049, 5000])
def test_cuts(n):
    got = cuts(n, 2048, 1 / 64)
    assert sum(got) == n and all(2048 - (2048 // c) * c <= 32 or c == got[-1] for c in got)


MIXED = ["<|ENDOFTEXT|>", "<|StartOfText|> a", "x<|endoftext|>y <|EndOfText|>", "<|startoftext|><|startoftext|>", "é" * 300 + " AK İ", "q" * 9000 + ". x"]


def test_added_tokens_in_any_case():
    e = encoder(default_tokenizer())
    for t in MIXED:
        assert [int.from_bytes(b, "little") for b in batched(e.encode([t.encode()])[0])] == ids_of(t)[:-1]


def batched(x):
    return [x[k : k + 4] for k in range(0, len(x), 4)]


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('61FF62206120C328') as string) as text")
    ids = ids_of(b"a\xffb a \xc3(".decode(errors="replace"))
    for r in pack(docs).collect():
        part = ids[r.start : r.start + r.length]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))


def test_odd_column_names(spark):
    docs = spark.createDataFrame([(1, "a b")], "`my id` long, `te-xt` string")
    assert pack(docs, id_col="my id", text_col="te-xt").columns[0] == "my id"
