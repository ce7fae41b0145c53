"""Sharding: what shards hold, and that equal texts stay together."""

import random
import zlib
from collections import defaultdict

import numpy as np

from chronoloom.llm import sharding
from chronoloom.llm.sharding import place, shard_documents, shard_report

DOCS = "doc_id long, text string, shard string, `Size` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS).repartition(3)


def check(rows, out, n_shards=16):
    size = {t: len((t or "").encode()) + 1 for _, t in rows}
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(i), size[t], zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(n_shards))
    return [(sum(r.size for r in out if r.shard == s), sum(r.tokens for r in out if r.shard == s), len(slots[s])) for s in range(n_shards)]


def test_balance_and_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 400)
    monkeypatch.setattr(sharding, "LAST_ROWS", 400)
    rng = random.Random(5)
    texts = [" ".join("word"[: rng.randrange(1, 5)] for _ in range(int(rng.lognormvariate(4, 1)))) + f" {k}" for k in range(2500)]
    rows = list(enumerate(texts + [rng.choice(texts[:300]) for _ in range(500)]))
    rng.shuffle(rows)
    out = shard_report(frame(spark, rows)).collect()
    held = np.array(check(rows, out))
    assert (held.max(axis=0) <= held.mean(axis=0) * [1.01, 1.02, 1.03]).all() and (held.min(axis=0) >= held.mean(axis=0) * [0.99, 0.98, 0.97]).all()
    by_text = defaultdict(set)
    for r in out:
        by_text[dict(rows)[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    again = shard_documents(frame(spark, rows).repartition(2)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in out}


def test_a_group_of_a_third_of_all_rows(spark):
    rows = [(i, "the same text again" if i % 3 == 0 else f"some text {i}") for i in range(3000)]
    held = np.array(check(rows, shard_documents(frame(spark, rows)).collect()))
    assert (np.abs(held / held.mean(axis=0) - 1) < [0.01, 0.02, 0.03]).all()


def test_edges(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (5, "é " * 50_000), (None, None), (6, "b")]
    out = shard_documents(frame(spark, rows), n_shards=3).collect()
    check(rows, out, 3)
    empty = shard_documents(frame(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "size", "tokens", "text_crc32", "shard", "slot"]


def test_place_takes_the_highest_product():
    left = np.array([[0.5, 0.1], [0.1, 0.5]])
    assert place(np.array([[0.1, 0.0], [0.0, 0.1], [0.05, 0.05]]), left).tolist() == [0, 1, 0]
