"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from chronoloom.llm import tiered
from chronoloom.llm.tiered import TieredIndex, impacts, search

DOCS = "doc_id long, text string, score string, `Rank` string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    n_terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            n, score = sum(c.values()), 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms)))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], schema).repartition(3)


def corpus(n):
    rng = random.Random(n)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"] + [f"rare{i}" for i in range(400)]
    weights = [100 / (k + 1) for k in range(30)] + [0.05] * 400
    text = lambda m: " ".join(rng.choices(vocab, weights, k=m))
    rows = [(i, text(int(rng.lognormvariate(3, 1)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "... !"), (n + 3, "Ba BA ba rare1"), (None, "ba rare1 rare2"), (3, rows[3][1]), (3, rows[3][1]), (n + 4, rows[3][1]), (n + 5, "é ü " * 3000)]
    items = [(i, text(rng.randrange(1, 40))) for i in range(25)] + [(90, None), (91, ""), (92, "unknown"), (93, "RARE1 rare1 é"), (94, rows[3][1]), (94, rows[3][1]), (None, "ba")]
    return rows, items


@pytest.mark.parametrize("ends", [((1 / 16, 2), (1 / 4, 5)), ((1 / 16, 32), (1 / 4, 128))])
def test_against_brute_force(spark, monkeypatch, tmp_path, ends):
    monkeypatch.setattr(tiered, "TIERS", ends)  # the tasks of a local session take these from here
    rows, items = corpus(600)
    index = TieredIndex.build(frame(spark, rows), f"file://{tmp_path}/index")
    found = TieredIndex.load(spark, index.path).search(frame(spark, items, "item_id long, text string, doc_id string, rest string")).collect()
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in found) == brute(rows, items)


def test_rare_terms_are_proven_in_the_first_tier(spark, tmp_path):
    rows = [(i, f"the common words of all and word{i}") for i in range(400)]
    items = [(1, "word7 word8"), (2, "the common word9")]
    found = search(frame(spark, rows), frame(spark, items, "item_id long, text string, x string, y string"), f"file://{tmp_path}/index").collect()
    assert {(r.item_id, r.doc_id, r.tier) for r in found if r.item_id == 1} == {(1, 7, 0), (1, 8, 0)}
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in found) == brute(rows, items)


def test_items_in_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tiered, "ENTRIES", 40)
    rows, items = corpus(80)
    found = search(frame(spark, rows), frame(spark, items, "item_id long, text string, x string, y string"), f"file://{tmp_path}/index", k=3).collect()
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in found) == brute(rows, items, 3)


def test_nothing(spark, tmp_path):
    rows, items = corpus(5)
    one = frame(spark, items, "item_id long, text string, x string, y string")
    assert search(frame(spark, rows).limit(0), one, f"file://{tmp_path}/a").count() == 0
    assert search(frame(spark, rows), one.limit(0), f"file://{tmp_path}/b").count() == 0


def test_impacts_beyond_64_bits():
    tf, n = np.array([1, 3]), np.array([900_000, 5])
    n_docs, n_terms = 10**12, 10**14
    assert impacts(tf, n, n_docs, n_terms).tolist() == [10**9 * int(t) // (1000 * int(t) + 8 * (25 + 75 * int(m) * n_docs // n_terms)) for t, m in zip(tf, n, strict=True)]
