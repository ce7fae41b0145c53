"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest

from chronoloom.llm.queries import repeated_tail
from chronoloom.llm.runs import TOGETHER, collapse, find_runs, run_report, runs_of


def brute(w, min_length, min_periods):
    """Every maximal stretch of a period, under the smallest period that it has."""
    out = {}
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i < len(w) - q:
            start = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(min_length, min_periods * q):
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


@pytest.mark.parametrize("min_length", [3, 24])
def test_against_brute_force(min_length):
    rng = random.Random(min_length)
    for _ in range(500):
        docs = []
        for _ in range(3):
            n, k = rng.randrange(110), rng.choice([1, 2, 3, 8, 50])
            w = [b"%d" % rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
                if rng.random() < 0.3:
                    w[rng.randrange(n)] = b"x"
            docs.append(w)
        assert runs_of(docs, min_length, 3) == [brute(w, min_length, 3) for w in docs]


def test_nested_runs_and_long_periods():
    inner = [b"a", b"b"] * 14
    w = (inner + [b"c", b"d", b"e"]) * 3
    assert runs_of([w], 24, 3) == [brute(w, 24, 3)] and len(brute(w, 24, 3)) == 4
    period = [b"%d" % i for i in range(40 * TOGETHER)]
    assert runs_of([period * 3, period * 2 + period[:-1]], 24, 3) == [[(0, len(period) * 3, len(period))], []]


def test_one_word_many_times():
    assert runs_of([[b"a"] * 200_000], 24, 3) == [[(0, 200_000, 1)]]


def test_collapse():
    w = b"x y a b a b a b z".split()
    assert collapse(w, [(2, 6, 2)]) == b"x y a b z" and collapse(w, []) == b"x y a b a b a b z"


def expected(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        w = [w[i] if i < a else w[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(n)]
    runs = brute(w, 24, 3)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), n)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]


def test_report(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a " * 30, "é\x1cq ü " * 20, "one two three\n" * 9 + "b " * 40, "w" * 50_000]
    texts += [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(300))) for _ in range(80)]
    rows = [*enumerate(texts), (None, "a " * 30), (5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, runs string, collapsed string").repartition(3)
    out = run_report(docs, rewrite=repeated_tail).select(COLUMNS).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str(expected(i, t)) for i, t in rows)
    whole = {r.doc_id: r for r in find_runs(docs).where("doc_id = 3").collect()}
    assert whole[3].collapsed == "a" and whole[3].runs[0].length == 30
    assert run_report(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_runs(docs, min_periods=2)
