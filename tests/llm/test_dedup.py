"""Exact copies, near copies and leaks against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from chronoloom.llm import near
from chronoloom.llm.decontamination import clean_of_benchmark, contamination_report, digest_of
from chronoloom.llm.exact_dedup import DigestIndex, append_documents, drop_exact_copies, find_exact_copies, known_copies
from chronoloom.llm.near_join import drop_near_copies, fewest_matches, near_classes

DOCS = "doc_id long, text string, digest string, `Row` string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS).repartition(3)


EDGE = [(1, "a"), (2, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (5, "A"), (6, "b" * 100_000), (7, "b" * 100_000), (None, "q"), (8, "é é"), (9, "é é")]


@pytest.mark.parametrize("digest_bytes", [32, 1])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_copies(spark, digest_bytes, keep):
    rows = EDGE + [(100 + i, f"text {i % 60}") for i in range(300)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: (max if keep == "largest" else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    expected = sorted(
        (str(i), str(best[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows
    )
    out = find_exact_copies(frame(spark, rows), keep=keep, digest_bytes=digest_bytes).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == expected
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    left = drop_exact_copies(frame(spark, rows), keep=keep, digest_bytes=digest_bytes)
    assert left.columns == ["doc_id", "text", "digest", "Row"]
    assert sorted(map(str, ((r.doc_id, r.text or "") for r in left.collect()))) == sorted(map(str, ((best[t], t) for t in groups)))


def test_exact_copies_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert find_exact_copies(empty).count() == 0 and drop_exact_copies(empty).count() == 0


def test_index_of_several_tables(spark, tmp_path):
    rng = random.Random(4)
    tables = [[(100 * k + i, f"text {rng.randrange(90)}") for i in range(30)] + [(100 * k + 50, None)] for k in range(6)]
    root = f"file://{tmp_path}/index"
    seen = []
    for k, rows in enumerate(tables):
        index = DigestIndex(spark, root, fanout=2)  # opened again each time
        docs = frame(spark, rows)
        if seen:
            got = {r.doc_id: r.known_id for r in known_copies(docs, index, frame(spark, seen)).collect()}
            first = {}
            for i, t in seen:
                first.setdefault(t or "", i)
            assert got == {i: first[t or ""] for i, t in rows if (t or "") in first}
        append_documents(docs, index)
        seen += rows
        digests = {t or "" for _, t in seen}
        assert index.merged().count() == len(digests) and max(sum(r.level == n for r in index.runs) for n in range(4)) < 2
    assert max(r.level for r in index.runs) == 2 and sum(r.n for r in index.runs) >= len(digests)
    total = {r.id: r.n for r in index.merged().collect()}
    assert sum(total.values()) == len(seen)
    assert len(list((tmp_path / "index").glob("run-*-filter"))) == len(index.runs)
    assert known_copies(frame(spark, tables[0]), DigestIndex(spark, f"{root}-none"), frame(spark, seen)).count() == 0


def test_contamination(spark):
    rng = random.Random(5)
    vocab = ["a", "B", "c", "é", "d1"]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 9, 10, 12, 14])))) for i in range(2, 30)]
    bench = [(i, t) for i, t in bench if len(t.split()) > 2] + [(30, None), (31, ""), (32, "!!"), (3, bench[0][1]), (None, bench[5][1])]
    docs = EDGE + [(200 + i, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(rng.choice([0, 2, 8, 40, 300])))) for i in range(60)]
    windows = defaultdict(set)
    for i, t in bench:
        w = words(t)
        for p in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[p : p + 10])].add(i)
    expected = []
    for i, t in docs:
        w = words(t)
        hit, items = set(), set()
        for pattern, owners in windows.items():
            n = len(pattern)
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) == pattern:
                    hit.update(range(p, p + n))
                    items |= owners
        names = sorted(str(x) for x in items if x is not None)
        expected.append((str(i), len(w), len(hit), len(names), digest_of(names), bool(hit)))
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    for most in (200_000, 40):
        out = contamination_report(frame(spark, docs), benchmark, max_windows=most).collect()
        assert sorted((str(r[0]), *r[1:]) for r in out) == sorted(expected)
        left = clean_of_benchmark(frame(spark, docs), benchmark, max_windows=most)
        assert left.columns == ["doc_id", "text", "digest", "Row"]
        assert left.count() == sum(not e[-1] for e in expected)
    none = contamination_report(frame(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)


def near_rows(seed=3):
    """Families of texts with edits, exact copies, and texts that share half."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, i = [], 10
    for family in range(12):
        base = [word() for _ in range(120)]
        for _ in range([1, 2, 3, 5, 8, 40][family % 6]):
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    half = [word() for _ in range(60)]
    for _ in range(40):
        rows.append((i, " ".join(half + [word() for _ in range(rng.choice([12, 16, 60]))])))
        i += 1
    rng.shuffle(rows)
    return rows + [(5, rows[0][1]), (6, rows[0][1].upper()), (7, "one two"), (8, "One, two!"), (9, "one two three")]


def brute_components(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
                if sets[a] != sets[b]:
                    links[a].add(frozenset(sets[b]))
                    links[b].add(frozenset(sets[a]))
    return [find(x) for x in range(len(rows))], [len(links[x]) for x in range(len(rows))]


@pytest.mark.parametrize("small", [64, 6])
def test_near_classes(spark, monkeypatch, small):
    monkeypatch.setattr(near, "SMALL_BUCKET", small)
    rows = near_rows()
    comps, links = brute_components(rows)
    low = {}
    for (i, _), c in zip(rows, comps, strict=True):
        low[c] = min(low.get(c, i), i)
    edge = [(None, None), (1, ""), (2, "!!"), (3, None)]
    out = {r.doc_id: r for r in near_classes(frame(spark, rows + edge)).collect()}
    assert len(out) == len(rows) + len(edge)
    for (i, _), c, n in zip(rows, comps, links, strict=True):
        assert out[i].class_id == low[c], i
        assert out[i].class_size == comps.count(c)
        if small == 64:
            assert out[i].n_links == n
    assert all(out[i].class_id == i and out[i].n_links == 0 for i, _ in edge)
    left = drop_near_copies(frame(spark, rows + edge + rows[:3]))
    assert left.columns == ["doc_id", "text", "digest", "Row"]
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted([*low.values(), 1, 2, 3])


@pytest.mark.parametrize("block", [1024, 8])
def test_links_of_large_buckets_are_counted(spark, monkeypatch, block):
    monkeypatch.setattr(near, "SMALL_BUCKET", 6)
    monkeypatch.setattr(near, "BLOCK", block)
    rows = near_rows()
    _, links = brute_components(rows)
    out = {r.doc_id: r.n_links for r in near_classes(frame(spark, rows)).collect()}
    assert [out[i] for i, _ in rows] == links
    assert max(links) > 2 * near.HUBS


def test_links_by_more_than_64_bands(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL_BUCKET", 6)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10_000)}" for _ in range(60)]
    rows = [(i, " ".join("x%d" % rng.randrange(10**6) if rng.random() < 0.04 else w for w in base)) for i in range(40)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    different = {frozenset(a) for a in sets}  # equal sets count once
    links = [sum(len(a & b) / len(a | b) >= 0.3 for b in different if a != b) for a in sets]
    out = {r.doc_id: r.n_links for r in near_classes(frame(spark, rows), threshold=0.3, most_hashes=128).collect()}
    got = [out[i] for i, _ in rows]
    assert all(g <= n for g, n in zip(got, links, strict=True)) and sum(got) >= 0.98 * sum(links)


def test_near_classes_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_classes(empty).count() == 0 and drop_near_copies(empty).count() == 0


def test_posterior_bound():
    # all values match: never dropped; none match: always
    assert all(fewest_matches(n, 0.8, 1e-4) <= n for n in (8, 16, 64))
    assert fewest_matches(64, 0.8, 1e-4) > 30


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_recall_on_a_table(spark, threshold):
    """All pairs at the threshold, of texts of the smallest table, share a class; links are counted."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    comps, links = brute_components(rows, threshold)
    out = {r.doc_id: r for r in near_classes(docs, threshold=threshold).collect()}
    found = wanted = 0
    for (i, _), c, n in zip(rows, comps, links, strict=True):
        low = min(j for (j, _), d in zip(rows, comps, strict=True) if d == c)
        found += out[i].class_id == low
        wanted += n
    assert found >= 0.99 * len(rows) and sum(r.n_links for r in out.values()) >= 0.99 * wanted


def test_names_that_need_quotes(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, "a b", 2), (3, None, 3)], "`my id` long, `te-xt` string, `a.b` int")
    assert near_classes(docs, id_col="my id", text_col="te-xt").count() == 3
    item = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    assert clean_of_benchmark(docs, item, text_col="te-xt").columns == docs.columns
    assert drop_exact_copies(docs, id_col="my id", text_col="te-xt").count() == 2
    left = drop_near_copies(docs, id_col="my id", text_col="te-xt")
    assert left.columns == docs.columns and left.count() == 2
