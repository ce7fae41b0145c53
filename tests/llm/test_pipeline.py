"""The corpus pipeline against what is planted in a small corpus."""

import random

import corpus_pipeline
from chronoloom.llm.common import words_of
from tests.llm.test_packing import check, ids_of


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("", "n", "r", "st")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, text(30)) for i in range(6)]
    docs, kind = {}, {}

    def add(t, k):
        i = len(docs)
        docs[i], kind[i] = t, k
        return i

    labels = []
    for _ in range(120):
        labels.append((add(text(rng.choice([20, 90])), "clean"), 1, 0))
    for _ in range(60):
        w = text(60).split()
        for _ in range(3):
            w.insert(rng.randrange(60), rng.choice(["vile", "foul", "rotten"]))
        i = add(" ".join(w), "toxic")
        if i % 3:
            labels.append((i, 1, 1))
    for _ in range(10):
        first = add(text(80), "clean")
        kind[first] = "copied"
        add(docs[first], "clean")  # of equal texts the largest id stays
    for _ in range(10):
        w = text(100).split()
        add(" ".join(w), "clean")
        w[50] = "zzz"
        add(" ".join(w), "near")
    for i, b in bench:
        add(f"{text(20)} {b} {text(20)}", "leak")
    add(None, "clean")
    add(rng.choice(bench)[1].upper(), "leak")
    lo = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    lo.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_join", "decontamination", "packing"]
    got = docs_left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_left = stage(spark, docs_left, str(tmp_path))
        assert docs_left.columns == got.columns
    expected = {i for i, k in kind.items() if k == "clean"}
    assert {r.doc_id for r in docs_left.collect()} == expected
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == expected and check(pieces) < 0.03
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(ids_of(docs[i])) for i in expected}
    assert all(len(words_of((docs[i] or "").encode())) < 101 for i in expected)


ODD = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `a.b` int, `__text` string, id int, `Doc Id` string"


def tables(spark, tmp_path, docs):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", 1, "x", 2, "d") for i, t in docs], ODD)
    spark.createDataFrame([(i, 1, int(i % 2)) for i in range(40)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, None), (3, "")], "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    return frame.repartition(3)


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows, ties and clashing column names."""
    rng = random.Random(5)
    plain = [(i, " ".join(f"t{rng.randrange(400)}" for _ in range(30)) + (" vile foul" if i % 2 else "")) for i in range(40)]
    odd = [(None, "alone and without an id"), (None, None), (50, None), (51, ""), (52, "!?"), (53, "long " * 20_000), (54, plain[0][1]), (54, plain[0][1]), (55, "W1 w2 w3 w4 w5 w6 w7 w8 w9 w10 and more")]
    docs = tables(spark, tmp_path, plain + odd)
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.schema.simpleString() == docs.schema.simpleString(), name
        rows = left.collect()
        assert all((r["row"], r["a.b"], r["__text"], r.id, r["Doc Id"]) == ("r", 1, "x", 2, "d") for r in rows)
    ids = sorted((r.doc_id for r in rows), key=lambda i: (i is None, i))
    assert ids.count(54) == 1 and 0 not in ids and 55 not in ids and ids.count(None) == 1
    assert sum((r.text or "") == "" for r in rows) == 1 and {2, 4, 52, 53, 54} <= set(ids)
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(ids) and check(pieces) < 0.03


def test_empty_table_through_all_stages(spark, tmp_path):
    left = docs = tables(spark, tmp_path, [(1, "a b c")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path))
        assert left.count() == 0, name
        if name != "packing":
            assert left.columns == docs.columns
