"""Toxicity: ordered grades, edge rows and held-out accuracy."""

import random
import zlib

import numpy as np

from chronoloom.llm.toxicity import PREFIXES, cross_fitted, drop_toxic, fit_ordinal, score_severity, train_severity


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = [rng.choice(clean) for _ in range(rng.choice([5, 40, 120]))]
        for _ in range(rng.choice([1, 2, 6]) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "foul", "mean"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    seen = spark.createDataFrame(labels[:250] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = train_severity(docs, seen)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    out = {r.doc_id: r for r in score_severity(docs, model).collect()}
    right = [out[i].toxic == bool(t) for i, t in labels[250:]]
    assert np.mean(right) > 0.97
    assert out[0].severity >= 0 and all(r.severity <= 2 and r.toxic == (r.p_toxic >= 0.5) for r in out.values())
    left = drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == sum(not r.toxic for r in out.values())


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (2, ""), (3, "x " * 50_000)], "doc_id long, text string")
    none = train_severity(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert score_severity(docs, none).where("toxic").count() == 0
    assert score_severity(docs.limit(0), none).count() == 0
    assert train_severity(docs, spark.createDataFrame([], "doc_id long, toxic int")).weights == {}


def test_ordinal_weights_are_shared():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3)) < 0.5
    eta = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=2000)
    grades = np.searchsorted([0.0, 1.5], eta)
    rows, cols = np.nonzero(x)
    w, theta = fit_ordinal(rows, cols, grades, 3, l2=1e-5)
    assert np.allclose(w, [2, -1, 0], atol=0.35) and np.allclose(theta, [0, 1.5], atol=0.35)


def test_severity_orders_held_out_texts(spark):
    """Texts with more toxic words are graded higher; clean words added to a text don't make it worse."""
    rows, labels = corpus(900, seed=5)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = train_severity(docs.where("doc_id < 600"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    count = lambda t: len({"vile", "foul", "mean"} & set(t.split()))
    out = {r.doc_id: r for r in score_severity(docs, model).collect()}
    by = {n: np.mean([out[i].severity for i, t, _ in rows[600:] if count(t) == n]) for n in range(4)}
    assert by[0] < 0.1 and by[0] < by[1] < by[2] < by[3]
    long = spark.createDataFrame([(0, "w1 w2 vile"), (1, "w1 w2 vile " + " ".join(f"w{i}" for i in range(3, 300)))], "doc_id long, text string")
    a, b = (r.severity for r in score_severity(long, model).orderBy("doc_id").collect())
    assert abs(a - b) < 0.35


def test_scores_against_brute_force(spark):
    rows, labels = corpus(300, seed=8)
    docs = spark.createDataFrame(rows + [(500, None, "x"), (501, "", "x"), (None, "vile", "x")], "doc_id long, text string, severity string")
    model = train_severity(docs, spark.createDataFrame(labels[:200], "doc_id long, toxic int"))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for r in score_severity(docs, model).collect():
        text = next(t for i, t, *_ in [*rows, (500, ""), (501, ""), (None, "vile")] if i == r.doc_id)
        names = {zlib.crc32(w.encode()) for w in text.split()} | {zlib.crc32(f"{w[:k]}*".encode()) for w in text.split() for k in PREFIXES if len(w) >= k}
        eta = sum(model.weights.get(f, 0.0) for f in names)
        over = [sigmoid(eta - t) for t in model.thresholds]
        grades = [a - b for a, b in zip([1, *over], [*over, 0], strict=True)]
        assert np.isclose(r.severity, sum(over)) and np.isclose(r.p_toxic, over[0]) and np.isclose(grades[r.grade], max(grades))


def test_cross_fitted_scores_do_not_know_their_own_label():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, 400)
    scores = cross_fitted(np.arange(400), np.arange(400), labels, 400)  # a feature of its own for each row
    assert not scores.any()


def test_repeated_ids_and_odd_names(spark):
    docs = spark.createDataFrame([(1, f"vile {i}") for i in range(50)] + [(2, "fine")], "`my id` long, `te-xt` string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "`my id` long, `is bad` int")
    model = train_severity(docs, labels, id_col="my id", text_col="te-xt", label_id_col="my id", label_col="is bad")
    left = drop_toxic(docs, model, text_col="te-xt")
    assert left.columns == docs.columns and left.count() <= 51
