"""Distances, neighbours, metrics, memory, selection, text and plans."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators.quantiles import exact_quantiles
from chronoloom.functions import text as X
from chronoloom.functions import vectors as V
from chronoloom.operators import gallery as G
from chronoloom.operators import metrics as M
from chronoloom.operators import retrieval as R
from chronoloom.operators import selector as S
from chronoloom.plans.memory import Conflict, Memory
from chronoloom.plans.pipelines import Inference, Persistence, StatRetrieval, aggregate_channels, vote_by_channel
from chronoloom.plans.registry import ConfigError, FactoryError, Registry
from chronoloom.plans.tasks import build_queries, normalize_label, parse_output, prompt_target
from chronoloom.plans.telemetry import EventLog, MetricTracker, NullTracker, build_logger, timed
from chronoloom.schema import RetrieverConfig, SelectorConfig, TaskSpec
from chronoloom.sources.files import read_json, read_jsonl


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_distances(spark):
    r = one(
        spark, same=V.cosine_distance(arr(1, 0), arr(1, 0)), other=V.cosine_distance(arr(1, 0), arr(0, 1)), zero=V.cosine_distance(arr(0, 0), arr(0, 1)), l2=V.l2_distance(arr(1, 0), arr(0, 1)),
        w=V.weighted_l2_distance(arr(1, 0), arr(0, 1), arr(1, 2)), sim=V.cosine_similarity(arr(0, 0), arr(1, 1)), conf=V.confidence(F.lit(1.0)), std=V.stddev(arr(1, 2, 4)), std1=V.stddev(arr(1), 1),
        down=V.downsample(arr(0, 1, 2, 3, 4, 5), 3), first=V.downsample(arr(3, 4), 1), whole=V.downsample(arr(3, 4), None), z=V.znorm(arr(1, 3)), flat=V.znorm(arr(2, 2)),
    )
    assert (r.same, r.other, r.zero, r.sim, r.conf, r.std1) == (0, 1, 1, 0, 0.5, 0)
    assert r.l2 == pytest.approx(math.sqrt(2)) and r.w == pytest.approx(math.sqrt(3)) and r.std == pytest.approx(np.std([1, 2, 4]))
    assert r.down == [0, 2, 5] and r.first == [3] and r.whole == [3, 4] and r.z == [-1, 1] and r.flat == [0, 0]
    for bad in (V.l2_distance(arr(1), arr(1, 2)), V.weighted_l2_distance(arr(1), arr(1), arr(-1))):
        with pytest.raises(Exception, match="differ|non-negative"):
            one(spark, x=bad)


def entries(spark, rows):
    return spark.createDataFrame([(n, n, str(i), 0, i, [float(x) for x in v]) for i, (n, v) in enumerate(rows)], "entry_id string, sample_id string, label string, channel_id int, ord long, vector array<double>")


def ask(spark, v, sample="query_sample"):
    return spark.createDataFrame([("q", sample, [float(x) for x in v])], "query_id string, sample_id string, vector array<double>")


def names(near):
    return [r.entry_id for r in near.orderBy("rank").collect()]


def test_knn(spark):
    g = entries(spark, [("a", (0, 0)), ("b", (2, 2)), ("c", (5, 5))])
    assert names(R.knn(ask(spark, (1, 1)), g, RetrieverConfig("l2", "none", 2))) == ["a", "b"]
    assert names(R.knn(ask(spark, (1, 1)), g.repartition(3), RetrieverConfig("l2", "none", 9))) == ["a", "b", "c"]
    w = entries(spark, [("a", (0.9, 0)), ("b", (0, 0.2))])
    assert names(R.knn(ask(spark, (0, 0)), w, RetrieverConfig("weighted_l2", "none", 1, (10.0, 1.0)))) == ["b"]
    d = entries(spark, [("dup", (0, 0)), ("other", (1, 1))])
    assert names(R.knn(ask(spark, (0.1, 0.1), "dup"), d, RetrieverConfig("l2", "none", 2))) == ["other"]
    assert R.knn(ask(spark, (1, 1)), g.limit(0), RetrieverConfig()).count() == 0
    for bad in (lambda: RetrieverConfig("l7"), lambda: RetrieverConfig(top_k=0), lambda: RetrieverConfig("weighted_l2"), lambda: RetrieverConfig(normalize="max")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(RuntimeError):
        R.knn(ask(spark, (1, 1)), g, RetrieverConfig(enabled=False))
    with pytest.raises(Exception, match="differ in length"):
        R.knn(ask(spark, (1,)), g, RetrieverConfig("l2")).collect()
    sets = R.retrieved_sets(R.knn(ask(spark, (1, 1)), g, RetrieverConfig("l2", "none", 3)))
    assert [x.entry_id for x in R.topk_of(sets, 1).first().examples] == ["a"]


def test_knn_in_chunks_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    g = entries(spark, [(f"e{i}", rng.normal(size=4)) for i in range(60)])
    q = g.withColumnRenamed("entry_id", "query_id")
    whole = R.knn(q, g, RetrieverConfig("cosine", "zscore", 3)).select("query_id", "rank", "entry_id").collect()
    monkeypatch.setattr(R, "CHUNK_VALUES", 40)
    parts = R.knn(q, g, RetrieverConfig("cosine", "zscore", 3)).select("query_id", "rank", "entry_id").collect()
    assert sorted(whole) == sorted(parts) and len(whole) == 180


def test_scaling_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=31), np.full(31, 3.0), rng.normal(size=31) ** 3])
    g = entries(spark, [(str(i), v) for i, v in enumerate(x)])
    y = np.sign(x) * np.log1p(abs(x))
    q = np.percentile(y, [25, 50, 75], axis=0)
    cases = {"zscore": (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0)), "log1p_robust": (y - q[1]) / np.where(q[2] - q[0] == 0, 1, q[2] - q[0])}
    for name, expected in cases.items():
        fit = R.fit_scaling(g, name)
        assert np.allclose(fit.apply(x), expected)
        got = g.orderBy("ord").select(fit.column("vector").alias("v")).collect()
        assert np.allclose([r.v for r in got], expected)


def test_metrics(spark):
    truth = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "query_id string, label string")
    near = spark.createDataFrame([("a", 1, "1"), ("a", 2, "1"), ("a", 3, "0"), ("b", 1, "0")], "query_id string, rank int, label string")
    per = {r.query_id: (r.top_k_accuracy, r.precision_at_k) for r in M.query_metrics(truth, near, 4).collect()}
    assert per == {"a": (1.0, 0.5), "b": (0.0, 0.0), "c": (0.0, 0.0)}
    assert M.batch_metrics(M.query_metrics(truth, near, 4)).first().num_query == 3
    z = M.zscores(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double"), {"x": "z"}).orderBy("x").collect()
    x = np.array([1.0, 2, 4])
    assert np.allclose([r.z for r in z], (x - x.mean()) / x.std(ddof=1))
    assert M.zscores(spark.createDataFrame([(1.0,)], "x double"), {"x": "z"}).first().z == 0


def series(spark, n=24, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for split, k in (("train", n), ("test", n // 3)):
        for i in range(k):
            y = i % 3
            for c in range(3):
                base = np.sin(np.arange(32) * (0.2 + 0.3 * y)) * (1 + y) if c == 1 else np.zeros(32)
                rows.append((f"{split}_{i}", split, i, c, (base + rng.normal(size=32) * (0.1 if c == 1 else 1)).tolist(), str(y)))
    return spark.createDataFrame(rows, "sample_id string, split string, sample_index long, channel_id int, values array<double>, label string")


def brute_selector(rows, config):
    by = {}
    for r in rows:
        x = np.array(r["values"])
        x = x - x.mean() if x.var() <= 1e-12 else (x - x.mean()) / x.std()
        by.setdefault(r.channel_id, []).append((r.sample_index, int(r.label), x))
    b, c = {}, {}
    for ch, items in by.items():
        items.sort(key=lambda t: t[0])
        cen = {y: np.mean([x for _, l, x in items if l == y], axis=0) for y in {l for _, l, _ in items}}
        within = np.mean([np.mean([np.linalg.norm(x - cen[y]) for _, l, x in items if l == y]) for y in cen])
        ys = sorted(cen)
        between = np.mean([np.linalg.norm(cen[p] - cen[q]) for i, p in enumerate(ys) for q in ys[i + 1 :]])
        b[ch] = between / (within + 1e-8)
        probes = S.probe_ids(len(items), ch, config) or range(len(items))
        hits = [items[min((j for j in range(len(items)) if j != i), key=lambda j: (round(((items[j][2] - items[i][2]) ** 2).sum(), 9), j))][1] == items[i][1] for i in probes]
        c[ch] = np.mean(hits)
    return b, c


@pytest.mark.parametrize("nn_eval", [0, 7, 200])
def test_selector(spark, nn_eval):
    config = SelectorConfig(top_k=1, nn_eval=nn_eval)
    train = series(spark).where("split = 'train'")
    out = {r.channel_id: r for r in S.select_channels(train, config).collect()}
    b, c = brute_selector(train.collect(), config)
    for ch in b:
        assert out[ch].score_b == pytest.approx(b[ch]) and out[ch].score_c == pytest.approx(c[ch])
    assert [ch for ch, r in out.items() if r.selected] == [1]
    alone = S.select_channels(train.where("channel_id = 0"), config).first()
    assert alone.selected and not alone.selection_applied and alone.score_b == 1


def test_pruning():
    ranked = [(3, [[1.0, 0.0]]), (1, [[0.99, 0.01]]), (2, [[0.0, 1.0]])]
    assert S.prune_similar(ranked, 2, 0.9) == [3, 2] and S.prune_similar(ranked, 2, None) == [3, 1]


def test_gallery(spark, tmp_path):
    rows = spark.createDataFrame(
        [("s1", "train", 0, 0, "1", {"b": 1.0, "a": 2.0}), ("s1", "train", 0, 1, "1", {"b": 3.0, "a": 4.0}), ("s2", "train", 1, 0, "2", {"a": 5.0, "b": 6.0})],
        "sample_id string, split string, sample_index long, channel_id int, label string, statistic_view map<string,double>",
    )
    g = G.check_unique(G.build_gallery(rows, dataset="toy"))
    assert G.filter_gallery(g, label="1", channel_ids=[1], has_view="statistic_view").count() == 1
    assert G.filter_gallery(g, exclude_sample_id="s1").count() == 1 and G.filter_gallery(g, has_view="ts_view").count() == 0
    assert G.get_entry(g, "s2__ch0").label == "2" and G.entries_of_sample(g, "s1").count() == 2
    with pytest.raises(KeyError):
        G.get_entry(g, "none")
    with pytest.raises(ValueError):
        G.check_unique(g.unionByName(g))
    vectors, order = G.gallery_vectors(g)
    assert order == ["a", "b"] and sorted(r.vector for r in vectors.collect()) == [[2, 1], [4, 3], [5, 6]]
    with pytest.raises(Exception, match="missing features"):
        G.gallery_vectors(g, ["a", "z"])[0].collect()
    for save, load in ((G.save_gallery, G.load_gallery), (G.save_gallery_json, G.load_gallery_json)):
        save(g, str(tmp_path / save.__name__))
        assert sorted(map(str, load(spark, str(tmp_path / save.__name__)).collect())) == sorted(map(str, g.collect()))
    meta = G.save_index(g, str(tmp_path / "index"))
    vectors, again = G.load_index(spark, str(tmp_path / "index"))
    assert meta == again == {"feature_order": ["a", "b"], "dim": 2, "num_entries": 3} and vectors.count() == 3
    assert {(r.kind, r.key): r.n for r in G.summarize(g).collect()}[("total", "samples")] == 2


def test_pipeline(spark, tmp_path):
    data = series(spark)
    train, test = (data.where(F.col("split") == s) for s in ("train", "test"))
    keep = Persistence(True, root=str(tmp_path), dataset="toy", experiment="one run")
    log = EventLog(tmp_path / "events.jsonl")
    pipe = StatRetrieval(RetrieverConfig("cosine", "zscore", 3), groups=["statistics"], persistence=keep, log=log)
    out = pipe.evaluate(train, test, 1)
    assert out.metrics["top_k_accuracy"] == 1.0 and out.num_train == 24 and out.num_query == 8
    meta = Path(keep.folder) / "build_meta.json"
    before = meta.stat().st_mtime_ns
    assert pipe.evaluate(train, test, 1).metrics == out.metrics and meta.stat().st_mtime_ns == before
    pipe.evaluate(train.where("sample_index < 20"), test, 1)
    assert read_json(meta)["entries"] == 20 and meta.stat().st_mtime_ns != before
    best = pipe.predict(pipe.memory(train, 1), test, 1).collect()
    assert len(best) == 8 and all(0 < r.confidence <= 1 for r in best)
    assert [e["event_type"] for e in read_jsonl(tmp_path / "events.jsonl")] == ["evaluation"] * 3
    with pytest.raises(ValueError):
        Persistence(True)
    found = Inference([1], RetrieverConfig("l2", "zscore", 3), groups=["statistics"]).run(train, test)
    got = {r.query_id: r.prediction for r in found["predictions"].collect()}
    truth = {f"query__{r.sample_id}": r.label for r in test.where("channel_id = 1").collect()}
    assert np.mean([got[k] == v for k, v in truth.items()]) > 0.8
    with pytest.raises(ValueError):
        Inference([])


def test_votes(spark):
    near = spark.createDataFrame([("q", 0, "a", 1.0), ("q", 0, "b", 0.5), ("q", 1, "b", 9.0), ("q", 1, "b", 9.0), ("q", 1, "a", 0.1)], "query_id string, channel_id int, label string, distance double")
    votes = vote_by_channel(near)
    assert sorted((r.channel_id, r.label) for r in votes.collect()) == [(0, "b"), (1, "b")]
    assert aggregate_channels(votes).first().prediction == "b"


def test_text(spark):
    f = lambda v, **k: X.format_float(F.lit(v).cast("double"), **k)
    r = one(
        spark, a=f(1.23456), b=f(2.0), c=f(-0.0001), d=f(float("nan")), e=f(float("-inf")), g=f(0.0625), h=f(-1.9999, mode="truncate"), i=f(2.5, digits=0), j=f(1.5, strip_zeros=False), k=f(1e300),
        s=X.format_series(arr(1, 2.5, 3), max_items=2), t=X.format_channel(F.lit(3), arr(1), F.lit(0.5)), p=X.format_payload(features=F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), F.lit(2.5))), n=X.format_payload(text=F.lit(None).cast("string")),
        x=X.format_example(F.lit("s"), label=F.lit("1"), view="ts", score=F.lit(0.25), payload=F.lit("body")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.g, r.h, r.i, r.j, r.k) == ("1.235", "2", "0", "nan", "-inf", "0.063", "-1.999", "3", "1.500", "1.0E300")
    assert r.s == "[1, 2.5] ... (total_length=3)" and r.t == "Channel 3: [1] (score=0.5)" and r.p == "{ a=2.5, b=1 }" and r.n == "None"
    assert r.x == "Sample: s | Label: 1 | View: ts | Score: 0.25\nbody"


def test_tasks(spark):
    spec = TaskSpec("classification", ("up", "down"))
    assert one(spark, x=parse_output(F.lit('{"decision": " up "}'), spec)).x == "up"
    assert one(spark, x=parse_output(F.lit("down"), spec)).x == "down"
    for bad in ("left", '{"other": 1}'):
        with pytest.raises(Exception, match="label space|neither"):
            one(spark, x=parse_output(F.lit(bad), spec))
    assert one(spark, x=normalize_label(F.lit("any "), TaskSpec("prediction"))).x == "any"
    assert "up, down" in prompt_target(spec)
    q = build_queries(series(spark, 3), spec).first()
    assert q.query_id == f"classification:{q.sample_id}" and q.n_channels == 3 and q.data_mode == "multivariate"
    with pytest.raises(ValueError):
        TaskSpec("classification", ("a", "a"))


def test_registry_and_telemetry(tmp_path):
    r = Registry("thing")

    @r.register(" One ")
    def make(x=1):
        if x < 0:
            raise ValueError("negative")
        return x

    assert r.build({"name": "one", "x": 3}) == 3 and r.build("ONE") == 1 and r.summary() == {"one": "make"}
    for bad, kind in ((lambda: r.build({}), ConfigError), (lambda: r.build({"name": "one", "x": -1}), FactoryError), (lambda: r.build("two"), KeyError), (lambda: r.register("one", make), KeyError)):
        with pytest.raises(kind):
            bad()
    t = MetricTracker(tmp_path)
    t.log({"a": 1.0}, step=1)
    t.log({"a": 2.0}, step=2)
    assert read_json(tmp_path / "latest_metrics.json")["step"] == 2 and len(read_jsonl(tmp_path / "metrics.jsonl")) == 2
    with pytest.raises(ValueError):
        t.log({})
    assert NullTracker().log({"a": 1.0}) == {"metrics": {"a": 1.0}}
    log = EventLog(tmp_path / "e.jsonl")
    with pytest.raises(RuntimeError), log.span("agent", "x"):
        raise RuntimeError("no")
    with timed("t", log) as took:
        pass
    assert took["seconds"] >= 0 and [e["event_type"] for e in read_jsonl(tmp_path / "e.jsonl")] == ["agent_start", "agent_error", "timer"]
    assert build_logger("x", tmp_path / "l.log") is build_logger("x", tmp_path / "l.log")


def test_cli(spark, tmp_path):
    from chronoloom.plans.cli import main

    d = tmp_path / "data" / "Toy"
    d.mkdir(parents=True)
    rng = np.random.default_rng(0)
    for split, n in (("TRAIN", 8), ("TEST", 4)):
        (d / f"Toy_{split}").write_text("\n".join(",".join(map(str, [i % 2, *(rng.normal(size=16) + 9 * (i % 2)).round(3)])) for i in range(n)))
    out = main(["--dataset", "Toy", "--base-dir", str(tmp_path / "data"), "--feature-groups", "0_Mean", "0_Median", "--distance", "l2", "--k", "1", "--outputs-root", str(tmp_path / "out")])
    assert out[0]["metrics"]["top_k_accuracy"] == 1.0
    assert read_json(tmp_path / "out" / "evaluations" / "stat_retrieval_Toy.json")[0]["num_query"] == 4
    args = ["--dataset-loader", "ucr2015", "--dataset", "Toy", "--channel-id", "0", "--feature-groups", "statistics.json", "spectral_frequency.json", "--distance", "cosine", "--normalize", "zscore", "--k", "5", "--persist-memory"]
    out = main([*args, "--base-dir", str(tmp_path / "data"), "--outputs-root", str(tmp_path / "out"), "--experiment-name", "x", "--save-json", str(tmp_path / "s.json")])
    assert read_json(tmp_path / "s.json")[0]["dataset_loader"] == "ucr2015" and out[0]["channel_id"] == 0
    with pytest.raises(SystemExit):
        main(["--dataset", "Toy", "--base-dir", str(tmp_path / "data"), "--channel-id", "3"])


@pytest.mark.parametrize("distance", ["l2", "cosine", "weighted_l2"])
@pytest.mark.parametrize("values", [4_000_000, 300])
def test_neighbours_against_brute_force(spark, monkeypatch, distance, values):
    """Queries sent whole, and queries and gallery in blocks; ties, far-off values, channels."""
    from chronoloom.operators import retrieval as R

    monkeypatch.setattr(R, "CHUNK_VALUES", values)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-2, 3, (50, 4)).astype(float), rng.normal(size=(20, 4)) * 1e5 + 1e6])
    rows = [(f"e{i}", f"s{i // 2}", str(i % 3), i % 2, i, x[i].tolist()) for i in range(len(x))]
    g = spark.createDataFrame(rows, "entry_id string, sample_id string, label string, channel_id int, ord long, vector array<double>").repartition(3)
    q = g.select(F.col("entry_id").alias("query_id"), "sample_id", F.when(F.col("ord") < 60, F.col("channel_id")).alias("channel_id"), "vector")
    w = (1.0, 0.5, 2.0, 0.0)
    config = RetrieverConfig(distance, "none", 4, w if distance == "weighted_l2" else None)
    got = {}
    for r in R.knn(q, g, config).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.entry_id, r.distance)
    for i, (e, sample, _, channel, _, v) in enumerate(rows):
        a = np.array(v)
        near = []
        for f, s2, _, c2, j, u in rows:
            if s2 == sample or config.by_channel and i < 60 and c2 != channel:
                continue
            b = np.array(u)
            if distance == "cosine":
                n = np.linalg.norm(a) * np.linalg.norm(b)
                d = max(0.0, 1 - (a @ b / n if n else 0.0))
            else:
                d = np.sqrt(((a - b) ** 2 * (w if distance == "weighted_l2" else 1.0)).sum())
            near.append((round(d, 9), j, f, d))
        near.sort()
        assert [got[e][k + 1][0] for k in range(4)] == [n[2] for n in near[:4]]
        assert [got[e][k + 1][1] for k in range(4)] == pytest.approx([n[3] for n in near[:4]], abs=1e-9)


def test_stream(spark, tmp_path):
    from chronoloom.streaming.scoring import score_stream, window_vectors

    events = spark.sql("select cast(id % 3 as string) user_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,cast(id as int)) ts, cast(id as double) value from range(120)")
    events.write.parquet(str(tmp_path / "in"))
    static = window_vectors(events)
    gallery = static.select(F.col("query_id").alias("entry_id"), F.col("sample_id"), F.lit("x").alias("label"), F.lit(0).alias("channel_id"), F.unix_timestamp("start").alias("ord"), "vector")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, gallery, RetrieverConfig("l2", "zscore", 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < got.count() <= static.count() and got.where("sample_id = split(query_id, '@')[0]").count() == 0


@pytest.mark.parametrize("few", [20_000, 60])
def test_exact_quantiles(spark, monkeypatch, few):
    """Against NumPy, with the values ranked at once or by brackets; heavy ties, outliers, nulls and a single value."""
    from chronoloom.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "ACCURACY", 300)
    rng = np.random.default_rng(3)
    columns = [
        rng.normal(size=4000), np.exp(rng.normal(size=3001) * 40), np.array([1.5]), np.repeat([3.0, -1.0, 7.0], [2500, 500, 100]),
        np.concatenate([np.zeros(1500), rng.normal(size=1500)]), np.array([-0.0, 0.0, 5e-324, -1e308, 1e308]), rng.integers(0, 50, 5000).astype(float), np.full(900, 2.0),
    ]
    rows = [(d, float(x)) for d, c in enumerate(columns) for x in c] + [(0, None), (99, None)]
    long = spark.createDataFrame(rows, "dim int, x double").repartition(4)
    probabilities = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    found = exact_quantiles(long, probabilities)
    got = {(r.dim, r.q): r.value for r in found.collect()}
    assert set(got) == {(d, q) for d in range(len(columns)) for q in range(len(probabilities))}
    for d, c in enumerate(columns):
        for q, p in enumerate(probabilities):
            assert got[d, q] == pytest.approx(np.percentile(c, 100 * p), rel=1e-12), (d, p)
    assert "percentile(" not in found._jdf.queryExecution().toString()
    assert exact_quantiles(long.limit(0), probabilities).count() == 0


def test_quantiles_of_nan(spark):
    long = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, float("nan"))], "dim int, x double")
    low, high = (r.value for r in exact_quantiles(long, (0.5, 1.0)).orderBy("q").collect())
    assert low == 2.0 and high != high


@pytest.mark.parametrize("distance", ["l2", "cosine"])
def test_blocks_are_left_out(spark, distance):
    """Clusters far apart: most pairs of query and block are never met, and the rows are those of all pairs."""
    from chronoloom.operators import pivots

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 50
    x = [centres[i % 12] + rng.normal(size=8) for i in range(1200)] + [np.zeros(8)] * 2
    rows = [(f"e{i}", f"s{i}", str(i % 3), None if i % 100 == 7 else 0, i, v.tolist()) for i, v in enumerate(x)]
    g = spark.createDataFrame(rows, "entry_id string, sample_id string, label string, channel_id int, ord long, vector array<double>").repartition(3)
    q = g.where("ord % 4 = 0 or ord > 1199").select(F.col("entry_id").alias("query_id"), "sample_id", F.lit(None).cast("int").alias("channel_id"), "vector")
    config = RetrieverConfig(distance, "none", 5)
    told = {}
    search = R.Search(8, R.Scaling(), None, config)
    found = R._ranked(pivots.pruned_neighbours(q.withColumnRenamed("vector", "v"), g.withColumnRenamed("vector", "v"), search, chunk=640, told=told), 5)
    key = lambda df: sorted((r.query_id, r["rank"], r.entry_id, round(r.distance, 7)) for r in df.collect())
    assert key(found) == key(R.knn(q, g, config, by_pivots=False)) and len(key(found)) == 302 * 5
    pairs = told["first"].count() + told["second"].count()
    assert told["blocks"] > 20 and pairs < 0.35 * told["blocks"] * 302


def test_far_off_queries_and_errors_by_pivots(spark):
    g = entries(spark, [(f"e{i}", [1e6 + i, 1e6]) for i in range(30)] + [("far", [-1e9, 5.0])])
    q = ask(spark, (0, 0))
    got = [(r.entry_id, r["rank"]) for r in R.knn(q, g, RetrieverConfig("l2", "none", 3), by_pivots=True).collect()]
    assert sorted(got) == [("e0", 1), ("e1", 2), ("e2", 3)]
    with pytest.raises(Exception, match="differ in length"):
        R.knn(ask(spark, (1,)), g, RetrieverConfig("l2"), by_pivots=True).collect()
    with pytest.raises(Exception, match="not finite"):
        R.knn(ask(spark, (float("nan"), 1)), g, RetrieverConfig("l2"), by_pivots=True).collect()


@pytest.mark.parametrize("width", [20, 200])
def test_leave_one_out_by_blocks(spark, monkeypatch, width):
    """Against brute force, in several blocks of a channel; all probed, some, and a channel of one sample."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(width)
    rows = [(c, i, int(rng.integers(0, 3)), np.cumsum(rng.normal(size=width)).round(3).tolist()) for c, n in ((0, 60), (1, 41), (2, 1)) for i in range(n)]
    rows[5] = (0, 5, rows[5][2], rows[9][3])  # a tie at 0
    prepared = spark.createDataFrame(rows, "channel_id int, idx long, label int, x array<double>").repartition(3)
    for config in (SelectorConfig(nn_eval=0), SelectorConfig(nn_eval=30)):
        got = {r.channel_id: r.score_c for r in S.one_nn_accuracy(prepared, config).collect()}
        for c in (0, 1, 2):
            mine = [r for r in rows if r[0] == c]
            hits = []
            for i in S.probe_ids(len(mine), c, config) or range(len(mine)):
                near = min(((round(float(np.linalg.norm(np.subtract(mine[i][3], r[3]))), 9), r[1], r[2]) for r in mine if r[1] != i), default=(0, 0, None))
                hits.append(near[2] == mine[i][2])
            assert got[c] == pytest.approx(np.mean(hits)), (c, config)


def test_fewer_distances_than_pairs():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(12, 1)) * 9 + np.cumsum(rng.normal(size=(12, 256)), axis=1) * k for k in (0.2, 1, 3) for _ in range(8)])
    apart = ~np.eye(len(x), dtype=bool)
    rows, cols, d, n = S.nearest_by_segments(x, x, apart, np.arange(len(x)))
    all_ = np.where(apart, np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), np.inf)
    assert (rows == np.arange(len(x))).all() and np.allclose(d, all_.min(axis=1)) and (cols == all_.round(9).argmin(axis=1)).all()
    assert n < 0.2 * apart.sum()


def test_a_memory_that_grows(spark, tmp_path):
    """Brought up to date, it is the gallery of a full build, and only what is new or changed is computed."""
    data = series(spark).where("split = 'train'")
    pipe = lambda name, **more: StatRetrieval(RetrieverConfig(), groups=["statistics"], persistence=Persistence(True, root=f"file://{tmp_path}", dataset="toy", experiment=name, **more))
    rows = lambda g: sorted(map(str, g.collect()))
    whole = rows(pipe("whole").memory(data, 1))
    grown = pipe("grown")
    made = []
    first = grown.entries
    grown.entries = lambda s, c: made.append(s.count()) or first(s, c)
    grown.memory(data.where("sample_index < 10"), 1)
    assert rows(grown.memory(data, 1)) == whole and made == [10, 14]
    assert rows(grown.memory(data, 1)) == whole and made[-1] == 0  # nothing is new
    kept = Memory(spark, f"{grown.persistence.folder}/memory_bank")
    assert kept.manifest()["number"] == 2 and kept.entries() == 24
    changed = data.withColumn("label", F.when(F.col("sample_index") == 3, "other").otherwise(F.col("label"))).where("sample_index <> 5")
    assert rows(grown.memory(changed, 1)) == rows(pipe("changed").memory(changed, 1)) and made[-1] == 1 and kept.entries() == 23
    assert rows(grown.memory(data, 1)) == whole and made[-1] == 2  # back again
    assert len(grown.memory(data, 0).collect()) == 24 and made[-1] == 24  # other settings
    assert rows(pipe("grown", force_rebuild=True).memory(data, 1)) == whole


def test_a_killed_build_is_invisible(spark, tmp_path, monkeypatch):
    data = series(spark).where("split = 'train'")
    keep = Persistence(True, root=str(tmp_path), dataset="toy", experiment="x")
    pipe = StatRetrieval(RetrieverConfig(), groups=["0_Mean"], persistence=keep)
    kept = Memory(spark, f"{keep.folder}/memory_bank")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Memory, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            pipe.memory(data, 0)
    assert kept.manifest() is None and kept.entries() == 0
    with pytest.raises(FileNotFoundError):
        kept.gallery()
    assert pipe.memory(data, 0).count() == 24 and len(kept.vacuum()) == 1 and pipe.memory(data, 0).count() == 24
    with pytest.raises(Conflict):
        kept._commit(kept.manifest())
    assert pipe.memory(data.unionByName(data), 0).count() == 24
    with pytest.raises(ValueError, match="repeated"):
        pipe.memory(data.unionByName(data), 1)
    monkeypatch.setattr("chronoloom.plans.memory.MOST_PARTS", 2)
    for n in (5, 9, 24):
        assert pipe.memory(data.where(F.col("sample_index") < n), 0).count() == n
    assert len(kept.manifest()["parts"]) <= 2


def test_no_job_only_counts(spark, tmp_path):
    """Building and evaluating: numbers come from jobs that do something else."""
    data = series(spark)
    seen = []
    real = type(data).count
    type(data).count = lambda self: seen.append(self) or real(self)
    try:
        out = StatRetrieval(RetrieverConfig("l2", "zscore", 1), groups=["0_Mean"], persistence=Persistence(True, root=str(tmp_path), dataset="d", experiment="e")).evaluate(data.where("split = 'train'"), data.where("split = 'test'"), 0)
    finally:
        type(data).count = real
    assert not seen and out.num_train == 24 and out.num_query == 8


def test_a_task_holds_the_best_only(monkeypatch):
    """However many entries a task reads, it holds the best of each query and ``PENDING`` more."""
    import pyarrow as pa

    from chronoloom.operators import retrieval as R
    from chronoloom.schema import RetrieverConfig

    monkeypatch.setattr(R, "PENDING", 200)
    rng = np.random.default_rng(5)
    g, q = rng.normal(size=(20_000, 6)), rng.normal(size=(40, 6))
    ids = [str(i) for i in range(len(g))]
    entries = pa.record_batch([ids, ids, ids, pa.array([0] * len(g), pa.int32()), pa.array(range(len(g)), pa.int64()), pa.array(g.tolist())], names=list("abcdef"))
    asked = pa.table({"q": [f"q{i}" for i in range(40)], "s": ids[:40], "c": pa.array([None] * 40, pa.int32()), "v": pa.array(q.tolist())})
    best = R.Asked(R.Search(6, R.Scaling(), None, RetrieverConfig("l2", "none", 5)), asked)
    most = 0
    for lo in range(0, len(g), 2048):
        best.meet(entries.slice(lo, 2048))
        most = max(most, best.rows)
    assert most <= 40 * 5 + 200
    (out,) = best.result()
    assert out.num_rows == 200
    for i in range(40):
        d = np.linalg.norm(g - q[i], axis=1)
        d[i] = np.inf  # its own sample
        assert [e for e, n in zip(out["entry_id"].to_pylist(), out["query_id"].to_pylist()) if n == f"q{i}"] == [str(j) for j in np.argsort(d)[:5]]


def test_vectors_of_few_dimensions_meet_few_cells(spark, monkeypatch):
    """Most pairs of sample and cell are left out, and the shares of hits are those of all pairs."""
    from chronoloom.operators import pivots, selector
    from chronoloom.operators.retrieval import Scaling, Search
    from chronoloom.schema import RetrieverConfig, SelectorConfig

    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 4)).round(2)
    x[:300] = x[300:600]  # ties
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(6000)], "i long, v array<double>")
    gallery = rows.selectExpr("string(i) as entry_id", "string(i) as sample_id", "string(i % 3) as label", "0 as channel_id", "i as ord", "v")
    told = {}
    asked = gallery.selectExpr("entry_id as query_id", "sample_id", "channel_id", "v")
    pivots.pruned_neighbours(asked, gallery, Search(4, Scaling(), None, RetrieverConfig("l2", "none", 1)), chunk=4_000_000, told=told)
    assert told["blocks"] >= 12 and told["first"].count() + told["second"].count() < 0.6 * told["blocks"] * 6000
    prepared = rows.selectExpr("int(i % 2) as channel_id", "i as idx", "int(i % 3) as label", "v as x")
    config = SelectorConfig(top_k=3, nn_eval=0)
    monkeypatch.setattr(selector, "CELLS_FROM", 100)
    cells = sorted(selector.one_nn_accuracy(prepared, config).collect())
    monkeypatch.setattr(selector, "CELLS_FROM", 10**9)
    assert cells == sorted(selector.one_nn_accuracy(prepared, config).collect())
