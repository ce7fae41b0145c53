"""Arrays, payloads, selections, agents and chains."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions.vectors import pair_score, payload_vector
from chronoloom.operators.selector import load_selection, save_selection
from chronoloom.plans.agents import Agent, ChannelSelectorAgent, Chain, set_seed
from chronoloom.plans.registry import AGENTS
from chronoloom.plans.telemetry import EventLog
from chronoloom.schema import SelectorConfig
from chronoloom.sources.arrays import ensure_channels, series_from_arrays
from chronoloom.sources.files import read_jsonl, write_json
from chronoloom.sources.registry import load_anomaly_placeholder


def test_arrays(spark):
    out = series_from_arrays(spark, np.arange(8).reshape(2, 2, 2), [0, 1], split="train").orderBy("sample_index", "channel_id").collect()
    assert [(r.sample_id, r.channel_id, list(r["values"]), r.label) for r in out] == [("train_0", 0, [0, 2], "0"), ("train_0", 1, [1, 3], "0"), ("train_1", 0, [4, 6], "1"), ("train_1", 1, [5, 7], "1")]
    assert series_from_arrays(spark, [[1.0, 2.0], [3.0]], None, split="test").count() == 2
    for x, y in ((np.zeros((2, 2)), [1]), ([np.zeros((1, 1, 1))], [1]), ([[]], [1])):
        with pytest.raises(ValueError):
            series_from_arrays(spark, x, y, split="train")
    assert ensure_channels(np.zeros((2, 3))).shape == (2, 3, 1)
    with pytest.raises(ValueError):
        ensure_channels(np.zeros(3))
    with pytest.raises(NotImplementedError):
        load_anomaly_placeholder()


def test_payloads(spark):
    m = F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), F.lit(2.0))
    none = F.lit(None).cast("array<double>")
    v, w = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    r = spark.range(1).select(
        payload_vector(["a", "b"], vector=none, features=m).alias("x"), payload_vector(["a", "b"], vector=v, features=m).alias("y"), payload_vector(["a", "b"], kept_features=F.lit(None).cast("map<string,double>"), kept_vector=w).alias("z"),
        pair_score(v, w, "cosine").alias("c"), pair_score(v, w, "l2").alias("l"), pair_score(v, w, "weighted_l2", F.array(F.lit(3.0), F.lit(6.0))).alias("wl"),
    ).first()
    assert (r.x, r.y, r.z) == ([2, 1], [1, 0], [0, 1]) and (r.c, r.wl) == (1, 3) and r.l == pytest.approx(2**0.5)
    for bad in (lambda: pair_score(v, w, "weighted_l2"), lambda: pair_score(v, w, "l9"), lambda: payload_vector(["a"])):
        with pytest.raises(ValueError):
            bad()


def test_agents(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 16, 2))
    x[::2, :, 1] += np.sin(np.arange(16)) * 9
    train = series_from_arrays(spark, x, [i % 2 for i in range(12)], split="train")
    log = EventLog(tmp_path / "e.jsonl")
    agent = AGENTS.build({"name": "channel_selector", "config": SelectorConfig()}, log=log)
    assert isinstance(agent, ChannelSelectorAgent)
    out = agent.run(train)
    told = save_selection(out, str(tmp_path / "s.json"), metadata={"dataset": "toy"})
    assert load_selection(str(tmp_path / "s.json")) == told and told["selected_channel_ids"] == [1]
    write_json(tmp_path / "bad.json", {"scores": {}})
    with pytest.raises(ValueError):
        load_selection(str(tmp_path / "bad.json"))

    class Add(Agent):
        def act(self, value):
            return value + 1

    add = Add("add", before=[lambda v: v * 10], after=[str])
    assert add.run(2) == "21"
    with pytest.raises(RuntimeError):
        Add("add", enabled=False).run(1)
    chain = Chain("chain", {"one": Add("one").run, "two": Add("two").run}, log=log)
    assert chain.run(1) == (3, {"one": 2, "two": 3}) and chain.run_batch([1, 5]) == [3, 7]
    with pytest.raises(TypeError):
        chain.run_batch([1, "x"])
    kinds = [e["event_type"] for e in read_jsonl(tmp_path / "e.jsonl")]
    assert kinds[:2] == ["agent_start", "agent_end"] and kinds[-1] == "pipeline_error"
    with pytest.raises(ValueError):
        Chain("none", {})
    set_seed(4)
    a = random.random()
    set_seed(4)
    assert random.random() == a


def test_checks_of_values(spark, tmp_path):
    import numpy as np

    from chronoloom.schema import existing_path, non_empty_items, vector_1d

    assert vector_1d(np.arange(3), "x") == [0, 1, 2] and vector_1d((1, 2.5), "x") == [1, 2.5]
    assert non_empty_items({3}, "x") == [3] and existing_path(spark, tmp_path, "x") == str(tmp_path)
    for bad in (lambda: vector_1d([[1]], "x"), lambda: vector_1d([], "x"), lambda: vector_1d(np.ones((2, 2)), "x"), lambda: vector_1d("12", "x"), lambda: non_empty_items("ab", "x"), lambda: non_empty_items([], "x"), lambda: non_empty_items(3, "x")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(FileNotFoundError):
        existing_path(spark, tmp_path / "none", "x")


def test_selector_needs_equal_channels(spark):
    from chronoloom.operators.selector import select_channels
    from chronoloom.schema import SelectorConfig

    rows = [(f"s{i}", i, c, [1.0, 2.0, float(i)], str(i % 2)) for i in range(4) for c in range(2) if (i, c) != (3, 1)]
    series = spark.createDataFrame(rows, "sample_id string, sample_index long, channel_id int, values array<double>, label string")
    with pytest.raises(ValueError, match="differ in their channels"):
        select_channels(series, SelectorConfig())


def test_queries_and_batches_tell_all(spark, tmp_path):
    from datetime import datetime

    from chronoloom.functions.features import batch_features
    from chronoloom.plans.tasks import build_queries
    from chronoloom.plans.telemetry import local_now
    from chronoloom.schema import TaskSpec

    rows = [("a", "train", 0, c, [1.0, 2.0, 4.0], None) for c in (1, 0)] + [("b", "train", 1, 0, [], "1")]
    series = spark.createDataFrame(rows, "sample_id string, split string, sample_index long, channel_id int, values array<double>, label string")
    a = build_queries(series.where("sample_id = 'a'"), TaskSpec("classification")).first()
    assert a.channel_ids == [0, 1] and a.metadata == {"task_type": "classification", "sequence_length": "3", "n_channels": "2", "data_mode": "multivariate", "has_ground_truth": "false"}
    out = batch_features(series, ["0_Mean"], save_path=f"file://{tmp_path}/features").orderBy("name", "channel_id").collect()
    assert [(r.name, r.channel_id, r.error) for r in out] == [("a", 0, None), ("a", 1, None), ("b", 0, "empty series")] and out[2].mean is None
    assert datetime.fromisoformat(local_now()).utcoffset() is not None
    with pytest.raises(Exception, match="no name"):
        batch_features(series, ["0_Mean"], names="label").collect()
