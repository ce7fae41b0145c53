"""Typed stages: built from a configuration, replaced, checked, saved and loaded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions.features import representation_records
from chronoloom.plans.inference import STAGES, InferencePipeline, Step
from chronoloom.plans.registry import PIPELINES, TASKS, ConfigError, FactoryError
from chronoloom.plans.telemetry import EventLog
from chronoloom.schema import TaskSpec
from chronoloom.sources.files import read_jsonl

CONFIG = {
    "name": "toy",
    "task": {"task_type": "classification", "label_space": ["0", "1"]},
    "stages": {"decomposer": {"name": "decompose", "channelIds": [0, 1]}, "representation": {"name": "statistic", "groups": ["statistics"]}, "retriever": {"name": "stat_knn", "distance": "l2", "topK": 3}},
}


@pytest.fixture(scope="module")
def halves(spark):
    rng = np.random.default_rng(7)
    rows = [(f"{s}_{i}", s, i, c, [float(x) for x in rng.normal(size=20) + (6 * (i % 2) if c else 0)], str(i % 2)) for s, n in (("train", 16), ("test", 6)) for i in range(n) for c in range(3)]
    data = spark.createDataFrame(rows, "sample_id string, split string, sample_index long, channel_id int, values array<double>, label string")
    return data.where("split = 'train'"), data.where("split = 'test'")


def told(df):
    return sorted((r.sample_id, r.task_type, r.prediction, round(r.confidence, 9)) for r in df.collect())


def test_from_a_dictionary_saved_and_loaded(spark, tmp_path, halves):
    train, test = halves
    log = EventLog(tmp_path / "events.jsonl")
    pipe = InferencePipeline.from_config(CONFIG, log=log).fit(train)
    found, stages = pipe.run_stages(test, channel_ids=[1])
    got = told(found)
    assert [(i, p) for i, _, p, _ in got] == [(f"test_{i}", str(i % 2)) for i in range(6)]
    assert list(stages) == ["query", "decomposer", "representation", "retriever", "reasoner", "aggregator", "parser"]
    assert {r.channel_id for r in stages["retriever"].collect()} == {1} and {r.channel_id for r in pipe.run_stages(test)[1]["reasoner"].collect()} == {0, 1}
    pipe.save(f"file://{tmp_path}/model")
    again = InferencePipeline.from_config(CONFIG).load(f"file://{tmp_path}/model")
    assert told(again.run(test, channel_ids=[1])) == got and told(again.run(test)) == told(pipe.run(test))
    assert again.model.stages[3].config() == pipe.component("retriever").config()
    assert [e["event_type"] for e in read_jsonl(tmp_path / "events.jsonl")][:2] == ["pipeline_start", "pipeline_end"]
    with pytest.raises(ConfigError, match="other stages"):
        InferencePipeline.from_config(CONFIG | {"stages": CONFIG["stages"] | {"parser": {"enabled": False}}}).load(f"file://{tmp_path}/model")


def test_a_stage_is_replaced(spark, halves):
    @STAGES.register("always_one", replace=True)
    class AlwaysOne(Step):
        needs = ("query_id", "label")
        gives = ("query_id", "raw_output", "confidence")

        def act(self, df):
            return df.select("query_id", F.lit("1").alias("raw_output"), F.lit(0.5).alias("confidence")).distinct()

    train, test = halves
    pipe = InferencePipeline.from_config(CONFIG | {"stages": CONFIG["stages"] | {"aggregator": "always_one"}}).fit(train)
    assert {(p, c) for _, _, p, c in told(pipe.run(test))} == {("1", 0.5)}


def test_hooks_batches_and_errors(spark, tmp_path, halves):
    train, test = halves
    log = EventLog(tmp_path / "events.jsonl")
    pipe = InferencePipeline.from_config(CONFIG, log=log, before=[lambda d: d.where("sample_index < 2")], after=[lambda d: d.withColumn("seen", F.lit(True))]).fit(train)
    assert [r.seen for r in pipe.run(test).collect()] == [True, True]
    out = pipe.run_batch([test, test.drop("values"), test], keep_going=True)
    assert out[1] is None and out[0].count() == out[2].count() == 2
    assert [e["event_type"] for e in read_jsonl(tmp_path / "events.jsonl") if "batch" in e["event_type"]] == ["batch_item", "batch_error", "batch_item"]
    with pytest.raises(ConfigError, match="needs the columns"):
        pipe.run_batch([test.drop("values")])
    with pytest.raises(ConfigError, match="no channel"):
        pipe.run(test, channel_ids=[])
    with pytest.raises(RuntimeError, match="disabled"):
        InferencePipeline.from_config(CONFIG | {"enabled": False}).fit(train)
    with pytest.raises(RuntimeError, match="isn't fit"):
        InferencePipeline.from_config(CONFIG).run(test)
    with pytest.raises(Exception, match="label space"):
        InferencePipeline.from_config(CONFIG | {"task": {"task_type": "classification", "label_space": ["x"]}}).fit(train).run(test).collect()


def test_configurations_that_can_not_be_used():
    stages = CONFIG["stages"]
    for bad, kind in (
        ({"stages": stages | {"extra": "query"}}, ConfigError),
        ({"stages": stages | {"retriever": {"enabled": False}}}, ConfigError),
        ({"stages": stages | {"retriever": {"name": "nothing"}}}, KeyError),
        ({"stages": stages | {"retriever": {"name": "stat_knn", "distance": "far"}}}, FactoryError),
        ({"stages": stages | {"reasoner": {"name": "majority", "more": 1}}}, FactoryError),
        ({"task": {"task_type": "nothing"}}, FactoryError),
    ):
        with pytest.raises(kind):
            InferencePipeline.from_config(CONFIG | bad)
    assert TASKS.build({"name": "task", "task_type": "prediction"}) == TaskSpec("prediction")
    assert PIPELINES.get("typed_inference") is InferencePipeline


def test_records(spark, tmp_path, halves):
    rows = halves[0].where("sample_index = 0 and channel_id = 1")
    empty = rows.withColumns({"values": F.lit(None).cast("array<double>"), "sample_id": F.lit("none")})
    out = representation_records(rows.unionByName(empty), ["0_Mean", "0_Max"], names="label", save_path=f"file://{tmp_path}/records", metadata={"by": "us"}).orderBy("sample_id").collect()
    assert out[0].record is None and out[1].record.rep_type == "statistic" and set(out[1].record.payload) == {"0_Mean", "0_Max"}
    assert out[1].record.metadata == {"sample_id": "0", "channel_id": "1", "feature_groups": "0_Mean,0_Max", "num_features": "2", "by": "us"}
