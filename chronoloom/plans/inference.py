"""Inference as Spark ML stages: query building, decomposition, representation, retrieval, reasoning, aggregation, parsing.

Each stage is a ``Transformer`` (retrieval an ``Estimator``) with ``Params``, checks the columns that it needs, and can be replaced by any other with the
same columns. A configuration names the stages; the pipeline that is fit is saved and loaded with its memory as Spark ML models are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import statistic_view
from ..operators import gallery as G
from ..operators.retrieval import knn
from ..schema import Distance, Normalization, RetrieverConfig, TaskSpec, TaskType, non_empty
from .pipelines import aggregate_channels, vote_by_channel
from .registry import PIPELINES, TASKS, ConfigError, FactoryError, Registry
from .tasks import build_queries, parse_output
from .telemetry import EventLog

STAGES: Registry = Registry("stage")


class Stage(Params):
    """What the stages share: the columns that they need are there, or it is said which stage misses which."""

    needs: tuple[str, ...] = ()
    gives: tuple[str, ...] = ()

    def checked(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in self.needs if c not in df.columns]:
            raise ConfigError(f"{type(self).__name__} needs the columns {missing}")
        return df

    def given(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in self.gives if c not in df.columns]:
            raise ConfigError(f"{type(self).__name__} doesn't give the columns {missing}")
        return df


class Step(Stage, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer of one frame. Subclasses give ``act``."""

    def act(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.given(self.act(self.checked(dataset)))


class _Task(Params):
    taskType = Param(Params._dummy(), "taskType", "type of the task", TypeConverters.toString)
    labelSpace = Param(Params._dummy(), "labelSpace", "labels that a prediction may have; none for any", TypeConverters.toListString)

    def spec(self) -> TaskSpec:
        return TaskSpec(self.getOrDefault(self.taskType), tuple(self.getOrDefault(self.labelSpace)))


@STAGES.register("query")
class QueryBuilder(Step, _Task):
    """Queries of a series table: query_id, and what describes the sample."""

    needs = ("sample_id", "split", "channel_id", "values", "label")
    gives = ("query_id", "n_channels", "sequence_length", "data_mode")

    @keyword_only
    def __init__(self, *, taskType="classification", labelSpace=()):
        super().__init__()
        self._setDefault(taskType="classification", labelSpace=[])
        self._set(taskType=str(TaskType(taskType)), labelSpace=list(labelSpace))

    def act(self, df: DataFrame) -> DataFrame:
        return build_queries(df, self.spec())


@STAGES.register("decompose")
class ChannelDecomposer(Step):
    """The rows of the selected channels. Given with the call (``params={stage.channelIds: [...]}``) they stand before those of the
    configuration; none selected, or one that no row has where the series are known to, is an error."""

    needs = ("query_id", "channel_id")
    gives = ("query_id", "channel_id")
    channelIds = Param(Params._dummy(), "channelIds", "channels that are used", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, channelIds=()):
        super().__init__()
        self._setDefault(channelIds=[])
        self._set(channelIds=list(channelIds))

    def act(self, df: DataFrame) -> DataFrame:
        if not (chosen := self.getOrDefault(self.channelIds)):
            raise ConfigError("no channel is selected")
        return df.where(F.col("channel_id").isin(chosen))


@STAGES.register("statistic")
class StatisticRepresentation(Step):
    """Features of each channel as a map; a series without any is an error."""

    needs = ("sample_id", "values")
    gives = ("statistic_view",)
    groups = Param(Params._dummy(), "groups", "groups or names of features; none for all", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, groups=()):
        super().__init__()
        self._setDefault(groups=[])
        self._set(groups=list(groups))

    def act(self, df: DataFrame) -> DataFrame:
        rows = statistic_view(df, self.getOrDefault(self.groups) or None)
        failed = F.raise_error(F.concat(F.lit("missing statistics: "), F.col("sample_id"))).cast("map<string,double>")
        return rows.withColumn("statistic_view", F.coalesce("statistic_view", failed)).drop("error")


class _Retrieval(Stage):
    distance = Param(Params._dummy(), "distance", "cosine, l2 or weighted_l2", TypeConverters.toString)
    normalize = Param(Params._dummy(), "normalize", "none, zscore, robust or log1p_robust", TypeConverters.toString)
    topK = Param(Params._dummy(), "topK", "neighbours of each query and channel", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "of the dimensions, for weighted_l2", TypeConverters.toListFloat)

    def config(self) -> RetrieverConfig:
        get = self.getOrDefault
        return RetrieverConfig(get(self.distance), get(self.normalize), get(self.topK), tuple(get(self.weights)) or None, by_channel=True)


@STAGES.register("stat_knn")
class StatRetriever(_Retrieval, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fit: a memory of the training samples' features."""

    needs = ("sample_id", "channel_id", "label", "sample_index", "split", "statistic_view")

    @keyword_only
    def __init__(self, *, distance="cosine", normalize="zscore", topK=3, weights=()):
        super().__init__()
        self._setDefault(distance="cosine", normalize="zscore", topK=3, weights=[])
        self._set(distance=str(Distance(distance)), normalize=str(Normalization(normalize)), topK=topK, weights=list(weights))
        self.config()

    def _fit(self, dataset: DataFrame) -> StatRetrieverModel:
        model = StatRetrieverModel(G.build_gallery(self.checked(dataset)))
        model._resetUid(self.uid)
        return self._copyValues(model)


class StatRetrieverModel(_Retrieval, Model, MLReadable, MLWritable):
    """Neighbours of each query's channels in the memory, of the same channel. Scalings are of one channel's entries."""

    needs = ("query_id", "sample_id", "channel_id", "statistic_view")
    gives = ("query_id", "channel_id", "rank", "label", "distance")

    def __init__(self, gallery: DataFrame | None = None):
        super().__init__()
        self._setDefault(distance="cosine", normalize="zscore", topK=3, weights=[])
        self.gallery = gallery

    def _transform(self, dataset: DataFrame) -> DataFrame:
        vectors, order = G.gallery_vectors(self.gallery)
        asked, _ = G.gallery_vectors(self.checked(dataset), order)
        out = None
        for c in [r[0] for r in asked.select("channel_id").distinct().orderBy("channel_id").collect()]:
            mine = asked.where(F.col("channel_id") == c).select("query_id", "sample_id", "channel_id", "vector")
            near = knn(mine, vectors.where(F.col("channel_id") == c), self.config())
            out = near if out is None else out.unionByName(near)
        if out is None:
            out = knn(asked.select("query_id", "sample_id", "channel_id", "vector"), vectors, self.config())
        return self.given(out)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: StatRetrieverModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        G.save_gallery(self.model.gallery, f"{path}/gallery")


class _ModelReader(MLReader):
    def load(self, path: str) -> StatRetrieverModel:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = StatRetrieverModel(G.load_gallery(self.sparkSession, f"{path}/gallery"))
        model._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(model, told)
        return model


@STAGES.register("majority")
class MajorityReasoner(Step):
    """A label for each query and channel, by its neighbours' majority."""

    needs = ("query_id", "channel_id", "label", "distance")
    gives = ("query_id", "channel_id", "label", "mean_distance")

    def act(self, df: DataFrame) -> DataFrame:
        return vote_by_channel(df)


@STAGES.register("weighted_vote")
class WeightedAggregator(Step):
    """A label for each query over its channels, the nearer the more it weighs; ``raw_output`` is a JSON object."""

    needs = ("query_id", "channel_id", "label", "mean_distance")
    gives = ("query_id", "raw_output", "confidence")

    def act(self, df: DataFrame) -> DataFrame:
        return aggregate_channels(df).select("query_id", F.to_json(F.struct("prediction")).alias("raw_output"), "confidence")


@STAGES.register("parse")
class OutputParser(Step, _Task):
    """Predictions of raw outputs: sample_id, task_type, prediction (of the label space), confidence."""

    needs = ("query_id", "raw_output", "confidence")
    gives = ("sample_id", "task_type", "prediction", "confidence")

    @keyword_only
    def __init__(self, *, taskType="classification", labelSpace=()):
        super().__init__()
        self._setDefault(taskType="classification", labelSpace=[])
        self._set(taskType=str(TaskType(taskType)), labelSpace=list(labelSpace))

    def act(self, df: DataFrame) -> DataFrame:
        kind = self.getOrDefault(self.taskType)
        sample = F.substring("query_id", F.lit(len(kind) + 2), F.length("query_id"))
        return df.select(sample.alias("sample_id"), F.lit(kind).alias("task_type"), parse_output("raw_output", self.spec()).alias("prediction"), "confidence")


#: The stages of an inference, in their order, and what stands for one that isn't named.
ROLES = {"query": "query", "decomposer": "decompose", "representation": "statistic", "retriever": "stat_knn", "reasoner": "majority", "aggregator": "weighted_vote", "parser": "parse"}


class InferencePipeline:
    """Named stages from a configuration: ``{"name": ..., "task": {...}, "enabled": ..., "stages": {role: {"name": ..., params}}}``. Roles that aren't named
    get their usual stage; an unknown role or stage is an error, as is a disabled pipeline that is run. Hooks may change what goes in and what comes out;
    a log gets start, end and error events."""

    required = ("retriever",)

    def __init__(self, name: str, stages: Mapping[str, Stage], *, enabled: bool = True, before: Iterable[Callable] = (), after: Iterable[Callable] = (), log: EventLog | None = None):
        self.name, self.enabled, self.stages = non_empty(name, "name"), enabled, dict(stages)
        self.before, self.after, self.log = list(before), list(after), log
        if missing := [r for r in self.required if r not in self.stages]:
            raise ConfigError(f"{name} has no {missing}")
        self.model: PipelineModel | None = None

    @classmethod
    def from_config(cls, config: Mapping[str, Any], **more: Any) -> InferencePipeline:
        told = dict(config.get("stages") or {})
        if unknown := sorted(set(told) - set(ROLES)):
            raise ConfigError(f"unknown roles {unknown}; there are {list(ROLES)}")
        spec = TASKS.build({"name": "task", "params": dict(config.get("task") or {"task_type": "classification"})})
        task = {"taskType": str(spec.task_type), "labelSpace": list(spec.label_space)}
        stages = {}
        for role, usual in ROLES.items():
            mine = told.get(role) or {}
            mine = {"name": mine} if isinstance(mine, str) else dict(mine)
            if mine.get("enabled", True) is False and role in cls.required:
                raise ConfigError(f"{role} can't be left out")
            if mine.pop("enabled", True) is False:
                continue
            mine = {"name": usual} | mine
            if mine["name"] in ("query", "parse"):
                mine = task | mine
            stages[role] = STAGES.build(mine)
            if not isinstance(stages[role], Transformer | Estimator):
                raise FactoryError(f"{role} must be a transformer or an estimator")
        return cls(config.get("name") or "inference", stages, enabled=bool(config.get("enabled", True)), **more)

    def component(self, role: str) -> Stage:
        if role not in self.stages:
            raise KeyError(f"no {role!r}; there are {list(self.stages)}")
        return self.stages[role]

    def _told(self, what: str, go: Callable[[], Any]) -> Any:
        if not self.enabled:
            raise RuntimeError(f"{self.name} is disabled")
        if self.log is None:
            return go()
        with self.log.span("pipeline", f"{self.name}.{what}"):
            return go()

    def fit(self, train: DataFrame) -> InferencePipeline:
        def go() -> None:
            self.model = Pipeline(stages=list(self.stages.values())).fit(train)

        self._told("fit", go)
        return self

    def run(self, samples: DataFrame, *, channel_ids: list[int] | None = None) -> DataFrame:
        """Predictions of the samples, as one plan. ``channel_ids`` stand before the configured ones."""
        return self.run_stages(samples, channel_ids=channel_ids)[0]

    def run_stages(self, samples: DataFrame, *, channel_ids: list[int] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
        """The predictions, and what each stage gave, by role."""
        if self.model is None:
            raise RuntimeError(f"{self.name} isn't fit")
        results: dict[str, DataFrame] = {}

        def go() -> DataFrame:
            out = samples
            for hook in self.before:
                out = hook(out)
            for role, stage in zip(self.stages, self.model.stages, strict=True):
                params = {stage.getParam("channelIds"): channel_ids} if channel_ids is not None and stage.hasParam("channelIds") else None
                out = results[role] = stage.transform(out, params) if params else stage.transform(out)
            for hook in self.after:
                out = hook(out)
            return out

        return self._told("run", go), results

    def run_batch(self, batches: Iterable[DataFrame], *, keep_going: bool = False) -> list[DataFrame | None]:
        """The predictions of each batch. An error ends it, or with ``keep_going`` is logged and gives None."""
        out: list[DataFrame | None] = []
        for i, samples in enumerate(batches):
            try:
                out.append(self.run(samples))
            except Exception as e:
                if self.log:
                    self.log.write("batch_error", {"name": self.name, "index": i, "error": str(e)})
                if not keep_going:
                    raise
                out.append(None)
            else:
                if self.log:
                    self.log.write("batch_item", {"name": self.name, "index": i})
        return out

    def save(self, path: str) -> None:
        if self.model is None:
            raise RuntimeError(f"{self.name} isn't fit")
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> InferencePipeline:
        """This pipeline with the stages that were saved: as many, of the same kinds."""
        model = PipelineModel.load(path)
        kinds = [StatRetrieverModel if isinstance(s, StatRetriever) else type(s) for s in self.stages.values()]
        if [type(s) for s in model.stages] != kinds:
            raise ConfigError(f"{path} has other stages: {[type(s).__name__ for s in model.stages]}")
        self.model = model
        return self


TASKS.register("task", TaskSpec)
PIPELINES.register("typed_inference", InferencePipeline)
