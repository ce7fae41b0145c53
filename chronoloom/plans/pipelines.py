"""Composite plans: memory building and reuse, split evaluation, single predictions, and inference over channels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.features import statistic_view
from ..operators import gallery as G
from ..operators.metrics import batch_metrics, query_metrics
from ..operators.retrieval import knn, top_predictions
from ..operators.series import pick_channel
from ..schema import RetrieverConfig, TaskType
from ..sources.files import normalize_name
from ..sources.store import Store
from .memory import Memory
from .registry import PIPELINES, REPRESENTATIONS, RETRIEVERS
from .telemetry import EventLog, MetricTracker, NullTracker

#: Names within a run's folder.
ARTIFACTS = {"gallery": "memory_bank", "index": "index_stat", "channels": "selected_channels.json", "meta": "build_meta.json", "logs": "logs"}


@dataclass(frozen=True)
class Persistence:
    """Where a memory is kept, in any store: ``<root>/memory/<dataset>_<experiment>``."""

    enabled: bool = False
    reuse: bool = True
    force_rebuild: bool = False
    root: str = "outputs"
    dataset: str | None = None
    experiment: str | None = None

    def __post_init__(self) -> None:
        if self.enabled and not (self.dataset and self.experiment):
            raise ValueError("persistence needs a dataset and an experiment name")

    @property
    def folder(self) -> str:
        return f"{str(self.root).rstrip('/')}/memory/{normalize_name(self.dataset or '')}_{normalize_name(self.experiment or '')}"


@dataclass
class Evaluation:
    """Scores of a split, and the rows they come from."""

    metrics: dict[str, float | None]
    per_query: DataFrame
    neighbours: DataFrame
    num_train: int
    num_query: int
    top_k: int
    channel_id: int
    task_type: str
    artifacts: dict[str, str] = field(default_factory=dict)

    def summary(self) -> dict:
        keys = ("metrics", "num_train", "num_query", "top_k", "channel_id", "task_type", "artifacts")
        return {k: getattr(self, k) for k in keys}


class StatRetrieval:
    """Features of one channel, a memory of the training samples, and nearest neighbours in it. Queries are compared
    on the same channel as the memory."""

    def __init__(self, retriever: RetrieverConfig, *, groups: list[str] | None = None, task_type: str = "classification", persistence: Persistence | None = None, log: EventLog | None = None, tracker: MetricTracker | NullTracker | None = None):
        self.retriever, self.groups, self.tracker = retriever, groups, tracker or NullTracker()
        self.task_type = str(TaskType(task_type))
        self.persistence = persistence or Persistence()
        self.log = log

    def features(self, series: DataFrame, channel_id: int) -> DataFrame:
        rows = statistic_view(pick_channel(series, channel_id), self.groups)
        checked = F.when(F.col("statistic_view").isNull(), F.raise_error(F.concat(F.lit("missing statistics: "), F.col("sample_id"))).cast("map<string,double>"))
        return rows.withColumn("statistic_view", checked.otherwise(F.col("statistic_view"))).drop("error")

    def settings(self, channel_id: int) -> dict:
        return {"task_type": self.task_type, "channel_id": channel_id, "feature_groups": self.groups, "dataset": self.persistence.dataset}

    def entries(self, series: DataFrame, channel_id: int) -> DataFrame:
        """The gallery's rows of these samples, and ``source`` if the series has it."""
        rows = self.features(series, channel_id)
        made = G.build_gallery(rows, task_type=self.task_type, dataset=self.persistence.dataset)
        if "source" not in series.columns:
            return made
        kept = rows.select(F.concat("sample_id", F.lit("__ch"), F.col("channel_id").cast("string")).alias("entry_id"), "source")
        return made.join(kept, "entry_id")

    def memory(self, train: DataFrame, channel_id: int = 0) -> DataFrame:
        """The gallery of the training samples. A kept one is brought up to date: features are computed of samples that are new or changed."""
        keep = self.persistence
        if not keep.enabled:
            return self.entries(train, channel_id)
        folder, settings = Store(train.sparkSession, keep.folder), self.settings(channel_id)
        kept = Memory(train.sparkSession, str(folder / ARTIFACTS["gallery"]))
        before = kept.manifest()
        gallery = kept.update(pick_channel(train, channel_id), lambda s: self.entries(s, channel_id), settings, reuse=keep.reuse and not keep.force_rebuild)
        now = kept.manifest()
        if before is None or before["number"] != now["number"]:
            G.save_index(gallery, str(folder / ARTIFACTS["index"]))
            (folder / ARTIFACTS["channels"]).write_json({"selected_channel_ids": [channel_id]})
            (folder / ARTIFACTS["meta"]).write_json(settings | {"number": now["number"], "entries": kept.entries()})
        return gallery

    def neighbours(self, gallery: DataFrame, samples: DataFrame, channel_id: int = 0) -> DataFrame:
        vectors, order = G.gallery_vectors(gallery)
        asked = self.features(samples, channel_id).withColumn("query_id", F.concat(F.lit("query__"), "sample_id"))
        asked, _ = G.gallery_vectors(asked, order)
        config = RetrieverConfig(self.retriever.distance, self.retriever.normalize, self.retriever.top_k, self.retriever.weights, self.retriever.enabled, by_channel=False)
        return knn(asked, vectors, config)

    def evaluate(self, train: DataFrame, test: DataFrame, channel_id: int = 0) -> Evaluation:
        """Scores of the test samples against a memory of the training samples, in one plan for all queries."""
        seen = Observation()
        gallery = self.memory(train, channel_id).observe(seen, F.count(F.lit(1)).alias("entries"))
        near = self.neighbours(gallery, test, channel_id)
        truth = pick_channel(test, channel_id).select(F.concat(F.lit("query__"), "sample_id").alias("query_id"), "label")
        per = query_metrics(truth, near, self.retriever.top_k)
        row = batch_metrics(per).first()
        keep = self.persistence
        out = Evaluation(
            {"top_k_accuracy": row.top_k_accuracy, "precision_at_k": row.precision_at_k}, per, near, seen.get["entries"], row.num_query, self.retriever.top_k, channel_id, self.task_type,
            {k: f"{keep.folder}/{v}" for k, v in ARTIFACTS.items()} if keep.enabled else {},
        )
        if self.log:
            self.log.write("evaluation", out.summary())
        told = {k: v for k, v in out.metrics.items() if v is not None} | {"entries": float(out.num_train), "queries": float(out.num_query)}
        self.tracker.log(told, stage="evaluation", metadata={"top_k": out.top_k, "channel_id": channel_id, "task_type": self.task_type})
        return out

    def predict(self, gallery: DataFrame, samples: DataFrame, channel_id: int = 0) -> DataFrame:
        """(sample_id, task_type, prediction, confidence) of the nearest neighbour."""
        best = top_predictions(self.neighbours(gallery, samples, channel_id))
        return best.select(F.regexp_replace("query_id", "^query__", "").alias("sample_id"), F.lit(self.task_type).alias("task_type"), "prediction", "confidence")


def vote_by_channel(neighbours: DataFrame) -> DataFrame:
    """(query_id, channel_id, label, mean_distance): the majority label of each channel's neighbours; ties by the smaller
    sum of distances, then the smaller label."""
    votes = neighbours.groupBy("query_id", "channel_id", "label").agg(F.count("*").alias("votes"), F.round(F.sum("distance"), 9).alias("total"))
    means = neighbours.groupBy("query_id", "channel_id").agg(F.avg("distance").alias("mean_distance"))
    w = Window.partitionBy("query_id", "channel_id").orderBy(F.desc("votes"), "total", "label")
    best = votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", "channel_id", "label")
    return best.join(means, ["query_id", "channel_id"])


def aggregate_channels(votes: DataFrame) -> DataFrame:
    """(query_id, prediction, confidence): each channel's vote weighs 1 / (1 + its mean distance); the confidence is the
    winner's share. Ties by the smaller label."""
    weights = votes.groupBy("query_id", "label").agg(F.sum(1 / (1 + F.greatest(F.lit(0.0), "mean_distance"))).alias("w"))
    total = Window.partitionBy("query_id")
    ranked = weights.withColumn("confidence", F.col("w") / F.sum("w").over(total)).withColumn("r", F.row_number().over(total.orderBy(F.desc(F.round("w", 9)), "label")))
    return ranked.where("r = 1").select("query_id", F.col("label").alias("prediction"), "confidence")


class Inference:
    """Retrieval for each selected channel, a vote by channel and one over channels."""

    def __init__(self, channel_ids: list[int], retriever: RetrieverConfig | None = None, *, groups: list[str] | None = None, task_type: str = "classification"):
        if not channel_ids:
            raise ValueError("no channel is selected")
        self.channel_ids = sorted(set(channel_ids))
        self.retriever = retriever or RetrieverConfig(top_k=3)
        self.groups, self.task_type = groups, task_type

    def run(self, train: DataFrame, samples: DataFrame) -> dict[str, DataFrame]:
        """``neighbours``, ``votes`` and ``predictions``, as plans that share nothing but their inputs."""
        stat = StatRetrieval(self.retriever, groups=self.groups, task_type=self.task_type)
        found = None
        for c in self.channel_ids:
            near = stat.neighbours(stat.memory(train, c), samples, c).withColumn("channel_id", F.lit(c))
            found = near if found is None else found.unionByName(near)
        votes = vote_by_channel(found)
        return {"neighbours": found, "votes": votes, "predictions": aggregate_channels(votes)}


RETRIEVERS.register("stat_knn", RetrieverConfig)
REPRESENTATIONS.register("statistic", statistic_view)
PIPELINES.register("stat_feature_retrieval", StatRetrieval)
PIPELINES.register("inference", Inference)
