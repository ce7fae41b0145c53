"""Command line: load a dataset, evaluate retrieval on it, print and keep the scores."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import functions as F

from ..schema import Distance, Normalization, RetrieverConfig
from ..session import session, ship
from ..sources.files import write_json
from ..sources.registry import get_loader, list_loaders
from .pipelines import Persistence, StatRetrieval

#: Fixed names: the folders under ``datasets`` of the working folder where loaders look if none is given.
BASE_DIRS = {"ucr2015": "UCR_TS_Archive_2015", "uea": "Multivariate_ts"}
#: Distance, normalization and k of the default grid.
GRID = (("cosine", "zscore", 1), ("cosine", "zscore", 5), ("l2", "robust", 1), ("l2", "robust", 5))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--dataset-loader", "--loader", dest="loader", default="ucr2015", choices=list_loaders())
    p.add_argument("--dataset", default="ECG200")
    p.add_argument("--base-dir", help="default: datasets/<folder of the loader>")
    p.add_argument("--max-samples-per-split", type=int)
    p.add_argument("--distance", default="cosine", choices=[d.value for d in Distance])
    p.add_argument("--normalize", default="zscore", choices=[n.value for n in Normalization])
    p.add_argument("--weights", type=float, nargs="*")
    p.add_argument("--k", type=int, default=1)
    p.add_argument("--channel-id", type=int, default=0)
    p.add_argument("--feature-groups", nargs="*")
    p.add_argument("--run-default-grid", action="store_true")
    p.add_argument("--save-json", nargs="?", const="", help="where to write the scores; default: <outputs-root>/evaluations/stat_retrieval_<dataset>.json")
    p.add_argument("--outputs-root", default="outputs")
    p.add_argument("--persist-memory", action="store_true")
    p.add_argument("--no-reuse-memory", action="store_true")
    p.add_argument("--force-rebuild-memory", action="store_true")
    p.add_argument("--experiment-name", default="stat_feature_retrieval")
    return p


def main(argv: list[str] | None = None) -> list[dict]:
    a = parser().parse_args(argv)
    if a.k <= 0 or a.channel_id < 0:
        raise SystemExit("--k must be positive and --channel-id non-negative")
    if a.base_dir is None and a.loader not in BASE_DIRS:
        raise SystemExit(f"--base-dir is needed for {a.loader}")
    spark = ship(session("chronoloom-cli"))
    data = get_loader(a.loader)(spark, a.dataset, a.base_dir or str(Path("datasets") / BASE_DIRS[a.loader]), max_samples_per_split=a.max_samples_per_split)
    train, test = data.split("train"), data.split("test")
    channels = train.agg(F.max("channel_id")).first()[0]
    if channels is not None and a.channel_id > channels:
        raise SystemExit(f"--channel-id out of range: {a.channel_id} for {channels + 1} channels")
    grid = GRID if a.run_default_grid else ((a.distance, a.normalize, a.k),)
    results = []
    for distance, normalize, k in grid:
        name = f"{a.experiment_name}_dist-{distance}_norm-{normalize}_k-{k}" if a.run_default_grid else a.experiment_name
        keep = Persistence(a.persist_memory, not a.no_reuse_memory, a.force_rebuild_memory, a.outputs_root, a.dataset, name)
        config = RetrieverConfig(distance, normalize, k, tuple(a.weights) if a.weights else None)
        pipeline = StatRetrieval(config, groups=a.feature_groups, persistence=keep)
        out = pipeline.evaluate(train, test, a.channel_id).summary()
        results.append(out | {"dataset": a.dataset, "dataset_loader": a.loader, "channel_id": a.channel_id, "distance": distance, "normalize": normalize})
        print(json.dumps(results[-1]))
    path = Path(a.save_json) if a.save_json else Path(a.outputs_root) / "evaluations" / f"stat_retrieval_{a.dataset}.json"
    write_json(path, results)
    print(f"saved to {path}")
    return results


if __name__ == "__main__":
    main()
