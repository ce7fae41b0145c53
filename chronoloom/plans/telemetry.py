"""Event logs, metric trackers and loggers, on the driver."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from ..schema import non_empty
from ..sources.files import write_json, write_jsonl


def utc_now() -> str:
    return datetime.now(UTC).isoformat()


def local_now() -> str:
    """The time of this machine, with its distance from UTC."""
    return datetime.now().astimezone().isoformat()


def path_timestamp() -> str:
    return datetime.now(UTC).strftime("%Y%m%d_%H%M%S")


@contextmanager
def timed(name: str, log: EventLog | None = None) -> Iterator[dict[str, float]]:
    """Seconds that a block takes, in the dict it gives."""
    out = {"seconds": 0.0}
    began = time.perf_counter()
    try:
        yield out
    finally:
        out["seconds"] = time.perf_counter() - began
        if log:
            log.write("timer", {"name": name, **out})


class EventLog:
    """Appends events as lines of JSON: timestamp, event_type, payload and what else is given."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def write(self, event_type: str, payload: Any = None, **more: Any) -> None:
        write_jsonl(self.path, [{"timestamp": utc_now(), "event_type": non_empty(event_type, "event_type"), "payload": payload, **more}], append=True)

    @contextmanager
    def span(self, kind: str, name: str) -> Iterator[None]:
        """A start event, and an end or error event."""
        self.write(f"{kind}_start", {"name": name})
        try:
            yield
        except Exception as e:
            self.write(f"{kind}_error", {"name": name, "error": str(e)})
            raise
        self.write(f"{kind}_end", {"name": name})


class MetricTracker:
    """Appends records to metrics.jsonl and keeps the last in latest_metrics.json."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def log(self, metrics: dict[str, float], *, step: int | None = None, stage: str | None = None, metadata: dict | None = None) -> dict:
        if not metrics:
            raise ValueError("no metrics")
        record = {"timestamp": utc_now(), "step": step, "stage": stage, "metrics": metrics, "metadata": metadata or {}}
        write_jsonl(self.folder / "metrics.jsonl", [record], append=True)
        write_json(self.folder / "latest_metrics.json", record)
        return record


class NullTracker:
    def log(self, metrics: dict[str, float], **_: Any) -> dict:
        return {"metrics": metrics}


def build_logger(name: str, path: str | Path | None = None, level: int = logging.INFO) -> logging.Logger:
    """A logger to the console and, with a path, to a file; asked again, it is the same."""
    logger = logging.getLogger(non_empty(name, "name"))
    logger.setLevel(level)
    logger.propagate = False
    form = logging.Formatter("%(asctime)s | %(levelname)s | %(name)s | %(message)s")
    if not logger.handlers:
        logger.addHandler(logging.StreamHandler())
    if path and not any(isinstance(h, logging.FileHandler) for h in logger.handlers):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        logger.addHandler(logging.FileHandler(path, encoding="utf-8"))
    for h in logger.handlers:
        h.setFormatter(form)
    return logger


def log_section(logger: logging.Logger, title: str, values: dict[str, Any] | None = None) -> None:
    logger.info("=== %s ===", title)
    for k, v in (values or {}).items():
        logger.info("%s: %s", k, v)
