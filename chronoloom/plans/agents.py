"""Steps with switches, hooks and events, and chains of them."""

from __future__ import annotations

import os
import random
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from ..operators.selector import select_channels
from ..schema import SelectorConfig, non_empty
from .registry import AGENTS
from .telemetry import EventLog

Hook = Callable[[Any], Any]


def set_seed(seed: int) -> None:
    """Seed the generators of the driver."""
    os.environ["PYTHONHASHSEED"] = str(seed)
    random.seed(seed)
    np.random.seed(seed % 2**32)


class Agent:
    """A step. Subclasses give ``act``; hooks may change what goes in and what comes out."""

    def __init__(self, name: str, *, enabled: bool = True, before: Iterable[Hook] = (), after: Iterable[Hook] = (), log: EventLog | None = None):
        self.name, self.enabled = non_empty(name, "name"), enabled
        self.before, self.after, self.log = list(before), list(after), log

    def act(self, value: Any) -> Any:
        raise NotImplementedError

    def run(self, value: Any) -> Any:
        if not self.enabled:
            raise RuntimeError(f"{self.name} is disabled")
        if self.log is None:
            return self._run(value)
        with self.log.span("agent", self.name):
            return self._run(value)

    def _run(self, value: Any) -> Any:
        for hook in self.before:
            value = hook(value)
        value = self.act(value)
        for hook in self.after:
            value = hook(value)
        return value


class ChannelSelectorAgent(Agent):
    """Ranks the channels of the training series."""

    def __init__(self, config: SelectorConfig | None = None, **options: Any):
        super().__init__("channel_selector", **options)
        self.config = config or SelectorConfig()

    def act(self, value: DataFrame) -> DataFrame:
        return select_channels(value, self.config)


class Chain:
    """Steps by name, one after the other. Their plans are lazy, so a chain of frames is one plan."""

    def __init__(self, name: str, steps: dict[str, Callable[[Any], Any]], *, log: EventLog | None = None):
        self.name, self.steps, self.log = non_empty(name, "name"), dict(steps), log
        if not steps:
            raise ValueError("a chain needs steps")

    def run(self, value: Any) -> tuple[Any, dict[str, Any]]:
        """The last result, and all by step."""
        results: dict[str, Any] = {}

        def go() -> Any:
            out = value
            for name, step in self.steps.items():
                out = results[name] = step(out)
            return out

        if self.log is None:
            return go(), results
        with self.log.span("pipeline", self.name):
            return go(), results

    def run_batch(self, values: Iterable[Any]) -> list[Any]:
        """The results one by one; the first error ends the batch."""
        out = []
        for i, v in enumerate(values):
            out.append(self.run(v)[0])
            if self.log:
                self.log.write("batch_item", {"name": self.name, "index": i})
        return out


AGENTS.register("channel_selector", ChannelSelectorAgent)
