"""Components by name, and objects from configuration."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any, Generic, TypeVar

T = TypeVar("T")


class ConfigError(ValueError):
    """A configuration that can't be used."""


class FactoryError(RuntimeError):
    """A component that couldn't be made."""


class Registry(Generic[T]):
    """Named components. Names are compared without case and outer spaces."""

    def __init__(self, kind: str):
        self.kind = kind
        self._items: dict[str, T] = {}

    @staticmethod
    def _key(name: str) -> str:
        if not isinstance(name, str) or not name.strip():
            raise ConfigError("a component needs a name")
        return name.strip().lower()

    def register(self, name: str, item: T | None = None, *, replace: bool = False):
        """Register an item, or use as a decorator. A taken name is an error unless replaced."""
        if item is None:
            return lambda f: self.register(name, f, replace=replace)
        if (key := self._key(name)) in self._items and not replace:
            raise KeyError(f"{self.kind} {key!r} is taken")
        self._items[key] = item
        return item

    def unregister(self, name: str) -> T:
        return self._items.pop(self._key(name))

    def get(self, name: str) -> T:
        if (found := self.try_get(name)) is None:
            raise KeyError(f"no {self.kind} {name!r}; there are {self.names()}")
        return found

    def try_get(self, name: str) -> T | None:
        return self._items.get(self._key(name))

    def names(self) -> list[str]:
        return sorted(self._items)

    def summary(self) -> dict[str, str]:
        return {k: getattr(v, "__name__", type(v).__name__) for k, v in sorted(self._items.items())}

    def build(self, config: Mapping[str, Any] | str, **more: Any) -> Any:
        """What the component ``name`` (or ``type``) of a configuration makes of the rest of it."""
        config = {"name": config} if isinstance(config, str) else dict(config)
        name = config.pop("name", None) or config.pop("type", None)
        if not name:
            raise ConfigError(f"a {self.kind} configuration needs a name")
        maker: Callable[..., Any] = self.get(name)
        try:
            return maker(**(config.pop("params", None) or config), **more)
        except (TypeError, ValueError) as e:
            raise FactoryError(f"{self.kind} {name!r}: {e}") from e


RETRIEVERS: Registry = Registry("retriever")
REPRESENTATIONS: Registry = Registry("representation")
AGENTS: Registry = Registry("agent")
PIPELINES: Registry = Registry("pipeline")
TASKS: Registry = Registry("task")
