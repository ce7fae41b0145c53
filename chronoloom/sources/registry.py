"""Loaders by key."""

from __future__ import annotations

from collections.abc import Callable

from .skab import load_skab_sequences, load_skab_windows
from .ucr import Dataset, load_ucr
from .uea import load_uea

Loader = Callable[..., Dataset]


def load_prediction(*args, **options) -> Dataset:
    raise NotImplementedError("there is no prediction dataset yet")


def load_anomaly_placeholder(*args, **options) -> Dataset:
    raise NotImplementedError("this anomaly dataset isn't there yet")


_LOADERS: dict[str, Loader] = {}


def _key(name: str) -> str:
    if not isinstance(name, str) or not name.strip():
        raise ValueError("a loader needs a key")
    return name.strip().lower()


def register_loader(name: str, loader: Loader) -> None:
    _LOADERS[_key(name)] = loader


def get_loader(name: str) -> Loader:
    if (key := _key(name)) not in _LOADERS:
        raise KeyError(f"no loader {key!r}; there are {list_loaders()}")
    return _LOADERS[key]


def list_loaders() -> list[str]:
    return sorted(_LOADERS)


for _name, _loader in (
    ("ucr2015", load_ucr),
    ("uea", load_uea),
    ("skab_sequence", lambda spark, name, base_dir, **o: load_skab_sequences(spark, base_dir, **o)),
    ("skab_window", lambda spark, name, base_dir, **o: load_skab_windows(spark, base_dir, **o)),
):
    register_loader(_name, _loader)
