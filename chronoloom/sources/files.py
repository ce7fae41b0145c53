"""Small files on the driver, and dataset folders."""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Iterable
from enum import Enum
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession


def to_jsonable(value: Any) -> Any:
    """Plain JSON values: dataclasses, arrays, sets, enumerations and paths; keys become text."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return to_jsonable({f.name: getattr(value, f.name) for f in dataclasses.fields(value)})
    if isinstance(value, Enum):
        return value.value
    if isinstance(value, dict):
        return {str(k): to_jsonable(v) for k, v in value.items()}
    if isinstance(value, set | frozenset):
        return sorted((to_jsonable(v) for v in value), key=str)
    if isinstance(value, list | tuple):
        return [to_jsonable(v) for v in value]
    if isinstance(value, Path):
        return str(value)
    if hasattr(value, "tolist"):
        return to_jsonable(value.tolist())
    return value


def write_text(path: str | Path, text: str, append: bool = False) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a" if append else "w", encoding="utf-8") as f:
        f.write(text)
    return path


def write_json(path: str | Path, value: Any, *, indent: int | None = 2, ensure_ascii: bool = False) -> Path:
    return write_text(path, json.dumps(to_jsonable(value), indent=indent, ensure_ascii=ensure_ascii))


def write_jsonl(path: str | Path, rows: Iterable[Any], *, append: bool = False) -> Path:
    return write_text(path, "".join(json.dumps(to_jsonable(r), ensure_ascii=False) + "\n" for r in rows), append)


def read_text(path: str | Path) -> str:
    return Path(path).read_text(encoding="utf-8")


def read_json(path: str | Path) -> Any:
    return json.loads(read_text(path))


def read_jsonl(path: str | Path) -> list[Any]:
    return [json.loads(x) for x in read_text(path).splitlines() if x.strip()]


def dataset_name(name: str) -> str:
    if not isinstance(name, str) or not name.strip():
        raise ValueError("a dataset needs a name")
    return name.strip()


def normalize_name(name: str) -> str:
    """A name for folders: white space becomes underscores, other marks go."""
    out = re.sub(r"[^A-Za-z0-9_\-]", "", re.sub(r"\s+", "_", name.strip()))
    if not out:
        raise ValueError(f"no usable characters in {name!r}")
    return out


def splits_of(root: str | Path, suffix: str = "", spark: SparkSession | None = None) -> list[str]:
    """Names of the folders under ``root``, of any store, that hold both splits; none if there is no such root."""
    from .store import Store

    top = Store(spark or SparkSession.builder.getOrCreate(), root)
    return [n for n in top.names(folders=True) if all((top / n / f"{n}_{s}{suffix}").exists() for s in ("TRAIN", "TEST"))]


def both_splits(spark: SparkSession, root: str | Path, name: str, suffix: str = "") -> dict[str, str]:
    """Where the splits are; each is a file, or a folder of parts in the order of their names."""
    from .store import Store

    name = dataset_name(name)
    out = {s: Store(spark, root) / name / f"{name}_{s.upper()}{suffix}" for s in ("train", "test")}
    for p in out.values():
        if not p.exists():
            raise FileNotFoundError(str(p))
    return {s: str(p) for s, p in out.items()}
