"""Files and folders of any store that Spark reaches, by its own file systems."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession

from .files import to_jsonable

#: Lines that a header may have.
HEADER_LINES = 10_000


class Store:
    """A file or folder by URI or path. What is written appears whole, by a rename."""

    def __init__(self, spark: SparkSession, path: Any):
        self.spark, self.path = spark, str(path).rstrip("/") or "/"
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def __truediv__(self, name: str) -> Store:
        return Store(self.spark, f"{self.path}/{name}")

    def __str__(self) -> str:
        return self.path

    @property
    def full(self) -> str:
        """The whole URI, as Spark names files in ``_metadata.file_path`` but for escapes."""
        return self._fs.makeQualified(self._at).toString()

    def exists(self) -> bool:
        return self._fs.exists(self._at)

    def is_dir(self) -> bool:
        return self.exists() and self._fs.getFileStatus(self._at).isDirectory()

    def names(self, folders: bool) -> list[str]:
        """Of the folders, or files, here; none if there is no such folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at) if s.isDirectory() == folders) if self.is_dir() else []

    def walk(self) -> Iterator[str]:
        """Paths, from here, of all files below."""
        if self.is_dir():
            found, skip = self._fs.listFiles(self._at, True), len(self.full.rstrip("/")) + 1
            while found.hasNext():
                yield found.next().getPath().toString()[skip:]

    def read(self) -> str:
        with _closing(self._fs.open(self._at)) as stream:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")

    def head(self, last: re.Pattern[str]) -> list[str] | None:
        """The first lines, up to one that matches. None if none of the first does."""
        jvm, out = self.spark._jvm, []
        with _closing(self._fs.open(self._at)) as stream:
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
            while len(out) < HEADER_LINES and (line := lines.readLine()) is not None:
                out.append(line)
                if last.search(line):
                    return out
        return None

    def write(self, text: str) -> None:
        part = Store(self.spark, f"{self.path}.{uuid.uuid4().hex}")
        with _closing(part._fs.create(part._at, True)) as stream:
            stream.write(bytearray(text.encode()))
        part.move(self)

    def read_json(self) -> Any:
        return json.loads(self.read())

    def write_json(self, value: Any) -> None:
        self.write(json.dumps(to_jsonable(value), indent=2))

    def move(self, to: Store) -> None:
        """In place of what is there."""
        to.delete()
        to._fs.mkdirs(to._at.getParent())
        if not self._fs.rename(self._at, to._at):
            raise OSError(f"cannot rename {self} to {to}")

    def move_new(self, to: Store) -> bool:
        """To where nothing is; False if something is."""
        to._fs.mkdirs(to._at.getParent())
        return not to.exists() and self._fs.rename(self._at, to._at)

    def delete(self) -> None:
        self._fs.delete(self._at, True)


class _closing:
    def __init__(self, stream):
        self.stream = stream

    def __enter__(self):
        return self.stream

    def __exit__(self, *_):
        self.stream.close()
