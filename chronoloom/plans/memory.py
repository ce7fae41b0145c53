"""A kept memory that grows: parts of a gallery, and numbered manifests that say which of them count.

A part is written whole before a manifest names it, and a manifest appears by a rename to the next number; so a build that was
killed leaves nothing that is read, and of two writers one is refused. Entries keep a hash of what they were made from: bringing a memory up to date
computes features of new and changed samples only, and marks entries of samples that are gone or changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import gallery as G
from ..schema import GALLERY
from ..sources.store import Store

#: Parts after which they are written as one.
MOST_PARTS = 16
_KEPT = StructType([*GALLERY.fields, StructField("source", LongType()), StructField("part", StringType())])
_GONE = StructType([GALLERY["entry_id"], StructField("part", StringType())])


class Conflict(RuntimeError):
    """Another writer was first."""


def with_source(series: DataFrame) -> DataFrame:
    """The rows with a hash of all that an entry is made from: sample, place, label and values."""
    made_from = F.struct("sample_id", "split", "sample_index", "channel_id", F.col("label").cast("string").alias("label"), "values")
    return series.withColumn("source", F.xxhash64(made_from))


class Memory:
    """A kept gallery in ``root`` (any store): ``parts/<name>/gallery`` and ``gone``, ``manifests/<number>.json``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Store(spark, root)

    def manifest(self) -> dict | None:
        """The newest, if there is one: number, settings, parts (name, entries, gone) and feature_order."""
        found = [n for n in (self.root / "manifests").names(folders=False) if n.endswith(".json")]
        return (self.root / "manifests" / max(found)).read_json() if found else None

    def gallery(self, manifest: dict | None = None) -> DataFrame:
        """The entries that count, with the hash of their sources and the part that they are in."""
        held = manifest or self.manifest()
        if held is None:
            raise FileNotFoundError(f"no memory in {self.root}")
        out = self._read(held, "entries", "gallery", _KEPT)
        gone = [p for p in held["parts"] if p["gone"]]
        if not gone:
            return out
        # an entry that is made anew is in another part
        return out.join(self._read(held, "gone", "gone", _GONE), ["entry_id", "part"], "left_anti")

    def _read(self, held: dict, counted: str, name: str, schema: StructType) -> DataFrame:
        paths = [f"{self.root}/parts/{p['name']}/{name}" for p in held["parts"] if p[counted]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entries(self) -> int:
        held = self.manifest() or {"parts": []}
        return sum(p["entries"] - p["gone"] for p in held["parts"])

    def update(self, series: DataFrame, build: Callable[[DataFrame], DataFrame], settings: dict, *, reuse: bool = True) -> DataFrame:
        """The gallery of just these samples under these settings. ``build`` makes entries (with ``source``) of series. What is kept is used for samples
        that are as they were; without ``reuse``, or under other settings, all are made. Samples are told apart by id and channel: two entries
        of one are an error; rows that repeat a kept sample as it was add nothing."""
        held = self.manifest()
        series = with_source(series)
        if not reuse or held is None or held["settings"] != settings:
            fresh, gone, parts = series, None, []
        else:
            known = self.gallery(held).select("sample_id", "channel_id", "source", "entry_id", "part")
            key = ["sample_id", "channel_id", "source"]
            fresh = series.join(known.select(key), key, "left_anti")
            gone = known.join(series.select(key), key, "left_anti").select("entry_id", "part")
            parts = held["parts"]
        part = self._write(build(fresh), gone)
        if not part["entries"] and not part["gone"] and held is not None and parts is held["parts"]:
            (self.root / "parts" / part["name"]).delete()
            return self.gallery(held).select(*GALLERY.names)
        now = {"number": (held["number"] if held else 0) + 1, "settings": settings, "parts": [*parts, part]}
        G.check_unique(self.gallery(now))
        if len(now["parts"]) > MOST_PARTS:
            now["parts"] = [self._write(self.gallery(now), None)]
        self._commit(now)
        return self.gallery(now).select(*GALLERY.names)

    def _write(self, entries: DataFrame, gone: DataFrame | None) -> dict:
        """A part, with its numbers as the writing job observes them."""
        name = uuid.uuid4().hex
        entries = entries.withColumn("part", F.lit(name))
        out = {"name": name}
        for kind, rows, schema in (("gallery", entries, _KEPT), ("gone", gone, _GONE)):
            seen = Observation()
            if rows is not None:
                rows.select(*schema.names).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/parts/{name}/{kind}")
            out["entries" if kind == "gallery" else "gone"] = seen.get["n"] if rows is not None else 0
        return out

    def _commit(self, manifest: dict) -> None:
        final = self.root / "manifests" / f"{manifest['number']:010d}.json"
        part = self.root / f"manifest.{uuid.uuid4().hex}"
        part.write_json(manifest)
        if not part.move_new(final):
            part.delete()
            raise Conflict(f"{final} is there already")

    def vacuum(self) -> list[str]:
        """Delete the parts that the newest manifest doesn't name, as killed builds and old versions leave them; their names. Not while a writer
        is at work."""
        used = {p["name"] for p in (self.manifest() or {"parts": []})["parts"]}
        left = [n for n in (self.root / "parts").names(folders=True) if n not in used]
        for n in left:
            (self.root / "parts" / n).delete()
        return left
