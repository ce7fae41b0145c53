"""Helpers shared by the text operators: tables, words and shared scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Bytes of a UTF-8 text to bytes of words: A-Z lower-cased, 0-9, a-z and every
#: non-ASCII byte kept, all other ASCII a space. ``translate(...).split()`` gives
#: the matches of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after ASCII lower-casing.
WORD_TABLE = bytes(
    b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20
    for b in range(256)
)


_TYPES = {
    "long": LongType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType(), "string": StringType(), "binary": BinaryType(),
    "array<string>": ArrayType(StringType()), "array<long>": ArrayType(LongType()),
}


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a UTF-8 text; null has none."""
    return text.translate(WORD_TABLE).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(text: str | Column) -> Column:
    """A text column as bytes, so that Python workers needn't decode it."""
    return (column(text) if isinstance(text, str) else text).cast("binary")


def with_id(docs: DataFrame, id_col: str, rest: str) -> StructType:
    """A schema: the id column of ``docs``, then the columns of a DDL string."""
    return StructType([StructField(id_col, docs.schema[id_col].dataType), *_parse(rest)])


def _parse(ddl: str) -> list[StructField]:
    return [StructField(*x) for x in ((n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(",")))]


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, named ``row``."""
    return F.struct(*[column(c) for c in docs.columns]).alias("row")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. Only where that is unset, and the session runs on one machine as in tests, a folder of this
    machine is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not re.match(r"local($|\[)", context.master) and context._jsc.sc().getCheckpointDir().isEmpty():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        held = context._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="chronoloom-"))
            held = context._jsc.sc().getCheckpointDir()
        found = held.get()
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder. They cut lineage as a checkpoint does,
    in columnar form, and outlive executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{re.sub(r'[^A-Za-z0-9_]', '_', label)}-{uuid.uuid4().hex}"
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def write(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        path = self.path(name)
        df.write.options(**(options or {})).parquet(path)
        return self._read(path, df.schema)

    def again(self, df: DataFrame) -> DataFrame:
        """The same table, as another frame to join it with."""
        return self._read(df._scratch_path, df.schema)

    def _read(self, path: str, schema: StructType) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """A column name that clashes with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
