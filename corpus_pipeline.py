"""The corpus pipeline: toxicity, exact copies, near copies, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.common import Scratch, table
from chronoloom.llm.decontamination import clean_of_benchmark
from chronoloom.llm.exact_dedup import drop_exact_copies
from chronoloom.llm.near_join import drop_near_copies
from chronoloom.llm.packing import pack
from chronoloom.llm.toxicity import drop_toxic, train_severity


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose expected severity is at or above the bound, by a model fit on ``labels``. Null and empty texts have no features
    and stay, as do null ids; repeated rows are judged alike; an empty table stays empty. All columns as they were, whatever their names."""
    return drop_toxic(docs, train_severity(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; null and empty texts are equal. Of rows with the same id and text one stays, and null ids
    only where their group has no other. An empty table stays empty. All columns as they were."""
    return drop_exact_copies(docs, keep="largest")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id. Texts without words stay, each; a null id gives way to others; an empty table
    stays empty. All columns as they were."""
    return drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which 10 words in a row of ``benchmark`` occur. Null and empty texts have none and stay, as do null ids and repeated
    rows of clean texts; an empty table or benchmark drops nothing. All columns as they were."""
    return clean_of_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in its sequence. Null and empty texts are their end id alone; rows with null ids and repeated rows
    are packed like others; an empty table gives no pieces. Other columns are not returned."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("exact_dedup", drop_copies),
    ("near_join", drop_near),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: A fitted classifier, MinHash and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return scratch.write(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
