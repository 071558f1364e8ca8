"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame; it is written as Parquet to the shared folder and reread as the next
stage's docs. Empty tables, null values, repeated rows and further columns with
any names pass through every stage; what each does with them is said there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.exact_dedup import drop_exact
from plumbline.llm.mixing import mix_documents
from plumbline.llm.near_dedup import drop_near
from plumbline.llm.packing import pack
from plumbline.llm.quality_rules import keep_good
from plumbline.llm.queries import tokenizer_file
from plumbline.session import read_table, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, with what the rules leave of their texts; null and empty texts are rejected. Other columns stay."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the smallest id; null counts as empty, rows without an id lose to others."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id; rows without an id, and texts without words, stay."""
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, none that it does not; a null source is a source of its own, repeated rows are rows each."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document; a null text is an empty one, of the end token alone. Only the id is carried on."""
    return pack(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Components, random draws and tokenizers are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage packs of ``sf_dir``'s documents."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
