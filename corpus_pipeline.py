"""A training corpus in four steps: language, near duplicates, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import language, packing, repeats, simhash
from weftline.llm.common import held_out
from weftline.session import settle

#: No SQL states the packing's input; tests hold every stage against a plain version.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts that are null, without a letter or in no learned language go."""
    return language.keep_identified(docs, language.learn(docs, ~held_out()))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return simhash.keep_one_each(docs, shingle=4, radius=4)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that start earlier too; ``n_chars`` counts what is left."""
    cut = repeats.cut_repeats(docs, length=100)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's words in sequences, dealt into length buckets and batches."""
    return packing.pack(docs, packing.word_count())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identified),
    ("near duplicates", one_of_each),
    ("repeated passages", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, name.replace(" ", "-"))
    return docs
