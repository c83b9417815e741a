"""Text search through a posting table of trigrams.

The index of a table is two Parquet tables: postings, each distinct trigram of a row's fields with the row's key, in short
lists of keys laid out by trigram, and the rows themselves, laid out by key. A search reads the postings of the rarest trigrams of its term, keeps
the keys that hold all of them, reads the parts in which these rows lie, and puts them to the exact test. Every
row that holds the term holds its trigrams, so nothing is lost; a term of fewer than three characters is looked for in
all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused
from weftline.operators import search
from weftline.operators.grams import key_lists
from weftline.operators.lookup import lookup
from weftline.session import settle, settle_measured
from weftline.specs import resolve

#: Parts that postings and rows are laid out in; trigrams of a term that are read; keys that are pushed to the scan.
PARTS, RAREST, PUSHED = 64, 4, 1000


@dataclass(frozen=True)
class TextIndex:
    """Where an index lies, the column that names a row, the fields that are searched, the columns of a row, and the
    parts that postings and rows are laid out in."""

    path: str
    key: str
    fields: tuple[str, ...]
    schema: T.StructType
    parts: int = PARTS

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema, T.StructField("__part", T.IntegerType())])).parquet(f"{self.path}/rows")

    def postings(self, spark: SparkSession) -> DataFrame:
        kind = self.schema[self.key].dataType
        columns = [T.StructField("keys", T.ArrayType(kind)), T.StructField("gram", T.StringType()), T.StructField("gram_part", T.IntegerType())]
        lists = spark.read.schema(T.StructType(columns)).parquet(f"{self.path}/postings")
        return lists.select(F.explode("keys").alias("key"), "gram", "gram_part")


def _part(value: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(parts)).cast("int")


def build_index(df: DataFrame, key: str, path: str, fields: Sequence[str] = (), parts: int = PARTS) -> TextIndex:
    """Writes the index of a table's text fields, or of those named, below ``path``.

    ``key`` names rows; rows without a key, and rows that share one, are indexed like any other. A trigram that most rows
    hold is laid out over as many files as its postings fill: it is dealt by range of trigram and key.
    """
    names = [resolve(df.columns, f) for f in fields]
    names = names or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        raise Refused("there is no text field to index")
    key = resolve(df.columns, key)
    index = TextIndex(path, key, tuple(names), df.schema, parts)
    laid = df.withColumn("__part", _part(F.col(key), parts)).repartitionByRange("__part", F.xxhash64(key))
    laid.sortWithinPartitions("__part", key).write.partitionBy("__part").parquet(f"{path}/rows")
    rows = index.rows(df.sparkSession)
    texts = [F.lower(F.col(n).cast("string")).alias(f"t{i}") for i, n in enumerate(names)]
    # Written once, as dealing by range looks at its input twice.
    lists = settle(key_lists(rows.select(F.col(key).alias("key"), *texts)), "key-lists").withColumn("gram_part", _part(F.col("gram"), parts))
    dealt = lists.repartitionByRange("gram_part", "gram", F.xxhash64("keys")).sortWithinPartitions("gram_part", "gram", F.col("keys")[0])
    dealt.write.partitionBy("gram_part").parquet(f"{path}/postings")
    return index


def term_grams(term: str) -> list[str]:
    """The trigrams that every text with the term holds, in lower case.

    The lower case of a sigma depends on what follows it, so trigrams with one prove nothing.
    """
    text = term.lower()
    found = {text[i : i + 3] for i in range(len(text) - 2)}
    return sorted(g for g in found if not set(g) & {"σ", "ς"})


def candidates(spark: SparkSession, index: TextIndex, term: str) -> DataFrame | None:
    """``key``: rows that may hold the term, all that do among them; None if the term tells nothing.

    Counts of the term's trigrams come first, which the postings of those trigrams alone answer, then the rarest are read.
    Keys that hold all of these are found by one aggregate, combined before its shuffle.
    """
    grams = term_grams(term)
    if not grams:
        return None
    own = _postings_of(spark, index, grams)
    counts = {r["gram"]: r["count"] for r in own.groupBy("gram").count().collect()}
    if len(counts) < len(grams):
        return own.where(F.lit(False)).select("key")
    rarest = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
    picked = _postings_of(spark, index, rarest)
    # A key that several rows share holds what any of them holds.
    return picked.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("key")


def _postings_of(spark: SparkSession, index: TextIndex, grams: Sequence[str]) -> DataFrame:
    """Partition and row group statistics leave only the files that hold these trigrams."""
    parts = spark.createDataFrame([(g,) for g in grams], "gram string").select(_part(F.col("gram"), index.parts).alias("p"))
    wanted = sorted({r["p"] for r in parts.collect()})
    return index.postings(spark).where(F.col("gram_part").isin(wanted) & F.col("gram").isin(list(grams))).select("key", "gram")


def candidate_rows(spark: SparkSession, index: TextIndex, term: str) -> DataFrame:
    """The rows to be tested: those of the candidates, read from the parts in which they lie.

    Few keys are pushed to the scan as a filter; many are joined. Neither list of parts nor of pushed keys grows with the
    table. Rows without a key are always tested.
    """
    rows = index.rows(spark)
    keys = candidates(spark, index, term)
    if keys is None:
        return rows.drop("__part")
    keys, seen = settle_measured(
        keys.where(F.col("key").isNotNull()).withColumn("__p", _part(F.col("key"), index.parts)),
        "candidates",
        n=F.count(F.lit(1)),
        parts=F.collect_set("__p"),
    )
    nameless = spark.range(1).select(_part(F.lit(None).cast(rows.schema[index.key].dataType), index.parts).alias("p")).first()["p"]
    near = rows.where(F.col("__part").isin(sorted({*(seen["parts"] or []), nameless})))
    if seen["n"] <= PUSHED:
        known = [r["key"] for r in keys.select("key").collect()]
        own = F.col(index.key).isin(known) if known else F.lit(False)
        return near.where(own | F.col(index.key).isNull()).drop("__part")
    named = lookup(near, keys.select(F.col("key").alias("__k"), F.col("__p")), [(index.key, "__k"), ("__part", "__p")], "left_semi")
    return named.unionByName(near.where(F.col(index.key).isNull())).drop("__part")


def find_text(
    spark: SparkSession, index: TextIndex, term: str, case_sensitive: bool = False, max_results: int | None = None
) -> DataFrame:
    """What ``search.find_text`` finds in the indexed fields, from the candidate rows alone."""
    if not term.strip():
        raise Refused("a search needs a term")
    rows = candidate_rows(spark, index, term)
    return search.find_text(rows, term, index.fields, case_sensitive, max_results, [index.key])


def ranked_search(spark: SparkSession, index: TextIndex, term: str, name: str) -> DataFrame:
    """What ``search.ranked_search`` finds in the indexed fields: an exact or a prefix match holds the term too."""
    if not term.strip():
        raise Refused("a search needs a term")
    return search.ranked_search(candidate_rows(spark, index, term), term, index.fields, name, index.key)
