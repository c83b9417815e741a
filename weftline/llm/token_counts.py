"""Token counts through a cache of digests.

A count depends on the content and on the tokenizer alone, so it is stored under the digests of both. A run joins its
documents to the stored counts, encodes each distinct missing content once, appends those counts to the cache and joins
again. The cache is a Parquet table; an interrupted run leaves either a whole append or none.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import pathlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import path_exists, pieces, slim
from weftline.operators.lookup import lookup

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
#: Counts of parts and of words that a Python worker remembers from one batch to the next, at most.
REMEMBERED = 700_000
# One task, one thread: Spark does the spreading.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def tokenizer_digest(path: str) -> str:
    """Names the vocabulary file's bytes and the library's version: either may change a count."""
    return hashlib.sha256(pathlib.Path(path).read_bytes() + tokenizers.__version__.encode()).hexdigest()


class Counter:
    """Counts tokens as the library does, with special strings inside texts as its default treats them.

    A byte-level vocabulary without a normaliser cuts a text into words before it merges bytes, and such a cut always
    lies before a space that a visible character follows. Counts then add up over the parts between these spaces, and
    over the words of a part. Parts and words seen before need not be encoded again. Any other vocabulary, and any
    text with runs of white space around a space or with an added token, is encoded whole.
    """

    def __init__(self, path: str) -> None:
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        stated = json.loads(pathlib.Path(path).read_text())
        cut = stated.get("pre_tokenizer") or {}
        self.additive = (
            stated.get("normalizer") is None
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
        )
        self.added = [t["content"] for t in stated.get("added_tokens", [])]
        self.parts: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        cut: list[list[str] | None] = []
        for text in texts:
            parts = text.split(" ")
            # A space that ends the text or stands before white space belongs to a run; runs are not cut.
            apart = self.additive and not _RUN.search(text) and not any(a in text for a in self.added)
            # A part keeps the space before it.
            cut.append([parts[0], *[" " + p for p in parts[1:]]] if apart else None)
        self._learn({p for parts in cut if parts for p in parts})
        whole = iter(self.whole([t for t, parts in zip(texts, cut, strict=True) if parts is None]))
        known = self.parts
        counts = [next(whole) if parts is None else sum(map(known.__getitem__, parts)) for parts in cut]
        _forget(self.parts)
        _forget(self.words)
        return counts

    def _learn(self, parts: set[str]) -> None:
        """Counts of parts not known yet: by their words where these are plain Latin text, else by the library."""
        new = [p for p in parts if p not in self.parts]
        plain = {p: _WORDS.findall(p) for p in new if _PLAIN.fullmatch(p)}
        unknown = list({w for words in plain.values() for w in words if w not in self.words})
        self.words.update(zip(unknown, self.whole(unknown), strict=True))
        for part, words in plain.items():
            self.parts[part] = sum(map(self.words.__getitem__, words))
        others = [p for p in new if p not in plain]
        self.parts.update(zip(others, self.whole(others), strict=True))


#: A space that ends a text or that white space follows.
_RUN = re.compile(r" (?:\s|\Z)")
#: Characters whose class every Unicode version agrees on, and the words that the byte-level cut makes of them.
_PLAIN = re.compile("[\\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _forget(known: dict[str, int]) -> None:
    """Past its bound a memory keeps its older half: frequent words are met early."""
    if len(known) > REMEMBERED:
        for word in list(itertools.islice(known, REMEMBERED // 2, None)):
            del known[word]


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in pieces(batches, 1000):
            counts = counter.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"]
            )

    return encode


def stored_counts(spark, cache: str, digest: str) -> DataFrame:
    """Stored counts of one tokenizer, one row per content even if two runs appended the same content."""
    if not path_exists(spark, cache):
        return spark.createDataFrame([], "content binary, n_tokens long")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == digest)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, tokenizer: str, cache: str, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every distinct content that the cache lacks and appends its count.

    Equal contents meet as partial aggregates, one row for each task and content, so a hot content is no hot task.
    """
    spark = docs.sparkSession
    digest = tokenizer_digest(tokenizer)
    found = slim(docs, key, text).select(_content(), "text")
    distinct = found.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(stored_counts(spark, cache, digest), "content", "left_anti")
    counted = misses.select("content", "text").mapInArrow(_encoder(tokenizer), "content binary, n_tokens long")
    counted.select("content", F.lit(digest).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)


def _content():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content")


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, limit: int = 512, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``tokenizer`` is the path of a vocabulary file of the tokenizers library, ``cache`` that of the cache table, below a
    folder all executors share. No begin, end or added special tokens, no truncation, no padding. A null or empty text
    has no bytes and no tokens; repeated rows each get their row; a null id stays null; an empty table gives no rows;
    other columns are ignored.
    """
    fill_cache(docs, tokenizer, cache, key, text)
    counts = stored_counts(docs.sparkSession, cache, tokenizer_digest(tokenizer))
    rows = slim(docs, key, text).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _content())
    # Very many rows may hold one content; a plain join to counts grouped by it would leave them in one task.
    counts = counts.withColumnRenamed("content", "counted")
    return lookup(rows, counts, [("content", "counted")]).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
