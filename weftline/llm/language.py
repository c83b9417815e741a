"""Language of a text from Bloom filters whose slots hold one bit for each language.

The frequent character n-grams of every language go into filters that share their hash functions; the filters are
stored sliced, slot by slot, so reading an n-gram's slots and combining them gives all languages that hold it at once.
A text's n-grams are counted per language, each count is corrected for the share of false positives that the fill
of that language's filter makes likely, and the largest corrected count decides.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import pieces, slim

UNDETERMINED = "und"
#: n-grams are taken over letters; everything else counts as one space.
ORDERS = (3, 4)
#: The documented bounds of the fitted model: labelled documents read for each language, n-grams kept for each language
#: and order, languages, and slots of the filters.
SAMPLE, GRAMS, LANGUAGES, SLOT_BITS = 1500, 4000, 64, 18
HASHES = 2
_MULTIPLIERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str) -> list[np.ndarray]:
    """For each order a 64-bit code of every n-gram of the letters, set between spaces; nothing without a letter."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return []
    kept = is_letter.copy()
    kept[1:] |= is_letter[:-1]
    kept[0] = True
    codes = np.where(is_letter, codes, 32)[kept].astype(np.uint64)
    code, found = codes, []
    for order in range(2, max(ORDERS) + 1):
        # Each order extends the codes of the one before.
        code = code[:-1] * _MULTIPLIERS[0] + codes[order - 1 :]
        if order in ORDERS:
            found.append(code)
    return found


@dataclass(frozen=True)
class Filters:
    """Languages in order, the sliced filters, and each language's share of set slots."""

    languages: tuple[str, ...]
    slots: np.ndarray
    fill: np.ndarray

    @staticmethod
    def build(languages: list[str], codes: np.ndarray, owner: np.ndarray, bits: int = SLOT_BITS) -> Filters:
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= len(languages))
        slots = np.zeros(1 << bits, kind)
        for at in _places(codes, bits):
            np.bitwise_or.at(slots, at, np.left_shift(kind(1), owner.astype(kind)))
        fill = np.array([(slots >> kind(i) & kind(1)).mean() for i in range(len(languages))])
        return Filters(tuple(languages), slots, fill)

    def holders(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram the set of languages that hold it, as bits."""
        found = None
        for at in _places(codes, int(self.slots.size).bit_length() - 1):
            found = self.slots[at] if found is None else found & self.slots[at]
        return found

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """How many n-grams each language holds, less the false positives to be expected."""
        if not len(codes):
            return np.zeros(len(self.languages))
        found = self.holders(codes).view(np.uint8).reshape(len(codes), -1)
        seen = []
        for byte in range(found.shape[1]):
            sets = np.bincount(found[:, byte], minlength=256)
            seen += [int(sets[_HAS_BIT[bit]].sum()) for bit in range(8)]
        false = self.fill**HASHES
        return np.maximum(0.0, (np.array(seen[: len(self.languages)]) - len(codes) * false) / (1 - false))

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language and its share of all corrected counts; the first of equals.

        Without a letter the text is undetermined. With letters but no known n-gram the first language is named with
        score 0.
        """
        codes = grams(text) if text else []
        if not self.languages or not codes:
            return UNDETERMINED, 0.0
        counts = sum(self.counts(c) for c in codes)
        best = int(np.argmax(counts))
        total = float(counts.sum())
        return self.languages[best], float(counts[best] / total) if total else 0.0


_HAS_BIT = [np.flatnonzero(np.arange(256) >> bit & 1) for bit in range(8)]


def _places(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slots of each n-gram, one array for each hash function."""
    mixed = codes ^ (codes >> np.uint64(29))
    return [(mixed * m >> np.uint64(64 - bits)).astype(np.int64) for m in _MULTIPLIERS[1 : 1 + HASHES]]


def _sample_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "width", "code", "n"]
    for batch in pieces(batches, 500):
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        for lang in dict.fromkeys(langs.tolist()):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            coded = [g for g in map(grams, own) if g]
            for i, order in enumerate(ORDERS if coded else ()):
                codes, n = np.unique(np.concatenate([g[i] for g in coded]), return_counts=True)
                same = [pa.array([lang] * len(codes), pa.string()), pa.array([order] * len(codes), pa.int32())]
                yield pa.RecordBatch.from_arrays([*same, pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], names=names)


def learn(
    docs: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE
) -> Filters:
    """Filters from labelled documents: of each language the ``sample`` learnable ones with the smallest hash of the id.

    That sample and the n-grams kept are the model's fixed size, whatever the corpus; both bounds are parameters. Only
    the kept n-grams, ``GRAMS`` for each language and order, come to the driver. Rows without a language, an id or a
    text teach nothing. More than ``LANGUAGES`` languages are refused.
    """
    labelled = docs.where(learnable & F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull())
    rows = labelled.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"))
    # A language's rows are thinned to a few times the sample before they meet in one task.
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()
    share = F.lit(1.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 2 * sample / r["n"]))).otherwise(share)
    rows = rows.withColumn("h", F.xxhash64("doc_id")).where((F.col("h") / 2.0**64 + 0.5) <= share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = rows.withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id").distinct()
    texts = labelled.select(
        F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    # At most ``sample`` ids for each of at most ``LANGUAGES`` languages: small enough to send along.
    taught = texts.join(F.broadcast(chosen), "doc_id").select("lang", "text")
    counted = taught.mapInArrow(_sample_grams, "lang string, width int, code long, n long")
    totals = counted.groupBy("lang", "width", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", "width").orderBy(F.desc("n"), "code"))
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    kept = totals.withColumn("place", place).where(F.col("place") <= GRAMS).select("lang", "code").toArrow()
    names = kept.column("lang").to_pylist()
    languages = sorted(set(names))
    place_of = {name: i for i, name in enumerate(languages)}
    owner = np.array([place_of[n] for n in names], np.int64)
    return Filters.build(languages, kept.column("code").to_numpy().astype(np.int64).view(np.uint64), owner)


def identify(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id, lang_pred, score``; reads nothing but the text.

    A null text, or one without a letter, is ``und`` with score 0. Repeated rows each get their row, a null id stays
    null, an empty table gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1000):
            said = [shared.value.decide(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return slim(docs, key, text).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns as they are, whose language could be told: not ``und`` and not score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("boolean")
    def told(texts):
        import pandas as pd

        return pd.Series([shared.value.decide(t)[1] > 0 for t in texts], dtype=bool)

    return docs.where(told(F.col(text)))
