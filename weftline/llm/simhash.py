"""Near-duplicate groups by SimHash, compared bit plane by bit plane.

Fingerprints that differ in at most r bits agree in at least two of r + 2 groups of bits, so every pair to be linked
shares one of the pairs of groups. Fingerprints that share it are sorted together and compared in bulk: the bits lie
vertically, one packed plane for each bit, 64 comparisons to a machine word. Carry-save counters add the differing
planes up for all comparisons at once, and a word is given up as soon as all of its comparisons exceed the radius.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import partitions, pieces, slim
from weftline.llm.components import components
from weftline.operators.lookup import lookup
from weftline.session import settle, settle_measured

SEED = 42
BITS = 64
#: Words of 64 comparisons that one step carries through the planes.
STEP = 8192
#: A run of fingerprints above this length is cut by further bits before it is compared.
LONG_RUN = 4096
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int) -> int:
    """Majority over the hashes of all word shingles, repeats included; 0 without a word.

    A-Z are lower-cased; words are what stands between ASCII white space; a text of fewer words is one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[b:e], SEED) for b, e in zip(begins, ends[width - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp long`` for every document; a null text has no words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1000):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return slim(docs, key, text).mapInArrow(rows, "doc_id long, fp long")


def bands(radius: int, inside: int = (1 << BITS) - 1) -> list[int]:
    """Masks of which at least one covers only equal bits of any two numbers that differ in ``radius`` bits or fewer.

    The bits of ``inside`` are dealt into radius + 2 groups; a mask holds two of them.
    """
    places = [i for i in range(BITS) if inside >> i & 1]
    groups = [sum(1 << p for p in part) for part in np.array_split(np.array(places, object), radius + 2)]
    return [a | b for a, b in itertools.combinations(groups, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _exploded(fps: DataFrame, masks: Column) -> DataFrame:
    """``mask, fp`` for every mask, dealt out by the bits under the mask."""
    rows = fps.select("fp", F.explode(masks).alias("mask"))
    return rows.repartition(partitions(fps), "mask", F.col("fp").bitwiseAND(F.col("mask")))


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints, enough to connect all that lie within the radius of each other.

    Within a run that shares a mask's bits, the links found are reduced to a forest before they leave the task, so a
    group of n near copies gives n - 1 edges and not all pairs. Runs above ``LONG_RUN`` are not compared at once: their
    fingerprints come back under further masks, inside the bits that the run does not share, until all runs are short
    or no bits are left to tell them apart.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in bands(radius)])
    rows, found = _exploded(fps, masks), None
    while True:
        out, seen = settle_measured(
            rows.mapInArrow(_compare(radius), "a long, b long, mask long"), "simhash-links", left=F.count("mask")
        )
        edges = out.where(F.col("mask").isNull()).select("a", "b")
        found = edges if found is None else found.union(edges)
        if not seen["left"]:
            return found
        rows = _further(out.where(F.col("mask").isNotNull()).select(F.col("a").alias("fp"), "mask"), radius)


def _further(rows: DataFrame, radius: int) -> DataFrame:
    """Rows of long runs under finer masks: the shared bits and two groups of the others."""
    known = [r.mask for r in rows.select("mask").distinct().collect()]  # no more than there are masks
    choice = F.lit(None).cast("array<long>")
    for mask in known:
        taken = mask & ((1 << BITS) - 1)
        finer = [_signed(taken | m) for m in bands(radius, ~taken & ((1 << BITS) - 1))]
        choice = F.when(F.col("mask") == mask, F.array(*[F.lit(m) for m in finer])).otherwise(choice)
    dealt = rows.select("fp", F.explode(choice).alias("mask"))
    return dealt.repartition(partitions(rows), "mask", F.col("fp").bitwiseAND(F.col("mask")))


def _compare(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("mask").to_numpy(), b.column("fp").to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        mask, fp = (np.concatenate(c).view(np.uint64) for c in zip(*got, strict=True))
        order = np.lexsort((fp, fp & mask, mask))
        mask, fp = mask[order], fp[order]
        fresh = np.ones(len(fp), bool)
        fresh[1:] = (mask[1:] != mask[:-1]) | ((fp & mask)[1:] != (fp & mask)[:-1])
        begins = np.flatnonzero(fresh)
        lengths = np.diff(np.append(begins, len(fp)))
        finer = _can_be_cut(mask[begins], radius)
        long = (lengths > LONG_RUN) & finer
        later = np.repeat(long, lengths)
        for start in range(0, int(later.sum()), 1 << 16):
            part = np.flatnonzero(later)[start : start + (1 << 16)]
            yield _batch(fp[part], fp[part], mask[part])
        for a, b in _linked(fp, begins[~long], lengths[~long], radius):
            yield _batch(a, b, None)

    return rows


def _can_be_cut(masks: np.ndarray, radius: int) -> np.ndarray:
    """Whether enough bits lie outside a mask to deal them into groups again."""
    outside = BITS - np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
    return outside >= 2 * (radius + 2)


def _batch(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None) -> pa.RecordBatch:
    kept = pa.nulls(len(a), pa.int64()) if mask is None else pa.array(mask.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), kept], names=["a", "b", "mask"])


def _linked(fp: np.ndarray, begins: np.ndarray, lengths: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A forest over each run's links. Runs of one have none."""
    begins, lengths = begins[lengths > 1], lengths[lengths > 1]
    if not len(begins):
        return
    # Long runs first: at a distance of s places only a prefix still holds pairs.
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    place = np.repeat(begins - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    fp, run = fp[place], np.repeat(np.arange(len(lengths)), lengths)
    planes = _planes(fp)
    root = np.arange(len(fp))
    reach = np.cumsum(lengths)
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for lag in range(1, int(lengths[0])):
        n = int(reach[np.searchsorted(-lengths, -lag, "left") - 1])
        same = np.zeros(-(-n // 64) * 64, bool)
        same[: n - lag] = run[: n - lag] == run[lag:n]
        alive = np.packbits(same, bitorder="little").view(np.uint64)
        words = np.flatnonzero(alive)
        waiting.append((words, np.full(len(words), lag), alive[words]))
        held += len(words)
        if held >= STEP:
            _join(root, *_within(planes, waiting, radius))
            waiting, held = [], 0
    if held:
        _join(root, *_within(planes, waiting, radius))
    moved = np.flatnonzero(root != np.arange(len(root)))
    if len(moved):
        yield fp[moved], fp[root[moved]]


def _planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word, with room for shifted reads."""
    words = -(-len(fp) // 64)
    bits = np.zeros((BITS, (2 * words + 2) * 64), np.uint8)
    bits[:, : len(fp)] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _within(planes: np.ndarray, waiting: list, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and i + lag of all waiting comparisons whose distance is at most the radius."""
    word, lag, alive = (np.concatenate(c) for c in zip(*waiting, strict=True))
    counter = [np.zeros(len(word), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(word), np.uint64)
    for bit in range(0, BITS, 2):
        far, turn = word + lag // 64, (lag % 64).astype(np.uint64)
        x, y = (planes[b, word] ^ _turned(planes[b], far, turn) for b in (bit, bit + 1))
        # Two planes enter the lowest counter at once; what they carry ripples upwards.
        carry = (counter[0] & (x | y)) | (x & y)
        counter[0] = counter[0] ^ x ^ y
        for i in range(1, len(counter)):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
        if bit % 8 == 6:
            alive = alive & ~(over | _above(counter, radius))
            kept = np.flatnonzero(alive)
            if len(kept) < len(alive):
                word, lag, alive, over = word[kept], lag[kept], alive[kept], over[kept]
                counter = [c[kept] for c in counter]
            if not len(word):
                break
    row, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    first = word[row] * 64 + lane
    return first, first + lag[row]


def _turned(plane: np.ndarray, far: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The plane's words from a place that need not be a word's edge."""
    return (plane[far] >> turn) | ((plane[far + 1] << np.uint64(1)) << (np.uint64(63) - turn))


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius, compared from the highest bit down."""
    more, equal = np.uint64(0), _ALL
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            equal = equal & counter[i]
        else:
            more = more | (equal & counter[i])
            equal = equal & ~counter[i]
    return more


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the trees of linked places under the smaller root."""
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(root, b, a)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def near_duplicates(
    docs: DataFrame, shingle: int, radius: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document ``doc_id, fingerprint, component_id``: 16 hex digits, and the smallest doc_id that links reach.

    Documents link when their fingerprints differ in at most ``radius`` bits; links chain. Texts without a word, null
    texts among them, have fingerprint 0 and link like any other. Equal fingerprints are one node of the graph, however
    many documents share it. Repeated rows each get their row; a null id stays null and is never a component's
    id unless the whole component lacks ids; an empty table gives no rows; other columns are ignored.
    """
    marked, groups = _grouped(docs, shingle, radius, key, text)
    # Very many documents may share a fingerprint, so their rows are left to be split.
    named = groups.select(F.col("fp").alias("node"), "component_id")
    return lookup(marked, named, [("fp", "node")], "inner").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _grouped(docs: DataFrame, shingle: int, radius: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every document's ``doc_id, fp``; every fingerprint's ``fp, first, root, component_id``: the smallest id that has
    it, the component's smallest fingerprint and the component's smallest id."""
    if not 1 <= radius <= 30:
        raise ValueError("the radius must be between 1 and 30")
    marked = settle(fingerprints(docs, shingle, key, text), "simhash")
    firsts = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    members = components(links(firsts.select("fp"), radius))
    ids = members.join(firsts, F.col("node") == F.col("fp")).groupBy(F.col("root").alias("top")).agg(F.min("first").alias("component_id"))
    named = lookup(members.withColumn("kept_root", F.col("root")), ids, [("root", "top")], "inner")
    named = named.select(F.col("node").alias("fp"), F.col("kept_root").alias("root"), "component_id")
    groups = firsts.join(named, "fp", "left")
    return marked, groups.select(
        "fp", "first", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id")
    )


def keep_one_each(docs: DataFrame, shingle: int, radius: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns as they are, one of each group: that with the smallest id.

    An id that several rows hold names none of them, so such rows are told apart by their fingerprints: rows of one id
    in different groups each stand for their own group. Of rows that repeat the chosen id and fingerprint, that with the
    smallest text stays. Rows without an id stay: nothing names them.
    """
    marked, groups = _grouped(docs, shingle, radius, key, text)
    chosen = groups.where(F.col("first").isNotNull()).groupBy("root").agg(F.min(F.struct("first", "fp")).alias("m"))
    kept = settle(chosen.select(F.col("m.first").alias("kept_id"), F.col("m.fp").alias("kept_fp")), "simhash-kept")
    several = marked.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = settle(several.select(F.col("doc_id").alias("many")), "simhash-repeated-ids")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(key).cast("long").alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"), whole.alias("__row"))
    single = kept.join(several, F.col("kept_id") == F.col("many"), "left_anti")
    once = rows.join(single, F.col("__id") == F.col("kept_id"), "left_semi")
    # Only rows of repeated ids are hashed again and compared with each other.
    again = lookup(rows, several, [("__id", "many")], "left_semi").withColumn("__fp", _hashed(shingle)("__text"))
    met = lookup(again, kept, [("__id", "kept_id"), ("__fp", "kept_fp")], "left_semi")
    one = met.groupBy("__id", "__fp").agg(F.min_by("__row", "__text").alias("__row"))
    found = once.select("__row").union(one.select("__row")).union(rows.where(F.col("__id").isNull()).select("__row"))
    return found.select("__row.*")


def _hashed(shingle: int) -> Callable[[str], Column]:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of
