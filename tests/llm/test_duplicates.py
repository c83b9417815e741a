"""Repeated passages and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from weftline.llm import repeats, simhash, suffixes
from weftline.llm.components import components


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=600).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 100))
def test_suffix_array_and_common_prefixes(data, depth):
    check_suffixes(data, depth)


@pytest.mark.parametrize("data", [(b"abcab" * 300 + b"xyz" * 100) * 3, b"a" * 2000, bytes(range(256)) * 9, b"ab\0" * 500 + b"\0" * 9])
def test_suffix_array_of_repeated_text(data):
    check_suffixes(data, 100)


def check_suffixes(data, depth):
    text = np.frombuffer(data, np.uint8)
    array, first = suffixes.suffix_array(text, depth)
    # A byte more for each, so that the end of the text is below NUL.
    keys = [tuple(b + 1 for b in data[i : i + depth]) for i in array]
    assert sorted(array.tolist()) == list(range(len(data))) and keys == sorted(keys)
    assert first.tolist() == [True] + [a != b for a, b in zip(keys, keys[1:], strict=False)]

    def shared(a, b):
        return next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    want = [0] + [shared(a, b) for a, b in zip(keys, keys[1:], strict=False)]
    assert suffixes.common_prefixes(suffixes.words(text), array, first, depth).tolist() == want


def test_search_between_texts():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(97, 99, n).astype(np.uint8) for n in (400, 300))
    wa, wb = suffixes.words(a), suffixes.words(b)
    array, _ = suffixes.suffix_array(a, 12)
    array = array[array <= 388]
    wanted = np.arange(289)
    keys = [a.tobytes()[i : i + 12] for i in array]
    import bisect

    assert suffixes.search(wa, array, wb, wanted, 12).tolist() == [bisect.bisect_left(keys, b.tobytes()[i : i + 12]) for i in wanted]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    common = bytes(rng.choices(b"abc ", k=150))
    texts = [bytes(rng.choices(b"abc ", k=rng.randint(0, 80))) + common + bytes(rng.choices(b"abc ", k=50)) for _ in range(5)]
    seen = {}
    for text in texts:
        at, hashes = repeats.anchors(text, 100)
        for i, place in enumerate(at):
            assert i <= place <= i + 100 - repeats.ANCHOR
            assert seen.setdefault(text[i : i + 100], (place - i, hashes[place])) == (place - i, hashes[place])


def removed_by_hand(rows, length):
    first = {}
    for k, text in sorted(rows, key=lambda r: r[0]):
        data = text.encode()
        for i in range(len(data) - length + 1):
            first.setdefault(data[i : i + length], (k, i))
    for k, text in rows:
        data = text.encode()
        mark = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] != (k, i):
                mark[i : i + length] = True
        runs = int((np.diff(mark.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, m in zip(data, mark, strict=True) if not m)
        yield k, len(data), int(mark.sum()), runs, hashlib.sha256(kept).hexdigest()


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["alpha", "béta", "gam", "x", "yy", "zzz\n", "hä", "漢"]
    passages = ["".join(rng.choice(vocabulary) + " " for _ in range(rng.randint(20, 60))) for _ in range(5)]
    rows = []
    for k in range(n):
        parts = [rng.choice([rng.choice(passages), str(rng.random())]) for _ in range(rng.randint(0, 6))]
        rows.append((k * 3, rng.choice(rows)[1] if rows and rng.random() < 0.15 else "".join(parts)))
    return rows


@pytest.mark.parametrize(("length", "shard"), [(100, suffixes.MOST), (100, 700), (40, 3000)])
def test_repeats_against_brute_force(docs, length, shard):
    rows = texts(length + shard, 90) + [(900, "a" * 700), (901, "ab" * 300), (902, "a" * 99), (903, "a" * 100), (904, "")]
    found = repeats.removed(docs(rows), length, shard=shard)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())
    assert got == sorted(removed_by_hand(rows, length))
    assert any(r[2] for r in got)


def test_repeats_query_over_a_table(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = entry.queries()["op3_suffix_dedup"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted(removed_by_hand(rows, 100))


def test_repeats_edge_cases(docs):
    rows = [(None, "q" * 120), (1, None), (2, ""), (3, "q" * 120), (4, "r" * 100), (4, "r" * 100), (5, "s" * 100), (5, "t" * 100)]
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in repeats.removed(docs(rows)).collect())
    assert got == sorted(
        [("None", 120, 119, 1), ("1", 0, 0, 0), ("2", 0, 0, 0), ("3", 120, 120, 1), ("4", 100, 0, 0), ("4", 100, 0, 0)]
        + [("5", 100, 0, 0), ("5", 100, 0, 0)]
    )
    cut = repeats.cut_repeats(docs(rows))
    assert cut.columns == docs(rows).columns
    assert sorted((repr(r.doc_id), r.text, r.tags) for r in cut.collect() if r.doc_id in (None, 1, 2, 3)) == sorted(
        [("None", "q", "x"), ("1", None, "x"), ("2", "", "x"), ("3", "", "x")], key=repr
    )
    assert repeats.removed(docs(rows).where("false")).count() == 0
    assert repeats.cut_repeats(docs(rows).where("false")).count() == 0


def test_lists_of_rows_without_an_id_belong_to_one_text_each(spark, docs):
    shared = "a passage that stands in every one of these texts, well over a hundred bytes long, so that it is cut out of the later ones. "
    rows = [(None, f"{shared}own end {i}") for i in range(60)] + [(None, f"{shared}own end 0")] * 40
    texts = repeats._stored(docs(rows), "doc_id", "text", False)
    spans = repeats._spans(texts, repeats._firsts(texts, 100), 100, repeats.SHARD).collect()
    assert len(spans) >= 59 and max(len(r.spans) for r in spans) < 10
    got = repeats.removed(docs(rows)).collect()
    whole = [r for r in got if not r.n_removed]
    assert len(got) == 100 and len({r.kept_sha256 for r in whole}) == 1


def test_cut_drops_broken_characters(docs):
    common = "é" * 60
    rows = [(1, "x" + common), (2, "y" + common + "漢z")]
    left = {r.doc_id: r.text for r in repeats.cut_repeats(docs(rows)).collect()}
    # Of document 1 the windows that start at bytes 3 and later repeat: 119 of its 121 bytes less the first 100 stay.
    assert left[2] == "y漢z"
    assert left[1].startswith("x") and set(left[1]) <= {"x", "é"}


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert len(found) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text, width):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBÉß \t\n\x0b\x1f ")), max_size=80), st.integers(1, 5))
def test_fingerprint(text, width):
    assert simhash.fingerprint(text, width) == plain_fingerprint(text, width)


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
@pytest.mark.parametrize("long_run", [4096, 40])
def test_links_connect_what_brute_force_links(spark, monkeypatch, radius, long_run):
    rng = np.random.default_rng(radius)
    fps = set()
    for centre in rng.integers(0, 2**63, 60).tolist():
        for _ in range(rng.integers(1, 60)):
            x = centre
            for bit in rng.integers(0, 64, rng.integers(0, 8)).tolist():
                x ^= 1 << bit
            fps.add(x - (1 << 64) if x >> 63 else x)
    nodes = np.array(sorted(fps), np.int64)
    unsigned = nodes.view(np.uint64)
    a, b = np.nonzero(np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= radius)
    want = roots(nodes.tolist(), zip(nodes[a].tolist(), nodes[b].tolist(), strict=True))
    if long_run == 4096:
        edges = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(int(n),) for n in nodes], "fp long"), radius).collect()]
    else:
        monkeypatch.setattr(simhash, "LONG_RUN", long_run)
        edges = _links_in_this_process(unsigned, radius)
    assert roots(nodes.tolist(), edges) == want
    assert len(edges) < 15 * len(nodes) * radius


def _links_in_this_process(fps, radius):
    """The task function by hand, with every long run sent back under finer masks."""
    import pyarrow as pa

    masks = simhash.bands(radius)
    todo = [(m, int(f)) for m in masks for f in fps]
    edges = []
    while todo:
        mask, fp = (np.array(c, np.uint64).view(np.int64) for c in zip(*todo, strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(mask), pa.array(fp)], names=["mask", "fp"])
        todo = []
        for out in simhash._compare(radius)(iter([batch])):
            if out.column("mask").null_count:
                edges += zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)
            else:
                for m, f in zip(out.column("mask").to_numpy().view(np.uint64).tolist(), out.column("a").to_numpy().view(np.uint64).tolist(), strict=True):
                    todo += [(m | x, f) for x in simhash.bands(radius, ~m & (2**64 - 1))]
    return edges


def test_near_duplicates(docs):
    rng = random.Random(4)
    base = [" ".join(rng.choices("abcdefghijklmnopq", k=200)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "new"
        rows.append((i * 2, " ".join(words)))
    rows += [(1, None), (3, ""), (5, " \t "), (0, rows[0][1]), (None, rows[0][1]), (None, "lonely word here"), (7, "w " * 20000)]
    prints = [plain_fingerprint(t or "", 4) for _, t in rows]
    up = list(range(len(rows)))
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = roots(up, edges)
    smallest = {}
    for i, (k, _) in enumerate(rows):
        smallest.setdefault(root[i], []).append(k)
    want = sorted(
        (repr(k), f"{prints[i]:016x}", repr(min((x for x in smallest[root[i]] if x is not None), default=None)))
        for i, (k, _) in enumerate(rows)
    )
    found = simhash.near_duplicates(docs(rows), 4, 4).collect()
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in found) == want
    kept = simhash.keep_one_each(docs(rows), 4, 4)
    assert kept.columns == docs(rows).columns
    ids = sorted({int(w[2]) for w in want if w[2] != "None"})
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == ids
    assert kept.where("doc_id IS NULL").count() == 2
    assert simhash.near_duplicates(docs(rows).where("false"), 4, 4).count() == 0


def test_unrelated_rows_of_one_id_both_stay(docs):
    rng = random.Random(9)
    a, b, c = (" ".join(rng.choices("abcdefghijklmnopq", k=120)) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (6, a), (4, c), (5, c), (7, b), (8, "alone here"), (None, b), (4, "z" + c), (9, None), (9, "")]
    kept = simhash.keep_one_each(docs(rows), 4, 4)
    # Each of the two groups of a and b keeps its row of id 5; c keeps id 4, and its row of id 5 goes.
    got = sorted((repr(r.doc_id), r.text or "") for r in kept.collect())
    near = bin(plain_fingerprint(c, 4) ^ plain_fingerprint("z" + c, 4)).count("1") <= 4
    want = [("5", a), ("5", b), ("4", c), ("8", "alone here"), ("None", b), ("9", "")] + ([] if near else [("4", "z" + c)])
    assert got == sorted(want)


def test_a_hot_fingerprint_is_split(spark):
    """Half of all rows have one fingerprint; no broadcast, so the join has to split them."""
    tight = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    for key, value in tight.items():
        spark.conf.set(key, value)
    try:
        text = F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.concat_ws(" ", F.lit("w"), F.col("id") * 7919, F.col("id") * 104729))
        docs = spark.range(0, 40000, 1, 8).select(F.col("id").alias("doc_id"), text.alias("text"))
        found = simhash.near_duplicates(docs, 4, 4)
        # All columns are asked for, else the ids would not travel.
        # Rows of the hot fingerprint are counted for each task; small partitions of others may be put together.
        hot = F.count_if(F.col("fingerprint") == "0" * 16).alias("n")
        tasks = found.groupBy(F.spark_partition_id()).agg(hot, F.bit_xor(F.xxhash64(*found.columns)))
        sizes = [r["n"] for r in tasks.collect()]
        assert sum(sizes) == 20000 and max(sizes) < 8000
    finally:
        for key in tight:
            spark.conf.unset(key)


def test_simhash_query_over_a_table(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    prints = [plain_fingerprint(t, 4) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = roots(range(len(rows)), edges)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root[i]] = min(k, least.get(root[i], k))
    found = entry.queries()["op5_simhash"](spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted((k, f"{prints[i]:016x}", least[root[i]]) for i, (k, _) in enumerate(rows))
