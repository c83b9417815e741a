"""Archives, packing, and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from weftline.llm import language, packing, repeats, simhash, warc
from weftline.session import scratch_path

PAGES = "page_id long, url string, html string, payload string, digest string, size int"


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "p", "d", 1) for k, u, h in rows], PAGES).repartition(3)


def by_hand(rows, least):
    out = []
    for k, _, html in rows:
        body = (html or "").encode()
        same = [x for x, _, h in rows if (h or "").encode() == body and x is not None]
        newest = max(same, default=None)
        revisit = len(body) >= least and k is not None and newest != k
        out.append((repr(k), len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", newest if revisit else None))
    return sorted(out, key=repr)


def odd_pages():
    rng = random.Random(6)
    body = ["<html>" + " ".join(rng.choices(["alpha", "beta", "gamma", "délta", "漢"], k=rng.randint(1, 600))) for _ in range(40)]
    rows = [(i, f"http://h/{i}", rng.choice(body)) for i in range(160)]
    long = "z" * 1500
    rows += [(None, None, long), (500, "a\r\nInjected: 1", long), (501, None, long), (501, "u", long), (502, "u", None), (503, "u", "")]
    return [*rows, (504, "u", "q" * 999), (505, "u", "q" * 999), (506, "u", "q" * 1000), (507, "u", "q" * 1000), (508, "u", "w" * 300_000)]


@pytest.mark.parametrize("file_bytes", [warc.FILE_BYTES, 2000])
def test_archive_round_trip(spark, file_bytes):
    rows = odd_pages()
    manifest = warc.write_archive(pages(spark, rows), scratch_path(spark, "warc"), file_bytes=file_bytes)
    found = warc.read_archive(manifest).collect()
    got = sorted(((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr)
    assert got == by_hand(rows, 1000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    bodies = {(k, (h or "").encode()) for k, _, h in rows}
    assert all((r.page_id, bytes(r.payload)) in bodies for r in found if r.record_type == "response")
    assert all(r.payload is None for r in found if r.record_type == "revisit")
    assert {r.url for r in found if r.page_id == 500} == {"a%0D%0AInjected: 1"}


def test_files_stand_alone(spark):
    manifest = warc.write_archive(pages(spark, odd_pages()), scratch_path(spark, "warc"))
    for r in manifest.collect():
        store, where = fs.FileSystem.from_uri(r.path)
        data = store.open_input_stream(where).read()
        first = next(iter(warc.frames(memoryview(data))))
        assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
        known = zstandard.ZstdCompressionDict(data[8 : first[1]])
        assert known.dict_id() != 0 and len(data) == r.bytes
        begin, end = list(warc.frames(memoryview(data)))[-1]
        assert zstandard.ZstdDecompressor(dict_data=known).decompress(data[begin:end]).startswith(b"WARC/1.1\r\n")


def test_tiny_and_empty_archives(spark):
    rows = [(1, "u", "tiny"), (2, None, None)]
    found = warc.round_trip(pages(spark, rows)).collect()
    assert sorted(((repr(r[0]), *r[1:]) for r in map(tuple, found)), key=repr) == by_hand(rows, 1000)
    assert warc.round_trip(pages(spark, rows).where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=12))
def test_frames(bodies):
    compressor = zstandard.ZstdCompressor(level=3, write_checksum=bool(len(bodies) % 2))
    parts = [compressor.compress(b) for b in bodies]
    ends = list(itertools.accumulate(map(len, parts)))
    assert [e for _, e in warc.frames(memoryview(b"".join(parts)))] == ends


def test_damage_is_noticed():
    data = zstandard.ZstdCompressor().compress(b"x" * 50)
    with pytest.raises(ValueError, match="inside a frame"):
        list(warc.frames(memoryview(data[:-2])))
    with pytest.raises(ValueError, match="length"):
        warc.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nab\r\n\r\n")


def padding_of(lengths, ends):
    return sum(min(e for e in ends if e >= x) - x for x in lengths)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 25), min_size=1, max_size=40), st.integers(1, 5))
def test_boundaries_are_optimal(lengths, buckets):
    distinct, counts = np.unique(lengths, return_counts=True)
    ends = packing.boundaries(distinct, counts, buckets)
    assert len(ends) <= buckets and ends == sorted(set(ends)) and ends[-1] == max(lengths)
    inner = distinct[:-1].tolist()
    best = min(
        padding_of(lengths, [*some, max(lengths)]) for n in range(min(buckets, len(distinct))) for some in itertools.combinations(inner, n)
    )
    assert padding_of(lengths, ends) == best


def check_packing(rows, lengths, buckets, budget, longest):
    """``lengths``: (doc_id, tokens) of every document, repeats included."""
    want = sorted(
        (repr(k), s, s * longest, min(n - s * longest, longest)) for k, n in lengths for s in range(max(1, -(-n // longest)))
    )
    assert sorted((repr(r.doc_id), r.segment, r.begin, r.length) for r in rows) == want
    sequences = [r.length for r in rows if r.length]
    distinct, counts = np.unique(sequences, return_counts=True)
    ends = packing.boundaries(distinct, counts, buckets) if sequences else []
    batches = {}
    for r in rows:
        if not r.length:
            assert (r.bucket, r.batch, r.place, r.padding) == (0, None, None, 0)
            continue
        assert r.bucket == min(e for e in ends if e >= r.length) and r.padding == r.bucket - r.length
        batches.setdefault(r.bucket, {}).setdefault(r.batch, []).append(r.place)
    for bucket, own in batches.items():
        fits = budget // bucket
        assert sorted(own) == list(range(len(own)))
        for batch, places in own.items():
            assert sorted(places) == list(range(len(places)))
            assert len(places) == fits or batch == max(own) and 0 < len(places) <= fits


def test_packing(spark, docs):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 2, 3, 10, 50, 51, 64, 65, 500]))) for i in range(300)]
    rows += [(None, "a b"), (None, None), (7, rows[7][1]), (7, "x\t\ny \x0b z u"), (1000, "w " * 5000)]
    lengths = [(k, len((t or "").encode().split())) for k, t in rows]
    found = packing.pack(docs(rows), packing.word_count(), buckets=4, budget=256, longest=64).collect()
    check_packing(found, lengths, 4, 256, 64)
    assert packing.pack(docs(rows).where("false"), packing.word_count()).count() == 0
    with pytest.raises(ValueError, match="budget"):
        packing.pack(docs(rows), packing.word_count(), budget=5)


def test_packing_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = entry.queries()["op10_packing"](spark, sf_dir).collect()
    check_packing(found, [(r.doc_id, len((r.text or "").encode().split())) for r in rows], 16, 65536, 2048)


def test_pipeline_stages_against_plain_versions(spark, docs):
    rng = random.Random(11)
    said = {"en": "the cat sat on a mat and ran off with his hat", "fr": "le chat noir dort sur le tapis avec son ami le chien"}
    rows = []
    for i in range(60):
        lang = rng.choice(list(said))
        rows.append((i, " ".join(rng.choices(said[lang].split(), k=rng.randint(3, 90))), lang))
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(10)]
    rows += [(200 + i, "start here " + rows[i][1] + f" {i} end", rows[i][2]) for i in range(20)]
    rows += [(300, None, "en"), (301, "", "en"), (302, "123 !!", "fr"), (303, "Ж", None)]
    frame = spark.createDataFrame([(k, t, g, "s", None) for k, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")

    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "repeated passages", "packing"]
    told = stages["language"](spark, frame, "")
    assert told.columns == frame.columns
    filters = language.learn(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    kept = {k: t for k, t, _ in rows if filters.decide(t)[1] > 0}
    assert {r.doc_id: r.text for r in told.collect()} == kept and set(kept) == {k for k, _, _ in rows} - {300, 301, 302, 303}

    single = stages["near duplicates"](spark, told, "")
    assert single.columns == frame.columns
    prints = {k: simhash.fingerprint(t, 4) for k, t in kept.items()}
    group = {k: k for k in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = group[a], group[b]
                group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    alone = {k: t for k, t in kept.items() if group[k] == k}
    assert {r.doc_id: r.text for r in single.collect()} == alone and len(alone) < len(kept)

    cut = stages["repeated passages"](spark, single, "")
    assert cut.columns == frame.columns
    first, left = set(), {}
    for k in sorted(alone):
        data = alone[k].encode()
        mark = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in first:
                mark[i : i + 100] = True
            first.add(data[i : i + 100])
        left[k] = bytes(b for b, m in zip(data, mark, strict=True) if not m).decode("utf-8", "ignore")
    found = {r.doc_id: (r.text, r.n_chars, r.lang) for r in cut.collect()}
    assert {k: v[0] for k, v in found.items()} == left and left != alone
    assert all(v[1] == len(v[0]) for v in found.values())

    packed = stages["packing"](spark, cut, "").collect()
    check_packing(packed, [(k, len(t.split())) for k, t in left.items()], 16, 65536, 2048)


def test_pipeline_run(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi").count()
    assert 0 < kept < docs.count()
    assert found.columns == ["doc_id", "segment", "begin", "length", "bucket", "batch", "place", "padding"]
    assert "pipeline" in entry.queries() and repeats.ANCHOR <= 100


def test_pipeline_of_an_empty_table(spark, docs):
    frame = docs([(1, "x")]).where("false").drop("tags", "h")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, "")
    assert frame.count() == 0


def test_a_hot_payload_or_content_is_split(spark):
    """Half of all rows share one text; no broadcast, so the join has to split it."""
    tight = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    for key, value in tight.items():
        spark.conf.set(key, value)
    try:
        page = F.when(F.col("id") % 2 == 0, F.lit("x" * 1200)).otherwise(F.concat(F.lit("y" * 1100), F.col("id").cast("string")))
        pages = spark.range(0, 6000, 1, 8).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), page.alias("html"))
        found = warc._classified(pages, 1000, "page_id", "url", "html")
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 6000 and max(sizes) < 1500
    finally:
        for key in tight:
            spark.conf.unset(key)
