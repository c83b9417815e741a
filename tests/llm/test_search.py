"""Exact top-k and approximate neighbours against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.llm import cells, impacts, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, v string, b string"

def asked():
    return F.col("vec_id") % 5 == 0



def table(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x", "y") for k, v in rows], SCHEMA).repartition(3)


def usable(rows):
    best = {}
    for k, v in rows:
        if k is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        at = (k, len(v))
        best[at] = min(best[at], v) if at in best else v
    return best


def brute(rows, k, scored, drop_zero=False):
    best = {i: v for i, v in usable(rows).items() if any(v) or not drop_zero}
    out = []
    for (q, n), a in best.items():
        if q % 5 == 0:
            found = sorted((-scored(a, v), i) for (i, m), v in best.items() if i != q and m == n)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def integers(a, b):
    return sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=True))


def plain(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def odd_rows(seed=0, n=60):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-3, 4, 6) / 4).tolist()) for i in range(n)]
    rows += [(None, [1.0] * 6), (1000, None), (1005, [None] * 6), (1010, [1.0, math.nan, 0.0, 0.0, 0.0, 0.0])]
    rows += [(1015, [math.inf] * 6), (1020, [1.0, 2.0]), (1021, [0.5, 2.0]), (1022, [3.0, 2.0]), (1040, [1.0] * 3), (1025, []), (1030, [0.0] * 6), (5, rows[5][1]), (10, [9.0] * 6)]
    return rows


def test_top_k_edge_cases(spark):
    rows = odd_rows()
    found = impacts.top_k(table(spark, rows), asked(), 20).collect()
    assert sorted(map(tuple, found)) == brute(rows, 20, integers)
    few = rows[:7]
    assert sorted(map(tuple, impacts.top_k(table(spark, few), asked(), 20).collect())) == brute(few, 20, integers)
    assert impacts.top_k(table(spark, rows).where("false"), asked()).count() == 0
    assert impacts.top_k(table(spark, rows), F.lit(False)).count() == 0


def test_top_k_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(impacts, "BLOCK", 150)
    monkeypatch.setattr(impacts, "QUERIES", 40)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 0.4, 6)).tolist()) for i in range(600)] + [(i, [0.5] * 6) for i in range(600, 700)]
    assert sorted(map(tuple, impacts.top_k(table(spark, rows), asked(), 7).collect())) == brute(rows, 7, integers)


@pytest.mark.parametrize("scale", [3, 500, 40_000])
@pytest.mark.parametrize("width", [1, 8, 64])
def test_index_stops_on_proof_only(scale, width):
    rng = np.random.default_rng(scale + width)
    x = rng.integers(-scale, scale + 1, (700, width))
    x[100:300] = x[100]
    x[:, 0] = 5
    index = impacts.Index(np.arange(700), x)
    asked_for = np.array([*range(0, 700, 50), 101])
    for q, (rows, scores) in zip(asked_for, index.best(asked_for, x[asked_for], 10), strict=True):
        want = x @ x[q]
        order = [i for i in np.lexsort((np.arange(700), -want)) if i != q][:10]
        assert rows.tolist() == order and scores.tolist() == want[order].tolist()
    (rows, _), = index.best(np.array([-1]), np.zeros((1, width), np.int64), 10)
    assert rows.tolist() == list(range(10))


def test_large_products(spark):
    rows = [(i, [float(2**k)] * 6) for i, k in enumerate([0, 10, 15, 3, 8])]
    assert sorted(map(tuple, impacts.top_k(table(spark, rows), asked(), 3).collect())) == brute(rows, 3, integers)
    with pytest.raises(Exception, match="too large|64 bits|OVERFLOW"):
        impacts.top_k(table(spark, [(0, [1e18] * 6), (1, [1e18] * 6)]), asked()).collect()


def test_neighbours_edge_cases(spark):
    """Below 128 vectors there is one part, so the answer is exact."""
    rows = odd_rows(1)
    found = neighbours.nearest(table(spark, rows), asked(), 20).collect()
    assert sorted(map(tuple, found)) == brute(rows, 20, plain, drop_zero=True)
    assert neighbours.nearest(table(spark, rows).where("false"), asked()).count() == 0
    assert neighbours.nearest(table(spark, rows), F.lit(False)).count() == 0


@pytest.mark.parametrize("kind", ["table", "clusters", "copies"])
def test_recall(spark, kind):
    if kind == "table":
        rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    else:
        rng = np.random.default_rng(8)
        centre = rng.normal(size=(10, 16))
        rows = [(i, (centre[i % 10] + rng.normal(0, 0.5, 16)).tolist()) for i in range(1500)]
        if kind == "copies":
            rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    frame = table(spark, rows)
    found = neighbours.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    x = np.array([np.float32(v) for _, v in rows], float)
    ids = np.array([k for k, _ in rows])
    got, hits, wanted = {}, 0, 0
    for r in found:
        got.setdefault(r.query_id, []).append(r)
    for q, own in got.items():
        scores = np.array([plain(x[np.flatnonzero(ids == q)[0]], v) for v in x])
        scores[ids == q] = -np.inf
        best = np.sort(scores)[::-1][:20]
        assert [r.rank for r in sorted(own, key=lambda r: r.rank)] == list(range(1, 21))
        assert all(r.score == scores[np.flatnonzero(ids == r.vec_id)[0]] for r in own)
        assert [(-r.score, r.vec_id) for r in sorted(own, key=lambda r: r.rank)] == sorted((-r.score, r.vec_id) for r in own)
        hits += sum(r.score >= best[-1] for r in own)
        wanted += 20
    assert len(got) == sum(k % 20 == 0 for k, _ in rows)
    assert hits >= 0.9 * wanted


def test_neighbours_query_returns_every_rank(spark):
    found = entry.queries()["op6_neighbours"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert found.count() == 20 * n


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(640, 8)) + 4 * (np.arange(640) < 400)[:, None]
    part = neighbours.balanced_parts(x, neighbours.neighbour_graph(x, 8), 8, 1)
    assert np.bincount(part, minlength=8).max() <= math.ceil(1.05 * 640 / 8)


def test_cells_keep_one_vector_for_each_id():
    import pyarrow as pa

    ids, x = cells.matrix(pa.table({"vec_id": [3, 1, 3], "v": [[2.0, 1.0], [0.0, 5.0], [2.0, 0.0]]}), "vec_id")
    assert ids.tolist() == [1, 3] and x.tolist() == [[0.0, 5.0], [2.0, 0.0]]
