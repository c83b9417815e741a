"""Groups by forests in tasks, and writes and searches with rows that lack a key."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from weftline.operators import forests, lineage, vectors, writes
from weftline.specs import TableSpec


def plain_groups(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def graphs():
    rnd = random.Random(3)
    chain = [(i, i + 1) for i in range(400)]
    rnd.shuffle(chain)
    return {
        "random": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)],
        "chain": chain,
        "hub": [(7, i) for i in range(500)] + [(600, 601)],
        "loops": [(1, 1), (2, 2), (2, 3)],
        "twice": [(1, 2), (2, 1), (1, 2)],
    }


@pytest.mark.parametrize("name", list(graphs()))
@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("chunk", [60, 1_000_000])
def test_groups_equal_plain_union_find(spark, name, kind, chunk):
    edges = [(f"n{a:04d}", f"n{b:04d}") if kind == "string" else (a, b) for a, b in graphs()[name]]
    df = spark.createDataFrame(edges, f"src {kind}, dst {kind}").repartition(5)
    got = {r["node"]: r["group_id"] for r in lineage.groups(df, chunk=chunk).collect()}
    assert got == plain_groups(edges)


def test_groups_of_nodes_that_no_forest_orders(spark):
    df = spark.createDataFrame([(1.5, 2.5), (2.5, 3.5), (9.0, 9.0)], "src double, dst double")
    assert {r["node"]: r["group_id"] for r in lineage.groups(df).collect()} == {1.5: 1.5, 2.5: 1.5, 3.5: 1.5, 9.0: 9.0}
    assert lineage.groups(df.where("src < 0")).count() == 0


def test_labels_are_the_smallest_nodes():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 3000):
        u, v = rng.integers(0, n, n), rng.integers(0, n, n)
        expected = plain_groups([*zip(u.tolist(), v.tolist(), strict=True), *((i, i) for i in range(n))])
        assert forests.labels(u, v, n).tolist() == [expected[i] for i in range(n)]


def test_a_task_contracts_a_bounded_number_of_edges():
    rnd = random.Random(8)
    edges = [(rnd.randrange(50), rnd.randrange(50)) for _ in range(1000)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    batches = [pa.record_batch([pa.array([a for a, _ in part]), pa.array([b for _, b in part])], names=["a", "b"]) for part in (edges[:400], edges[400:])]
    out = [tuple(r.values()) for b in forests._forest(100)(iter(batches)) for r in b.to_pylist()]
    assert len(out) <= 49 and plain_groups(out) == plain_groups(edges)


def test_a_hub_of_very_many_edges(spark):
    df = spark.range(0, 300_000, 1, 8).selectExpr("id + 1 AS src", "0L AS dst")
    got = lineage.groups(df, chunk=10_000)
    assert got.where("group_id = 0").count() == 300_001


def test_a_wide_tree_needs_no_star_contraction(spark, monkeypatch):
    def refuse(pairs):
        raise AssertionError(f"{pairs.count()} pairs go on")

    monkeypatch.setattr(lineage, "_large_star", refuse)
    df = spark.range(1, 6000, 1, 6).selectExpr("concat('n', lpad(id div 20, 5, '0')) AS src", "concat('n', lpad(id, 5, '0')) AS dst")
    got = lineage.groups(df.repartition(6), chunk=500).collect()
    assert len(got) == len({r["node"] for r in got}) == 6000 and {r["group_id"] for r in got} == {"n00000"}


@pytest.mark.parametrize("chunk", [1, 1_000_000])
def test_loops_and_ends_without_a_node(spark, chunk):
    edges = [(5, 5), (None, 7), (8, None), (None, None), (3, 2), (3, 3), (2, 2), (4, 3), (4, 9), (9, 7), (5, 5)]
    got = lineage.groups(spark.createDataFrame(edges, "src long, dst long").repartition(3), chunk=chunk).collect()
    want = {None: None, 5: 5, 7: 2, 8: 8, 2: 2, 3: 2, 4: 2, 9: 2}
    assert len(got) == len(want) and {r["node"]: r["group_id"] for r in got} == want


def test_saved_rows_without_a_logical_id_stay_current(spark):
    spec = TableSpec("t", ["pk", "a", "v", "IsCurrent", "IsDeleted"], logical_key=["a"], physical_key="pk")
    schema = "pk long, a string, v int, IsCurrent boolean, IsDeleted boolean"
    target = spark.createDataFrame([(1, "x", 1, True, False), (2, None, 2, True, False)], schema)
    rows = spark.createDataFrame([("x", 5), (None, 6), (None, 7), ("y", 8), ("y", 9)], "a string, v int")
    state = {r["v"]: (r["a"], r["IsCurrent"]) for r in writes.version_save(target, rows, spec, ["v"]).state.collect()}
    assert state == {1: ("x", False), 2: (None, True), 5: ("x", True), 6: (None, True), 7: (None, True), 8: ("y", False), 9: ("y", True)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_batch_search_answers_rows_without_a_key(spark, kind):
    big = 2**53 + 1
    rows = [(big, [1.0, 0.0]), (None, [1.0, 0.0]), (big + 2, [0.9, 0.1]), (None, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "k long, v array<double>").selectExpr(f"CAST(k AS {kind}) AS k", "v")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0])], "q long, v array<double>")
    found = vectors.nearest_batch(df, "v", "k", queries, "v", "q", 3).orderBy("query_id", "place").collect()
    for q, vector in ((1, [1.0, 0.0]), (2, [0.0, 1.0])):
        alone = vectors.nearest(df, "v", vector, 3, "k").collect()
        assert [r["k"] for r in found if r["query_id"] == q] == [r["k"] for r in alone]
    assert {r["query_id"] for r in found} == {1, 2}
