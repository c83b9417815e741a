"""Paths of trees by pointer jumping."""

from __future__ import annotations

import random

import pytest

from weftline.errors import Refused
from weftline.operators import lineage


def plain_paths(rows):
    own = {i: (p, n) for i, p, n in rows if i is not None}
    out = {}
    for i in own:
        at, labels, seen = i, [], set()
        while at is not None and at in own and at not in seen:
            seen.add(at)
            labels.append(own[at][1])
            at = own[at][0]
        if at is None:
            out[i] = (None if None in labels else "/".join(labels[::-1]), len(labels) - 1)
    return out


def paths(spark, rows):
    df = spark.createDataFrame(rows, "id long, parent_id long, name string").repartition(4)
    return {r["id"]: (r["path"], r["depth"]) for r in lineage.tree_paths(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_equal_those_walked_one_by_one(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, *range(max(0, i - 6), i)]) if i else None, rnd.choice(["a", "b", None, "c"])) for i in range(150)]
    # Unknown parents, cycles, what hangs off them, and a row of itself.
    rows += [(900, 999, "x"), (901, 900, "y"), (910, 911, "p"), (911, 912, "q"), (912, 910, "r"), (913, 910, "s"), (920, 920, "t")]
    assert paths(spark, rows) == plain_paths(rows)


def test_a_chain_of_a_thousand_levels_takes_few_rounds(spark, monkeypatch):
    rounds = []
    whole = lineage.settle_measured
    monkeypatch.setattr(lineage, "settle_measured", lambda *a, **k: rounds.append(a[1]) or whole(*a, **k))
    rows = [(i, i - 1 if i else None, "n") for i in range(1000)]
    got = paths(spark, rows)
    assert got[999] == ("/".join(["n"] * 1000), 999) and len(got) == 1000
    assert len(rounds) <= 25


def test_odd_trees(spark):
    rows = [(None, None, "r"), (1, None, "a"), (2, 1, "b"), (None, 2, "nameless"), (None, 77, "nowhere")]
    df = spark.createDataFrame(rows, "id long, parent_id long, name string")
    got = sorted((tuple(r) for r in lineage.tree_paths(df).collect()), key=repr)
    assert got == [(1, "a", 0), (2, "a/b", 1), (None, "a/b/nameless", 2), (None, "r", 0)]
    assert paths(spark, []) == {}
    with pytest.raises(Refused):
        paths(spark, [(1, None, "a"), (1, 1, "b")])
