"""Flows, streams, lineage, vectors, quality, schedules and transforms on small frames."""

from __future__ import annotations

import datetime
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused
from weftline.functions import transforms
from weftline.operators import aggregates, lineage, quality, schedules, vectors
from weftline.operators.quality import Rule
from weftline.plans import domain, flows
from weftline.plans.flows import Graph, Node, Parameter
from weftline.specs import Step, TableSpec
from weftline.streaming import streams


def at(text):
    return F.lit(text).cast("timestamp_ntz")


# -- transforms -----------------------------------------------------------------------------


def test_chain_runs_by_ordinal(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 3, 5),)], "t timestamp_ntz")
    steps = [Step(3, "ToUpper"), Step(1, "FormatDate", {"fmt": " MMM "}), Step(2, "Trim")]
    assert df.select(transforms.chain(F.col("t"), steps)).first()[0] == "MAR"
    with pytest.raises(Refused):
        transforms.chain(F.col("t"), [Step(1, "Reverse")])


def test_format_date_moves_to_a_zone(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 7, 1, 23, 30),)], "t timestamp_ntz")
    assert df.select(transforms.format_date(F.col("t"), "yyyy-MM-dd HH:mm", "Europe/Berlin")).first()[0] == "2024-07-02 01:30"


def test_upper_keeps_the_length_of_a_text(spark):
    texts = ["straße", "ŉ ﬁx", "plain é", "\U000f0000ß a", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(transforms.to_upper(F.col("t"))).collect()]
    assert got == ["STRAßE", "ŉ ﬁX", "PLAIN É", "\U000f0000ß A", None]


def test_boolean_family(spark):
    df = spark.createDataFrame([("TRUE",), (" false ",), ("0",), ("2.5",), ("maybe",), (None,)], "t string")
    assert [r[0] for r in df.select(transforms.boolean(F.col("t"))).collect()] == [True, False, False, True, None, None]


def test_ratio_is_half_even_and_zero_for_no_divisor(spark):
    df = spark.createDataFrame([(9, 4), (47, 20), (5, 0), (1700, 17)], "n int, d int")
    assert [r[0] for r in df.select(transforms.safe_ratio(F.col("n"), F.col("d"))).collect()] == [2.2, 2.4, 0.0, 100.0]


def test_geography_puts_longitude_first(spark):
    df = spark.createDataFrame([(47.6, -122.3, None)], "lat double, lon double, none double")
    got = df.select(
        transforms.point_wkt(F.col("lat"), F.col("lon"), geography=True), transforms.point_wkt(F.col("lat"), F.col("none"))
    ).first()
    assert tuple(got) == ("POINT (-122.3 47.6)", None)


# -- schedules ------------------------------------------------------------------------------


def test_due(spark):
    now = "2026-01-01 00:02:00"
    cases = [
        (None, None, False), ("", None, False), ("abc", None, False), ("0", None, False), ("-5", None, False),
        ("60", None, True), ("60", "2026-01-01 00:00:00", True), ("60", "2026-01-01 00:01:30", False),
        ("60", "2026-01-01 00:01:00", True),
    ]
    df = spark.createDataFrame([(i, s, r) for i, (s, r, _) in enumerate(cases)], "i int, s string, r string")
    df = df.withColumn("r", F.col("r").cast("timestamp_ntz"))
    got = schedules.interval_due(df, "r", "s", at(now)).orderBy("i").collect()
    assert [r["due"] for r in got] == [c[2] for c in cases]
    assert got[6]["next_run"] == datetime.datetime(2026, 1, 1, 0, 1) and got[2]["next_run"] is None


def test_a_slot_exactly_now_is_missed(spark):
    df = spark.createDataFrame([("86400", "2026-01-01 06:00:00"), ("x", "2026-01-01 06:00:00"), ("60", None)], "s string, r string")
    df = df.withColumn("r", F.col("r").cast("timestamp_ntz"))
    first, second, third = schedules.missed_slots(df, "r", "s", at("2026-01-04 06:00:00")).collect()
    assert (first["missed"], first["first_missed"].day, first["latest_missed"].day) == (3, 2, 4)
    assert (second["missed"], second["first_missed"], third["missed"]) == (0, None, 0)


# -- quality --------------------------------------------------------------------------------


def test_rules(spark, rows):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 11.0)], "id int, v double")
    rules = [Rule("set", "NotNull", "v"), Rule("range", "InRange", "v", low=0, high=10), Rule("off", "NotNull", "v", enabled=False)]
    assert rows(quality.check_all(df, rules), "rule", "checked", "violations", "passed") == [
        ("range", 3, 1, False), ("set", 3, 1, False)
    ]
    assert {r["id"]: r["broken_rules"] for r in quality.failures(df, rules).collect()} == {2: ["set"], 3: ["range"]}
    assert quality.check(df, Rule("low", "InRange", "v", low=5.0)).first()["passed"] is True
    with pytest.raises(Refused):
        Rule("x", "Unique", "v")


# -- aggregates -----------------------------------------------------------------------------


def test_stat_set_counts_nulls_and_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1, None), (None, 3, 2.0), (None, 3, None)], "g string, x int, y double")
    got = {(r["g"], r["column"]): r for r in aggregates.stat_set(df, ["x", "y"], ["g"]).collect()}
    assert got[None, "x"]["distinct_values"] == 1 and got[None, "x"]["sum_value"] == 6.0
    assert (got["a", "y"]["n"], got["a", "y"]["nulls"], got["a", "y"]["distinct_values"], got["a", "y"]["mean_value"]) == (0, 1, 0, None)
    empty = aggregates.stat_set(df.where("x > 9"), ["x"]).first()
    assert (empty["n"], empty["distinct_values"]) == (0, 0)


def test_precompute_picks_the_stale_ones(spark):
    df = spark.createDataFrame(
        [("a", 9, None), ("b", 7, "2024-01-01"), ("c", 8, "2024-03-01"), ("d", 2, None)], "k string, executions int, c string"
    ).select("k", "executions", F.col("c").cast("timestamp_ntz").alias("last_cached_at"))
    assert [r["k"] for r in aggregates.precompute_stale(df, at("2024-02-01"), "k").collect()] == ["a", "b"]


# -- vectors --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    data = rng.integers(-3, 4, size=(300, 4)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "id long, v array<float>").repartition(5)


def brute(data, q, k):
    with np.errstate(invalid="ignore", divide="ignore"):
        distances = 1 - data @ q / (np.linalg.norm(data, axis=1) * np.linalg.norm(q))
    usable = [(round(d, 9), i) for i, d in enumerate(distances) if not np.isnan(d)]
    return [i for _, i in sorted(usable)[:k]]


def test_nearest_skips_zero_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0])], "id long, v array<float>")
    got = vectors.nearest(df, "v", [1.0, 0.0, 0.0], 5, "id").collect()
    assert [(r["id"], r["distance"]) for r in got] == [(1, 0.0), (3, 1.0)]
    assert [r["id"] for r in vectors.nearest(df, "v", [1.0, 0.0, 0.0], 5, "id", where=F.col("id") > 1).collect()] == [3]


@pytest.mark.parametrize("block", [4, 4_000_000])
def test_nearest_batch_equals_brute_force(spark, cloud, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_VALUES", block)
    data, df = cloud
    wanted = [3, 7, 11]
    queries = df.where(F.col("id").isin(wanted))
    got = vectors.nearest_batch(df, "v", "id", queries.select(F.col("id").alias("q"), "v"), "v", "q", 6).collect()
    for q in wanted:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["place"])
        assert [round(r["distance"], 6) for r in mine] == [
            round(float(1 - data[i] @ data[q] / (np.linalg.norm(data[i]) * np.linalg.norm(data[q]))), 6) + 0.0 for i in brute(data, data[q], 6)
        ]


def test_tasks_do_not_need_the_package(tmp_path):
    import pathlib
    import subprocess
    import sys

    import pyarrow as pa
    from pyspark import cloudpickle

    schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
    (tmp_path / "task").write_bytes(cloudpickle.dumps(vectors._task([0], np.array([[1.0, 0.0]]), 1, schema)))
    load = "import pickle, sys; f = pickle.load(open('task', 'rb')); print(f.__name__, 'weftline' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", load], cwd=pathlib.Path(tmp_path), capture_output=True, text=True, check=True)
    assert done.stdout.split() == ["run", "False"]


def test_vector_refusals(cloud):
    _, df = cloud
    with pytest.raises(Refused, match="limit"):
        vectors.nearest(df, "v", [1.0], 11, "id", max_rows=10)
    with pytest.raises(Refused, match="no vectors"):
        vectors.nearest(df, "id", [1.0], 1, "id")
    with pytest.raises(Refused, match="distance"):
        vectors.nearest(df, "v", [1.0], 1, "id", metric="manhattan")


# -- lineage --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tangle(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(38)} | {(50, 51), (51, 52), (52, 50), (60, 60)}
    return sorted(pairs), spark.createDataFrame(sorted(pairs), "src long, dst long")


def walk(pairs, start, hops=None):
    seen, frontier, depth = {start: 0}, {start}, 0
    while frontier and (hops is None or depth < hops):
        depth += 1
        frontier = {b for a, b in pairs if a in frontier} - set(seen)
        seen |= dict.fromkeys(frontier, depth)
    return seen


@pytest.mark.parametrize("start", [0, 7, 51])
def test_closures_end_on_cycles(tangle, start):
    pairs, edges = tangle
    down = {n: d for n, d in walk(pairs, start).items() if d}
    assert {r["node"]: r["distance"] for r in lineage.downstream(edges, start).collect()} == down
    back = [(b, a) for a, b in pairs]
    up = {n: d for n, d in walk(back, start).items() if d}
    assert {r["node"]: r["distance"] for r in lineage.upstream(edges, start).collect()} == up
    near = walk(pairs + back, start, 2)
    assert {r["node"]: r["distance"] for r in lineage.neighbourhood(edges, start, 2).collect()} == near


def test_groups_equal_brute_force(spark, tangle):
    pairs, edges = tangle
    chain = [(i, i + 1) for i in range(100, 130)]
    every = pairs + chain
    both = every + [(b, a) for a, b in every]
    want = {n: min(walk(both, n)) for n in {x for p in every for x in p}}
    more = edges.unionByName(spark.createDataFrame(chain, "src long, dst long"))
    assert {r["node"]: r["group_id"] for r in lineage.groups(more).collect()} == want


def test_path_is_shortest_and_smallest(spark):
    pairs = [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "x"), ("x", "y"), ("y", "e"), ("e", "a")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    assert [r["node"] for r in lineage.path(edges, "a", "e").orderBy("position").collect()] == ["a", "b", "d", "e"]
    assert lineage.path(edges, "a", "zz").count() == 0
    assert [r["node"] for r in lineage.path(edges, "a", "a").collect()] == ["a"]


def test_neighbours_answer_edges_between_them(spark, rows):
    edges = spark.createDataFrame([("a", "n"), ("n", "b"), ("a", "b"), ("b", "z")], "src string, dst string")
    nodes, inner = lineage.neighbours(edges, "n")
    assert rows(nodes) == [("a", "upstream"), ("b", "downstream")]
    assert rows(inner) == [("a", "b"), ("a", "n"), ("n", "b")]


def test_tree_paths(spark, rows):
    nodes = spark.createDataFrame([(1, None, "all"), (2, 1, "b"), (3, 2, "c"), (9, 8, "lost")], "id int, parent_id int, name string")
    assert rows(lineage.tree_paths(nodes)) == [(1, "all", 0), (2, "all/b", 1), (3, "all/b/c", 2)]
    assert rows(lineage.tree_children(nodes, None), "name") == [("all",)]


# -- flows ----------------------------------------------------------------------------------


def test_player_flow_counts_what_it_drops(spark):
    lines = spark.createDataFrame(
        [("a", "QB", 16, 4400, 120, None), ("b", "WR", 15, None, None, 1650), ("c", "qb", 9, 310, None, None), ("d", "TE", 0, None, None, None)],
        "name string, position string, games int, passing int, rushing int, receiving int",
    )
    got = {r["name"]: (r["total"], r["rating"], r["classification"]) for r in flows.player_lines(lines, 0).collect()}
    assert got["a"] == (4520, 282.5, "Elite") and got["b"] == (1650, 110.0, "Pro Bowl")
    assert got["c"][2] == "Rotational" and got["d"] == (0, 0.0, "Rotational")
    assert {r["name"] for r in flows.player_lines(lines, 12, "qb").collect()} == {"a"}
    assert {r["name"] for r in flows.player_lines(lines, 1, "").collect()} == {"a", "b", "c"}
    assert tuple(flows.player_counts(lines, 12, "QB").first()) == (4, 1, 3)


def test_graph_describes_orders_and_counts(spark):
    graph = Graph(
        [
            Node("even", lambda d: d.where("id % 2 = 0"), ["numbers"]),
            Node("numbers", lambda: spark.range(10)),
            Node("named", lambda d: d.selectExpr("id", "string(id) AS name"), ["even"]),
        ]
    )
    assert [n.name for n in graph.ordered()] == ["numbers", "even", "named"]
    assert graph.describe()["named"] == [("id", "bigint"), ("name", "string")]
    assert graph.sinks() == ["named"]
    counts = flows.edge_counts(graph, "named", lambda df: df.write.format("noop").mode("overwrite").save())
    assert counts == {("numbers", "even"): 10, ("even", "named"): 5}
    part = Graph([*graph.nodes, Node("none", lambda d: d.where("id < 0"), ["even"]), Node("few", lambda a, b: a.limit(2).join(b, "id"), ["numbers", "none"])])
    assert flows.edge_counts(part, "few", lambda df: df.collect()) == {
        ("numbers", "even"): 10, ("even", "none"): 5, ("numbers", "few"): 10, ("none", "few"): 0
    }
    assert [r["id"] for r in flows.edge_sample(graph, "even", ["id"], 2).collect()] == [0, 2]


def test_graph_refusals(spark):
    with pytest.raises(Refused, match="unknown node"):
        Graph([Node("a", lambda d: d, ["b"])])
    with pytest.raises(Refused, match="cycle"):
        Graph([Node("a", lambda d: d, ["b"]), Node("b", lambda d: d, ["a"])]).ordered()
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        Graph([Node("a", lambda: spark.range(1)), Node("b", lambda d: d.select("nope"), ["a"])]).describe()


def test_runs(spark):
    runs = spark.createDataFrame(
        [("a", 1, "2024-01-01", True), ("a", 2, "2024-01-02", False), ("b", 3, "2024-01-01", True)],
        "flow string, run_id int, started_at string, ok boolean",
    )
    assert {r["flow"]: r["run_id"] for r in flows.flow_status(runs).collect()} == {"a": 2, "b": 3}
    assert [r["run_id"] for r in flows.flow_history(runs, "flow", "a").collect()] == [2, 1]


def test_parameters(spark):
    declared = [Parameter("n", T.IntegerType(), 3), Parameter("s", T.StringType())]
    bound = flows.bind_parameters(declared, {"s": "x"})
    assert tuple(spark.range(1).select(bound["n"], bound["s"]).first()) == (3, "x")
    with pytest.raises(Refused, match="other"):
        flows.bind_parameters(declared, {"other": 1})


def test_transfer_needs_the_player(spark, rows):
    players = spark.createDataFrame([(1, 10), (2, 10)], "id int, team_id int")
    spec = TableSpec("players", ["id", "team_id"], "id")
    assert rows(domain.transfer(players, spec, 2, 11).state) == [(1, 10), (2, 11)]
    with pytest.raises(Refused):
        domain.transfer(players, spec, 3, 11)


# -- streams --------------------------------------------------------------------------------


@pytest.fixture
def event_files(spark, tmp_path):
    schema = "id long, ts timestamp_ntz, service string"
    folder = str(tmp_path / "events")
    base = datetime.datetime(2024, 1, 1)
    for part in range(4):
        rows = [(part * 10 + i, base + datetime.timedelta(minutes=part * 40 + i * 7), "ab"[i % 2]) for i in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.read.parquet(folder).schema


def test_stream_equals_batch(spark, rows, event_files):
    folder, schema = event_files

    def transform(df):
        return df.where(F.col("service") == "a").select("id", F.upper("service").alias("service"))

    stream = streams.read_stream(spark, folder, schema, files_per_trigger=1)
    assert rows(streams.run_available(spark, stream, transform, "t")) == rows(transform(spark.read.parquet(folder)))


def test_throughput_stream_equals_batch(spark, rows, event_files):
    folder, schema = event_files
    stream = streams.read_stream(spark, folder, schema, files_per_trigger=1)
    got = streams.keep_latest_counts(spark, stream, "ts", "service", "1 hour", "1 day", "t")
    assert rows(got) == rows(aggregates.throughput(spark.read.parquet(folder), "ts", "service", "1 hour"))


def test_append_stream_emits_closed_windows_only(spark, event_files, tmp_path):
    folder, schema = event_files
    stream = streams.read_stream(spark, folder, schema, files_per_trigger=1)
    target = str(tmp_path / "out")
    query = streams.start_counts(stream, "ts", "service", "1 hour", "0 seconds", target, str(tmp_path / "state"))
    query.awaitTermination()
    closed = spark.read.parquet(target)
    batch = aggregates.throughput(spark.read.parquet(folder), "ts", "service", "1 hour")
    assert closed.join(batch, ["window_start", "service"]).where(closed["events"] > batch["events"]).count() == 0
    assert 0 < closed.count() <= batch.count()


def test_late_rows_are_counted(spark, tmp_path):
    schema, base, folder = "id long, ts timestamp_ntz, service string", datetime.datetime(2024, 1, 1), tmp_path / "late"
    folder.mkdir()
    # Files are taken in the order of their age. A batch drops by the watermark that the batch before it began with.
    for i, hours in enumerate([0, 48, 49, 1]):
        rows = [(10 * i + j, base + datetime.timedelta(hours=hours), s) for j, s in enumerate("ab")]
        spark.createDataFrame(rows, schema).toPandas().astype({"ts": "datetime64[us]"}).to_parquet(folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i * 60,) * 2)
    stream = streams.read_stream(spark, str(folder), spark.read.parquet(str(folder)).schema, files_per_trigger=1)
    query = streams.start_counts(stream, "ts", "service", "1 hour", "1 hour", str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert streams.late_rows(query) == 2
