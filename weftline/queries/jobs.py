"""Flows, streams, lineage and the sample domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import lineage
from weftline.plans import domain, flows
from weftline.plans.flows import Graph, Node, Parameter
from weftline.queries.fields import FLOW_BANDS, RATIO, YARDAGE, yardage
from weftline.queries.registry import money, moment, query, table
from weftline.specs import TableSpec
from weftline.streaming import streams

# -- flows ----------------------------------------------------------------------------------


@query(
    "demo_flow",
    f"""SELECT player, position, games, passing, rushing, receiving, total, {RATIO} AS rating, {FLOW_BANDS} AS classification
        FROM ({YARDAGE}) WHERE games >= 25 AND lower(position) = 'economy'""",
)
def demo_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.player_lines(yardage(spark, sf_dir), 25, "Economy")


@query(
    "demo_flow_counts",
    f"""SELECT count(*) AS extracted, count(*) FILTER (WHERE games >= 25) AS transformed, count(*) FILTER (WHERE games < 25) AS failed
        FROM ({YARDAGE})""",
)
def demo_flow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.player_counts(yardage(spark, sf_dir), 25)


def revenue_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Open orders joined with their customers, summed per segment."""
    return Graph(
        [
            Node("per_segment", lambda d: d.groupBy("c_mktsegment").agg(F.sum("amount").cast("double").alias("revenue")), ["joined"]),
            Node("joined", lambda o, c: o.join(c, o["o_custkey"] == c["c_custkey"]), ["open", "customers"]),
            Node("open", lambda o: o.where(F.col("o_orderstatus") == "O").withColumn("amount", money("o_totalprice")), ["orders"]),
            Node("orders", lambda: table(spark, sf_dir, "orders")),
            Node("customers", lambda: table(spark, sf_dir, "customer")),
        ]
    )


@query(
    "graph_flow",
    """SELECT c_mktsegment, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY c_mktsegment""",
)
def graph_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revenue_graph(spark, sf_dir).run()["per_segment"]


@query(
    "edge_metrics",
    """SELECT 'orders' AS source, 'open' AS target, count(*) AS records FROM orders
       UNION ALL SELECT 'customers', 'joined', count(*) FROM customer
       UNION ALL SELECT 'open', 'joined', count(*) FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT 'joined', 'per_segment', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'""",
)
def edge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow runs once; the counts were observed on the way."""
    graph = revenue_graph(spark, sf_dir)
    counts = flows.edge_counts(graph, "per_segment", lambda df: df.write.format("noop").mode("overwrite").save())
    rows = [(a, b, n) for (a, b), n in counts.items()]
    return spark.createDataFrame(rows, "source string, target string, records long")


@query(
    "edge_sample",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25""",
)
def edge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = flows.edge_sample(revenue_graph(spark, sf_dir), "open", ["o_orderkey"], 25)
    return sample.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "flow_history",
    """SELECT event_type AS flow, user_id AS run_id, ts AS started_at FROM events WHERE event_type = 'click'
       ORDER BY started_at DESC, run_id DESC""",
)
def flow_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("flow"), F.col("user_id").alias("run_id"), F.col("ts").alias("started_at")
    )
    return flows.flow_history(runs, "flow", "click")


@query(
    "flow_parameters",
    """SELECT o_orderkey, o_totalprice, 'EUR' AS currency, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 1.5 AS DOUBLE) AS converted
       FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'""",
)
def flow_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = [
        Parameter("since", T.TimestampNTZType(), "1995-01-01"),
        Parameter("rate", T.DecimalType(4, 2), "1.50"),
        Parameter("currency", T.StringType(), "EUR"),
    ]
    bound = flows.bind_parameters(declared, {"since": "1999-01-01"})
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= bound["since"]).select(
        "o_orderkey",
        "o_totalprice",
        bound["currency"].alias("currency"),
        (money("o_totalprice") * bound["rate"]).cast("double").alias("converted"),
    )


@query(
    "flow_status",
    """SELECT event_type AS flow, user_id AS run_id, ts AS started_at, "value" < 40 AS succeeded FROM events
       QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, user_id DESC) = 1""",
)
def flow_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("flow"),
        F.col("user_id").alias("run_id"),
        F.col("ts").alias("started_at"),
        (F.col("value") < 40).alias("succeeded"),
    )
    return flows.flow_status(runs)


# -- streams --------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return streams.read_stream(spark, streams.as_pattern(f"{sf_dir.rstrip('/')}/events.parquet"), schema)


@query(
    "stream_flow",
    """SELECT event_id, user_id, upper(event_type) AS event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
       FROM events WHERE event_type <> 'view'""",
)
def stream_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateless flow as a streaming query over all data at hand."""

    def transform(events: DataFrame) -> DataFrame:
        return events.where(F.col("event_type") != "view").select(
            "event_id",
            "user_id",
            F.upper("event_type").alias("event_type"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )

    return streams.run_available(spark, event_stream(spark, sf_dir), transform, "stream-flow")


@query(
    "stream_throughput",
    """SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type,
              count(*) AS events FROM events GROUP BY ALL""",
)
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.keep_latest_counts(
        spark, event_stream(spark, sf_dir), "ts", "event_type", "1 hour", "40 days", "stream-throughput"
    )


# -- lineage --------------------------------------------------------------------------------


def named(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def place_edges(spark: SparkSession, sf_dir: str, region: bool = True) -> DataFrame:
    """region -> nation -> customer -> order."""
    def edges(source: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
        return table(spark, sf_dir, source).select(named(*a).alias("src"), named(*b).alias("dst"))

    parts = [
        edges("customer", ("nation", "c_nationkey"), ("customer", "c_custkey")),
        edges("orders", ("customer", "o_custkey"), ("order", "o_orderkey")),
    ]
    if region:
        parts.append(edges("nation", ("region", "n_regionkey"), ("nation", "n_nationkey")))
    return reduce(DataFrame.unionByName, parts)


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same and order -> part, below one root."""
    regions = table(spark, sf_dir, "region").select(F.lit("world:0").alias("src"), named("region", "r_regionkey").alias("dst"))
    lines = table(spark, sf_dir, "lineitem").select(
        named("order", "l_orderkey").alias("src"), named("part", "l_partkey").alias("dst")
    )
    return place_edges(spark, sf_dir).unionByName(regions).unionByName(lines)


EDGES = """e AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
                 UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
                 UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders)"""
BOTH = "u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"


@query(
    "graph_neighbours",
    f"""WITH {EDGES}, n AS (SELECT src AS node, 'upstream' AS side FROM e WHERE dst = 'nation:4'
                            UNION SELECT dst, 'downstream' FROM e WHERE src = 'nation:4'),
             r AS (SELECT node FROM n UNION SELECT 'nation:4')
        SELECT 'node' AS part, node AS a, side AS b FROM n
        UNION ALL SELECT 'edge', src, dst FROM e WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)""",
)
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = lineage.neighbours(place_edges(spark, sf_dir), "nation:4")
    return nodes.select(F.lit("node").alias("part"), F.col("node").alias("a"), F.col("side").alias("b")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"))
    )


@query(
    "lineage_downstream",
    f"""WITH RECURSIVE {EDGES}, c AS (SELECT dst AS node, 1 AS distance FROM e WHERE src = 'region:1'
                                      UNION SELECT e.dst, distance + 1 FROM c JOIN e ON e.src = c.node)
        SELECT node, min(distance) AS distance FROM c GROUP BY node""",
)
def lineage_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.downstream(place_edges(spark, sf_dir), "region:1")


@query(
    "lineage_upstream",
    f"""WITH RECURSIVE {EDGES}, c AS (SELECT src AS node, 1 AS distance FROM e WHERE dst = 'order:7'
                                      UNION SELECT e.src, distance + 1 FROM c JOIN e ON e.dst = c.node)
        SELECT node, min(distance) AS distance FROM c GROUP BY node""",
)
def lineage_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.upstream(place_edges(spark, sf_dir), "order:7")


@query(
    "impact",
    f"""WITH RECURSIVE {EDGES}, c AS (SELECT dst AS node, 1 AS distance FROM e WHERE src = 'nation:3'
                                      UNION SELECT e.dst, distance + 1 FROM c JOIN e ON e.src = c.node)
        SELECT node, min(distance) AS distance FROM c GROUP BY node""",
)
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.impact(place_edges(spark, sf_dir), "nation:3")


@query(
    "lineage_path",
    """WITH p AS (SELECT DISTINCT ['world:0', 'region:' || n_regionkey, 'nation:' || n_nationkey, 'customer:' || c_custkey,
                         'order:' || o_orderkey, 'part:7'] AS nodes
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
                  JOIN nation ON c_nationkey = n_nationkey WHERE l_partkey = 7),
            b AS (SELECT min(nodes) AS nodes FROM p)
       SELECT CAST(i - 1 AS INTEGER) AS position, nodes[i] AS node FROM b, (SELECT unnest(range(1, 7)) AS i)""",
)
def lineage_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.path(part_edges(spark, sf_dir), "world:0", "part:7")


@query(
    "lineage_neighbourhood",
    f"""WITH RECURSIVE {EDGES}, {BOTH}, c AS (SELECT 'customer:3' AS node, 0 AS distance
              UNION SELECT u.dst, distance + 1 FROM c JOIN u ON u.src = c.node WHERE distance < 3)
        SELECT node, min(distance) AS distance FROM c GROUP BY node""",
)
def lineage_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.neighbourhood(place_edges(spark, sf_dir), "customer:3", 3)


@query(
    "lineage_groups",
    """WITH n AS (SELECT c_nationkey AS g, 'nation:' || c_nationkey AS node FROM customer
                  UNION SELECT c_nationkey, 'customer:' || c_custkey FROM customer
                  UNION SELECT c_nationkey, 'order:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)
       SELECT node, min(node) OVER (PARTITION BY g) AS group_id FROM n""",
)
def lineage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.groups(place_edges(spark, sf_dir, region=False))


def place_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select(
        named("region", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name")
    )
    nation = table(spark, sf_dir, "nation").select(
        named("nation", "n_nationkey").alias("id"), named("region", "n_regionkey").alias("parent_id"), F.col("n_name").alias("name")
    )
    customer = table(spark, sf_dir, "customer").select(
        named("customer", "c_custkey").alias("id"), named("nation", "c_nationkey").alias("parent_id"), F.col("c_name").alias("name")
    )
    return region.unionByName(nation).unionByName(customer)


@query("tree_children", "SELECT 'customer:' || c_custkey AS id, 'nation:6' AS parent_id, c_name AS name FROM customer WHERE c_nationkey = 6")
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.tree_children(place_tree(spark, sf_dir), "nation:6")


@query(
    "category_path",
    """SELECT 'region:' || r_regionkey AS id, r_name AS path, 0 AS depth FROM region
       UNION ALL SELECT 'nation:' || n_nationkey, r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
       UNION ALL SELECT 'customer:' || c_custkey, r_name || '/' || n_name || '/' || c_name, 2
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def category_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.tree_paths(place_tree(spark, sf_dir))


# -- sample domain --------------------------------------------------------------------------


@query(
    "standings",
    """WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, r_name AS conference, n_nationkey AS team_id,
                  count(*) FILTER (WHERE o_orderstatus = 'F') AS wins, count(*) FILTER (WHERE o_orderstatus = 'O') AS losses,
                  count(*) FILTER (WHERE o_orderstatus = 'P') AS ties
                  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
                  JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
       SELECT * FROM s WHERE season = 1997 AND conference = 'ASIA'""",
)
def standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as teams, years as seasons, regions as conferences, order outcomes as results."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    status = F.col("o_orderstatus")
    keys = [F.year("o_orderdate").alias("season"), F.col("r_name").alias("conference"), F.col("n_nationkey").alias("team_id")]
    results = orders.groupBy(*keys).agg(
        F.count_if(status == "F").alias("wins"),
        F.count_if(status == "O").alias("losses"),
        F.count_if(status == "P").alias("ties"),
    )
    return domain.standings(results, 1997, "ASIA")


@query(
    "games",
    """WITH g AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(week(o_orderdate) AS INTEGER) AS week,
                  o_orderdate AS game_date, c_nationkey AS home_team_id, away_team_id
                  FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, min(s_nationkey) AS away_team_id
                  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) ON l_orderkey = o_orderkey)
       SELECT * FROM g WHERE season = 1998 AND (home_team_id = 9 OR away_team_id = 9)""",
)
def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games: the customer's nation at home, the first supplying nation away."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    away = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(
        F.min("s_nationkey").alias("away_team_id")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("home_team_id"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        "o_custkey",
        F.year("o_orderdate").alias("season"),
        F.weekofyear("o_orderdate").alias("week"),
        F.col("o_orderdate").alias("game_date"),
    )
    played = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(away, F.col("id") == F.col("l_orderkey"))
    columns = ["id", "season", "week", "game_date", "home_team_id", "away_team_id"]
    return domain.games(played.select(*columns), season=1998, team=9)


PLAYERS = TableSpec("players", ["id", "team_id", "last_name", "position", "is_active"], "id", ["id"])
PLAYER_SQL = """SELECT c_custkey AS id, c_nationkey AS team_id, c_name AS last_name, c_mktsegment AS position, c_acctbal > 3000 AS is_active FROM customer"""


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as players of their nation's team."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("team_id"),
        F.col("c_name").alias("last_name"),
        F.col("c_mktsegment").alias("position"),
        (F.col("c_acctbal") > 3000).alias("is_active"),
    )


@query("roster", f"SELECT * FROM ({PLAYER_SQL}) WHERE team_id = 11 AND position = 'BUILDING' AND is_active")
def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.roster(players(spark, sf_dir), 11, "BUILDING", True)


@query("boxscore", "SELECT l_orderkey AS game_id, l_partkey AS player_id, l_quantity AS yards FROM lineitem WHERE l_orderkey = 33")
def boxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), F.col("l_partkey").alias("player_id"), F.col("l_quantity").alias("yards")
    )
    return domain.boxscore(stats, 33)


@query("transfer", f"SELECT id, CASE WHEN id = 5 THEN 24 ELSE team_id END AS team_id, last_name, position, is_active FROM ({PLAYER_SQL})")
def transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.transfer(players(spark, sf_dir), PLAYERS, 5, 24).state
