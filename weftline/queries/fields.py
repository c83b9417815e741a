"""Field transforms, vector search and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import columntypes, transforms
from weftline.operators import quality, vectors
from weftline.operators.quality import Rule
from weftline.plans.flows import batch_copy
from weftline.queries.reads import LABELLED, labelled
from weftline.queries.registry import money, moment, query, table, text_list
from weftline.session import scratch_path
from weftline.specs import Param, Step

# -- transforms -----------------------------------------------------------------------------


def register_transform(name: str, source: str, key: str, column: str, step: Step, sql: str) -> None:
    """One transform over one column of a whole table."""

    @query(name, f"SELECT {key}, {sql} AS result FROM {source}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        return rows.select(key, transforms.apply_step(F.col(column), step).alias("result"))


register_transform("tf_to_upper", "documents", "doc_id", "text", Step(1, "ToUpper"), "replace(upper(text), 'ẞ', 'ß')")
register_transform("tf_to_lower", "conversations", "conv_id", "text", Step(1, "ToLower"), "lower(text)")
register_transform("tf_static", "supplier", "s_suppkey", "s_name", Step(1, "Static", {"value": "fixed"}), "'fixed'")
register_transform(
    "tf_format_date", "events", "event_id", "ts", Step(1, "FormatDate", {"fmt": "yyyy/MM/dd HH:mm"}), "strftime(ts, '%Y/%m/%d %H:%M')"
)
register_transform(
    "tf_field_param", "part", "p_partkey", "p_name", Step(1, "Inject", {"value": Param("p_brand")}), "p_brand"
)


@query("tf_trim", "SELECT s_suppkey, s_name AS result FROM supplier")
def tf_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("  "), "s_name", F.lit("   "))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", transforms.apply_step(padded, Step(1, "Trim")).alias("result")
    )


@query("tf_round", "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)), 1) AS DOUBLE) AS result FROM lineitem")
def tf_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = transforms.apply_step(money("l_extendedprice"), Step(1, "Round", {"digits": 1})).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", result.alias("result"))


@query(
    "tf_when",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'huge' WHEN o_totalprice > 200000 THEN o_orderpriority ELSE 'small' END AS result
       FROM orders""",
)
def tf_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    cases = [(price > 400000, "huge"), (price > 200000, Param("o_orderpriority"))]
    step = Step(1, "When", {"cases": cases, "otherwise": "small"})
    return table(spark, sf_dir, "orders").select("o_orderkey", transforms.apply_step(price, step).alias("result"))


FLAG_SQL = "CASE p_size % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN '0' WHEN 3 THEN '2.5' ELSE 'maybe' END"


@query("tf_boolean", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true END AS result FROM part")
def tf_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("flag", F.expr(FLAG_SQL))
    return part.select("p_partkey", transforms.apply_step(F.col("flag"), Step(1, "Boolean")).alias("result"))


@query(
    "tf_inject",
    "SELECT r_regionkey, 'run-17' AS run_id, 'region' AS source_name, TIMESTAMP '2024-02-01' AS loaded_at FROM region",
)
def tf_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"run_id": "run-17", "source_name": "region", "loaded_at": moment("2024-02-01")}
    region = table(spark, sf_dir, "region")
    injected = {n: transforms.apply_step(F.lit(None), Step(1, "Inject", {"value": v})) for n, v in values.items()}
    return region.withColumns(injected).select("r_regionkey", *values)


@query(
    "transform_chain",
    """SELECT event_id, upper(trim(strftime(ts, ' %b %Y'))) AS result FROM events""",
)
def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed out of order; run by ordinal."""
    steps = [Step(3, "ToUpper"), Step(2, "Trim"), Step(1, "FormatDate", {"fmt": " MMM yyyy"})]
    return table(spark, sf_dir, "events").select("event_id", transforms.chain(F.col("ts"), steps).alias("result"))


def yardage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as players: quantities per return flag as nullable yards, lines as games."""
    def yards(flag: str):
        return F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity").cast("decimal(18,0)")))

    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("player")).agg(
        F.count(F.lit(1)).alias("games"),
        (yards("A") * 3).cast("long").alias("passing"),
        (yards("N") * 2).cast("long").alias("rushing"),
        yards("R").cast("long").alias("receiving"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), F.col("p_type").alias("position"))
    return part.join(lines, "player", "left").withColumn("games", F.coalesce("games", F.lit(0)))


YARDAGE = """SELECT p_partkey AS player, p_type AS position, coalesce(games, 0) AS games, passing, rushing, receiving,
                    coalesce(passing, 0) + coalesce(rushing, 0) + coalesce(receiving, 0) AS total
             FROM part LEFT JOIN (SELECT l_partkey, count(*) AS games,
                    CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'A') * 3 AS BIGINT) AS passing,
                    CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'N') * 2 AS BIGINT) AS rushing,
                    CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS receiving
                    FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey"""
BANDS = """CASE WHEN total >= 4000 THEN 'MVP Candidate' WHEN total >= 2000 THEN 'Elite' WHEN total >= 1500 THEN 'Pro Bowl'
                WHEN total >= 1000 THEN 'Starter' WHEN total >= 500 THEN 'Backup' ELSE 'Rotational' END"""
FLOW_BANDS = """CASE WHEN total >= 2000 THEN 'Elite' WHEN total >= 1500 THEN 'Pro Bowl' WHEN total >= 1000 THEN 'Starter'
                     WHEN total >= 500 THEN 'Backup' ELSE 'Rotational' END"""
RATIO = "CASE WHEN games = 0 THEN 0 ELSE CAST(round_even(CAST(total AS DOUBLE) / games, 1) AS DOUBLE) END"


@query("sum_null_as_zero", f"SELECT player, total FROM ({YARDAGE})")
def sum_null_as_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(c) for c in ("passing", "rushing", "receiving")]
    return yardage(spark, sf_dir).select("player", transforms.sum_null_as_zero(*parts).alias("total"))


@query("classify_bands", f"SELECT player, total, {BANDS} AS classification FROM ({YARDAGE})")
def classify_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(c) for c in ("passing", "rushing", "receiving")]
    rows = yardage(spark, sf_dir).select("player", transforms.sum_null_as_zero(*parts).alias("total"))
    band = transforms.classify_bands(F.col("total"), transforms.YARDAGE_BANDS, transforms.LOWEST_BAND)
    return rows.withColumn("classification", band)


@query("safe_ratio", f"SELECT player, {RATIO} AS rating FROM ({YARDAGE})")
def safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(c) for c in ("passing", "rushing", "receiving")]
    rows = yardage(spark, sf_dir).withColumn("total", transforms.sum_null_as_zero(*parts))
    return rows.select("player", transforms.safe_ratio(F.col("total"), F.col("games")).alias("rating"))


@query(
    "to_point_wkt",
    """SELECT l_orderkey, l_linenumber, 'POINT (' || CAST(l_partkey AS VARCHAR) || ' ' || CAST(l_suppkey AS VARCHAR) || ')' AS geometry,
              'POINT (' || CAST(l_suppkey AS VARCHAR) || ' ' || CAST(l_partkey AS VARCHAR) || ')' AS geography, 4326 AS srid FROM lineitem""",
)
def to_point_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        transforms.spatial_value(x, y, 0).alias("flat"),
        transforms.spatial_value(x, y, 4326, geography=True).alias("globe"),
    )
    return rows.select(
        "l_orderkey", "l_linenumber", F.col("flat.wkt").alias("geometry"), F.col("globe.wkt").alias("geography"), "globe.srid"
    )


@query(
    "strict_cast",
    """SELECT event_id, CAST(CAST("value" AS DECIMAL(18,2)) AS VARCHAR) AS amount, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, TRY_CAST(event_type AS INTEGER) IS NULL AS bad_code FROM events""",
)
def strict_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        columntypes.strict_cast(F.col("value"), columntypes.column_type("DECIMAL(18, 2)")).cast("string").alias("amount"),
        columntypes.strict_cast(F.col("ts"), T.DateType()).cast("string").alias("day"),
        columntypes.unconvertible(F.col("event_type"), T.IntegerType()).alias("bad_code"),
    )


@query(
    "batch_copy",
    """SELECT o_orderkey AS id, lower(trim(o_orderpriority)) AS priority, strftime(o_orderdate, '%d.%m.%Y') AS ordered,
              CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS DOUBLE) AS amount FROM orders""",
)
def copy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source, transforms, sink; the sink's rows are read back."""
    orders = table(spark, sf_dir, "orders").withColumn("o_totalprice", money("o_totalprice"))
    mappings = [
        ("o_orderkey", "id", []),
        ("o_orderpriority", "priority", [Step(1, "Trim"), Step(2, "ToLower")]),
        ("o_orderdate", "ordered", [Step(1, "FormatDate", {"fmt": "dd.MM.yyyy"})]),
        ("o_totalprice", "amount", [Step(1, "Round", {"digits": 0})]),
    ]
    copied = batch_copy(orders, mappings).withColumn("amount", F.col("amount").cast("double"))
    path = scratch_path(spark, "copied")
    copied.write.parquet(path)
    return spark.read.schema(copied.schema).parquet(path)


# -- vectors --------------------------------------------------------------------------------

COSINE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(
    "nearest",
    f"""SELECT e.vec_id, e.label, round(1 - {COSINE}, 6) AS distance
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 1 - {COSINE}, e.vec_id LIMIT 10""",
)
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    target = embeddings.where(F.col("vec_id") == 0).select("embedding").scalar()
    found = vectors.nearest(embeddings, "embedding", target, 10, "vec_id")
    return found.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(
    "nearest_batch",
    f"""WITH q AS (SELECT CAST(label AS BIGINT) AS query_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
             d AS (SELECT query_id, vec_id, 1 - {COSINE} AS distance FROM embeddings e, q)
        SELECT query_id, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place
        FROM d QUALIFY place <= 5""",
)
def nearest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of each label's first vector."""
    embeddings = table(spark, sf_dir, "embeddings")
    queries = embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    found = vectors.nearest_batch(embeddings, "embedding", "vec_id", queries, "embedding", "label", 5)
    return found.withColumn("distance", F.round("distance", 6))


# -- quality --------------------------------------------------------------------------------

NOT_LABELLED = Rule("labelled", "NotNull", "quality", "Warning")
DISCOUNT = Rule("discount", "InRange", "l_discount", "Error", 0.0, 0.08)
LINE_RULES = [
    DISCOUNT,
    Rule("quantity", "InRange", "l_quantity", "Warning", 1.0, 50.0),
    Rule("price", "InRange", "l_extendedprice", "Critical", low=1000.0),
    Rule("shipped", "NotNull", "l_shipdate", "Error"),
    Rule("tax", "InRange", "l_tax", "Error", 0.0, 0.01, enabled=False),
]


def rule_sql(name: str, field: str, severity: str, violated: str, source: str) -> str:
    return f"""SELECT '{name}' AS rule, '{field}' AS field, '{severity}' AS severity, count(*) AS checked,
                      count(*) FILTER (WHERE {violated}) AS violations, count(*) FILTER (WHERE {violated}) = 0 AS passed FROM {source}"""


@query("quality_not_null", rule_sql("labelled", "quality", "Warning", "l.quality IS NULL", LABELLED))
def quality_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check(labelled(spark, sf_dir), NOT_LABELLED)


@query("quality_in_range", rule_sql("discount", "l_discount", "Error", "l_discount < 0 OR l_discount > 0.08", "lineitem"))
def quality_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check(table(spark, sf_dir, "lineitem"), DISCOUNT)


@query(
    "quality_check_all",
    " UNION ALL ".join(
        [
            rule_sql("discount", "l_discount", "Error", "l_discount < 0 OR l_discount > 0.08", "lineitem"),
            rule_sql("quantity", "l_quantity", "Warning", "l_quantity < 1 OR l_quantity > 50", "lineitem"),
            rule_sql("price", "l_extendedprice", "Critical", "l_extendedprice < 1000", "lineitem"),
            rule_sql("shipped", "l_shipdate", "Error", "l_shipdate IS NULL", "lineitem"),
        ]
    ),
)
def quality_check_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_all(table(spark, sf_dir, "lineitem"), LINE_RULES)


@query(
    "quality_dashboard",
    """WITH e AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'Critical' ELSE 'Warning' END AS severity, "value" < 40 AS passed FROM events
                  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
       SELECT severity, passed, count(*) AS rules FROM e GROUP BY ALL""",
)
def quality_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    executions = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("rule"),
        F.col("ts").alias("executed_at"),
        F.col("event_id").alias("execution_id"),
        F.when(F.col("user_id") % 3 == 0, "Critical").otherwise("Warning").alias("severity"),
        (F.col("value") < 40).alias("passed"),
    )
    return quality.dashboard(executions)


@query(
    "quality_failures",
    """SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_discount < 0 OR l_discount > 0.08 THEN 'discount' END,
              CASE WHEN l_quantity < 1 OR l_quantity > 50 THEN 'quantity' END, CASE WHEN l_extendedprice < 1000 THEN 'price' END,
              CASE WHEN l_shipdate IS NULL THEN 'shipped' END) AS broken
       FROM lineitem WHERE l_discount < 0 OR l_discount > 0.08 OR l_quantity < 1 OR l_quantity > 50 OR l_extendedprice < 1000 OR l_shipdate IS NULL""",
)
def quality_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = quality.failures(table(spark, sf_dir, "lineitem"), LINE_RULES)
    return failed.select("l_orderkey", "l_linenumber", text_list("broken_rules").alias("broken"))
