"""Projections, filters, joins of data sets, paging and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import formula as fx
from weftline.functions.predicates import Condition, all_of, any_of, build, by_fields, current_rows, in_scope
from weftline.operators import aggregates, joins, paging, search, setops, trigrams
from weftline.operators.datasets import (
    open_data_set,
    open_named,
    project_declared,
    query_data_set,
    rename_fields,
    union_all,
)
from weftline.queries.registry import money, moment, query, table, text_list
from weftline.session import scratch_path
from weftline.sources import files, sinks
from weftline.specs import Calculated, DataSetSpec, FieldSpec, JoinSpec, SourceSpec

# -- the flagship data set ------------------------------------------------------------------

CUSTOMER_ORDERS = DataSetSpec(
    name="CustomerOrders",
    kind="compound",
    sources=[
        SourceSpec(
            "orders",
            fields=[
                FieldSpec("o_orderkey", "order_id"),
                FieldSpec("o_custkey", "customer_id"),
                FieldSpec("o_orderstatus", "status"),
                FieldSpec("o_totalprice", "amount", T.DecimalType(18, 2)),
            ],
        ),
        SourceSpec(
            "customer",
            fields=[FieldSpec("c_custkey", "id"), FieldSpec("c_mktsegment", "segment")],
            unique_key=["id"],
        ),
    ],
    joins=[JoinSpec("orders", "customer", [("customer_id", "id")])],
    output=[
        ("orders", "order_id", "order_id"),
        ("orders", "status", "status"),
        ("orders", "amount", "amount"),
        ("customer", "segment", "segment"),
    ],
    key=["order_id"],
)


@query(
    "customer_orders",
    """SELECT c_mktsegment AS segment, 'amount' AS "column", count(*) AS n, CAST(0 AS BIGINT) AS nulls,
              count(DISTINCT o_totalprice) AS distinct_values, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_value,
              round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean_value,
              round(stddev_samp(o_totalprice), 4) AS stddev_value
       FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_orderstatus = 'F' AND (o_totalprice > 100000 OR c_mktsegment IN ('BUILDING', 'MACHINERY'))
       GROUP BY c_mktsegment ORDER BY sum_value DESC, segment LIMIT 10""",
)
def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    orders = open_data_set(CUSTOMER_ORDERS, frames)
    wanted = all_of(
        Condition("status", "equal", "F"),
        any_of(Condition("amount", "greater", 100000), Condition("segment", "in", ["BUILDING", "MACHINERY"])),
    )
    stats = aggregates.stat_set(orders.where(build(wanted, orders.schema)), ["amount"], ["segment"])
    return paging.top_k(rounded(stats), "sum_value", 10, ["segment"])


def rounded(stats: DataFrame) -> DataFrame:
    exact = {c: F.col(c).cast("double") for c in ("min_value", "max_value", "sum_value")}
    return stats.withColumns(exact | {c: F.round(c, 4) for c in ("mean_value", "stddev_value")})


@query(
    "data_set_query",
    """SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS amount, c_mktsegment AS segment,
              (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O') > 60 AS has_more
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'
       ORDER BY o_orderkey LIMIT 40 OFFSET 20""",
)
def data_set_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    params = {"Segment": "BUILDING", "STATUS": "O", "order_id": ""}
    rows = query_data_set(CUSTOMER_ORDERS, frames, params, skip=20, take=40)
    return rows.withColumn("amount", F.col("amount").cast("double"))


@query(
    "data_set_view",
    """SELECT c_mktsegment AS segment, o_orderkey AS id, o_totalprice AS gross, o_totalprice / 2 AS net FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def data_set_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of a view of the joined data set."""
    frames = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    renamed = [FieldSpec("segment"), FieldSpec("order_id", "id"), FieldSpec("amount", "gross", T.DoubleType())]
    specs = {
        "CustomerOrders": CUSTOMER_ORDERS,
        "Amounts": DataSetSpec("Amounts", "simple", [SourceSpec("CustomerOrders", fields=renamed)], key=["id"]),
        "Net": DataSetSpec("Net", "simple", [SourceSpec("Amounts")], calculated=[Calculated("net", "gross / 2")]),
    }
    return open_named("net", specs, frames)


# -- projection -----------------------------------------------------------------------------


@query("project_declared", "SELECT c_mktsegment AS segment, c_custkey AS id, CAST(NULL AS VARCHAR) AS email FROM customer")
def project_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [
        FieldSpec("c_mktsegment", "segment"),
        FieldSpec("c_custkey", "id"),
        FieldSpec("c_name", "name", current=False),
        FieldSpec("c_acctbal", "balance", deleted=True),
        FieldSpec("c_email", "email"),
    ]
    return project_declared(table(spark, sf_dir, "customer"), fields)


@query(
    "rename_fields",
    """SELECT event_id AS "EventId", ts, user_id, event_type, "value",
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS "Magnitude" FROM events""",
)
def rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "struct<k:bigint>"))
    return rename_fields(events, {"event_id": "EventId", "props.k": "Magnitude"})


@query(
    "project_alias",
    """SELECT o.o_orderkey AS id, c.c_name AS "customerName", o.o_totalprice AS "itemTotal"
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = DataSetSpec(
        "OrderItems",
        "compound",
        [SourceSpec("o"), SourceSpec("c", unique_key=["c_custkey"])],
        [JoinSpec("o", "c", [("o_custkey", "c_custkey")])],
        [("o", "o_orderkey", "id"), ("c", "c_name", "customerName"), ("o", "o_totalprice", "itemTotal")],
    )
    return open_data_set(spec, {"o": table(spark, sf_dir, "orders"), "c": table(spark, sf_dir, "customer")})


@query(
    "calculated_field",
    """SELECT l_orderkey AS order_id, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
              l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross
       FROM lineitem""",
)
def calculated(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [
        FieldSpec("l_orderkey", "order_id"),
        FieldSpec("l_extendedprice", "price"),
        FieldSpec("l_discount", "discount"),
        FieldSpec("l_tax", "tax"),
    ]
    lines = SourceSpec("lineitem", fields=fields)
    spec = DataSetSpec(
        "Lines", "simple", [lines],
        calculated=[Calculated("net", "price * (1 - discount)"), Calculated("gross", "net * (1 + tax)")],
    )
    return open_data_set(spec, {"lineitem": table(spark, sf_dir, "lineitem")})


@query(
    "formula",
    """SELECT p_partkey, upper(coalesce(nullif(p_brand, 'Brand#1'), 'none')) || '/' || lower(p_type) AS label,
              CASE WHEN p_size >= 25 AND NOT p_retailprice < 1000 THEN 'large' WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS size_class,
              CAST(round(abs(CAST(p_retailprice AS DECIMAL(18,2)) - 1000), 1) AS DOUBLE) AS gap
       FROM part""",
)
def formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("price", money("p_retailprice"))
    f, v, c = fx.field, fx.value, fx.call
    brand = c("upper", c("coalesce", c("nullif", f("p_brand"), v("Brand#1")), v("none")))
    large = c("and", c(">=", f("p_size"), v(25)), c("not", c("<", f("price"), v(1000))))
    even = c("=", c("%", f("p_size"), v(2)), v(0))
    formulas = {
        "label": c("concat", brand, v("/"), c("lower", f("p_type"))),
        "size_class": c("case", large, v("large"), even, v("even"), v("odd")),
        "gap": c("round", c("abs", c("-", f("price"), v(1000))), v(1)),
    }
    rows = fx.with_formulas(part, formulas).select("p_partkey", *formulas)
    return rows.withColumn("gap", F.col("gap").cast("double"))


@query(
    "calculation_entity",
    """SELECT c_nationkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.25 AS DECIMAL(4,2))) AS DOUBLE) AS levy
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY c_nationkey""",
)
def calculation(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = fx.CalculationEntity(
        "Levy",
        """SELECT c_nationkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(:rate AS DECIMAL(4,2))) AS DOUBLE) AS levy
           FROM {orders} JOIN {customers} ON o_custkey = c_custkey
           WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ) GROUP BY c_nationkey""",
        "levy",
        {"rate": "0.25", "since": "1997-01-01"},
    )
    return fx.run_calculation(
        entity, {"orders": table(spark, sf_dir, "orders"), "customers": table(spark, sf_dir, "customer")}
    )


# -- filters --------------------------------------------------------------------------------


def register_filter(name: str, source: str, columns: str, condition: Condition, where: str) -> None:
    """One filter operator over one table, as a query and its SQL."""

    @query(name, f"SELECT {columns} FROM {source} WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        return rows.where(build(condition, rows.schema)).select(*columns.split(", "))


ORDER = "o_orderkey, o_orderstatus, o_totalprice"
register_filter("filter_eq", "orders", ORDER, Condition("o_orderstatus", "equal", "F"), "o_orderstatus = 'F'")
register_filter("filter_ne", "orders", ORDER, Condition("O_ORDERSTATUS", "not_equal", "F"), "o_orderstatus <> 'F'")
register_filter("filter_gt", "orders", ORDER, Condition("o_totalprice", "greater", 250000.0), "o_totalprice > 250000")
register_filter("filter_gte", "lineitem", "l_orderkey, l_quantity", Condition("l_quantity", "greater_or_equal", 25.0), "l_quantity >= 25")
register_filter("filter_lt", "lineitem", "l_orderkey, l_quantity", Condition("l_quantity", "less", 25.0), "l_quantity < 25")
register_filter("filter_lte", "lineitem", "l_orderkey, l_discount", Condition("l_discount", "less_or_equal", 0.05), "l_discount <= 0.05")
register_filter("filter_contains", "pages", "page_id, html", Condition("html", "contains", "%%%"), "contains(html, '%%%')")
register_filter("filter_starts_with", "pages", "page_id, url", Condition("url", "starts_with", "https://m."), "starts_with(url, 'https://m.')")
register_filter("filter_ends_with", "documents", "doc_id, text", Condition("text", "ends_with", "en."), "ends_with(text, 'en.')")
register_filter("filter_in", "customer", "c_custkey, c_mktsegment", Condition("c_mktsegment", "in", ["BUILDING", "FURNITURE"]), "c_mktsegment IN ('BUILDING', 'FURNITURE')")
register_filter("filter_not_in", "customer", "c_custkey, c_mktsegment", Condition("c_mktsegment", "not_in", ["BUILDING", "FURNITURE"]), "c_mktsegment NOT IN ('BUILDING', 'FURNITURE')")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their label, NULL where there is none."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled_id"), "quality", "toxic")
    documents = table(spark, sf_dir, "documents")
    return joins.join_frames(documents, labels, [("doc_id", "labelled_id")], "left").drop("labelled_id")


LABELLED = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query("filter_is_null", f"SELECT d.doc_id, d.lang, l.quality FROM {LABELLED} WHERE l.quality IS NULL")
def filter_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return rows.where(build(Condition("quality", "is_null"), rows.schema)).select("doc_id", "lang", "quality")


@query("filter_is_not_null", f"SELECT d.doc_id, d.lang, l.quality FROM {LABELLED} WHERE l.quality IS NOT NULL")
def filter_is_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return rows.where(build(Condition("quality", "is_not_null"), rows.schema)).select("doc_id", "lang", "quality")


@query(
    "filter_groups",
    f"""SELECT {ORDER}, o_orderpriority FROM orders
        WHERE o_orderstatus = 'F' AND (o_totalprice > 400000 OR (o_orderpriority = '1-URGENT' AND
              (o_totalprice < 50000 OR o_custkey IN (7, 42)))) AND NOT o_orderpriority = '5-LOW'""",
)
def filter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    inner = any_of(Condition("o_totalprice", "less", 50000.0), Condition("o_custkey", "in", [7, 42]))
    either = any_of(
        Condition("o_totalprice", "greater", 400000.0),
        all_of(Condition("o_orderpriority", "equal", "1-URGENT"), inner),
    )
    tree = all_of(Condition("o_orderstatus", "equal", "F"), either, Condition("o_orderpriority", "not_equal", "5-LOW"))
    return orders.where(build(tree, orders.schema)).select(*ORDER.split(", "), "o_orderpriority")


@query("filter_by_fields", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def filter_by_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    params = {"C_MKTSEGMENT": "BUILDING", "c_NationKey": "7", "c_name": "", "no_such_field": "x"}
    return customer.where(by_fields(params, customer.schema))


@query("scope_filter", f"SELECT d.doc_id, l.quality FROM {LABELLED} WHERE l.quality = 1 OR l.quality IS NULL")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).where(in_scope(F.col("quality"), 1)).select("doc_id", "quality")


@query("current_rows", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'")
def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        (F.col("o_orderstatus") != "P").alias("IsCurrent"),
        (F.col("o_orderpriority") == "5-LOW").alias("IsDeleted"),
    )
    return versions.where(current_rows()).select("o_orderkey", "o_orderpriority")


# -- joins ----------------------------------------------------------------------------------


def label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled_id"), "quality")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label")


@query(
    "join_inner",
    """SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = joins.join_frames(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")])
    return joined.select("o_orderkey", "o_totalprice", "c_name")


@query(
    "join_left",
    """SELECT s_suppkey, s_nationkey, o_orderkey, o_totalprice FROM supplier LEFT JOIN
       (SELECT * FROM orders WHERE o_totalprice > 350000) ON s_suppkey = o_custkey""",
)
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The looked-up side repeats its key, so the join runs as matches plus unmatched rows."""
    large = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 350000)
    joined = joins.join_frames(table(spark, sf_dir, "supplier"), large, [("s_suppkey", "o_custkey")], "left")
    return joined.select("s_suppkey", "s_nationkey", "o_orderkey", "o_totalprice")


@query("join_right", "SELECT vec_id, label, l.doc_id AS labelled_id, quality FROM embeddings RIGHT JOIN labels l ON vec_id = l.doc_id")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_frames(vectors(spark, sf_dir), label_ids(spark, sf_dir), [("vec_id", "labelled_id")], "right")


@query("join_full", "SELECT vec_id, label, l.doc_id AS labelled_id, quality FROM embeddings FULL JOIN labels l ON vec_id = l.doc_id")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_frames(vectors(spark, sf_dir), label_ids(spark, sf_dir), [("vec_id", "labelled_id")], "full")


@query(
    "join_left_heavy",
    "SELECT n_nationkey, n_name, l_linenumber, l_orderkey FROM nation LEFT JOIN lineitem ON n_nationkey = l_linenumber",
)
def join_left_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven keys hold all rows of the looked-up side."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey")
    return joins.join_frames(nations, lines, [("n_nationkey", "l_linenumber")], "left", sketch=True)


@query(
    "join_full_heavy",
    "SELECT s_suppkey, s_nationkey, c_custkey, c_nationkey FROM supplier FULL JOIN customer ON s_nationkey = c_nationkey",
)
def join_full_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return joins.join_frames(suppliers, customers, [("s_nationkey", "c_nationkey")], "full", sketch=True)


@query(
    "join_chain",
    """SELECT o_orderkey AS order_id, c_name AS customer, n_name AS nation, r_name AS region
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey""",
)
def join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("orders", "customer", "nation", "region")
    spec = DataSetSpec(
        "OrdersByRegion",
        "compound",
        [SourceSpec(n) for n in names],
        [
            JoinSpec("orders", "customer", [("o_custkey", "c_custkey")]),
            JoinSpec("customer", "nation", [("c_nationkey", "n_nationkey")]),
            JoinSpec("nation", "region", [("n_regionkey", "r_regionkey")]),
        ],
        [
            ("orders", "o_orderkey", "order_id"),
            ("customer", "c_name", "customer"),
            ("nation", "n_name", "nation"),
            ("region", "r_name", "region"),
        ],
    )
    return open_data_set(spec, {n: table(spark, sf_dir, n) for n in names})


@query(
    "join_federated",
    "SELECT o_orderkey AS order_id, o_totalprice AS amount, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey",
)
def join_federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a columnar store joined with customers of a file store."""
    path = scratch_path(spark, "federated")
    sinks.export_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path)
    schema = files.declared({"c_custkey": "bigint", "c_name": "nvarchar"})
    spec = DataSetSpec(
        "OrdersAcrossStores",
        "federated",
        [SourceSpec("orders", "warehouse"), SourceSpec("customers", "files")],
        [JoinSpec("orders", "customers", [("o_custkey", "c_custkey")])],
        [
            ("orders", "o_orderkey", "order_id"),
            ("orders", "o_totalprice", "amount"),
            ("customers", "c_name", "customer"),
        ],
    )
    frames = {"orders": table(spark, sf_dir, "orders"), "customers": files.read_delimited(spark, path, schema)}
    return open_data_set(spec, frames)


@query("join_sibling", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def join_sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two containers of one folder of JSON files."""
    folder = scratch_path(spark, "folder")
    for name in ("supplier", "nation"):
        sinks.export_json(table(spark, sf_dir, name), f"{folder}/{name}")
    supplier = files.read_json(spark, f"{folder}/supplier", table(spark, sf_dir, "supplier").schema)
    nation = files.read_json(spark, f"{folder}/nation", table(spark, sf_dir, "nation").schema)
    joined = joins.sibling_join(supplier, nation, [("s_nationkey", "n_nationkey")], nation.schema, ["n_regionkey"])
    return joined.where(F.col("n_regionkey") == 2).select("s_suppkey", "s_name", "n_name")


@query(
    "semi_join",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""",
)
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return joins.semi_join(lines, owners, [("l_orderkey", "o_orderkey")])


@query("anti_join", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return joins.anti_join(documents, label_ids(spark, sf_dir), [("doc_id", "labelled_id")])


@query(
    "scoped_overlay",
    """WITH d AS (SELECT p_partkey AS row_id, p_name || '/' || p_type AS code,
                  CASE WHEN p_size < 15 THEN NULL ELSE p_partkey % 3 END AS tenant_id,
                  CASE WHEN p_size < 35 THEN NULL ELSE p_partkey % 2 END AS organization_id, p_brand LIKE '%1' AS locked FROM part),
            w AS (SELECT *, CASE WHEN tenant_id IS NULL THEN 0 WHEN organization_id IS NULL THEN 1 ELSE 2 END AS width FROM d
                  WHERE (tenant_id IS NULL AND organization_id IS NULL) OR (tenant_id = 1 AND coalesce(organization_id, 0) = 0))
       SELECT row_id, code, tenant_id, organization_id, locked FROM w
       QUALIFY row_number() OVER (PARTITION BY code ORDER BY CASE WHEN locked AND width < 2 THEN 0 ELSE 1 END,
               CASE WHEN locked AND width < 2 THEN width ELSE -width END, row_id) = 1""",
)
def scoped_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.concat_ws("/", "p_name", "p_type").alias("code"),
        F.when(F.col("p_size") >= 15, F.col("p_partkey") % 3).alias("tenant_id"),
        F.when(F.col("p_size") >= 35, F.col("p_partkey") % 2).alias("organization_id"),
        F.col("p_brand").endswith("1").alias("locked"),
    )
    return joins.scoped_overlay(definitions, "code", "row_id", 1, 0)


CHILD_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]


@query(
    "parent_child",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey
                  ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS n FROM lineitem),
            b AS (SELECT l_orderkey, (n - 1) // 3 AS block_no, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY n) AS lines
                  FROM p GROUP BY 1, 2)
       SELECT o_orderkey, o_custkey, coalesce(block_no, 0) AS block_no, coalesce(lines, '') AS lines
       FROM orders LEFT JOIN b ON o_orderkey = l_orderkey""",
)
def parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *CHILD_ORDER)
    composed = joins.parent_child(orders, "o_orderkey", lines, "l_orderkey", CHILD_ORDER, "items", block=3)
    listed = F.transform("items", lambda i: F.concat_ws(":", i["l_linenumber"].cast("string"), i["l_partkey"].cast("string")))
    return composed.select("o_orderkey", "o_custkey", "block_no", F.array_join(listed, ",").alias("lines"))


@query(
    "left_lookup_counts",
    """SELECT d.doc_id, d.source, coalesce(n, 0) AS labels FROM documents d
       LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
)
def left_lookup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return joins.child_counts(documents, "doc_id", label_ids(spark, sf_dir), "labelled_id", "labels")


# -- ordering and paging --------------------------------------------------------------------


@query("order_by", f"SELECT {ORDER} FROM orders ORDER BY o_orderstatus DESC, o_totalprice DESC, o_orderkey")
def order_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(*ORDER.split(", "))
    return paging.order_by(orders, "-o_orderstatus", "-o_totalprice", "o_orderkey")


@query("page", f"SELECT {ORDER} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(*ORDER.split(", "))
    return paging.page(orders, 100, 50, ["-o_totalprice"], ["o_orderkey"])


@query("page_deep", "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 3000 OFFSET 9000")
def page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep enough, with its rows, that positions are computed."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return paging.page(table(spark, sf_dir, "lineitem"), 9000, 3000, ["-l_extendedprice"], key)


@query("page_by_key", f"SELECT {ORDER} FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 20")
def page_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page(table(spark, sf_dir, "orders").select(*ORDER.split(", ")), 20, 40, key=["o_orderkey"])


@query(
    "page_has_more",
    """SELECT c_custkey, c_name, (SELECT count(*) FROM customer) > 60 AS has_more FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 30""",
)
def page_has_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page_with_more(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 30, 30, key=["c_custkey"])


@query("top_k", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return paging.top_k(lines, "l_extendedprice", 20, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("row_ceiling", "SELECT n_nationkey, n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def row_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    counted = joins.child_counts(nations, "n_nationkey", table(spark, sf_dir, "customer"), "c_nationkey", "customers")
    return paging.row_ceiling(counted, 1000)


@query("page_keyset", f"SELECT {ORDER} FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page_after(table(spark, sf_dir, "orders").select(*ORDER.split(", ")), "o_orderkey", 500, 100)


# -- set operations -------------------------------------------------------------------------


@query(
    "union_all",
    """SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier""",
)
def concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = DataSetSpec(
        "Parties",
        "federated",
        [
            SourceSpec("customer", "a", [FieldSpec("c_name", "name"), FieldSpec("c_nationkey", "nation"), FieldSpec("c_mktsegment", "segment")]),
            SourceSpec("supplier", "b", [FieldSpec("s_name", "name"), FieldSpec("s_nationkey", "nation")]),
        ],
    )
    return open_data_set(spec, {n: table(spark, sf_dir, n) for n in ("customer", "supplier")})


@query(
    "schema_diff",
    """WITH stored AS (SELECT DISTINCT lower(c_name) AS name FROM customer),
            now AS (SELECT lower(c_name) AS name FROM customer WHERE c_acctbal >= 1000 UNION SELECT lower(s_name) FROM supplier)
       SELECT name, 'added' AS change FROM now WHERE name NOT IN (SELECT name FROM stored)
       UNION ALL SELECT name, 'removed' FROM stored WHERE name NOT IN (SELECT name FROM now)""",
)
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    stored = customer.select(F.col("c_name").alias("name"))
    kept = customer.where(F.col("c_acctbal") >= 1000).select(F.upper("c_name").alias("name"))
    now = union_all(kept, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")))
    return setops.schema_diff(stored, now, "name")


@query(
    "has_changes",
    """SELECT count(*) > 0 AS changed FROM (SELECT lower(c_name) AS name FROM customer
       EXCEPT SELECT lower(c_name) FROM customer WHERE c_acctbal >= 1000)""",
)
def has_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_acctbal")
    diff = setops.schema_diff(names, names.where(F.col("c_acctbal") >= 1000), "name")
    return spark.range(1).select(setops.has_changes(diff).alias("changed"))


@query(
    "distinct_by",
    """SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_quantity FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_quantity) = 1""",
)
def distinct_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_quantity")
    return setops.distinct_by(lines, ["l_orderkey"], ["l_shipdate", "l_linenumber"])


# -- search ---------------------------------------------------------------------------------


@query(
    "find_text",
    """SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'en t') THEN 'text' END, CASE WHEN contains(lower(lang), 'en t') THEN 'lang' END,
              CASE WHEN contains(lower(source), 'en t') THEN 'source' END) AS fields
       FROM documents WHERE contains(lower(text), 'en t') OR contains(lower(lang), 'en t') OR contains(lower(source), 'en t')""",
)
def find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.find_text(table(spark, sf_dir, "documents"), "EN T")
    return found.select("doc_id", text_list("matched").alias("fields"))


@query(
    "catalog_search",
    """SELECT * FROM (
         SELECT 'customer' AS kind, c_name AS name, c_mktsegment AS description FROM customer
         UNION ALL SELECT 'nation', n_name, NULL FROM nation
         UNION ALL SELECT 'part', p_name, p_type FROM part
         UNION ALL SELECT 'supplier', s_name, NULL FROM supplier)
       WHERE contains(lower(name), 'bu') OR contains(lower(description), 'bu')""",
)
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kind(source: str, name: str, description: str | None = None) -> DataFrame:
        text = F.col(description) if description else F.lit(None).cast("string")
        return table(spark, sf_dir, source).select(F.col(name).alias("name"), text.alias("description"))

    kinds = {
        "customer": kind("customer", "c_name", "c_mktsegment"),
        "nation": kind("nation", "n_name"),
        "part": kind("part", "p_name", "p_type"),
        "supplier": kind("supplier", "s_name"),
    }
    return search.catalog_search(kinds, "BU")


@query(
    "ranked_search",
    """WITH s AS (SELECT p_partkey, p_name, p_type, greatest(
                CASE WHEN lower(p_name) = 'small' THEN 3 WHEN starts_with(lower(p_name), 'small') THEN 2 WHEN contains(lower(p_name), 'small') THEN 1 ELSE 0 END,
                CASE WHEN lower(p_type) = 'small' THEN 3 WHEN starts_with(lower(p_type), 'small') THEN 2 WHEN contains(lower(p_type), 'small') THEN 1 ELSE 0 END) AS score FROM part)
       SELECT * FROM s WHERE score > 0""",
)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return search.ranked_search(part, "Small", ["p_name", "p_type"], "p_name", "p_partkey")


@query(
    "find_text_indexed",
    """SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'censed un') THEN 'text' END, CASE WHEN contains(lower(lang), 'censed un') THEN 'lang' END,
              CASE WHEN contains(lower(source), 'censed un') THEN 'source' END) AS fields
       FROM documents WHERE contains(lower(text), 'censed un') OR contains(lower(lang), 'censed un') OR contains(lower(source), 'censed un')""",
)
def find_text_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = trigrams.build_index(table(spark, sf_dir, "documents"), "doc_id", scratch_path(spark, "text-index"))
    found = trigrams.find_text(spark, index, "CENSED UN")
    return found.select("doc_id", text_list("matched").alias("fields"))


@query(
    "ranked_search_indexed",
    """WITH s AS (SELECT p_partkey, p_name, p_type, greatest(
                CASE WHEN lower(p_name) = 'small' THEN 3 WHEN starts_with(lower(p_name), 'small') THEN 2 WHEN contains(lower(p_name), 'small') THEN 1 ELSE 0 END,
                CASE WHEN lower(p_type) = 'small' THEN 3 WHEN starts_with(lower(p_type), 'small') THEN 2 WHEN contains(lower(p_type), 'small') THEN 1 ELSE 0 END) AS score FROM part)
       SELECT * FROM s WHERE score > 0""",
)
def ranked_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    index = trigrams.build_index(part, "p_partkey", scratch_path(spark, "text-index"))
    return trigrams.ranked_search(spark, index, "Small", "p_name")
