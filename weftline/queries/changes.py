"""Table writes, as the next state of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import governance, writes
from weftline.queries.registry import moment, query, table
from weftline.session import scratch_path
from weftline.sources import sinks
from weftline.specs import TableSpec

CUSTOMERS = TableSpec(
    "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "c_custkey", ["c_custkey"]
)


def supplier_rows(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    """Suppliers in the shape of customers, with a key when an expression for it is given."""
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"),
        *([F.expr(key).cast("long").alias("c_custkey")] if key else []),
    )
    return rows


@query(
    "insert_append",
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
       UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_name), s_name, s_nationkey, s_acctbal, NULL
       FROM supplier""",
)
def insert_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_rows(spark, sf_dir)
    return writes.insert_append(table(spark, sf_dir, "customer"), rows, CUSTOMERS, ["c_name"]).state


@query("insert_replace", "SELECT s_suppkey AS c_custkey, s_name AS c_name, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM supplier")
def insert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishes the customers, then the state that replaces them, and reads the table."""
    customer = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "replaced")
    sinks.publish(customer, path)
    change = writes.insert_replace(spark.read.parquet(path), supplier_rows(spark, sf_dir, "s_suppkey"), CUSTOMERS)
    sinks.publish(change.state, path)
    return spark.read.parquet(path)


@query(
    "update_where",
    """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 2000 THEN 0 ELSE c_acctbal END AS c_acctbal,
              CASE WHEN c_acctbal < 2000 THEN 'DORMANT' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"C_MKTSEGMENT": "DORMANT", "c_acctbal": 0, "c_custkey": -1, "unknown": "x"}
    return writes.update_where(table(spark, sf_dir, "customer"), CUSTOMERS, F.col("c_acctbal") < 2000, values).state


@query("delete_where", "SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal >= 5000")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 5000)
    return writes.delete_where(table(spark, sf_dir, "customer"), gone).state


FLAGGED = TableSpec("customer", [*CUSTOMERS.columns, "IsDeleted", "DeletedAt"], "c_custkey", ["c_custkey"])


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of which the poorest are deleted already; a few carry no flag at all."""
    balance = F.col("c_acctbal")
    flag = F.when(balance < 1000, True).when(balance < 9000, False)
    at = F.when(balance < 1000, moment("2020-01-01"))
    return table(spark, sf_dir, "customer").withColumns({"IsDeleted": flag, "DeletedAt": at})


FLAGGED_SQL = """SELECT *, CASE WHEN c_acctbal < 1000 THEN true WHEN c_acctbal < 9000 THEN false END AS f,
                        CASE WHEN c_acctbal < 1000 THEN TIMESTAMP '2020-01-01' END AS d FROM customer"""


@query(
    "soft_delete",
    f"""WITH t AS ({FLAGGED_SQL}), h AS (SELECT *, f IS DISTINCT FROM true AND c_acctbal < 9500 AND c_mktsegment = 'BUILDING' AS hit FROM t)
        SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CASE WHEN hit THEN true ELSE f END AS "IsDeleted",
               CASE WHEN hit THEN TIMESTAMP '2024-02-01' ELSE d END AS "DeletedAt" FROM h""",
)
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = writes.SoftDelete(
        "IsDeleted", True, ("DeletedAt", moment("2024-02-01")), marker=("c_mktsegment", "building")
    )
    return writes.soft_delete(flagged(spark, sf_dir), FLAGGED, options, F.col("c_acctbal") < 9500).state


@query(
    "soft_delete_absent",
    f"""WITH t AS ({FLAGGED_SQL}),
             h AS (SELECT *, f IS DISTINCT FROM true AND c_custkey NOT IN (SELECT s_suppkey FROM supplier) AS hit FROM t)
        SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CASE WHEN hit THEN true ELSE f END AS "IsDeleted",
               d AS "DeletedAt" FROM h""",
)
def soft_delete_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    options = writes.SoftDelete("IsDeleted", True, absent_keys=["c_custkey"])
    return writes.soft_delete(flagged(spark, sf_dir), FLAGGED, options, source=source).state


VERSIONED = TableSpec("versions", ["RowId", "Id", "Name", "IsCurrent", "IsDeleted"], "RowId", ["Id"])


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as versioned rows; every name of a market segment is a deleted one."""
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).alias("RowId"),
        F.col("c_custkey").alias("Id"),
        F.col("c_name").alias("Name"),
        F.lit(True).alias("IsCurrent"),
        (F.col("c_mktsegment") == "MACHINERY").alias("IsDeleted"),
    )


def new_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under every twentieth id: some are stored, some are new."""
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("Id"), F.col("s_name").alias("Name"))


@query(
    "version_save",
    """SELECT c_custkey + 1 AS "RowId", c_custkey AS "Id", c_name AS "Name",
              c_custkey NOT IN (SELECT s_suppkey * 20 FROM supplier) AS "IsCurrent", c_mktsegment = 'MACHINERY' AS "IsDeleted" FROM customer
       UNION ALL SELECT (SELECT max(c_custkey) + 1 FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_suppkey * 20, s_name, true, false
       FROM supplier""",
)
def version_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.version_save(versions(spark, sf_dir), new_versions(spark, sf_dir), VERSIONED, ["Id"]).state


@query(
    "version_retire",
    """SELECT c_custkey + 1 AS "RowId", c_custkey AS "Id", c_name AS "Name", true AS "IsCurrent",
              c_mktsegment = 'MACHINERY' OR c_custkey IN (SELECT s_suppkey * 20 FROM supplier) AS "IsDeleted" FROM customer""",
)
def version_retire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.version_retire(versions(spark, sf_dir), new_versions(spark, sf_dir).select("Id"), VERSIONED).state


MIXED = """SELECT s_suppkey * 20, s_name, s_nationkey, s_acctbal, NULL FROM supplier"""


@query("upsert", f"SELECT * FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 20 FROM supplier) UNION ALL {MIXED}")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_rows(spark, sf_dir, "s_suppkey * 20")
    return writes.upsert(table(spark, sf_dir, "customer"), rows, CUSTOMERS, ["c_custkey"]).state


@query("insert_if_new", f"SELECT * FROM customer UNION ALL {MIXED} WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)")
def insert_if_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_rows(spark, sf_dir, "s_suppkey * 20")
    return writes.insert_if_new(table(spark, sf_dir, "customer"), rows, CUSTOMERS, ["c_custkey"]).state


@query("returning", "SELECT c_custkey, 'DORMANT' AS c_mktsegment FROM customer WHERE c_acctbal < 2000")
def returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"c_mktsegment": "DORMANT"}
    change = writes.update_where(table(spark, sf_dir, "customer"), CUSTOMERS, F.col("c_acctbal") < 2000, values)
    return writes.returning(change, CUSTOMERS, ["C_CustKey", "c_mktsegment"])


@query(
    "state_change",
    """WITH l AS (SELECT l_orderkey, l_linestatus, row_number() OVER (PARTITION BY l_orderkey
                  ORDER BY l_shipdate DESC, l_linenumber DESC, l_linestatus DESC) AS n FROM lineitem)
       SELECT o_orderkey AS document_id, coalesce(l_linestatus, o_orderstatus) AS state, o_orderdate FROM orders
       LEFT JOIN l ON l_orderkey = o_orderkey AND n = 1""",
)
def state_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("state"), "o_orderdate"
    )
    changes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linestatus").alias("state"),
        F.col("l_shipdate").alias("entered_at"), F.col("l_linenumber").alias("change_id"),
    )
    log = changes.where(F.lit(False))
    moved, _ = writes.state_change(documents, log, changes, "document_id", "state", "entered_at", "change_id")
    return moved


@query(
    "attribute_upsert",
    """WITH l AS (SELECT l_partkey, max(l_quantity) AS q, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY l_partkey)
       SELECT p_partkey AS owner, p_brand AS brand, coalesce(q, CAST(p_size AS DOUBLE)) AS size, r AS returned
       FROM part LEFT JOIN l ON p_partkey = l_partkey""",
)
def attribute_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")

    def slot(rows: DataFrame, owner: str, code: str, **values) -> DataFrame:
        slots = {
            s: values[s].cast(t) if s in values else F.lit(None).cast(t) for s, t in writes.SLOTS.items()
        }
        return rows.select(F.col(owner).alias("owner"), F.lit(code).alias("code"), *[v.alias(s) for s, v in slots.items()])

    stored = slot(part, "p_partkey", "brand", text=F.col("p_brand")).unionByName(
        slot(part, "p_partkey", "size", number=F.col("p_size"))
    )
    seen = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.max("l_quantity").alias("q"), F.max(F.col("l_returnflag") == "R").alias("r")
    )
    rows = slot(seen, "l_partkey", "size", number=F.col("q")).unionByName(
        slot(seen, "l_partkey", "returned", flag=F.col("r"))
    )
    values = writes.attribute_upsert(stored, rows, "owner", "code").state
    return writes.attribute_table(values, "owner", "code", {"brand": "text", "size": "number", "returned": "flag"})


@query(
    "sample_upsert",
    """SELECT c_mktsegment AS data_set, 'nation' || c_nationkey AS sample, c_name AS name, c_acctbal AS amount FROM customer
       WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey = 5)
       UNION ALL SELECT 'BUILDING', 'nation5', s_name, s_acctbal FROM supplier""",
)
def sample_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("data_set"),
        F.concat(F.lit("nation"), "c_nationkey").alias("sample"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("amount"),
    )
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount"))
    return writes.sample_upsert(samples, rows, "BUILDING", "nation5").state


# -- governance -----------------------------------------------------------------------------


@query(
    "stand_in",
    """SELECT c_custkey, sha256(c_name || 'pepper') AS c_name, CAST(NULL AS VARCHAR) AS c_nationkey, 'hidden' AS c_acctbal,
              repeat('*', greatest(length(c_mktsegment) - 4, 0)) || right(c_mktsegment, 4) AS c_mktsegment FROM customer""",
)
def stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.stand_in(
        table(spark, sf_dir, "customer"),
        {
            "c_name": governance.StandIn("hash", salt="pepper"),
            "c_nationkey": governance.StandIn("null"),
            "c_acctbal": governance.StandIn("constant", "hidden"),
            "C_MKTSEGMENT": governance.StandIn("partial"),
        },
    )


@query("classified_read", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def classified_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = {"c_name": "confidential", "c_acctbal": "restricted", "c_mktsegment": "internal"}
    return governance.classified_read(governance.classify(table(spark, sf_dir, "customer"), levels), "internal")


@query(
    "retention_select",
    """WITH d AS (SELECT CASE o_orderstatus WHEN 'P' THEN 'Archive' WHEN 'F' THEN 'Invoices' ELSE 'Offers' END AS folder, * FROM orders)
       SELECT folder || '/' || o_orderpriority || '/' || o_orderkey AS path, o_orderdate AS modified, folder AS document_type, 'archive' AS action
       FROM d WHERE folder <> 'Archive' AND o_orderdate < CASE folder WHEN 'Invoices' THEN TIMESTAMP '1996-01-01' ELSE TIMESTAMP '1999-06-01' END""",
)
def retention_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    folder = F.when(status == "P", "Archive").when(status == "F", "Invoices").otherwise("Offers")
    documents = table(spark, sf_dir, "orders").select(
        F.concat_ws("/", folder, "o_orderpriority", F.col("o_orderkey").cast("string")).alias("path"),
        F.col("o_orderdate").alias("modified"),
    )
    cutoffs = {"Invoices": moment("1996-01-01"), "Offers": moment("1999-06-01")}
    return governance.retention_select(documents, "path", "modified", cutoffs, "archive")


def changed_customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The customers, and as they might be later: some dormant, some gone, the suppliers added."""
    before = table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_acctbal") < 2000, "DORMANT").otherwise(F.col("c_mktsegment"))
    kept = before.where(F.col("c_mktsegment") != "FURNITURE").withColumn("c_mktsegment", segment)
    return before, kept.unionByName(supplier_rows(spark, sf_dir, "-1 - s_suppkey"), allowMissingColumns=True)


@query(
    "audit_changes",
    """WITH o AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey = 3),
            n AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal < 2000 THEN 'DORMANT' ELSE c_mktsegment END AS c_mktsegment,
                         'user' || c_custkey % 7 AS w FROM customer
                  WHERE c_mktsegment <> 'FURNITURE' AND c_nationkey = 3
                  UNION ALL SELECT -1 - s_suppkey, s_name, NULL, 'user' || (-1 - s_suppkey) % 7 FROM supplier WHERE s_nationkey = 3),
            j AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.c_name AS a1, n.c_name AS b1, o.c_mktsegment AS a2, n.c_mktsegment AS b2,
                         CAST(3 AS INTEGER) AS c_nationkey, n.w AS changed_by, CASE WHEN n.c_custkey IS NOT NULL THEN TIMESTAMP '2024-03-01' END AS changed_at
                  FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)
       SELECT c_custkey, c_nationkey, changed_by, changed_at, 'c_name' AS field, a1 AS old_value, b1 AS new_value FROM j WHERE a1 IS DISTINCT FROM b1
       UNION ALL SELECT c_custkey, c_nationkey, changed_by, changed_at, 'c_mktsegment', a2, b2 FROM j WHERE a2 IS DISTINCT FROM b2""",
)
def audit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = changed_customers(spark, sf_dir)
    who = F.concat(F.lit("user"), (F.col("c_custkey") % 7).cast("string"))
    return governance.audit_changes(
        before, after, ["c_custkey"], ["c_name", "c_mktsegment"], who, moment("2024-03-01"), "c_nationkey", 3
    )


@query(
    "audit_changes_all",
    """WITH o AS (SELECT c_custkey, c_name, c_mktsegment FROM customer),
            n AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal < 2000 THEN 'DORMANT' ELSE c_mktsegment END AS c_mktsegment FROM customer
                  WHERE c_mktsegment <> 'FURNITURE' UNION ALL SELECT -1 - s_suppkey, s_name, NULL FROM supplier),
            j AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.c_name AS a1, n.c_name AS b1, o.c_mktsegment AS a2, n.c_mktsegment AS b2
                  FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)
       SELECT c_custkey, 'c_name' AS field, a1 AS old_value, b1 AS new_value FROM j WHERE a1 IS DISTINCT FROM b1
       UNION ALL SELECT c_custkey, 'c_mktsegment', a2, b2 FROM j WHERE a2 IS DISTINCT FROM b2""",
)
def audit_changes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.audit_changes(*changed_customers(spark, sf_dir), ["c_custkey"], ["c_name", "c_mktsegment"])
