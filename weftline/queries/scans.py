"""Sources: record files written from the tables, page bodies, scripts, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.datasets import project_declared, union_all
from weftline.operators.paging import rows_per_source
from weftline.queries.registry import money, moment, query, table
from weftline.session import scratch_path
from weftline.sources import envelopes, files, listing, scripts, sinks
from weftline.specs import FieldSpec


@query(
    "scan_delimited",
    """SELECT c_custkey, c_name, '"' || c_mktsegment || '"; ' || c_name || ', "x"' AS note, c_acctbal
       FROM customer""",
)
def scan_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    note = F.concat(F.lit('"'), "c_mktsegment", F.lit('"; '), "c_name", F.lit(', "x"'))
    path = scratch_path(spark, "delimited")
    sinks.export_csv(customer.select("c_custkey", "c_name", note.alias("note"), "c_acctbal"), path, separator=";")
    schema = files.declared({"c_custkey": "bigint", "c_name": "nvarchar", "note": "nvarchar", "c_acctbal": "float"})
    return files.read_delimited(spark, path, schema, separator=";")


@query(
    "scan_json",
    """SELECT d.doc_id, d.text, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a label lack the field altogether; the reader's superset makes it NULL."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    records = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(labels, "doc_id", "left")
    path = scratch_path(spark, "json")
    records.write.option("ignoreNullFields", True).json(path)
    schema = files.declared({"doc_id": "bigint", "text": "nvarchar", "lang": "nvarchar", "quality": "int"})
    return files.read_json(spark, path, schema)


@query("scan_xml", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def scan_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "xml")
    sinks.export_xml(table(spark, sf_dir, "supplier"), path, row_element="supplier", root="suppliers")
    schema = files.declared({"s_suppkey": "bigint", "s_name": "nvarchar", "s_acctbal": "float"})
    return files.read_xml(spark, path, schema, "supplier")


@query("scan_fixed_width", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def scan_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = [("p_partkey", 16), ("p_name", 60), ("p_size", 8), ("p_retailprice", 24)]
    path = scratch_path(spark, "fixed")
    sinks.export_fixed_width(table(spark, sf_dir, "part"), path, widths)
    types = ["bigint", "string", "int", "double"]
    fields, start = [], 0
    for (name, width), kind in zip(widths, types, strict=True):
        fields.append(files.FixedField(name, start, width, kind))
        start += width
    return files.read_fixed_width(spark, path, fields)


@query(
    "scan_table",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'R'""",
)
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = files.read_table(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    wanted = lines.where((F.col("l_shipdate") >= moment("1998-01-01")) & (F.col("l_returnflag") == "R"))
    return wanted.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


RECORD = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
    ]
)

PAGE_ROWS = 100


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page bodies of at most 100 events, wrapped in each of the known ways in turn."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("amount"))
    grouped = (
        rows.groupBy(F.floor(F.col("event_id") / PAGE_ROWS).alias("page_no"))
        .agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "amount"))).alias("rows"))
    )
    array = F.to_json("rows")
    way = F.col("page_no") % 5
    body = F.when(way == 4, array)
    for number, member in enumerate(envelopes.WRAPPERS):
        total = F.concat(F.lit(', "meta": {"total": '), F.size("rows").cast("string"), F.lit("}"))
        link = F.concat(F.lit(', "links": {"next": "/events?page='), (F.col("page_no") + 1).cast("string"), F.lit('"}}'))
        body = body.when(way == number, F.concat(F.lit(f'{{"{member}": '), array, total, link))
    return grouped.select("page_no", body.alias("body"))


@query(
    "unwrap_envelope",
    'SELECT event_id, event_type, "value" AS amount FROM events',
)
def unwrap_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.unwrap_envelope(event_pages(spark, sf_dir), "body", RECORD).drop("raw_body")


@query(
    "page_metadata",
    """SELECT p AS page_no, CASE WHEN p % 5 = 4 THEN NULL ELSE n END AS total,
              CASE WHEN p % 5 = 4 THEN NULL ELSE '/events?page=' || CAST(p + 1 AS VARCHAR) END AS "next"
       FROM (SELECT event_id // 100 AS p, count(*) AS n FROM events GROUP BY 1)""",
)
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.page_metadata(event_pages(spark, sf_dir), "body").drop("body")


@query(
    "unwrap_soap",
    """SELECT s_suppkey, CASE WHEN s_acctbal < 1000 THEN 'Fault' ELSE 'Supplier' END AS element,
              s_acctbal < 1000 AS failed,
              CASE WHEN s_acctbal < 1000 THEN 'low balance' END AS fault,
              CASE WHEN s_acctbal < 1000 THEN NULL ELSE s_name END AS "Name"
       FROM supplier""",
)
def unwrap_soap(spark: SparkSession, sf_dir: str) -> DataFrame:
    opening = '<s:Envelope xmlns:s="http://schemas.xmlsoap.org/soap/envelope/"><s:Body>'
    closing = "</s:Body></s:Envelope>"
    good = F.concat(F.lit('<m:Supplier xmlns:m="urn:m"><m:Name>'), "s_name", F.lit("</m:Name></m:Supplier>"))
    bad = F.lit("<s:Fault><faultcode>s:Server</faultcode><faultstring>low balance</faultstring></s:Fault>")
    body = F.concat(F.lit(opening), F.when(F.col("s_acctbal") < 1000, bad).otherwise(good), F.lit(closing))
    messages = table(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body"))
    return envelopes.unwrap_soap(messages, "body", ["Name"]).drop("body")


@query(
    "script_read",
    """SELECT c_mktsegment, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 GROUP BY c_mktsegment""",
)
def script_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """
        SELECT c_mktsegment, count(*) AS orders,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
        WHERE o_orderstatus = :status AND o_totalprice >= :least
        GROUP BY c_mktsegment"""
    inputs = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    return scripts.script_read(spark, text, {"status": "F", "least": 100000}, inputs)


@query("script_read_take", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey <= 2")
def script_read_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 25 nations are expected; more would be refused."""
    text = "SELECT n_name, n_regionkey FROM {nation} WHERE n_regionkey <= :last"
    return scripts.script_read(spark, text, {"last": 2}, {"nation": table(spark, sf_dir, "nation")}, take=25)


@query("script_read_take_groups", "SELECT l_linenumber, count(*) AS lines FROM lineitem WHERE l_linenumber <= 7 GROUP BY l_linenumber")
def script_read_take_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order has seven lines at most, so the ceiling is just met; one row more would be refused."""
    text = "SELECT l_linenumber, count(*) AS lines FROM {lineitem} WHERE l_linenumber <= :last GROUP BY l_linenumber"
    return scripts.script_read(spark, text, {"last": 7}, {"lineitem": table(spark, sf_dir, "lineitem")}, take=7)


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as document paths: host, folders, file."""
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.length("html").alias("length"))


@query(
    "document_listing",
    """WITH d AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages),
            r AS (SELECT path, row_number() OVER (ORDER BY path) AS n, count(*) OVER () AS total FROM d WHERE path > 'blog')
       SELECT path, (SELECT max(path) FILTER (WHERE n = 200 AND total > 200) FROM r) AS continuation
       FROM r WHERE n <= 200""",
)
def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = page_paths(spark, sf_dir).select("path").distinct()
    return listing.document_listing(documents, "path", after="blog")


@query(
    "path_template",
    """SELECT page_id, regexp_extract(path, '^([^/]+)/([^/]+)/([^/]+)$', 1) AS host,
              regexp_extract(path, '^([^/]+)/([^/]+)/([^/]+)$', 2) AS language,
              regexp_extract(path, '^([^/]+)/([^/]+)/([^/]+)$', 3) AS filename,
              'acme/' || regexp_extract(path, '^([^/]+)/([^/]+)/([^/]+)$', 1) || '/' ||
              regexp_extract(path, '^([^/]+)/([^/]+)/([^/]+)$', 3) AS address
       FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)
       WHERE regexp_matches(path, '^([^/]+)/([^/]+)/([^/]+)$')""",
)
def path_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = listing.read_address(page_paths(spark, sf_dir), "path", "{host}/{language}/{filename}")
    built = listing.build_address(parts, "{tenantId}/{host}/{filename}", "address", tenantId="acme")
    return built.select("page_id", "host", "language", "filename", "address")


@query(
    "test_rows_per_source",
    """(SELECT 'customer' AS source, c_custkey AS id, c_name AS name FROM customer ORDER BY c_custkey LIMIT 25)
       UNION ALL (SELECT 'supplier', s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 25)
       UNION ALL (SELECT 'part', p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25)""",
)
def test_rows_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    def source(name: str, key: str, label: str) -> DataFrame:
        fields = [FieldSpec(key, "id"), FieldSpec(label, "name")]
        rows = project_declared(table(spark, sf_dir, name), fields).select(F.lit(name).alias("source"), "*")
        return rows_per_source(rows, 25, ["id"])

    return union_all(
        source("customer", "c_custkey", "c_name"),
        source("supplier", "s_suppkey", "s_name"),
        source("part", "p_partkey", "p_name"),
    )


@query(
    "export_csv",
    """SELECT p_partkey, CASE WHEN p_size < 30 THEN '''' ELSE '' END ||
              CASE WHEN p_size < 10 THEN '=' WHEN p_size < 20 THEN '+' WHEN p_size < 30 THEN '-' ELSE '"' END || p_name AS label,
              CAST(CAST(-p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS price
       FROM part""",
)
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a spreadsheet would run come back inert; negative numbers are left alone."""
    size = F.col("p_size")
    first = F.when(size < 10, "=").when(size < 20, "+").when(size < 30, "-").otherwise('"')
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(first, "p_name").alias("label"), (-money("p_retailprice")).alias("price")
    )
    path = scratch_path(spark, "export-csv")
    sinks.export_csv(part, path)
    return files.read_delimited(spark, path, files.declared({"p_partkey": "bigint", "label": "text", "price": "text"}))


@query("export_json", "SELECT doc_id, text, source FROM documents")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export-json")
    sinks.export_json(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path)
    return files.read_json(spark, path, files.declared({"doc_id": "bigint", "text": "text", "source": "text"}))
