"""Aggregates, window calculations and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import aggregates, schedules, setops, windows
from weftline.operators.windows import WindowColumn
from weftline.queries.reads import rounded
from weftline.queries.registry import money, moment, query, table

EXACT = "CAST({0} AS DECIMAL(18,2))"

# -- the five calculation types -------------------------------------------------------------


def register_calculation(name: str, kind: str, sql: str) -> None:
    """A calculation type over the line prices, per return flag."""

    @query(name, f"SELECT l_returnflag, {sql} AS result FROM lineitem GROUP BY l_returnflag")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = table(spark, sf_dir, "lineitem").select("l_returnflag", money("l_extendedprice").alias("price"))
        result = aggregates.calculate(lines, kind, "price", "result", ["l_returnflag"])
        return result if kind == "Count" else result.withColumn("result", F.round(F.col("result").cast("double"), 4))


PRICE = EXACT.format("l_extendedprice")
register_calculation("agg_sum", "Sum", f"CAST(sum({PRICE}) AS DOUBLE)")
register_calculation("agg_average", "Average", f"round(CAST(sum({PRICE}) AS DOUBLE) / count(*), 4)")
register_calculation("agg_count", "Count", "count(l_extendedprice)")
register_calculation("agg_min", "Min", f"CAST(min({PRICE}) AS DOUBLE)")
register_calculation("agg_max", "Max", f"CAST(max({PRICE}) AS DOUBLE)")

# -- statistical summaries ------------------------------------------------------------------

STAT_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def stat_sql(group: str) -> str:
    picked = f"{group}, " if group else ""
    parts = [
        f"""SELECT {picked}'{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS nulls,
                   count(DISTINCT {c}) AS distinct_values, min({c}) AS min_value, max({c}) AS max_value,
                   CAST(sum(CAST({c} AS DECIMAL(28,4))) AS DOUBLE) AS sum_value,
                   round(CAST(sum(CAST({c} AS DECIMAL(28,4))) AS DOUBLE) / count({c}), 4) AS mean_value,
                   round(stddev_samp({c}), 4) AS stddev_value
            FROM lineitem {"GROUP BY " + group if group else ""}"""
        for c in STAT_COLUMNS
    ]
    return " UNION ALL ".join(parts)


def exact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", *[money(c).alias(c) for c in STAT_COLUMNS])


@query("stat_set", stat_sql(""))
def stat_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.stat_set(exact_lines(spark, sf_dir), STAT_COLUMNS))


@query("stat_set_grouped", stat_sql("l_returnflag"))
def stat_set_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.stat_set(exact_lines(spark, sf_dir), STAT_COLUMNS, ["l_returnflag"]))


@query(
    "value_histogram",
    """SELECT l_returnflag, 'l_discount' AS "column", CAST(l_discount AS DECIMAL(18,2)) AS value, count(*) AS n FROM lineitem GROUP BY ALL
       UNION ALL SELECT l_returnflag, 'l_extendedprice', CAST(l_extendedprice AS DECIMAL(18,2)), count(*) FROM lineitem GROUP BY ALL""",
)
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_discount", "l_extendedprice"]
    counted = aggregates.value_histogram(exact_lines(spark, sf_dir), columns, ["l_returnflag"])
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column_no") + 1)
    return counted.select(F.col("__by_l_returnflag").alias("l_returnflag"), names.alias("column"), F.col("d").alias("value"), "n")


# -- counts ---------------------------------------------------------------------------------


@query("count_by_group", 'SELECT o_custkey, count(*) AS "rows" FROM orders GROUP BY o_custkey')
def count_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_by(table(spark, sf_dir, "orders"), "o_custkey")


@query("status_counts", "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY o_orderstatus")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_by(table(spark, sf_dir, "orders"), "o_orderstatus", name="orders")


KINDS = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "documents", "pages")


@query("kind_summary", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS items FROM {k}" for k in KINDS))
def kind_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.kind_summary({k: table(spark, sf_dir, k) for k in KINDS})


@query("shared_names", "SELECT lower(p_name) AS name, count(*) AS uses FROM part GROUP BY 1 HAVING count(*) > 1")
def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.shared_names(table(spark, sf_dir, "part"), "p_name")


@query("distinct_ci", "SELECT DISTINCT lower(p_name) AS name FROM part")
def distinct_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.distinct_names(table(spark, sf_dir, "part"), "p_name")


# -- usage ----------------------------------------------------------------------------------


@query(
    "period_summary",
    """SELECT strftime(ts, '%Y-%m') AS period, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS successes,
              count(*) FILTER (WHERE event_type = 'error') AS failures,
              CAST(sum(CAST("value" AS DECIMAL(18,2))) AS DOUBLE) / count("value") AS mean_value, count(DISTINCT user_id) AS users
       FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-03-01' GROUP BY 1""",
)
def period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return aggregates.period_summary(
        table(spark, sf_dir, "events"), "ts", failed, money("value"), "user_id", moment("2024-01-05"), moment("2024-03-01")
    )


@query("top_by_usage", "SELECT user_id, count(*) AS uses FROM events GROUP BY user_id ORDER BY uses DESC, user_id LIMIT 10")
def top_by_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_by_usage(table(spark, sf_dir, "events"), "user_id", 10)


@query(
    "throughput_window",
    """SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type,
              count(*) AS events FROM events GROUP BY ALL""",
)
def throughput_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.throughput(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour")


@query(
    "run_metrics",
    """SELECT user_id, strftime(ts, '%Y-%m-%d') AS run_day, count(*) AS extracted, count(*) FILTER (WHERE event_type <> 'error') AS transformed,
              count(*) FILTER (WHERE event_type = 'error') AS failed, date_sub('second', min(ts), max(ts)) AS seconds,
              count(*) FILTER (WHERE event_type = 'error') = 0 AS success
       FROM events GROUP BY ALL""",
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("run_day", F.date_format("ts", "yyyy-MM-dd"))
    return aggregates.run_metrics(events, ["user_id", "run_day"], F.col("event_type") == "error", "ts")


@query(
    "precompute_stale",
    """WITH u AS (SELECT user_id, count(*) AS executions, max(ts) FILTER (WHERE event_type = 'purchase') AS last_cached_at
                  FROM events GROUP BY user_id)
       SELECT * FROM u WHERE executions >= 5 AND (last_cached_at IS NULL OR last_cached_at < TIMESTAMP '2024-01-29')
       ORDER BY executions DESC, user_id LIMIT 50""",
)
def precompute_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    usage = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("executions"), cached.alias("last_cached_at")
    )
    return aggregates.precompute_stale(usage, moment("2024-01-29"), "user_id")


# -- windows --------------------------------------------------------------------------------

ORDER_KEYS = ["o_orderkey", "o_custkey", "o_orderdate"]


def register_window(function: str, column: str | None, sql: str, order: str, total: bool, cast: str | None = None) -> None:
    """A window function over each customer's orders by date."""
    ties = ", o_orderkey" if total else ""

    @query(
        f"window_{function}",
        f"SELECT o_orderkey, o_custkey, o_orderdate, {sql.format(f'PARTITION BY o_custkey ORDER BY {order}{ties}')} AS result FROM orders",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select(*ORDER_KEYS, money("o_totalprice").alias("price"), "o_orderpriority")
        spec = WindowColumn("result", function, column)
        key = ["o_orderkey"] if total else []
        result = windows.windowed(orders, ["o_custkey"], ["o_orderdate"], spec, key).select(*ORDER_KEYS, "result")
        return result.withColumn("result", F.col("result").cast(cast)) if cast else result


SCAN = "ROWS UNBOUNDED PRECEDING"
AMOUNT = EXACT.format("o_totalprice")
register_window("row_number", None, "row_number() OVER ({})", "o_orderdate", True)
register_window("rank", None, "rank() OVER ({})", "o_orderdate", False)
register_window("dense_rank", None, "dense_rank() OVER ({})", "o_orderdate", False)
register_window("sum", "price", f"CAST(sum({AMOUNT}) OVER ({{}} {SCAN}) AS DOUBLE)", "o_orderdate", True, "double")
register_window(
    "avg", "price",
    f"CAST(sum({AMOUNT}) OVER ({{0}} {SCAN}) AS DOUBLE) / count(o_totalprice) OVER ({{0}} {SCAN})", "o_orderdate", True,
)
register_window("min", "price", f"CAST(min({AMOUNT}) OVER ({{}} {SCAN}) AS DOUBLE)", "o_orderdate", True, "double")
register_window("max", "price", f"CAST(max({AMOUNT}) OVER ({{}} {SCAN}) AS DOUBLE)", "o_orderdate", True, "double")
register_window("count", "price", f"count(o_totalprice) OVER ({{}} {SCAN})", "o_orderdate", True)
register_window("lag", "price", f"CAST(lag({AMOUNT}) OVER ({{}}) AS DOUBLE)", "o_orderdate", True, "double")
register_window("lead", "o_orderpriority", "lead(o_orderpriority) OVER ({})", "o_orderdate", True)


@query(
    "window_lag_offset",
    """SELECT event_id, user_id, lag("value", 3) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS earlier FROM events""",
)
def window_lag_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    spec = WindowColumn("earlier", "lag", "value", 3)
    return windows.windowed(events, ["user_id"], ["-ts"], spec, ["event_id"]).select("event_id", "user_id", "earlier")


@query(
    "period_over_period",
    """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS "value"
                  FROM orders GROUP BY 1)
       SELECT CAST(a.period AS VARCHAR) AS period, a."value", b."value" AS previous_month, a."value" - b."value" AS delta_month,
              round((a."value" - b."value") * 100 / b."value", 4) AS percent_month, c."value" AS previous_year,
              a."value" - c."value" AS delta_year, round((a."value" - c."value") * 100 / c."value", 4) AS percent_year
       FROM m a LEFT JOIN m b ON b.period = a.period - INTERVAL 1 MONTH LEFT JOIN m c ON c.period = a.period - INTERVAL 12 MONTH""",
)
def period_over_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = windows.period_over_period(
        table(spark, sf_dir, "orders"), "o_orderdate", F.sum(money("o_totalprice")).cast("double")
    )
    shares = {c: F.round(c, 4) for c in ("percent_month", "percent_year")}
    return result.withColumns(shares).withColumn("period", F.col("period").cast("string"))


@query(
    "latest_per_key",
    """SELECT event_id, user_id, ts, event_type, "value" FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return windows.latest_per_key(events, ["user_id"], ["ts", "event_id"])


@query(
    "field_history",
    """SELECT o_custkey, o_orderkey AS version, o_orderpriority, o_orderdate AS valid_from,
              lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS valid_to FROM orders""",
)
def field_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("version"), "o_orderpriority", F.col("o_orderdate").alias("valid_from")
    )
    return windows.field_history(versions, ["o_custkey"], "version", "valid_from")


# -- schedules ------------------------------------------------------------------------------

NOW = "2024-01-31 00:00:00"


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as schedules: last run by their last purchase, intervals as text, some of them no interval."""
    purchase = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    kind = F.col("user_id") % 4
    interval = F.when(kind == 0, "86400").when(kind == 1, "3600").when(kind == 2, "0").otherwise("abc")
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(purchase.alias("last_run"))
    return runs.withColumn("interval", interval)


SCHEDULE = """SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS last_run,
                     CASE user_id % 4 WHEN 0 THEN '86400' WHEN 1 THEN '3600' WHEN 2 THEN '0' ELSE 'abc' END AS "interval",
                     CASE user_id % 4 WHEN 0 THEN 86400 WHEN 1 THEN 3600 END AS step
              FROM events GROUP BY user_id"""


@query(
    "missed_slots",
    f"""WITH s AS ({SCHEDULE}),
             m AS (SELECT *, CAST(coalesce(date_sub('second', last_run, TIMESTAMP '{NOW}') // step, 0) AS BIGINT) AS missed FROM s)
        SELECT user_id, last_run, "interval", missed, CASE WHEN missed > 0 THEN last_run + to_seconds(step) END AS first_missed,
               CASE WHEN missed > 0 THEN last_run + to_seconds(step * missed) END AS latest_missed FROM m""",
)
def missed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedules.missed_slots(schedule(spark, sf_dir), "last_run", "interval", moment(NOW))


@query(
    "interval_due",
    f"""SELECT user_id, last_run, "interval", CASE WHEN step IS NULL THEN false WHEN last_run IS NULL THEN true
               ELSE date_sub('second', last_run, TIMESTAMP '{NOW}') >= step END AS due, last_run + to_seconds(step) AS next_run
        FROM ({SCHEDULE})""",
)
def interval_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedules.interval_due(schedule(spark, sf_dir), "last_run", "interval", moment(NOW))
