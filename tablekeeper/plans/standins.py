"""Stand-in inputs built from the driver tables.

These only reshape driver rows into the schemas the operators expect (the
reference's shop tables, metadata tables, fix history ...).  They do none of
the operators' work.  Each builder has a SQL twin (``*_SQL``) used inside the
oracle queries, with the same arithmetic so both engines see equal inputs.

Fixed values (chosen for the stand-ins, shared with the oracle SQL):
  fault injection   null e-mail when c_custkey % 5 < 2
  orphan orders     o_custkey + 10000000 when o_orderkey % 97 = 0
  test names        event_id % 4 -> email_not_null, id_duplicate_check,
                    phone_format_check, row_count
  lineage edges     ((k - 1) div 2 -> k) for k >= 1 and (k -> 7k + 3) where
                    7k + 3 < number of customers
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeeper.plans.registry import table

TEST_NAMES = ["email_not_null", "id_duplicate_check", "phone_format_check", "row_count"]
TEST_COLUMNS = ["customer_email", "customer_id", "phone", "customer_id"]


# ---------------------------------------------------------------- shop layers
def raw_customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


RAW_CUSTOMERS_SQL = "(SELECT c_custkey AS id, c_name AS name FROM customer)"


def raw_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    total = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderdate").alias("ordered_at"),
        (F.col("o_custkey") % 25).cast("int").alias("store_id"),
        (total - F.floor(total / 13)).cast("bigint").alias("subtotal"),
        F.floor(total / 13).cast("bigint").alias("tax_paid"),
        total.alias("order_total"),
    )


RAW_ORDERS_SQL = """(SELECT o_orderkey AS id, o_custkey AS customer, o_orderdate AS ordered_at,
  CAST(o_custkey % 25 AS INTEGER) AS store_id,
  CAST(round(o_totalprice * 100) AS BIGINT) - CAST(floor(CAST(round(o_totalprice * 100) AS BIGINT) / 13) AS BIGINT) AS subtotal,
  CAST(floor(CAST(round(o_totalprice * 100) AS BIGINT) / 13) AS BIGINT) AS tax_paid,
  CAST(round(o_totalprice * 100) AS BIGINT) AS order_total FROM orders)"""


def raw_order_items(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
                     F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku"))


RAW_ORDER_ITEMS_SQL = "(SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS sku FROM lineitem)"


def raw_products(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"),
                    F.col("p_type").alias("type"),
                    F.round(F.col("p_retailprice") * 100).cast("bigint").alias("price"),
                    F.col("p_brand").alias("description"))


RAW_PRODUCTS_SQL = """(SELECT p_partkey AS sku, p_name AS name, p_type AS type,
  CAST(round(p_retailprice * 100) AS BIGINT) AS price, p_brand AS description FROM part)"""


def raw_supplies(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select((F.col("p_partkey") * 10).alias("id"), F.col("p_brand").alias("name"),
                    F.round(F.col("p_retailprice") * 10).cast("bigint").alias("cost"),
                    (F.col("p_size") % 2 == 0).alias("perishable"), F.col("p_partkey").alias("sku"))


RAW_SUPPLIES_SQL = """(SELECT p_partkey * 10 AS id, p_brand AS name, CAST(round(p_retailprice * 10) AS BIGINT) AS cost,
  p_size % 2 = 0 AS perishable, p_partkey AS sku FROM part)"""


def raw_stores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    opened = F.make_timestamp_ntz(F.lit(2016), (F.col("s_nationkey") % 12 + 1).cast("int"), (F.col("s_suppkey") % 28 + 1).cast("int"),
                                  F.lit(9), F.lit(30), F.lit(0))
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), opened.alias("opened_at"),
                    ((F.col("s_suppkey") % 1000) / 10000).cast("decimal(5,4)").alias("tax_rate"))


RAW_STORES_SQL = """(SELECT s_suppkey AS id, s_name AS name,
  make_timestamp(2016, s_nationkey % 12 + 1, s_suppkey % 28 + 1, 9, 30, 0) AS opened_at,
  CAST((s_suppkey % 1000) / 10000 AS DECIMAL(5,4)) AS tax_rate FROM supplier)"""


def customer_spiked(spark: SparkSession, d: str) -> DataFrame:
    """customer + an e-mail column that is NULL for 40 % of keys."""
    c = table(spark, d, "customer")
    email = F.when(F.col("c_custkey") % 5 < 2, F.lit(None).cast("string")).otherwise(
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")))
    return c.withColumn("email", email)


CUSTOMER_SPIKED_SQL = """(SELECT *, CASE WHEN c_custkey % 5 < 2 THEN NULL
  ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email FROM customer)"""


def stg_customers_spiked(spark: SparkSession, d: str) -> DataFrame:
    return customer_spiked(spark, d).select(F.col("c_custkey").alias("customer_id"),
                                            F.col("c_name").alias("customer_name"),
                                            F.col("email").alias("customer_email"))


STG_CUSTOMERS_SPIKED_SQL = f"""(SELECT c_custkey AS customer_id, c_name AS customer_name, email AS customer_email
  FROM {CUSTOMER_SPIKED_SQL} cs)"""


def orders_orphaned(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 97 == 0, F.col("o_custkey") + 10000000)
                        .otherwise(F.col("o_custkey")))


ORDERS_ORPHANED_SQL = """(SELECT * REPLACE (CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 10000000
  ELSE o_custkey END AS o_custkey) FROM orders)"""


# ---------------------------------------------------------------- lineage
def lineage_edges(spark: SparkSession, d: str) -> DataFrame:
    """Directed edges between customer nodes (acyclic, deterministic)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    n = c.agg(F.count("*")).scalar()  # uncorrelated scalar subquery
    tree = c.filter(F.col("k") >= 1).select(F.floor((F.col("k") - 1) / 2).cast("bigint").alias("src"),
                                            F.col("k").alias("dst"))
    jump = (c.filter(F.col("k") * 7 + 3 < n)
            .select(F.col("k").alias("src"), (F.col("k") * 7 + 3).alias("dst")))
    return tree.unionByName(jump).distinct()


LINEAGE_EDGES_SQL = """(SELECT DISTINCT src, dst FROM (
  SELECT CAST(floor((c_custkey - 1) / 2) AS BIGINT) AS src, c_custkey AS dst FROM customer WHERE c_custkey >= 1
  UNION ALL
  SELECT c_custkey AS src, c_custkey * 7 + 3 AS dst FROM customer
  WHERE c_custkey * 7 + 3 < (SELECT count(*) FROM customer)))"""


def lineage_nodes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.format_string("n%d", F.col("c_custkey")).alias("id"),
        F.col("c_name").alias("name"),
        F.format_string("svc.db.mart.t%d", F.col("c_custkey")).alias("fqn"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("PIPELINE")).otherwise(F.lit("TABLE")).alias("type"),
    )


LINEAGE_NODES_SQL = """(SELECT 'n' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
  'svc.db.mart.t' || CAST(c_custkey AS VARCHAR) AS fqn,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'PIPELINE' ELSE 'TABLE' END AS type FROM customer)"""


# ---------------------------------------------------------------- test results
def test_results(spark: SparkSession, d: str) -> DataFrame:
    """One row per test execution: node, FQNs, name, status, message."""
    e = table(spark, d, "events")
    name = F.element_at(F.array(*[F.lit(x) for x in TEST_NAMES]), (F.col("event_id") % 4 + 1).cast("int"))
    colname = F.element_at(F.array(*[F.lit(x) for x in TEST_COLUMNS]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("result_id"),
        F.col("user_id").alias("node"),
        F.format_string("svc.db.mart.t%d", F.col("user_id")).alias("table_fqn"),
        name.alias("test_name"),
        F.format_string("svc.db.mart.t%d.%s.%s", F.col("user_id"), colname, name).alias("test_fqn"),
        F.when(F.col("event_type") == "error", F.lit("Failed")).otherwise(F.lit("Success")).alias("status"),
        F.format_string("Found %d rows failing %s", F.floor(F.col("value")).cast("bigint"), name).alias("result"),
        F.col("ts"),
    )


TEST_RESULTS_SQL = """(SELECT event_id AS result_id, user_id AS node,
  'svc.db.mart.t' || CAST(user_id AS VARCHAR) AS table_fqn,
  ['email_not_null','id_duplicate_check','phone_format_check','row_count'][event_id % 4 + 1] AS test_name,
  'svc.db.mart.t' || CAST(user_id AS VARCHAR) || '.' ||
    ['customer_email','customer_id','phone','customer_id'][event_id % 4 + 1] || '.' ||
    ['email_not_null','id_duplicate_check','phone_format_check','row_count'][event_id % 4 + 1] AS test_fqn,
  CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Success' END AS status,
  'Found ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' rows failing ' ||
    ['email_not_null','id_duplicate_check','phone_format_check','row_count'][event_id % 4 + 1] AS result,
  ts FROM events)"""


# ---------------------------------------------------------------- fix history
def fix_history_input(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("fix_id"),
        F.col("ts").alias("fixed_at"),
        F.format_string("svc.db.mart.t%d", F.col("user_id")).alias("table_fqn"),
        F.col("user_id").alias("table_key"),
        F.floor(F.col("value")).cast("int").alias("rows_affected"),
        (F.col("event_id") % 3 == 0).alias("ai_generated"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("int"))
         .otherwise((F.col("event_id") % 8 + 1).cast("int")).alias("hours_saved"),
        F.floor(F.col("value")).cast("int").alias("before_nulls"),
        F.lit(0).alias("after_nulls"),
        (F.col("event_id") % 101).cast("int").alias("severity_score"),
    )


FIX_HISTORY_SQL = """(SELECT event_id AS fix_id, ts AS fixed_at, 'svc.db.mart.t' || CAST(user_id AS VARCHAR) AS table_fqn,
  user_id AS table_key, CAST(floor(value) AS INTEGER) AS rows_affected, (event_id % 3 = 0) AS ai_generated,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 8 + 1 AS INTEGER) END AS hours_saved,
  CAST(floor(value) AS INTEGER) AS before_nulls, 0 AS after_nulls, CAST(event_id % 101 AS INTEGER) AS severity_score
  FROM events)"""


def fix_attempts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("ts"), F.col("event_id").alias("attempt_id"),
                    (F.col("event_type") != "error").alias("ok"))


FIX_ATTEMPTS_SQL = """(SELECT user_id AS key, ts, event_id AS attempt_id, (event_type <> 'error') AS ok FROM events)"""
