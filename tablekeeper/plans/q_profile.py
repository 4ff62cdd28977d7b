"""Queries: metrics, profiles, reports, samples, fault injection, row-set edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeeper.functions.money import TOTAL, cents_to_amount, to_cents
from tablekeeper.operators import faults, layers, profile
from tablekeeper.plans import standins as S
from tablekeeper.plans.q_layers import STG_CUSTOMERS_SQL, STG_ORDERS_SQL, stg_customers, stg_orders
from tablekeeper.plans.registry import query, table


def pct_sql(part: str, whole: str, digits: int = 2) -> str:
    scale = 2 * 10 ** (digits + 2)
    return (f"CASE WHEN {whole} > 0 THEN CAST((({part}) * {scale} + ({whole})) // (2 * ({whole})) AS DOUBLE)"
            f" / {10 ** digits} END")


@query("table_metrics", oracle=f"""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE email IS NULL) AS null_count FROM {S.CUSTOMER_SPIKED_SQL} c""")
def q_table_metrics(spark, d):
    return profile.table_metrics(S.customer_spiked(spark, d), "email")


def _profile_sql(src: str, cols: list[str]) -> str:
    aggs = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS n{i}" for i, c in enumerate(cols))
    parts = [f"SELECT {i} AS ordinal, '{c}' AS column_name, r AS total_rows, n{i} AS null_count, "
             f"r - n{i} AS non_null_count, {pct_sql(f'n{i}', 'r')} AS null_pct FROM a" for i, c in enumerate(cols)]
    return f"WITH a AS (SELECT count(*) AS r, {aggs} FROM {src} t) " + " UNION ALL ".join(parts)


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
CUSTOMER_SPIKED_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "email"]


@query("profile", oracle=_profile_sql("lineitem", LINEITEM_COLS))
def q_profile(spark, d):
    return profile.profile(table(spark, d, "lineitem"))


@query("profile_customers", oracle=_profile_sql(S.CUSTOMER_SPIKED_SQL, CUSTOMER_SPIKED_COLS))
def q_profile_customers(spark, d):
    return profile.profile(S.customer_spiked(spark, d))


MART_ITEMS_SQL = f"""(SELECT oi.id FROM {S.RAW_ORDER_ITEMS_SQL} oi JOIN {S.RAW_PRODUCTS_SQL} p ON oi.sku = p.sku)"""
MART_CUSTOMERS_COUNT_SQL = f"""(SELECT c.customer_id FROM {STG_ORDERS_SQL} o JOIN {STG_CUSTOMERS_SQL} c
  ON o.customer_id = c.customer_id GROUP BY c.customer_id, c.customer_name)"""


#: fixed values: labels of the count report, in order, and what DuckDB counts for each
COUNT_REPORT = [
    ("raw_customers count:", "customer"), ("raw_orders count:", "orders"), ("raw_order_items count:", "lineitem"),
    ("raw_products count:", "part"), ("raw_supplies count:", "part"), ("raw_stores count:", "supplier"),
    ("stg_customers count:", "customer"), ("stg_orders count:", "orders"), ("stg_order_items count:", "lineitem"),
    ("stg_products count:", "part"), ("stg_supplies count:", "part"), ("stg_locations count:", "supplier"),
    ("mart_customers count:", MART_CUSTOMERS_COUNT_SQL), ("mart_orders count:", "orders"),
    ("mart_order_items count:", MART_ITEMS_SQL), ("mart_products count:", "part"),
    ("mart_locations count:", "supplier"), ("mart_supplies count:", "part"),
]


@query("row_count_report", oracle=" UNION ALL ".join(
    f"SELECT '{label}' AS info, count(*) AS count FROM {source} t{i}" for i, (label, source) in enumerate(COUNT_REPORT)))
def q_row_count_report(spark, d):
    raw = [S.raw_customers(spark, d), S.raw_orders(spark, d), S.raw_order_items(spark, d), S.raw_products(spark, d),
           S.raw_supplies(spark, d), S.raw_stores(spark, d)]
    stages = [layers.stage_customers, layers.stage_orders, layers.stage_order_items, layers.stage_products, layers.stage_supplies,
              layers.stage_locations]
    customers, orders, items, products, supplies, locations = staged = [f(r) for f, r in zip(stages, raw)]
    marts = [layers.mart_customers(orders, customers), layers.mart_orders(orders), layers.mart_order_items(items, products),
             layers.mart_products(products), layers.mart_locations(locations), layers.mart_supplies(supplies)]
    return profile.row_count_report([(label, df) for (label, _), df in zip(COUNT_REPORT, [*raw, *staged, *marts], strict=True)])


@query("non_null_rows", oracle=f"""
SELECT 'total' AS info, count(*) AS n FROM {S.CUSTOMER_SPIKED_SQL} a UNION ALL
SELECT 'null', count(*) FROM {S.CUSTOMER_SPIKED_SQL} b WHERE email IS NULL UNION ALL
SELECT 'non-null', count(email) FROM {S.CUSTOMER_SPIKED_SQL} c""")
def q_non_null_rows(spark, d):
    """Total, null and non-null rows of a column."""
    c = S.customer_spiked(spark, d)
    return profile.row_count_report([("total", c), ("null", profile.null_rows(c, "email")), ("non-null", profile.non_null_rows(c, "email"))]
                                    ).withColumnRenamed("count", "n")


MART_EMAIL_SQL = f"""(SELECT c.customer_id, s.customer_email FROM {STG_ORDERS_SQL} o
  JOIN {S.STG_CUSTOMERS_SPIKED_SQL} c ON o.customer_id = c.customer_id
  JOIN {S.STG_CUSTOMERS_SPIKED_SQL} s ON c.customer_id = s.customer_id
  GROUP BY c.customer_id, c.customer_name, s.customer_email)"""


@query("null_pct", oracle=f"""
WITH st AS (SELECT count(*) FILTER (WHERE customer_email IS NULL) AS n, count(*) AS r FROM {S.STG_CUSTOMERS_SPIKED_SQL} x),
     mt AS (SELECT count(*) FILTER (WHERE customer_email IS NULL) AS n, count(*) AS r FROM {MART_EMAIL_SQL} y)
SELECT 'Null count in staging:' AS info, n AS null_count, {pct_sql('n', 'r')} AS null_percentage FROM st
UNION ALL SELECT 'Null count in mart:', n, {pct_sql('n', 'r')} FROM mt""")
def q_null_pct(spark, d):
    stg = S.stg_customers_spiked(spark, d)
    mart = layers.mart_customers(stg_orders(spark, d), stg, email=stg)
    return profile.null_pct_report([("Null count in staging:", stg, "customer_email"),
                                    ("Null count in mart:", mart, "customer_email")])


@query("null_rows", oracle=f"SELECT * FROM {S.CUSTOMER_SPIKED_SQL} c WHERE email IS NULL")
def q_null_rows(spark, d):
    return profile.null_rows(S.customer_spiked(spark, d), "email")


@query("sample_null_rows", oracle=f"""
SELECT * FROM {S.STG_CUSTOMERS_SPIKED_SQL} s WHERE customer_email IS NULL ORDER BY customer_id LIMIT 10""")
def q_sample_null_rows(spark, d):
    return profile.sample_rows(S.stg_customers_spiked(spark, d), "customer_id", 10, column="customer_email")


@query("rows_by_id", oracle=f"""
SELECT customer_id, customer_name,
  CASE WHEN customer_email IS NULL THEN lower(replace(customer_name, ' ', '.')) || '@jaffleshop.com'
       ELSE customer_email END AS customer_email
FROM {S.STG_CUSTOMERS_SPIKED_SQL} s
WHERE customer_id IN (SELECT customer_id FROM {S.STG_CUSTOMERS_SPIKED_SQL} b WHERE customer_email IS NULL
                      ORDER BY customer_id LIMIT 10)
ORDER BY customer_id LIMIT 10""")
def q_rows_by_id(spark, d):
    """Re-read, after the e-mail fix, exactly the rows sampled before it."""
    before = S.stg_customers_spiked(spark, d)
    ids = profile.sample_rows(before, "customer_id", 10, column="customer_email").select("customer_id")
    after = faults.derive_email(before, "customer_email", "customer_name")
    return profile.sample_rows(after, "customer_id", 10, ids=ids)


def generated_items(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_discount",
        F.col("l_quantity").cast("int").alias("quantity"),
        cents_to_amount(to_cents("l_extendedprice")).alias("unit_price"),
        cents_to_amount(to_cents(F.col("l_extendedprice") * F.col("l_discount"))).alias("discount_amount"),
    )


GENERATED_ITEMS_SQL = """(SELECT l_orderkey, l_linenumber, l_discount, CAST(l_quantity AS INTEGER) AS quantity,
  CAST(CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0 AS DECIMAL(10,2)) AS unit_price,
  CAST(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) / 100.0 AS DECIMAL(10,2)) AS discount_amount
  FROM lineitem)"""

GENERATED_TOTAL = "quantity * unit_price - discount_amount"


@query("generated_total", oracle=f"""
SELECT *, CAST({GENERATED_TOTAL} AS DECIMAL(18,2)) AS total_price FROM {GENERATED_ITEMS_SQL} g""")
def q_generated_total(spark, d):
    g = generated_items(spark, d)
    return g.withColumn("total_price", F.expr(GENERATED_TOTAL).cast(TOTAL))


@query("dq_sample_probes", oracle=f"""
SELECT 'customers with null email' AS probe, count(*) AS count FROM {S.CUSTOMER_SPIKED_SQL} c WHERE email IS NULL
UNION ALL SELECT 'line items with zero discount', count(*) FROM lineitem WHERE l_discount = 0
UNION ALL SELECT 'orders without customer', count(*) FROM {S.ORDERS_ORPHANED_SQL} o
  WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)""")
def q_dq_sample_probes(spark, d):
    from tablekeeper.operators.checks import orphan_keys
    cust = S.customer_spiked(spark, d)
    orphans = orphan_keys(S.orders_orphaned(spark, d), "o_custkey", table(spark, d, "customer"), "c_custkey")
    return (cust.filter(F.col("email").isNull()).agg(F.count(F.lit(1)).alias("count"))
            .select(F.lit("customers with null email").alias("probe"), "count")
            .unionByName(table(spark, d, "lineitem").filter(F.col("l_discount") == 0)
                         .agg(F.count(F.lit(1)).alias("count"))
                         .select(F.lit("line items with zero discount").alias("probe"), "count"))
            .unionByName(orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
                         .select(F.lit("orders without customer").alias("probe"), "count")))


NULL_SPIKE_BASE_SQL = f"""(SELECT id AS customer_id, name AS customer_name,
  lower(replace(name, ' ', '.')) || '@jaffleshop.com' AS customer_email FROM {S.RAW_CUSTOMERS_SQL} r)"""


@query("null_spike", oracle=f"""
WITH s AS {NULL_SPIKE_BASE_SQL}
SELECT customer_id, customer_name,
  CASE WHEN customer_id IN (SELECT customer_id FROM s ORDER BY md5(CAST(customer_id AS VARCHAR)), customer_id
                            LIMIT (SELECT CAST(round(count(*) * 0.4) AS BIGINT) FROM s))
       THEN NULL ELSE customer_email END AS customer_email
FROM s""")
def q_null_spike(spark, d):
    base = faults.derive_email(stg_customers(spark, d).withColumn("customer_email", F.lit(None).cast("string")),
                               "customer_email", "customer_name")
    return faults.null_spike(base, "customer_id", "customer_email", 0.4)


@query("gen_customers", oracle="""
SELECT i AS customer_id, 'Customer ' || CAST(i AS VARCHAR) AS customer_name,
  DATE '2024-01-01' + CAST((i * 7919 + 13) % 91 AS INTEGER) AS first_order_date,
  DATE '2024-03-01' + CAST((i * 104729 + 7) % 31 AS INTEGER) AS most_recent_order_date,
  CAST((i * 31 + 3) % 11 + 1 AS INTEGER) AS number_of_orders,
  CAST((5000 + (i * 7907 + 11) % 100001) / 100.0 AS DECIMAL(10,2)) AS lifetime_spend,
  CASE WHEN (i * 37 + 11) % 100 < 40 THEN NULL ELSE 'customer' || CAST(i AS VARCHAR) || '@example.com' END
    AS customer_email
FROM (SELECT c_custkey + 1 AS i FROM customer) s""")
def q_gen_customers(spark, d):
    ids = table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id"))
    return faults.generate_customers(ids, "id")


@query("delete_in", oracle=f"""
SELECT * FROM {S.RAW_ORDER_ITEMS_SQL} oi
WHERE (order_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) IS NOT TRUE""")
def q_delete_in(spark, d):
    items = layers.stage_order_items(S.raw_order_items(spark, d))
    done = table(spark, d, "orders").filter(F.col("o_orderstatus") == "F")
    return faults.delete_in(items, "order_id", done, "o_orderkey")


@query("update_in", oracle="""
SELECT c_custkey, c_name, c_nationkey, c_acctbal,
  CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
       THEN 'FLAGGED' ELSE c_mktsegment END AS c_mktsegment
FROM customer""")
def q_update_in(spark, d):
    ids = table(spark, d, "orders").filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
    return faults.update_in(table(spark, d, "customer"), "c_custkey", ids, "o_custkey", {"c_mktsegment": "FLAGGED"})


# The driver tables and their columns (the schema every scale factor shares).
ALL_TABLES = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": LINEITEM_COLS,
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def _profile_all_sql() -> str:
    parts = []
    for t, cols in ALL_TABLES.items():
        parts.append(f"SELECT '{t}' AS table_name, * FROM ({_profile_sql(t, cols)}) p_{t}")
    return " UNION ALL ".join(parts)


@query("profile_all", oracle=_profile_all_sql())
def q_profile_all(spark, d):
    """Profile every driver table (the 'scan all tables' case): one aggregate per table."""
    return profile.profile_tables([(t, table(spark, d, t)) for t in ALL_TABLES])
