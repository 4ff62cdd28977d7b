"""Queries: data-quality checks and the fused check suite."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeeper.operators import checks
from tablekeeper.operators.checks import Rule
from tablekeeper.plans import standins as S
from tablekeeper.plans.q_profile import GENERATED_ITEMS_SQL, GENERATED_TOTAL, generated_items
from tablekeeper.plans.registry import query, table

URL_FORMAT = r"^https://[a-z0-9.-]+/[a-z]{2}/[0-9]+$"


def _check_sql(test_fqn, table_fqn, column, test_name, failed, total, src):
    return (f"SELECT '{test_fqn}' AS test_fqn, '{table_fqn}' AS table_fqn, '{column}' AS \"column\", "
            f"'{test_name}' AS test_name, CASE WHEN f > 0 THEN 'Failed' ELSE 'Success' END AS status, "
            f"f AS failed_rows, t AS total_rows, "
            f"CAST(f AS VARCHAR) || ' of ' || CAST(t AS VARCHAR) || ' rows failed {test_name}' AS result "
            f"FROM (SELECT CAST({failed} AS BIGINT) AS f, CAST({total} AS BIGINT) AS t FROM {src}) x")


def _row_sql(table_fqn, column, test_name, fail_pred, src):
    return _check_sql(f"{table_fqn}.{column}.{test_name}", table_fqn, column, test_name,
                      f"count(*) FILTER (WHERE {fail_pred})", "count(*)", src)


def _unique_sql(table_fqn, cols, test_name, src):
    keys = ", ".join(cols)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    col = "_".join(cols)
    inner = (f"(SELECT {keys}, count(*) AS n FROM {src} GROUP BY {keys}) g")
    return _check_sql(f"{table_fqn}.{col}.{test_name}", table_fqn, col, test_name,
                      f"coalesce(sum(CASE WHEN {nn} AND n > 1 THEN n - 1 END), 0)", "coalesce(sum(n), 0)", inner)


def _reference_sql(table_fqn, fk, parent, pk, test_name, src):
    failed = (f"(SELECT count(*) FROM {src} c WHERE c.{fk} IS NOT NULL AND NOT EXISTS "
              f"(SELECT 1 FROM {parent} p WHERE p.{pk} = c.{fk}))")
    return _check_sql(f"{table_fqn}.{fk}.{test_name}", table_fqn, fk, test_name,
                      failed, f"(SELECT count(*) FROM {src} c2)", "(SELECT 1) one")


CUST = "svc.db.mart.customer"
ORD = "svc.db.mart.orders"
ITEMS = "svc.db.mart.lineitem"
PAGES = "svc.db.raw.pages"
EMAIL_FORMAT = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"


@query("check_not_null", oracle=_row_sql(CUST, "email", "email_not_null", "email IS NULL", S.CUSTOMER_SPIKED_SQL + " c"))
def q_check_not_null(spark, d):
    return checks.check_not_null(S.customer_spiked(spark, d), "email", CUST, "email_not_null")


@query("check_unique", oracle=" UNION ALL ".join([
    _unique_sql(ITEMS, ["l_orderkey", "l_linenumber"], "line_unique", "lineitem"),
    _unique_sql("svc.db.mart.part", ["p_name"], "name_unique", "part"),
    _unique_sql("svc.db.raw.documents", ["text"], "text_unique", "documents"),
]))
def q_check_unique(spark, d):
    return (checks.check_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ITEMS, "line_unique")
            .unionByName(checks.check_unique(table(spark, d, "part"), ["p_name"], "svc.db.mart.part", "name_unique"))
            .unionByName(checks.check_unique(table(spark, d, "documents"), ["text"], "svc.db.raw.documents",
                                             "text_unique")))


@query("duplicate_keys", oracle="""
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_duplicate_keys(spark, d):
    return checks.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_reference", oracle=_reference_sql(ORD, "o_custkey", "customer", "c_custkey", "customer_exists",
                                                S.ORDERS_ORPHANED_SQL))
def q_check_reference(spark, d):
    return checks.check_reference(S.orders_orphaned(spark, d), "o_custkey", table(spark, d, "customer"),
                                  "c_custkey", ORD, "customer_exists")


@query("check_expression", oracle=_row_sql(ITEMS, "l_discount", "discount_positive",
                                           "(l_discount > 0) = false", "lineitem"))
def q_check_expression(spark, d):
    return checks.check_expression(table(spark, d, "lineitem"), "l_discount > 0", "l_discount", ITEMS,
                                   "discount_positive")


@query("check_format", oracle=_row_sql(PAGES, "url", "url_format_check",
                                       f"url IS NOT NULL AND NOT regexp_matches(url, '{URL_FORMAT}')", "pages"))
def q_check_format(spark, d):
    return checks.check_format(table(spark, d, "pages"), "url", URL_FORMAT, PAGES, "url_format_check")


def stored_totals(spark, d):
    """Line items with a stored total; every 50th order carries a stale value."""
    g = generated_items(spark, d)
    return g.withColumn("total_price", (F.expr(GENERATED_TOTAL) + F.when(F.col("l_orderkey") % 50 == 0, 1)
                                        .otherwise(0)).cast("decimal(18,2)"))


STORED_TOTALS_SQL = f"""(SELECT *, CAST({GENERATED_TOTAL} + CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END
  AS DECIMAL(18,2)) AS total_price FROM {GENERATED_ITEMS_SQL} g)"""


@query("check_generated", oracle=_row_sql(ITEMS, "total_price", "total_price_generated",
                                          f"total_price IS DISTINCT FROM ({GENERATED_TOTAL})",
                                          STORED_TOTALS_SQL + " s"))
def q_check_generated(spark, d):
    return checks.check_generated(stored_totals(spark, d), "total_price", GENERATED_TOTAL, ITEMS,
                                  "total_price_generated")


def asset_nodes(spark, d):
    """Lineage assets: customer tables (linked) and supplier tables (never linked)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.lit("customer").alias("kind"))
    s = table(spark, d, "supplier").select((-(F.col("s_suppkey") + 1)).alias("node"), F.lit("supplier").alias("kind"))
    return c.unionByName(s)


ASSET_NODES_SQL = """(SELECT c_custkey AS node, 'customer' AS kind FROM customer
  UNION ALL SELECT -(s_suppkey + 1), 'supplier' FROM supplier)"""


@query("orphan_assets", oracle=f"""
SELECT * FROM {ASSET_NODES_SQL} n
WHERE NOT EXISTS (SELECT 1 FROM {S.LINEAGE_EDGES_SQL} e WHERE e.src = n.node)
  AND NOT EXISTS (SELECT 1 FROM {S.LINEAGE_EDGES_SQL} e WHERE e.dst = n.node)""")
def q_orphan_assets(spark, d):
    return checks.orphan_assets(asset_nodes(spark, d), S.lineage_edges(spark, d), "node")


def suite_inputs(spark, d):
    cust = S.customer_spiked(spark, d)
    orders = S.orders_orphaned(spark, d)
    items = stored_totals(spark, d)
    tables = {CUST: cust, ORD: orders, ITEMS: items}
    rules = {
        CUST: [Rule("not_null", "email", "email_not_null"),
               Rule("format", "email", "email_format_check", EMAIL_FORMAT),
               Rule("unique", "c_custkey", "id_duplicate_check"),
               Rule("expression", "c_acctbal", "balance_not_negative", "c_acctbal >= 0")],
        ORD: [Rule("reference", "o_custkey", "customer_exists", (CUST, "c_custkey")),
              Rule("unique", "o_orderkey", "id_duplicate_check"),
              Rule("expression", "o_totalprice", "price_positive", "o_totalprice > 0")],
        ITEMS: [Rule("unique", "l_orderkey", "line_duplicate_check", columns=["l_orderkey", "l_linenumber"]),
                Rule("expression", "l_discount", "discount_positive", "l_discount > 0"),
                Rule("generated", "total_price", "total_price_generated", GENERATED_TOTAL)],
    }
    return tables, rules


RUN_SUITE_SQL = " UNION ALL ".join([
    _row_sql(CUST, "email", "email_not_null", "email IS NULL", S.CUSTOMER_SPIKED_SQL + " c"),
    _row_sql(CUST, "email", "email_format_check",
             f"email IS NOT NULL AND NOT regexp_matches(email, '{EMAIL_FORMAT}')", S.CUSTOMER_SPIKED_SQL + " c"),
    _row_sql(CUST, "c_acctbal", "balance_not_negative", "(c_acctbal >= 0) = false", S.CUSTOMER_SPIKED_SQL + " c"),
    _unique_sql(CUST, ["c_custkey"], "id_duplicate_check", S.CUSTOMER_SPIKED_SQL + " c"),
    _row_sql(ORD, "o_totalprice", "price_positive", "(o_totalprice > 0) = false", S.ORDERS_ORPHANED_SQL + " o"),
    _reference_sql(ORD, "o_custkey", "customer", "c_custkey", "customer_exists", S.ORDERS_ORPHANED_SQL),
    _unique_sql(ORD, ["o_orderkey"], "id_duplicate_check", S.ORDERS_ORPHANED_SQL + " o"),
    _row_sql(ITEMS, "l_discount", "discount_positive", "(l_discount > 0) = false", STORED_TOTALS_SQL + " s"),
    _row_sql(ITEMS, "total_price", "total_price_generated", f"total_price IS DISTINCT FROM ({GENERATED_TOTAL})",
             STORED_TOTALS_SQL + " s"),
    _unique_sql(ITEMS, ["l_orderkey", "l_linenumber"], "line_duplicate_check", STORED_TOTALS_SQL + " s"),
])


@query("run_suite", oracle=RUN_SUITE_SQL)
def q_run_suite(spark, d):
    tables, rules = suite_inputs(spark, d)
    return checks.run_suite(tables, rules)
