"""Flagship: spoil -> check -> trace -> score -> fix -> verify, one row per column."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeeper.operators import diagnose as G
from tablekeeper.operators import fixes
from tablekeeper.operators.checks import Rule, fused_row_checks
from tablekeeper.operators.profile import pct, profile
from tablekeeper.plans import standins as S
from tablekeeper.plans.registry import query

TABLE_FQN = "svc.db.mart.customer"


def steward_report(spark, sf_dir):
    """Per column of the (spoiled) customer table: nulls before/after the repair,
    check status before/after, and the table's severity score and band."""
    spiked = S.customer_spiked(spark, sf_dir)                       # spoil (40 % NULL e-mails)
    rules = [Rule("not_null", c, f"{c}_not_null") for c in spiked.columns]
    before = fused_row_checks(spiked, TABLE_FQN, rules)             # check, one scan
    root = spiked.agg(F.min("c_custkey").alias("root"))             # the table's lineage node
    results = before.select(root.select("root").scalar().alias("node"), "test_name", "test_fqn", "status",
                            "result", F.xxhash64("test_fqn").alias("result_id"))
    sev = G.severity(results, S.lineage_edges(spark, sf_dir), root)  # trace + score
    fixed = fixes.fill_nulls(spiked, "email", fixes.DEFAULT_FILL)   # fix
    after = fused_row_checks(fixed, TABLE_FQN, rules)               # verify
    pb = profile(spiked).select("column_name", F.col("null_count").alias("before_nulls"))
    pa = profile(fixed).select("column_name", F.col("null_count").alias("after_nulls"))
    sb = before.select(F.col("column").alias("column_name"), F.col("status").alias("status_before"))
    sa = after.select(F.col("column").alias("column_name"), F.col("status").alias("status_after"))
    score = sev.select("severity_score").scalar()    # one root: scalar sub-queries, no pairing
    band = sev.select("severity").scalar()
    return (pb.join(pa, "column_name").join(sb, "column_name").join(sa, "column_name")
            .select("column_name", "before_nulls", "after_nulls",
                    (F.col("before_nulls") - F.col("after_nulls")).alias("nulls_fixed"),
                    pct(F.col("before_nulls") - F.col("after_nulls"), F.col("before_nulls"), 1).alias("reduction_pct"),
                    "status_before", "status_after", score.alias("severity_score"), band.alias("severity")))


_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "email"]
_ROOT_SQL = "(SELECT min(c_custkey) AS root FROM customer)"
_NULLS_SQL = " UNION ALL ".join(
    f"SELECT {i} AS i, '{c}' AS c, count(*) FILTER (WHERE {c} IS NULL) AS n, "
    f"{'0' if c == 'email' else f'count(*) FILTER (WHERE {c} IS NULL)'} AS n_after FROM {S.CUSTOMER_SPIKED_SQL} cs"
    for i, c in enumerate(_COLS))
_RESULTS_SQL = f"""(SELECT (SELECT min(c_custkey) FROM customer) AS node, c || '_not_null' AS test_name,
  '{TABLE_FQN}.' || c || '.' || c || '_not_null' AS test_fqn, CASE WHEN n > 0 THEN 'Failed' ELSE 'Success' END AS status,
  '' AS result, CAST(i AS BIGINT) AS result_id FROM ({_NULLS_SQL}) x)"""


def _oracle() -> str:
    from tablekeeper.plans.q_diagnose import _severity_sql
    from tablekeeper.plans.q_profile import pct_sql
    sev = _severity_sql(G.DEFAULT_SEVERITY, _RESULTS_SQL, _ROOT_SQL)
    return f"""
SELECT c AS column_name, n AS before_nulls, n_after AS after_nulls, n - n_after AS nulls_fixed,
  {pct_sql('n - n_after', 'n', 1)} AS reduction_pct,
  CASE WHEN n > 0 THEN 'Failed' ELSE 'Success' END AS status_before,
  CASE WHEN n_after > 0 THEN 'Failed' ELSE 'Success' END AS status_after,
  (SELECT severity_score FROM {sev} s1) AS severity_score, (SELECT severity FROM {sev} s2) AS severity
FROM ({_NULLS_SQL}) x"""


@query("steward_report", oracle=_oracle())
def q_steward_report(spark, d):
    return steward_report(spark, d)
