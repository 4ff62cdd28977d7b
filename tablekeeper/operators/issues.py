"""Issues: one open issue per failing root; a clean scan closes earlier issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeeper.operators import diagnose as G
from tablekeeper.operators.lineage import downstream_impact
from tablekeeper.session import materialize

ISSUE_COLUMNS = ["issue_id", "table_fqn", "test", "issue", "severity", "severity_score", "failing_tests_count",
                 "issue_type", "downstream_count", "diagnosis", "fix_sql", "ai_generated", "confidence_score",
                 "expected_rows_affected", "hours_saved", "fix_generated", "status"]


def lineage_context(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upstream reach and downstream impact of the roots, written once to the
    shared folder: they depend on the lineage only and serve every scan."""
    reach = materialize(G.upstream_reach(edges, roots, cut_every=0), "issues-reach")
    impact = materialize(downstream_impact(edges, roots), "issues-impact")
    return reach, impact


def open_issues(results: DataFrame, edges: DataFrame, roots: DataFrame, previous: DataFrame | None = None,
                params: G.SeverityParams = G.DEFAULT_SEVERITY, table_fqn_format: str = "svc.db.mart.t%d",
                context: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Scan -> issues.  ``previous``: an earlier issue table; its open issues
    whose root passes this scan come back with status 'closed'.  ``context``
    (from ``lineage_context``) lets several scans share one lineage trace."""
    reach, impact = context if context is not None else lineage_context(edges, roots)
    rc = G.root_cause(results, edges, roots, reach=reach).withColumn(
        "table_fqn", F.format_string(table_fqn_format, "root"))
    sev = G.severity(results, edges, roots, params, reach=reach, impact=impact).select(
        "root", "severity_score", "severity", "failing_tests_count", "issue_type", "downstream_count")
    txt = G.diagnosis_text(rc).select("root", "diagnosis")
    cur = (rc.filter(F.col("status") == "failed").join(sev, "root").join(txt, "root")
           .select(F.col("root").alias("issue_id"), "table_fqn",
                   F.coalesce("test_fqn", F.lit("unknown")).alias("test"),
                   F.coalesce("result", F.lit("unknown")).alias("issue"),
                   "severity", "severity_score", "failing_tests_count", "issue_type", "downstream_count", "diagnosis",
                   F.lit(None).cast("string").alias("fix_sql"), F.lit(False).alias("ai_generated"),
                   F.lit(None).cast("int").alias("confidence_score"),
                   F.lit(None).cast("bigint").alias("expected_rows_affected"),
                   F.lit(None).cast("int").alias("hours_saved"), F.lit(False).alias("fix_generated"),
                   F.lit("open").alias("status")))
    if previous is None:
        return cur
    passing = rc.filter(F.col("status") == "success").select(F.col("root").alias("issue_id"))
    closed = (previous.filter(F.col("status") == "open").join(passing, "issue_id", "left_semi")
              .withColumn("status", F.lit("closed")))
    return cur.unionByName(closed.select(*ISSUE_COLUMNS))
