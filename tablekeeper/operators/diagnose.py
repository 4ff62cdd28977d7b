"""Root cause, severity, diagnosis text and open issues over whole tables.

Inputs
* ``results``: test results (node, test_name, test_fqn, status, result, result_id)
* ``edges``:   lineage edges (src, dst)
* ``roots``:   the tables being diagnosed (root)

Everything "first" (first failing node, first failing test) is an explicit
order - (depth, node, test_fqn, result_id) - and is computed with
``min(struct(...))`` aggregates rather than ``row_number`` windows: a root
with a huge number of failing tests is combined map-side instead of being
sorted inside one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeeper.functions import text as T
from tablekeeper.operators.lineage import downstream_impact, trace
from tablekeeper.sources.files import DIAGNOSIS


@dataclass(frozen=True)
class SeverityParams:
    base_score: int = 30
    failing_test_points: int = 5
    max_failing_test_score: int = 20
    issue_type_scores: dict = field(default_factory=lambda: {T.ISSUE_NULL: 20, T.ISSUE_DUP: 15,
                                                               T.ISSUE_FORMAT: 10})
    downstream_impact_points: int = 3
    max_downstream_impact_score: int = 15
    max_total_score: int = 100


# The defaults above and the example configuration's set.
DEFAULT_SEVERITY = SeverityParams()
EXAMPLE_SEVERITY = SeverityParams(30, 10, 40, {T.ISSUE_NULL: 20, T.ISSUE_DUP: 15, T.ISSUE_FORMAT: 10}, 10, 30, 100)

HIGH_AT, MEDIUM_AT = 70, 40
NO_TEST_SENTENCE = "We found a data quality issue that needs attention."


def severity_band(score) -> "F.Column":
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= HIGH_AT, "high").when(s >= MEDIUM_AT, "medium").otherwise("low")


def upstream_reach(edges: DataFrame, roots: DataFrame, up_depth: int = 3, cut_every: int | None = None) -> DataFrame:
    """(root, node, depth) for each root's upstream nodes, the root itself at depth 0.
    It depends on the lineage only, so one reach serves any number of scans."""
    if cut_every is None:
        return trace(edges, roots, "up", up_depth, include_self=True)
    return trace(edges, roots, "up", up_depth, include_self=True, cut_every=cut_every)


def failing_nodes(results: DataFrame) -> DataFrame:
    """One row per node with failed results: how many, the first, and the first whose test name classifies.

    A node with a huge number of failures collapses map-side here, before the
    lineage join copies it to every root that reaches it.
    """
    cls = T.classify_issue("test_name")
    return results.filter((F.col("status") == "Failed") & F.col("node").isNotNull()).groupBy("node").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("test_fqn", "result_id", "test_name", "result")).alias("f"),
        F.min(F.when(cls != T.ISSUE_UNKNOWN, F.struct("test_fqn", "result_id", cls.alias("cls")))).alias("typed"))


def failing_upstream(results: DataFrame, edges: DataFrame, roots: DataFrame, up_depth: int = 3,
                     reach: DataFrame | None = None) -> DataFrame:
    """Failing upstream nodes of each root (depth 0 = the root itself), one row per (root, node)."""
    up = reach if reach is not None else upstream_reach(edges, roots, up_depth)
    return up.join(failing_nodes(results), "node", "inner")


def root_cause(results: DataFrame, edges: DataFrame, roots: DataFrame, up_depth: int = 3,
               reach: DataFrame | None = None) -> DataFrame:
    """Per root: status, failing node and test counts, first failing node and its first test."""
    fu = failing_upstream(results, edges, roots, up_depth, reach)
    per_root = fu.groupBy("root").agg(
        F.count(F.lit(1)).alias("failing_nodes"),
        F.sum("n").alias("failing_results"),
        F.min(F.struct("depth", "node", "f")).alias("first"))
    r = roots.select("root").distinct()
    j = r.join(per_root, "root", "left")
    return j.select(
        "root",
        F.when(F.col("first").isNotNull(), "failed").otherwise("success").alias("status"),
        F.coalesce("failing_nodes", F.lit(0)).cast("bigint").alias("failing_nodes"),
        F.coalesce("failing_results", F.lit(0)).cast("bigint").alias("failing_results"),
        F.col("first.node").alias("first_node"), F.col("first.depth").alias("first_depth"),
        F.col("first.f.test_name").alias("test_name"), F.col("first.f.test_fqn").alias("test_fqn"),
        F.col("first.f.result").alias("result"))


def severity(results: DataFrame, edges: DataFrame, roots: DataFrame, params: SeverityParams = DEFAULT_SEVERITY,
             up_depth: int = 3, down_depth: int = 2, reach: DataFrame | None = None,
             impact: DataFrame | None = None) -> DataFrame:
    """Severity score and breakdown per root.

    failed:  base + min(max_tests, points * tests of the first failing node)
             + type score of the first of those tests whose name classifies
             + min(max_downstream, points * downstream edges), capped at the total.
    not failed: score 0, breakdown NULL.
    """
    first = (failing_upstream(results, edges, roots, up_depth, reach).groupBy("root")
             .agg(F.min(F.struct("depth", "node", "n", "typed")).alias("first")))
    per_root = first.select("root", F.col("first.n").alias("failing_tests_count"), F.col("first.typed").alias("typed"))
    impact = impact if impact is not None else downstream_impact(edges, roots, down_depth)
    r = roots.select("root").distinct()
    j = r.join(per_root, "root", "left").join(impact, "root", "left")
    failed = F.col("failing_tests_count").isNotNull()
    return scored(j.select("root", failed.alias("failed"), failed.alias("traced"), "failing_tests_count", F.col("typed.cls").alias("cls"),
                           "downstream_edges", "downstream_assets"), params)


def scored(j: DataFrame, params: SeverityParams = DEFAULT_SEVERITY) -> DataFrame:
    """Scores from (root, failed, traced, failing_tests_count, cls, downstream_edges, downstream_assets).

    ``traced``: there is a failing node.  A failure without one scores 0; its
    breakdown shows the base score and zeros.
    """
    p = params
    failed, traced = F.col("failed"), F.col("traced")
    none = F.lit(0)
    itype = F.when(traced, F.coalesce("cls", F.lit(T.ISSUE_UNKNOWN))).otherwise(F.lit(T.ISSUE_UNKNOWN))
    type_score = none
    for k, v in p.issue_type_scores.items():
        type_score = F.when(itype == k, F.lit(v)).otherwise(type_score)
    tests = F.when(traced, F.col("failing_tests_count")).otherwise(none)
    edges = F.when(traced, F.col("downstream_edges")).otherwise(none)
    tests_score = F.least(F.lit(p.max_failing_test_score), tests * p.failing_test_points)
    down_score = F.least(F.lit(p.max_downstream_impact_score), edges * p.downstream_impact_points)
    total = F.least(F.lit(p.max_total_score), F.lit(p.base_score) + tests_score + type_score + down_score)
    out = j.select(
        "root",
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed & traced, total).otherwise(0).cast("int").alias("severity_score"),
        F.when(failed, F.lit(p.base_score)).cast("int").alias("base_score"),
        F.when(failed, tests_score).cast("int").alias("failing_tests_score"),
        F.when(failed, type_score).cast("int").alias("issue_type_score"),
        F.when(failed, down_score).cast("int").alias("downstream_impact_score"),
        F.when(failed, tests).cast("bigint").alias("failing_tests_count"),
        F.when(failed, itype).alias("issue_type"),
        F.when(failed, edges).cast("bigint").alias("downstream_count"),
        F.col("downstream_assets").cast("bigint").alias("downstream_assets"),
    )
    return out.withColumn("severity", severity_band("severity_score"))


# ---------------------------------------------------------------- from diagnosis payloads
def read_payloads(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """Diagnosis payloads (JSON text) as root, failed, nodes, first (the first failing node), edges.

    Order is the payload's own: of the failing nodes the first one counts, of its
    tests the first, and for the type the first whose name classifies.  A payload
    that cannot be read, or says anything but "failed", did not fail.  All that
    follows is a projection of a payload's own arrays: nothing is shuffled.
    """
    d = df.select(F.col(id_col).alias("root"), F.from_json(F.col(json_col), DIAGNOSIS).alias("d"))
    nodes = F.coalesce("d.upstreamAnalysis.failingUpstreamNodes", F.array())
    return d.select("root", F.coalesce(F.col("d.status") == "failed", F.lit(False)).alias("failed"), nodes.alias("nodes"),
                    F.get(nodes, F.lit(0)).alias("first"), F.coalesce("d.lineage.downstreamEdges", F.array()).alias("edges"))


def _tests(node) -> "F.Column":
    return F.coalesce(node["failingTestCases"]["testCaseResults"], F.array())


def payload_severity(payloads: DataFrame, params: SeverityParams = DEFAULT_SEVERITY) -> DataFrame:
    """The severity of each payload of ``read_payloads``, in the columns of ``severity``."""
    tests = _tests(F.col("first"))
    typed = F.filter(F.transform(tests, lambda t: T.classify_issue(t["name"])), lambda c: c != T.ISSUE_UNKNOWN)
    targets = F.array_distinct(F.filter(F.transform("edges", lambda e: e["toEntity"]), lambda x: x.isNotNull()))
    return scored(payloads.select("root", "failed", (F.size("nodes") > 0).alias("traced"), F.size(tests).cast("bigint").alias("failing_tests_count"),
                                  F.get(typed, F.lit(0)).alias("cls"), F.size("edges").cast("bigint").alias("downstream_edges"),
                                  F.size(targets).cast("bigint").alias("downstream_assets")), params)


def payload_cause(payloads: DataFrame) -> DataFrame:
    """The root cause of each payload: status, failing nodes and tests, the first node's name and its first test."""
    test = F.get(_tests(F.col("first")), F.lit(0))
    each = F.transform("nodes", lambda n: F.size(_tests(n)))
    told = lambda c: F.when(F.col("failed"), c)
    return payloads.select(
        "root", F.when(F.col("failed"), "failed").otherwise("success").alias("status"),
        F.when(F.col("failed"), F.size("nodes")).otherwise(0).cast("bigint").alias("failing_nodes"),
        F.when(F.col("failed"), F.aggregate(each, F.lit(0), lambda a, b: a + b)).otherwise(0).cast("bigint").alias("failing_results"),
        told(F.col("first")["fullyQualifiedName"]).alias("node_fqn"), told(test["name"]).alias("test_name"),
        told(test["testCaseFQN"]).alias("test_fqn"), told(test["result"]).alias("result"))


def diagnosis_text(rc: DataFrame, table_fqn_col: str = "table_fqn") -> DataFrame:
    """Sentence naming problem, table and column of each root's first failing test."""
    table_name = T.last_part(F.col(table_fqn_col))
    label = T.issue_label("test_name", "test_fqn")
    column = T.issue_column("test_fqn", "test_name", table_fqn_col)
    sentence = F.format_string("We found %s in the %s table's %s column that needs attention.",
                               label, table_name, column)
    return rc.select("root", table_fqn_col,
                     F.when(F.col("test_fqn").isNotNull(), label).alias("issue_label"),
                     F.when(F.col("test_fqn").isNotNull(), column).alias("issue_column"),
                     F.when(F.col("test_fqn").isNotNull(), sentence).otherwise(F.lit(NO_TEST_SENTENCE))
                     .alias("diagnosis"))
