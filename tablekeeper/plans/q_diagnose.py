"""Queries: root cause, severity, classification, diagnosis text, open issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeeper.functions import text as T
from tablekeeper.operators import diagnose as G
from tablekeeper.operators.issues import lineage_context, open_issues
from tablekeeper.plans import standins as S
from tablekeeper.plans.q_lineage import (FQN_INPUTS_SQL, ROOTS_SQL, _reach_sql, downstream_impact_sql,
                                         fqn_inputs, roots)
from tablekeeper.plans.registry import query, table

def fu_sql(results_sql: str = S.TEST_RESULTS_SQL, roots_sql: str = ROOTS_SQL) -> str:
    return f"""(SELECT u.root, u.node, u.depth, t.test_name, t.test_fqn, t.result, t.result_id
  FROM {_reach_sql("up", 3, roots_sql)} u JOIN {results_sql} t ON t.node = u.node WHERE t.status = 'Failed')"""


def root_cause_sql(results_sql: str = S.TEST_RESULTS_SQL, roots_sql: str = ROOTS_SQL) -> str:
    return f"""(WITH fu AS {fu_sql(results_sql, roots_sql)},
agg AS (SELECT root, count(DISTINCT node) AS fn, count(*) AS fr FROM fu GROUP BY root),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node, test_fqn, result_id) AS rn
          FROM fu) x WHERE rn = 1)
SELECT r.root, CASE WHEN f.root IS NOT NULL THEN 'failed' ELSE 'success' END AS status,
  CAST(coalesce(a.fn, 0) AS BIGINT) AS failing_nodes, CAST(coalesce(a.fr, 0) AS BIGINT) AS failing_results,
  f.node AS first_node, f.depth AS first_depth, f.test_name, f.test_fqn, f.result
FROM {roots_sql} r LEFT JOIN agg a ON a.root = r.root LEFT JOIN first f ON f.root = r.root)"""


ROOT_CAUSE_SQL = root_cause_sql()


def _scan(spark, d, results=None):
    return (results if results is not None else S.test_results(spark, d)), S.lineage_edges(spark, d)


@query("root_cause", oracle=f"SELECT * FROM {ROOT_CAUSE_SQL} x")
def q_root_cause(spark, d):
    res, edges = _scan(spark, d)
    return G.root_cause(res, edges, roots(spark, d))


def _classify_sql(col: str) -> str:
    n = f"lower(coalesce({col}, ''))"
    return (f"CASE WHEN contains({n}, 'null') THEN 'null_values' WHEN contains({n}, 'duplicate') THEN 'duplicates' "
            f"WHEN contains({n}, 'format') OR contains({n}, 'mismatch') THEN 'format_mismatch' ELSE 'unknown' END")


def _severity_sql(p: G.SeverityParams, results_sql: str = S.TEST_RESULTS_SQL, roots_sql: str = ROOTS_SQL) -> str:
    ts = " ".join(f"WHEN itype = '{k}' THEN {v}" for k, v in p.issue_type_scores.items())
    return f"""(WITH fu AS {fu_sql(results_sql, roots_sql)},
firstnode AS (SELECT root, node FROM (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS rn
              FROM fu) x WHERE rn = 1),
tests AS (SELECT fu.*, {_classify_sql('fu.test_name')} AS cls FROM fu JOIN firstnode f ON f.root = fu.root AND f.node = fu.node),
per AS (SELECT root, count(*) AS n FROM tests GROUP BY root),
typed AS (SELECT root, cls FROM (SELECT root, cls, row_number() OVER (PARTITION BY root ORDER BY test_fqn, result_id) AS rn
          FROM tests WHERE cls <> 'unknown') x WHERE rn = 1),
j AS (SELECT r.root, per.n, coalesce(typed.cls, 'unknown') AS itype, i.downstream_edges AS de, i.downstream_assets AS da
      FROM {roots_sql} r LEFT JOIN per ON per.root = r.root LEFT JOIN typed ON typed.root = r.root
      LEFT JOIN {downstream_impact_sql(roots_sql)} i ON i.root = r.root),
s AS (SELECT *, least({p.max_failing_test_score}, n * {p.failing_test_points}) AS tsc,
        CASE {ts} ELSE 0 END AS typ, least({p.max_downstream_impact_score}, de * {p.downstream_impact_points}) AS dsc FROM j)
SELECT root, CASE WHEN n IS NOT NULL THEN 'failed' ELSE 'success' END AS status,
  CAST(CASE WHEN n IS NOT NULL THEN least({p.max_total_score}, {p.base_score} + tsc + typ + dsc) ELSE 0 END AS INTEGER)
    AS severity_score,
  CAST(CASE WHEN n IS NOT NULL THEN {p.base_score} END AS INTEGER) AS base_score,
  CAST(CASE WHEN n IS NOT NULL THEN tsc END AS INTEGER) AS failing_tests_score,
  CAST(CASE WHEN n IS NOT NULL THEN typ END AS INTEGER) AS issue_type_score,
  CAST(CASE WHEN n IS NOT NULL THEN dsc END AS INTEGER) AS downstream_impact_score,
  CAST(n AS BIGINT) AS failing_tests_count,
  CASE WHEN n IS NOT NULL THEN itype END AS issue_type,
  CAST(CASE WHEN n IS NOT NULL THEN de END AS BIGINT) AS downstream_count,
  CAST(da AS BIGINT) AS downstream_assets,
  CASE WHEN (CASE WHEN n IS NOT NULL THEN least({p.max_total_score}, {p.base_score} + tsc + typ + dsc) ELSE 0 END)
       >= {G.HIGH_AT} THEN 'high'
       WHEN (CASE WHEN n IS NOT NULL THEN least({p.max_total_score}, {p.base_score} + tsc + typ + dsc) ELSE 0 END)
       >= {G.MEDIUM_AT} THEN 'medium' ELSE 'low' END AS severity
FROM s)"""


@query("severity", oracle=f"SELECT * FROM {_severity_sql(G.DEFAULT_SEVERITY)} x")
def q_severity(spark, d):
    res, edges = _scan(spark, d)
    return G.severity(res, edges, roots(spark, d), G.DEFAULT_SEVERITY)


@query("severity_example_config", oracle=f"SELECT * FROM {_severity_sql(G.EXAMPLE_SEVERITY)} x")
def q_severity_example(spark, d):
    res, edges = _scan(spark, d)
    return G.severity(res, edges, roots(spark, d), G.EXAMPLE_SEVERITY)


def diagnosis_payloads(spark, d):
    """The scan of every root as a JSON payload: its failing nodes with their tests, in order, and its downstream edges.
    Every fifth root that passes says that it failed, without a node."""
    res, edges = _scan(spark, d)
    r = roots(spark, d)
    tests = (G.upstream_reach(edges, r).join(res.filter(F.col("status") == "Failed"), "node").groupBy("root", "depth", "node")
             .agg(F.sort_array(F.collect_list(F.struct("test_fqn", "result_id", "test_name", "result"))).alias("t")))
    case = lambda t: F.struct(t["test_name"].alias("name"), t["test_fqn"].alias("testCaseFQN"), t["result"].alias("result"))
    node = F.struct(F.format_string("svc.db.mart.t%d", "node").alias("fullyQualifiedName"),
                    F.struct(F.transform("t", case).alias("testCaseResults")).alias("failingTestCases"))
    nodes = (tests.select("root", F.struct("depth", "node", node.alias("json")).alias("n")).groupBy("root")
             .agg(F.transform(F.sort_array(F.collect_list("n")), lambda n: n["json"]).alias("nodes")))
    impact = G.downstream_impact(edges, r, 2).withColumnRenamed("root", "_root")
    edge = lambda i: F.struct(F.lit("here").alias("fromEntity"), F.concat(F.lit("to "), i % F.col("downstream_assets")).alias("toEntity"))
    down = F.when(F.col("downstream_edges") > 0, F.transform(F.sequence(F.lit(1).cast("long"), "downstream_edges"), edge)).otherwise(F.array())
    status = F.when(F.col("nodes").isNotNull() | (F.col("root") % 5 == 0), "failed").otherwise("success")
    every = r.select("root").distinct().join(nodes, "root", "left").join(impact, F.col("root") == F.col("_root"))
    return every.select("root", F.to_json(F.struct(
        status.alias("status"), F.struct(F.size("nodes").alias("failingUpstreamNodesCount"), F.col("nodes").alias("failingUpstreamNodes")).alias("upstreamAnalysis"),
        F.struct(down.alias("downstreamEdges")).alias("lineage"))).alias("payload"))


@query("severity_payloads", oracle=f"""
SELECT * EXCLUDE (untraced) REPLACE (CASE WHEN untraced THEN 'failed' ELSE status END AS status, CASE WHEN untraced THEN {G.DEFAULT_SEVERITY.base_score} ELSE base_score END AS base_score,
  CASE WHEN untraced THEN 0 ELSE failing_tests_score END AS failing_tests_score, CASE WHEN untraced THEN 0 ELSE issue_type_score END AS issue_type_score,
  CASE WHEN untraced THEN 0 ELSE downstream_impact_score END AS downstream_impact_score,
  CASE WHEN untraced THEN 0 ELSE failing_tests_count END AS failing_tests_count, CASE WHEN untraced THEN 'unknown' ELSE issue_type END AS issue_type,
  CASE WHEN untraced THEN 0 ELSE downstream_count END AS downstream_count)
FROM (SELECT *, status = 'success' AND root % 5 = 0 AS untraced FROM {_severity_sql(G.DEFAULT_SEVERITY)} x) y""")
def q_severity_payloads(spark, d):
    """Severity from payloads: as from the tables; failures without a failing node score 0 and show the base score."""
    return G.payload_severity(G.read_payloads(diagnosis_payloads(spark, d), "payload", "root"))


@query("root_cause_payloads", oracle=f"""
SELECT root, CASE WHEN root % 5 = 0 THEN 'failed' ELSE status END AS status, failing_nodes, failing_results,
  'svc.db.mart.t' || CAST(first_node AS VARCHAR) AS node_fqn, test_name, test_fqn, result FROM {ROOT_CAUSE_SQL} x""")
def q_root_cause_payloads(spark, d):
    return G.payload_cause(G.read_payloads(diagnosis_payloads(spark, d), "payload", "root"))


@query("severity_band", oracle=f"""
SELECT root, severity_score, severity FROM {_severity_sql(G.EXAMPLE_SEVERITY)} x""")
def q_severity_band(spark, d):
    s = q_severity_example(spark, d)
    return s.select("root", "severity_score", G.severity_band("severity_score").alias("severity"))


@query("classify_issue", oracle=f"""
SELECT result_id, test_name, {_classify_sql('test_name')} AS issue_type FROM {S.TEST_RESULTS_SQL} t""")
def q_classify_issue(spark, d):
    return S.test_results(spark, d).select("result_id", "test_name", T.classify_issue("test_name").alias("issue_type"))


def _label_sql(name: str, fqn: str) -> str:
    n, f = f"lower(coalesce({name}, ''))", f"lower(coalesce({fqn}, ''))"
    return (f"CASE WHEN contains({n}, 'null') OR contains({f}, 'null') THEN 'missing values' "
            f"WHEN contains({n}, 'duplicate') OR contains({f}, 'duplicate') THEN 'duplicate records' "
            f"WHEN contains({n}, 'format') OR contains({n}, 'mismatch') THEN 'format mismatch' ELSE 'data quality' END")


def issue_inputs(spark, d):
    """Test results with FQNs of 1..6 parts, so every column rule gets exercised."""
    tr = S.test_results(spark, d).select("result_id", "test_name", "table_fqn")
    return tr.join(fqn_inputs(spark, d).withColumnRenamed("fqn", "test_fqn"), "result_id")


ISSUE_INPUTS_SQL = f"""(SELECT t.result_id, t.test_name, t.table_fqn, f.fqn AS test_fqn
  FROM {S.TEST_RESULTS_SQL} t JOIN {FQN_INPUTS_SQL} f ON f.result_id = t.result_id)"""


@query("issue_label", oracle=f"""
SELECT result_id, test_name, test_fqn, {_label_sql('test_name', 'test_fqn')} AS issue_label FROM {ISSUE_INPUTS_SQL} i""")
def q_issue_label(spark, d):
    i = issue_inputs(spark, d)
    return i.select("result_id", "test_name", "test_fqn", T.issue_label("test_name", "test_fqn").alias("issue_label"))


def _column_sql(fqn: str, name: str, table_fqn: str) -> str:
    parts = f"string_split(coalesce({fqn}, ''), '.')"
    tname = f"string_split(coalesce({table_fqn}, ''), '.')[-1]"
    n = f"lower(coalesce({name}, ''))"
    stop = "[" + ", ".join(f"'{w}'" for w in T.COLUMN_STOP_WORDS) + "]"
    rules = " ".join(
        "WHEN " + " AND ".join(f"contains({n}, '{w}')" for w in words) + f" THEN '{col}'"
        for words, col in T.COLUMN_KEYWORDS)
    return f"""coalesce(
  CASE WHEN coalesce({fqn}, '') <> '' AND len({parts}) >= 5 AND {parts}[5] <> '' AND {parts}[5] <> {tname}
       THEN {parts}[5] END,
  CASE {rules} END,
  list_filter(regexp_extract_all({n}, '[a-z_]+'), lambda w: NOT list_contains({stop}, w) AND length(w) > 2)[1],
  '{T.UNKNOWN_COLUMN}')"""


@query("issue_column", oracle=f"""
SELECT result_id, test_name, test_fqn, table_fqn, {_column_sql('test_fqn', 'test_name', 'table_fqn')} AS issue_column
FROM {ISSUE_INPUTS_SQL} i""")
def q_issue_column(spark, d):
    i = issue_inputs(spark, d)
    return i.select("result_id", "test_name", "test_fqn", "table_fqn",
                    T.issue_column("test_fqn", "test_name", "table_fqn").alias("issue_column"))


def _diagnosis_sql(name: str, fqn: str, table_fqn: str) -> str:
    return (f"CASE WHEN {fqn} IS NOT NULL THEN 'We found ' || {_label_sql(name, fqn)} || ' in the ' || "
            f"string_split({table_fqn}, '.')[-1] || ' table''s ' || {_column_sql(fqn, name, table_fqn)} || "
            f"' column that needs attention.' ELSE '{G.NO_TEST_SENTENCE}' END")


@query("diagnosis_text", oracle=f"""
SELECT root, table_fqn,
  CASE WHEN test_fqn IS NOT NULL THEN {_label_sql('test_name', 'test_fqn')} END AS issue_label,
  CASE WHEN test_fqn IS NOT NULL THEN {_column_sql('test_fqn', 'test_name', 'table_fqn')} END AS issue_column,
  CASE WHEN test_fqn IS NOT NULL THEN 'We found ' || {_label_sql('test_name', 'test_fqn')} || ' in the ' ||
       string_split(table_fqn, '.')[-1] || ' table''s ' || {_column_sql('test_fqn', 'test_name', 'table_fqn')} ||
       ' column that needs attention.'
       ELSE '{G.NO_TEST_SENTENCE}' END AS diagnosis
FROM (SELECT *, 'svc.db.mart.t' || CAST(root AS VARCHAR) AS table_fqn FROM {ROOT_CAUSE_SQL} rc) x""")
def q_diagnosis_text(spark, d):
    res, edges = _scan(spark, d)
    rc = G.root_cause(res, edges, roots(spark, d))
    rc = rc.withColumn("table_fqn", F.format_string("svc.db.mart.t%d", "root"))
    return G.diagnosis_text(rc)


def messages(spark, d):
    """All turns as generated answers: some quoted, some behind a lead-in phrase, some plain."""
    c = table(spark, d, "conversations")
    k = F.col("conv_id") % 3
    msg = (F.when(k == 0, F.concat(F.lit("Here is a specific, detailed explanation of the data quality issue: "),
                                   F.col("text"), F.lit("  ")))
           .when(k == 1, F.concat(F.lit('Answer: "'), F.col("text"), F.lit('" - done')))
           .otherwise(F.concat(F.lit(' "'), F.col("text"))))
    return c.select("conv_id", "turn", msg.alias("message"))


MESSAGES_SQL = """(SELECT conv_id, turn, CASE conv_id % 3
    WHEN 0 THEN 'Here is a specific, detailed explanation of the data quality issue: ' || text || '  '
    WHEN 1 THEN 'Answer: "' || text || '" - done'
    ELSE ' "' || text END AS message FROM conversations)"""


def _strip_sql(x: str) -> str:
    ws = " || ".join(f"chr({ord(ch)})" for ch in T.WHITESPACE)
    return f"trim({x}, {ws})"


def _clean_sql(m: str) -> str:
    s = m
    for p in T.MESSAGE_PREFIXES:
        s = f"(CASE WHEN contains({s}, '{p}') THEN {_strip_sql(f'replace({s}, {chr(39)}{p}{chr(39)}, {chr(39)}{chr(39)})')} ELSE {s} END)"
    picked = f"(CASE WHEN regexp_matches({m}, '\"[^\"]+\"') THEN regexp_extract({m}, '\"([^\"]+)\"', 1) ELSE {s} END)"
    return _strip_sql(f"regexp_replace({_strip_sql(picked)}, '^\"+|\"+$', '', 'g')")


@query("clean_messages", oracle=f"SELECT conv_id, turn, {_clean_sql('message')} AS message FROM {MESSAGES_SQL} m")
def q_clean_messages(spark, d):
    m = messages(spark, d)
    return T.with_clean_message(m, "message", "cleaned").select("conv_id", "turn", F.col("cleaned").alias("message"))


def _issues_inputs(spark, d):
    res = S.test_results(spark, d)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return res.filter(F.col("ts") < cut), res.filter(F.col("ts") >= cut), S.lineage_edges(spark, d), roots(spark, d)


def _issues_sql(results_sql: str) -> str:
    rc, sev = root_cause_sql(results_sql), _severity_sql(G.DEFAULT_SEVERITY, results_sql)
    tf = "'svc.db.mart.t' || CAST(rc.root AS VARCHAR)"
    return f"""(SELECT rc.root AS issue_id, {tf} AS table_fqn, coalesce(rc.test_fqn, 'unknown') AS test,
  coalesce(rc.result, 'unknown') AS issue, sv.severity, sv.severity_score, sv.failing_tests_count, sv.issue_type,
  sv.downstream_count, {_diagnosis_sql('rc.test_name', 'rc.test_fqn', tf)} AS diagnosis,
  CAST(NULL AS VARCHAR) AS fix_sql, false AS ai_generated, CAST(NULL AS INTEGER) AS confidence_score,
  CAST(NULL AS BIGINT) AS expected_rows_affected, CAST(NULL AS INTEGER) AS hours_saved, false AS fix_generated,
  'open' AS status
FROM {rc} rc JOIN {sev} sv ON sv.root = rc.root WHERE rc.status = 'failed')"""


BEFORE_SQL = f"(SELECT * FROM {S.TEST_RESULTS_SQL} t WHERE ts < TIMESTAMP '2024-01-16 00:00:00')"
AFTER_SQL = f"(SELECT * FROM {S.TEST_RESULTS_SQL} t WHERE ts >= TIMESTAMP '2024-01-16 00:00:00')"


@query("open_issues", oracle=f"""
SELECT * FROM {_issues_sql(AFTER_SQL)} cur
UNION ALL
SELECT * REPLACE ('closed' AS status) FROM {_issues_sql(BEFORE_SQL)} prev
WHERE prev.status = 'open' AND prev.issue_id IN (SELECT root FROM {root_cause_sql(AFTER_SQL)} a WHERE status = 'success')""")
def q_open_issues(spark, d):
    """Issues after two scans: the second scan opens issues for failing roots
    and closes earlier open issues whose root now passes."""
    before, after, edges, r = _issues_inputs(spark, d)
    context = lineage_context(edges, r)
    previous = open_issues(before, edges, r, context=context)
    return open_issues(after, edges, r, previous=previous, context=context)
