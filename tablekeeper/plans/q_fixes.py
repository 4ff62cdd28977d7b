"""Queries: repairs, suggestions, answer parsing, versioned apply / impact / rollback."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeeper.functions import text as T
from tablekeeper.operators import diagnose as G
from tablekeeper.operators import fixes
from tablekeeper.operators.apply import Fix, apply_fix, rollback
from tablekeeper.operators.checks import Rule
from tablekeeper.plans import standins as S
from tablekeeper.plans.q_checks import EMAIL_FORMAT, URL_FORMAT
from tablekeeper.plans.q_profile import pct_sql
from tablekeeper.plans.q_diagnose import ROOT_CAUSE_SQL, _classify_sql, _column_sql
from tablekeeper.plans.q_lineage import roots
from tablekeeper.plans.registry import query, table
from tablekeeper.session import shared_dir
from tablekeeper.sources.versions import VersionedTable


WS_SQL = " || ".join(f"chr({ord(ch)})" for ch in T.WHITESPACE)


def _strip(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


@query("fix_fill_null", oracle=f"""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, coalesce(email, '{fixes.DEFAULT_FILL}') AS email
FROM {S.CUSTOMER_SPIKED_SQL} c""")
def q_fix_fill_null(spark, d):
    return fixes.fill_nulls(S.customer_spiked(spark, d), "email", fixes.DEFAULT_FILL)


@query("fix_dedupe", oracle="""
SELECT * FROM part WHERE (p_partkey NOT IN (SELECT min(p_partkey) FROM part WHERE p_name IS NOT NULL GROUP BY p_name))
  IS NOT TRUE OR p_name IS NULL""")
def q_fix_dedupe(spark, d):
    return fixes.dedupe(table(spark, d, "part"), ["p_name"], "p_partkey", "keep")


@query("fix_dedupe_documents", oracle="""
SELECT * FROM documents WHERE (doc_id NOT IN (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL GROUP BY text))
  IS NOT TRUE OR text IS NULL""")
def q_fix_dedupe_documents(spark, d):
    return fixes.dedupe(table(spark, d, "documents"), ["text"], "doc_id", "keep")


@query("fix_dedupe_null_keys", oracle=f"""
SELECT * FROM {S.CUSTOMER_SPIKED_SQL} c
WHERE (c_custkey NOT IN (SELECT min(c_custkey) FROM {S.CUSTOMER_SPIKED_SQL} c2 GROUP BY email)) IS NOT TRUE""")
def q_fix_dedupe_null_keys(spark, d):
    """NULL e-mails grouped together, as GROUP BY does: one of them survives."""
    return fixes.dedupe(S.customer_spiked(spark, d), ["email"], "c_custkey", "group")


URL_PATTERN, URL_REPLACEMENT = r"^http://", "https://"


@query("fix_format", oracle=f"""
SELECT page_id, CASE WHEN url IS NOT NULL AND NOT regexp_matches(url, '{URL_FORMAT}')
  THEN regexp_replace(url, '{URL_PATTERN}', '{URL_REPLACEMENT}') ELSE url END AS url FROM pages""")
def q_fix_format(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return fixes.fix_format(p, "url", URL_FORMAT, URL_PATTERN, URL_REPLACEMENT)


def issue_rows(spark, d):
    rc = G.root_cause(S.test_results(spark, d), S.lineage_edges(spark, d), roots(spark, d))
    rc = rc.withColumn("table_fqn", F.format_string("svc.db.mart.t%d", "root"))
    return rc.select(F.col("root").alias("issue_id"), "table_fqn", F.col("test_fqn").alias("test"),
                     F.col("result").alias("issue"), T.classify_issue("test_name").alias("issue_type"),
                     T.issue_column("test_fqn", "test_name", "table_fqn").alias("issue_column"), "status")


def rule_table(spark):
    return spark.createDataFrame(fixes.FIX_RULES, "issue_type string, template string, confidence_score int, "
                                                  "hours_saved int")


RULES_SQL = "(VALUES " + ", ".join(f"('{t}', '{s.replace(chr(39), chr(39) * 2)}', {c}, {h})"
                                   for t, s, c, h in fixes.FIX_RULES) + ") AS r(issue_type, template, conf, hours)"


@query("suggest_fix", oracle=f"""
WITH i AS (SELECT root AS issue_id, 'svc.db.mart.t' || CAST(root AS VARCHAR) AS table_fqn, test_fqn AS test,
             result AS issue, {_classify_sql('test_name')} AS issue_type,
             {_column_sql('test_fqn', 'test_name', "'svc.db.mart.t' || CAST(root AS VARCHAR)")} AS issue_column, status
           FROM {ROOT_CAUSE_SQL} rc),
j AS (SELECT i.*, r.template, r.conf, r.hours FROM i LEFT JOIN {RULES_SQL} ON r.issue_type = i.issue_type
      WHERE i.status = 'failed')
SELECT issue_id, issue, test AS test_name,
  replace(replace(template, '{{table}}', table_fqn), '{{column}}', issue_column) AS fix_sql,
  regexp_replace(replace(replace(template, '{{table}}', table_fqn), '{{column}}', issue_column),
                 '{T.FOUR_PART_NAME}', '\\3.\\4', 'g') AS executable_sql,
  regexp_replace(table_fqn, '^.*\\.([^.]+\\.[^.]+)$', '\\1') AS target_table,
  false AS ai_generated, '{fixes.RULES_MODEL}' AS model,
  CAST(coalesce(conf, 50) AS INTEGER) AS confidence_score, CAST(coalesce(hours, 0) AS INTEGER) AS hours_saved
FROM j""")
def q_suggest_fix(spark, d):
    return fixes.suggest_fix(issue_rows(spark, d), rule_table(spark))


def answers(spark, d):
    """Generated-answer texts keyed by order: with/without metrics block, valid and
    invalid integers, with/without a label, statements in different places."""
    k = F.col("o_orderkey")
    pick = lambda vals, m: F.element_at(F.array(*[F.lit(v) for v in vals]), (k % m + 1).cast("int"))
    label = pick(ANSWER_LABELS, 4)
    stmt = pick(ANSWER_STATEMENTS, 3)
    conf = F.when(k % 7 == 0, F.lit("high")).otherwise((k % 100).cast("string"))
    metrics = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(
        F.lit("\n\nMETRICS:\nconfidence_score: "), conf, F.lit("\nexpected_rows_affected: "),
        (k % 1000).cast("string"), F.lit("\nhours_saved: "), (k % 8 + 1).cast("string"),
        F.when(k % 11 == 0, F.lit("\nhours_saved: x")).otherwise(F.lit(""))))
    return table(spark, d, "orders").select(k.alias("answer_id"), F.concat(label, stmt, metrics).alias("answer"))


ANSWER_LABELS = ["SQL Fix: ", "", "Solution: ", "Here is the fix: "]
ANSWER_STATEMENTS = [
    "UPDATE svc.db.mart.customers SET email = 'unknown@example.com' WHERE email IS NULL;",
    "-- updated_at is refreshed too\nDELETE FROM svc.db.mart.orders WHERE id NOT IN "
    "(SELECT MIN(id) FROM svc.db.mart.orders GROUP BY o_custkey);",
    "sql\nINSERT INTO svc.db.staging.audit_log SELECT * FROM svc.db.mart.customers;",
]


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


ANSWERS_SQL = f"""(SELECT o_orderkey AS answer_id,
  [{', '.join(_lit(x) for x in ANSWER_LABELS)}][o_orderkey % 4 + 1] ||
  [{', '.join(_lit(x) for x in ANSWER_STATEMENTS)}][o_orderkey % 3 + 1] ||
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE
    chr(10) || chr(10) || 'METRICS:' || chr(10) || 'confidence_score: ' ||
    CASE WHEN o_orderkey % 7 = 0 THEN 'high' ELSE CAST(o_orderkey % 100 AS VARCHAR) END ||
    chr(10) || 'expected_rows_affected: ' || CAST(o_orderkey % 1000 AS VARCHAR) ||
    chr(10) || 'hours_saved: ' || CAST(o_orderkey % 8 + 1 AS VARCHAR) ||
    CASE WHEN o_orderkey % 11 = 0 THEN chr(10) || 'hours_saved: x' ELSE '' END END AS answer FROM orders)"""


def _fix_sql_sql(t: str) -> str:
    h = f"(CASE WHEN contains({t}, 'METRICS:') THEN {_strip(f'split_part({t}, {chr(39)}METRICS:{chr(39)}, 1)')} ELSE {t} END)"
    for label in T.FIX_LABELS:
        h = (f"(CASE WHEN starts_with({h}, '{label}') THEN {_strip(f'substr({h}, {len(label) + 1})')} "
             f"ELSE {h} END)")
    kw = "|".join(T.SQL_KEYWORDS)
    lead = f"regexp_extract({h}, '(?is)^(.*?)\\b({kw})\\b', 1)"
    cut = _strip(f"substr({h}, length({lead}) + 1)")
    return f"(CASE WHEN regexp_matches({h}, '(?is)\\b({kw})\\b') THEN {cut} ELSE {h} END)"


def _metric_sql(t: str, key: str) -> str:
    block = _strip(f"split_part({t}, 'METRICS:', 2)")
    lines = f"list_transform(string_split({block}, chr(10)), lambda l: {_strip('l')})"
    val = lambda x: _strip(f"split_part({x}, ':', 2)")
    good = f"list_filter({lines}, lambda l: starts_with(l, '{key}:') AND regexp_matches({val('l')}, '^[+-]?[0-9]+$'))"
    parsed = f"CAST({val(f'{good}[-1]')} AS BIGINT)"
    d = T.METRIC_DEFAULTS[key]
    return f"CAST(CASE WHEN contains({t}, 'METRICS:') THEN coalesce({parsed}, {d}) ELSE {d} END AS BIGINT)"


PARSED_SQL = f"""(SELECT answer_id, answer, {_fix_sql_sql('answer')} AS fix_sql, contains(answer, 'METRICS:') AS has_metrics,
  {', '.join(f"{_metric_sql('answer', k)} AS {k}" for k in T.METRIC_KEYS)} FROM {ANSWERS_SQL} a)"""


@query("parse_responses", oracle=f"SELECT * FROM {PARSED_SQL} p")
def q_parse_responses(spark, d):
    return fixes.parse_responses(answers(spark, d), "answer")


@query("parse_responses_fallback", oracle=f"""
SELECT answer_id, nulls, confidence_score,
  CASE WHEN has_metrics THEN expected_rows_affected ELSE nulls END AS expected_rows_affected,
  CASE WHEN has_metrics THEN hours_saved WHEN nulls // 100 < 1 THEN 1 ELSE nulls // 100 END AS hours_saved
FROM (SELECT *, answer_id % 1000 AS nulls FROM {PARSED_SQL} p) q""")
def q_parse_responses_fallback(spark, d):
    """Answers without a metrics block are estimated from the null count of their issue's column."""
    a = answers(spark, d).withColumn("nulls", (F.col("answer_id") % 1000).cast("bigint"))
    return fixes.parse_responses(a, "answer", null_count="nulls").select(
        "answer_id", "nulls", "confidence_score", "expected_rows_affected", "hours_saved")


@query("rewrite_fqn", oracle=f"""
SELECT answer_id, fix_sql, regexp_replace(fix_sql, '{T.FOUR_PART_NAME}', '\\3.\\4', 'g') AS executable_sql
FROM {PARSED_SQL} p""")
def q_rewrite_fqn(spark, d):
    p = fixes.parse_responses(answers(spark, d), "answer")
    return p.select("answer_id", "fix_sql", T.rewrite_fqn("fix_sql").alias("executable_sql"))


@query("fix_estimates", oracle=f"""
SELECT c_mktsegment, count(*) FILTER (WHERE email IS NULL) AS null_count,
  count(*) FILTER (WHERE email IS NULL) AS expected_rows_affected,
  CAST(greatest(1, count(*) FILTER (WHERE email IS NULL) // 100) AS INTEGER) AS hours_saved, 50 AS confidence_score
FROM {S.CUSTOMER_SPIKED_SQL} c GROUP BY c_mktsegment""")
def q_fix_estimates(spark, d):
    m = S.customer_spiked(spark, d).groupBy("c_mktsegment").agg(F.count_if(F.col("email").isNull()).alias("null_count"))
    return fixes.fix_estimates(m)


# ---------------------------------------------------------------- versioned flow
def _versioned_customers(spark, d):
    vt = VersionedTable(spark, shared_dir(spark, "customer-versions"))
    vt.commit(S.customer_spiked(spark, d).select("c_custkey", "c_name", "email"))
    return vt


FILL_FIX = Fix("fill_null", "email", fixes.DEFAULT_FILL)


@query("apply_fix", oracle=f"""
SELECT 'customer' AS table_name, 1 AS version_before, 2 AS version_after, true AS success,
  count(*) FILTER (WHERE email IS NULL) AS rows_affected,
  'Fix applied: ' || CAST(count(*) FILTER (WHERE email IS NULL) AS VARCHAR) || ' rows affected' AS message
FROM {S.CUSTOMER_SPIKED_SQL} c""")
def q_apply_fix(spark, d):
    vt = _versioned_customers(spark, d)
    return apply_fix(spark, vt, FILL_FIX, "customer")


@query("fix_impact", oracle=f"""
SELECT 'email' AS column_name, count(*) FILTER (WHERE email IS NULL) AS before_nulls, CAST(0 AS BIGINT) AS after_nulls,
  count(*) FILTER (WHERE email IS NULL) AS nulls_fixed,
  {pct_sql("count(*) FILTER (WHERE email IS NULL)", "count(*) FILTER (WHERE email IS NULL)", 1)} AS reduction_pct,
  count(*) AS before_rows, count(*) AS after_rows FROM {S.CUSTOMER_SPIKED_SQL} c""")
def q_fix_impact(spark, d):
    vt = _versioned_customers(spark, d)
    apply_fix(spark, vt, FILL_FIX, "customer").collect()
    return fixes.fix_impact(vt.read(1), vt.read(2), "email")


@query("before_after", oracle=f"""
SELECT c_custkey, email AS before_email, '{fixes.DEFAULT_FILL}' AS after_email
FROM {S.CUSTOMER_SPIKED_SQL} c WHERE email IS NULL""")
def q_before_after(spark, d):
    vt = _versioned_customers(spark, d)
    apply_fix(spark, vt, FILL_FIX, "customer").collect()
    return fixes.before_after(vt.read(1), vt.read(2), "c_custkey", ["email"])


@query("rollback", oracle=f"""
SELECT 'customer' AS table_name, 2 AS version_before, 1 AS version_after, true AS success,
  count(*) FILTER (WHERE email IS NULL) AS rows_restored, 'reverted' AS action FROM {S.CUSTOMER_SPIKED_SQL} c""")
def q_rollback(spark, d):
    vt = _versioned_customers(spark, d)
    apply_fix(spark, vt, FILL_FIX, "customer").collect()
    return rollback(spark, vt, 1, "c_custkey", ["email"], "customer")


@query("rollback_dedupe", oracle="""
SELECT 'orders' AS table_name, 2 AS version_before, 1 AS version_after, true AS success,
  (SELECT count(*) FROM orders) - (SELECT count(DISTINCT o_custkey) FROM orders) AS rows_restored, 'reverted' AS action,
  'reverted' AS history_action, true AS history_time,
  (SELECT count(*) FROM orders) - (SELECT count(DISTINCT o_custkey) FROM orders) AS history_rows""")
def q_rollback_dedupe(spark, d):
    """Taking a de-duplication back restores the removed rows, counts them and writes a 'reverted' entry."""
    vt = VersionedTable(spark, shared_dir(spark, "order-versions"))
    vt.commit(table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    apply_fix(spark, vt, Fix("dedupe", "o_custkey", keys=["o_custkey"], id_col="o_orderkey"), "orders").collect()
    path = shared_dir(spark, "revert-history")
    out = rollback(spark, vt, 1, "o_orderkey", ["o_custkey"], "orders", {"test": "orders_unique"}, path)
    h = spark.read.parquet(path)
    return out.join(
        h.select(F.col("table_fqn").alias("table_name"), F.col("action").alias("history_action"),
                 F.col("reverted_at").isNotNull().alias("history_time"), F.col("rows_affected").alias("history_rows")), "table_name")


# ---------------------------------------------------------------- approve-and-apply flow
FLOW_TABLE = "svc.db.mart.customer"
FLOW_DECIDED_AT = "2024-01-31 00:00:00"
FLOW_KEY = ["c_nationkey", "c_mktsegment"]


def flow_customers(spark, d):
    """Customers with missing e-mails, some in capitals behind a blank, some that are none, and repeated (nation, segment) keys."""
    k = F.col("c_custkey")
    email = F.when(k % 7 == 0, F.concat(F.lit(" "), F.upper("email"))).when(k % 11 == 0, F.lit("none at all")).otherwise(F.col("email"))
    return S.customer_spiked(spark, d).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.when(F.col("email").isNotNull(), email).alias("email"))


FLOW_CUSTOMERS_SQL = f"""(SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CASE WHEN email IS NULL THEN NULL WHEN c_custkey % 7 = 0
  THEN ' ' || upper(email) WHEN c_custkey % 11 = 0 THEN 'none at all' ELSE email END AS email FROM {S.CUSTOMER_SPIKED_SQL} c)"""
FLOW_RULES = [Rule("not_null", "email", "email_not_null"), Rule("format", "email", "email_format_check", EMAIL_FORMAT),
              Rule("unique", FLOW_KEY[0], "key_duplicate_check", columns=FLOW_KEY), Rule("unique", "c_mktsegment", "segment_duplicate_check"),
              Rule("unique", "c_nationkey", "nation_duplicate_check"), Rule("not_null", "c_name", "c_name_not_null"),
              Rule("unique", "c_custkey", "id_duplicate_check")]
#: one decision a minute; the limit lets three pass
FLOW_DECISIONS = ["approve", "approve", "approve", "reject", "approve", "approve", "approve"]
FLOW_MAX = 3


def _flow_sql() -> str:
    failed = {"not_null": lambda r: f"count(*) FILTER (WHERE {r.column} IS NULL)",
              "format": lambda r: f"count(*) FILTER (WHERE email IS NOT NULL AND NOT regexp_matches(email, '{EMAIL_FORMAT}'))",
              "unique": lambda r: f"count(*) - count(DISTINCT ({', '.join(r.columns or [r.column])}))"}
    of_class = {"not_null": 0, "unique": 1, "format": 2}
    parts, allowed = [], 0
    for i, (r, decision) in enumerate(zip(FLOW_RULES, FLOW_DECISIONS)):
        columns = r.columns or [r.column]
        test, (_, template, conf, hours) = f"{FLOW_TABLE}.{'_'.join(columns)}.{r.test_name}", fixes.FIX_RULES[of_class[r.kind]]
        sql = template.replace("{table}", FLOW_TABLE).replace("{column}", ", ".join(columns)).replace("'", "''")
        pass_ = i < FLOW_MAX and decision == "approve"
        parts.append(f"""SELECT TIMESTAMP '{FLOW_DECIDED_AT}' + INTERVAL {i} MINUTE AS fixed_at, '{FLOW_TABLE}' AS table_fqn, '{test}' AS test,
  CAST(b.failed AS VARCHAR) || ' of ' || CAST(b.n AS VARCHAR) || ' rows failed {r.test_name}' AS issue,
  '{'approved' if decision == 'approve' else 'rejected'}' AS action, '{', '.join(columns)}' AS column_name, '{sql}' AS fix_sql, {pass_} AS allowed,
  CAST({conf} AS INTEGER) AS confidence_score, CAST({hours} AS INTEGER) AS hours_saved, '{fixes.RULES_MODEL}' AS model,
  b.n AS before_rows, b.nulls AS before_nulls, b.failed AS before_failed, a.n AS after_rows, a.nulls AS after_nulls, a.failed AS after_failed,
  CAST({'b.failed - a.failed' if pass_ else '0'} AS BIGINT) AS rows_affected, 1 AS version_before, 2 AS version_after
FROM (SELECT count(*) AS n, count(*) - count({columns[0]}) AS nulls, {failed[r.kind](r)} AS failed FROM t) b,
     (SELECT count(*) AS n, count(*) - count({columns[0]}) AS nulls, {failed[r.kind](r)} AS failed FROM fixed) a WHERE b.failed > 0""")
    return f"""WITH t AS (SELECT * FROM {FLOW_CUSTOMERS_SQL} x),
fixed AS (SELECT * REPLACE (coalesce(trim(lower(email)), '{fixes.DEFAULT_FILL}') AS email) FROM t
          WHERE c_custkey IN (SELECT min(c_custkey) FROM t GROUP BY {', '.join(FLOW_KEY)}))
{' UNION ALL '.join(parts)}"""


@query("fix_flow", oracle=_flow_sql())
def q_fix_flow(spark, d):
    """Check the customer table, suggest repairs of all three classes, decide, rate limit, apply the allowed ones as one new
    version (one rejected, the later ones blocked), verify and append the history; the entries as read back from it."""
    from tablekeeper.operators.flow import approve_and_apply
    from tablekeeper.operators.history import read_history
    vt = VersionedTable(spark, shared_dir(spark, "flow-versions"))
    vt.commit(flow_customers(spark, d))
    tests = [f"{FLOW_TABLE}.{'_'.join(r.columns or [r.column])}.{r.test_name}" for r in FLOW_RULES]
    decisions = spark.createDataFrame([(t, x, i) for i, (t, x) in enumerate(zip(tests, FLOW_DECISIONS))], "test string, decision string, i int").select(
        "test", "decision", F.expr(f"timestampadd(MINUTE, i, TIMESTAMP_NTZ '{FLOW_DECIDED_AT}')").alias("decided_at"))
    path = shared_dir(spark, "flow-history")
    approve_and_apply(spark, vt, FLOW_TABLE, FLOW_RULES, decisions, rule_table(spark), max_n=FLOW_MAX, history_path=path, id_col="c_custkey")
    return read_history(spark, path).select(
        "fixed_at", "table_fqn", "test", "issue", "action", "column_name", "fix_sql", "allowed", "confidence_score", "hours_saved", "model",
        *[f"{when}_{m}" for when in ("before", "after") for m in ("rows", "nulls", "failed")], "rows_affected", "version_before", "version_after")
