"""Queries: fix history analytics, decisions, audit text, notifications, tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeeper.operators import history as H
from tablekeeper.plans import standins as S
from tablekeeper.plans.q_lineage import roots
from tablekeeper.plans.registry import query, table
from tablekeeper.session import shared_dir
from tablekeeper.sources.files import inline_rows

FH = S.FIX_HISTORY_SQL


@query("history_summary", oracle=f"""
SELECT count(*) AS total_fixes, CAST(coalesce(sum(rows_affected), 0) AS BIGINT) AS total_rows_fixed,
  CAST(coalesce(sum(coalesce(hours_saved, 2)), 0) AS BIGINT) AS total_hours_saved FROM {FH} h""")
def q_history_summary(spark, d):
    return H.history_summary(S.fix_history_input(spark, d))


@query("fix_sequence", oracle=f"""
SELECT fix_id, table_key, fixed_at,
  'Fix ' || CAST(row_number() OVER (PARTITION BY table_key ORDER BY fixed_at, fix_id) AS VARCHAR) AS label,
  rows_affected FROM {FH} h""")
def q_fix_sequence(spark, d):
    return H.fix_sequence(S.fix_history_input(spark, d))


@query("running_hours", oracle=f"""
SELECT fix_id, table_key, fixed_at,
  CAST(row_number() OVER w AS BIGINT) AS fixes_so_far,
  CAST(sum(coalesce(hours_saved, 2)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hours_so_far
FROM {FH} h WINDOW w AS (PARTITION BY table_key ORDER BY fixed_at, fix_id)""")
def q_running_hours(spark, d):
    return H.running_hours(S.fix_history_input(spark, d))


@query("running_nulls", oracle=f"""
SELECT fix_id, table_key, fixed_at, CAST(row_number() OVER w AS BIGINT) AS fixes_so_far,
  CAST(sum(coalesce(hours_saved, 2)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hours_so_far
FROM (SELECT fix_id, hours_saved, CASE WHEN fix_id % 7 = 0 THEN NULL ELSE table_key END AS table_key,
        CASE WHEN fix_id % 11 = 0 THEN NULL ELSE fixed_at END AS fixed_at FROM {FH} h) x
WINDOW w AS (PARTITION BY table_key ORDER BY fixed_at NULLS FIRST, fix_id)""")
def q_running_nulls(spark, d):
    """Running totals over a history with NULL keys and times: no row is lost."""
    h = S.fix_history_input(spark, d)
    return H.running_hours(h.withColumns({"table_key": F.when(F.col("fix_id") % 7 != 0, F.col("table_key")),
                                          "fixed_at": F.when(F.col("fix_id") % 11 != 0, F.col("fixed_at"))}))


def full_entries(spark, d):
    """Full history entries of all events: errors stand for reverts."""
    e = table(spark, d, "events")
    test = F.element_at(F.array(*[F.lit(x) for x in S.TEST_NAMES]), (F.col("event_id") % 4 + 1).cast("int"))
    nulls = F.floor("value").cast("bigint")
    return e.select(
        F.col("event_id").alias("fix_id"), F.col("ts").alias("fixed_at"), F.format_string("svc.db.mart.t%d", "user_id").alias("table_fqn"),
        F.col("user_id").alias("table_key"), nulls.alias("rows_affected"), F.lit(False).alias("ai_generated"),
        F.lit(2).alias("hours_saved"), (F.col("event_id") % 101).cast("int").alias("severity_score"),
        F.when(F.col("event_type") == "error", "reverted").otherwise("approved").alias("action"),
        F.when(F.col("event_type") == "error", F.col("ts")).alias("reverted_at"),
        F.format_string("Found %d rows failing", nulls).alias("issue"), test.alias("test"), F.lit("email").alias("column_name"),
        F.when(F.col("event_id") % 5 != 0, F.format_string("UPDATE t%d", "user_id")).alias("fix_sql"),
        F.when(F.col("event_id") % 3 != 0, F.lit(92)).alias("confidence_score"), F.lit("rules").alias("model"),
        F.struct(F.lit(None).cast("bigint").alias("rows"), nulls.alias("nulls")).alias("before"),
        F.struct(F.lit(None).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("nulls")).alias("after"))


@query("fix_timeline_actions", oracle="""
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'svc.db.mart.t' || CAST(user_id AS VARCHAR) AS table_fqn,
  CASE WHEN event_type = 'error' THEN 'REVERTED' ELSE 'APPROVED' END AS action, CAST(floor(value) AS BIGINT) AS rows_affected,
  event_id AS fix_id FROM events ORDER BY ts DESC, event_id DESC""")
def q_fix_timeline_actions(spark, d):
    return H.fix_timeline(full_entries(spark, d))


@query("audit_document", oracle="""
WITH e AS (SELECT *, 'svc.db.mart.t' || CAST(user_id AS VARCHAR) AS fqn, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS n,
             event_id % 101 AS s FROM events),
b AS (SELECT fqn, ts, event_id, 'Fix - ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || '- Table: ' || fqn || chr(10) || '- Severity: ' ||
  CASE WHEN s >= 70 THEN 'HIGH' WHEN s >= 40 THEN 'MEDIUM' ELSE 'LOW' END || ' (' || CAST(s AS VARCHAR) || '/100)' || chr(10) ||
  '- Impact: ' || n || ' rows affected' || chr(10) || '- Before: ' || n || ' nulls' || chr(10) || '- After: 0 nulls' || chr(10) ||
  '- Generated: no' || chr(10) || '- Issue: Found ' || n || ' rows failing' || chr(10) || '- Test: ' ||
  ['email_not_null','id_duplicate_check','phone_format_check','row_count'][event_id % 4 + 1] || chr(10) || '- Fix SQL: ' ||
  CASE WHEN event_id % 5 = 0 THEN 'N/A' ELSE 'UPDATE t' || CAST(user_id AS VARCHAR) END || chr(10) || '- Confidence: ' ||
  CASE WHEN event_id % 3 = 0 THEN 'N/A' ELSE '92' END || chr(10) || '- Model: rules' AS audit FROM e)
SELECT fqn AS table_fqn, count(*) AS entries, string_agg(audit, chr(10) || chr(10) ORDER BY ts, event_id) AS document FROM b GROUP BY fqn""")
def q_audit_document(spark, d):
    h = full_entries(spark, d)
    return H.audit_document(h.withColumns({"before_nulls": F.col("before.nulls"), "after_nulls": F.col("after.nulls")}))


@query("fix_timeline", oracle=f"""
SELECT strftime(fixed_at, '%Y-%m-%dT%H:%M:%S') AS timestamp, table_fqn, 'APPROVED' AS action, rows_affected, fix_id
FROM {FH} h ORDER BY fixed_at DESC, fix_id DESC""")
def q_fix_timeline(spark, d):
    return H.fix_timeline(S.fix_history_input(spark, d))


@query("fixes_over_time", oracle=f"""
SELECT date_trunc('day', fixed_at) AS period, count(*) AS fixes, CAST(coalesce(sum(rows_affected), 0) AS BIGINT)
  AS rows_affected FROM {FH} h GROUP BY 1 ORDER BY 1""")
def q_fixes_over_time(spark, d):
    return H.fixes_over_time(S.fix_history_input(spark, d))


def _decisions(spark, d):
    """Reviewer decisions: approve every third root, reject the next, leave the rest."""
    r = roots(spark, d)
    return r.select(F.col("root").alias("issue_id"),
                    F.when(F.col("root") % 3 == 0, "approve").when(F.col("root") % 3 == 1, "reject").alias("decision")
                    ).filter(F.col("decision").isNotNull())


@query("decide_issues", oracle="""
WITH r AS (SELECT DISTINCT user_id AS issue_id FROM events),
     iss AS (SELECT issue_id, CASE WHEN issue_id % 2 = 0 THEN 'open' ELSE 'failed' END AS status FROM r)
SELECT issue_id, status_in AS status_before, CASE WHEN dec = 'approve' THEN 'applied' WHEN dec = 'reject' THEN 'closed'
  ELSE status_in END AS status, dec AS decision
FROM (SELECT iss.issue_id, iss.status AS status_in,
        CASE WHEN iss.issue_id % 3 = 0 THEN 'approve' WHEN iss.issue_id % 3 = 1 THEN 'reject' END AS dec FROM iss) x""")
def q_decide_issues(spark, d):
    r = roots(spark, d)
    issues = r.select(F.col("root").alias("issue_id"),
                      F.when(F.col("root") % 2 == 0, "open").otherwise("failed").alias("status"))
    out = H.decide(issues.withColumn("status_before", F.col("status")), _decisions(spark, d))
    return out.select("issue_id", "status_before", "status", "decision")


@query("audit_text", oracle=f"""
SELECT table_fqn, CAST(row_number() OVER (PARTITION BY table_key ORDER BY fixed_at, fix_id) AS BIGINT) AS seq, fix_id,
  'Fix - ' || strftime(fixed_at, '%Y-%m-%d %H:%M:%S') || chr(10) || '- Table: ' || table_fqn || chr(10) ||
  '- Severity: ' || upper(CASE WHEN coalesce(severity_score, 0) >= 70 THEN 'high'
                              WHEN coalesce(severity_score, 0) >= 40 THEN 'medium' ELSE 'low' END) ||
  ' (' || coalesce(CAST(severity_score AS VARCHAR), 'N/A') || '/100)' || chr(10) ||
  '- Impact: ' || coalesce(CAST(rows_affected AS VARCHAR), 'N/A') || ' rows affected' || chr(10) ||
  '- Before: ' || coalesce(CAST(before_nulls AS VARCHAR), 'N/A') || ' nulls' || chr(10) ||
  '- After: ' || coalesce(CAST(after_nulls AS VARCHAR), 'N/A') || ' nulls' || chr(10) ||
  '- Generated: ' || CASE WHEN ai_generated THEN 'yes' ELSE 'no' END AS audit
FROM {FH} h""")
def q_audit_text(spark, d):
    return H.audit_text(S.fix_history_input(spark, d))


def notify_events(spark, d):
    e = table(spark, d, "events")
    kind = (F.when(F.col("event_type") == "signup", "issue_detected").when(F.col("event_type") == "purchase",
                                                                             "fix_applied")
            .when(F.col("event_type") == "error", "fix_failed").when(F.col("event_type") == "click", "error")
            .otherwise("heartbeat"))
    score = (F.col("event_id") % 101).cast("int")
    return e.select(
        "event_id", kind.alias("event_type"), F.format_string("svc.db.mart.t%d", "user_id").alias("table_fqn"),
        F.element_at(F.array(*[F.lit(x) for x in S.TEST_NAMES]), (F.col("event_id") % 4 + 1).cast("int")).alias("test"),
        F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low").alias("severity"),
        F.when(F.col("event_id") % 9 == 0, F.lit(None).cast("int")).otherwise(score).alias("severity_score"),
        F.format_string("Found %d rows failing", F.floor("value").cast("bigint")).alias("issue"),
        F.lit("customer_email").alias("column_name"), F.floor("value").cast("bigint").alias("rows_affected"),
        F.floor("value").cast("bigint").alias("before_nulls"), F.lit(0).cast("bigint").alias("after_nulls"),
        F.when(F.col("event_type") == "click", "connection lost").otherwise("timeout while applying fix")
        .alias("error"))


ROUTING = [("issue_detected", True, "@data-oncall"), ("fix_applied", True, ""), ("fix_failed", True, "@platform"),
           ("error", False, "@platform")]


@query("notifications", oracle="""
WITH e AS (SELECT event_id,
    CASE event_type WHEN 'signup' THEN 'issue_detected' WHEN 'purchase' THEN 'fix_applied' WHEN 'error' THEN 'fix_failed'
      WHEN 'click' THEN 'error' ELSE 'heartbeat' END AS event_type,
    'svc.db.mart.t' || CAST(user_id AS VARCHAR) AS table_fqn,
    ['email_not_null','id_duplicate_check','phone_format_check','row_count'][event_id % 4 + 1] AS test,
    CASE WHEN event_id % 101 >= 70 THEN 'high' WHEN event_id % 101 >= 40 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 101 AS INTEGER) END AS severity_score,
    'Found ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' rows failing' AS issue,
    CAST(floor(value) AS BIGINT) AS rows_affected,
    CASE WHEN event_type = 'click' THEN 'connection lost' ELSE 'timeout while applying fix' END AS error FROM events),
r AS (SELECT * FROM (VALUES ('issue_detected', 'Data Quality Issue Detected', 16711680, '@data-oncall'),
                            ('fix_applied', 'Fix Applied Successfully', 65280, ''),
                            ('fix_failed', 'Fix Application Failed', 16753920, '@platform')) v(event_type, title, color, team))
SELECT e.event_id, e.event_type, nullif(r.team, '') AS mention, r.title, r.color,
  CASE e.event_type
    WHEN 'issue_detected' THEN 'Table: ' || table_fqn || chr(10) || 'Test: ' || test || chr(10) || 'Severity: ' ||
      upper(severity) || ' (' || coalesce(CAST(severity_score AS VARCHAR), 'N/A') || '/100)' || chr(10) || 'Issue: ' || issue
    WHEN 'fix_applied' THEN 'Table: ' || table_fqn || chr(10) || 'Column: customer_email' || chr(10) || 'Rows Affected: ' ||
      CAST(rows_affected AS VARCHAR) || chr(10) || 'Before: ' || CAST(rows_affected AS VARCHAR) || ' nulls' || chr(10) ||
      'After: 0 nulls'
    WHEN 'fix_failed' THEN 'Table: ' || table_fqn || chr(10) || 'Error: ' || error
    ELSE 'Error: ' || error END AS description
FROM e JOIN r ON r.event_type = e.event_type""")
def q_notifications(spark, d):
    routing = inline_rows(spark, ROUTING, "event_type string, enabled boolean, team string")
    return H.notifications(notify_events(spark, d), routing)


def tag_inputs(spark, d):
    tr = S.test_results(spark, d)
    cols = (tr.select("table_fqn", F.split_part("test_fqn", F.lit("."), F.lit(5)).alias("column")).distinct()
            .withColumn("tags", F.when(F.col("column") == "customer_id", F.array(F.struct(
                F.lit("PII.Sensitive").alias("tagFQN"), F.lit("Classification").alias("source"),
                F.lit("Manual").alias("labelType")))).when(F.col("column") != "phone_number", F.array().cast(
                    "array<struct<tagFQN:string,source:string,labelType:string>>"))))      # phone_number: no tag list
    h = S.fix_history_input(spark, d)
    fixed = (h.select("table_fqn", F.when(F.col("fix_id") % 4 == 0, "phone_number")
                      .when(F.col("fix_id") % 4 == 1, "customer_id").otherwise("customer_email").alias("column")))
    return cols, fixed


@query("tag_columns", oracle=f"""
WITH cols AS (SELECT DISTINCT table_fqn, split_part(test_fqn, '.', 5) AS "column" FROM {S.TEST_RESULTS_SQL} t),
fixed AS (SELECT DISTINCT table_fqn, CASE WHEN fix_id % 4 = 0 THEN 'phone_number' WHEN fix_id % 4 = 1 THEN 'customer_id'
          ELSE 'customer_email' END AS "column" FROM {FH} h),
j AS (SELECT coalesce(c.table_fqn, f.table_fqn) AS table_fqn, coalesce(c."column", f."column") AS "column",
        c.table_fqn IS NOT NULL AS in_cat, f.table_fqn IS NOT NULL AS is_fixed,
        CASE WHEN c."column" = 'customer_id' THEN 'PII.Sensitive' END AS old_tag
      FROM cols c FULL OUTER JOIN fixed f ON c.table_fqn = f.table_fqn AND c."column" = f."column")
SELECT table_fqn, "column",
  CASE WHEN NOT in_cat OR (old_tag IS NULL AND NOT is_fixed AND "column" = 'phone_number') THEN NULL
       ELSE array_to_string(list_concat(CASE WHEN old_tag IS NULL THEN [] ELSE [old_tag] END,
                                        CASE WHEN is_fixed THEN ['{H.DEFAULT_TAG}'] ELSE [] END), ',') END AS tag_list,
  CASE WHEN NOT in_cat THEN 'column not found' WHEN NOT is_fixed THEN 'unchanged' ELSE 'tagged' END AS status
FROM j""")
def q_tag_columns(spark, d):
    cols, fixed = tag_inputs(spark, d)
    t = H.tag_columns(cols, fixed)
    return t.select("table_fqn", "column",
                    F.array_join(F.transform("tags", lambda x: x["tagFQN"]), ",").alias("tag_list"), "status")


@query("fix_history", oracle=f"""
SELECT fix_id, fixed_at, table_fqn, table_key, rows_affected, ai_generated, hours_saved, before_nulls, after_nulls,
  severity_score, CAST(fixed_at AS DATE) AS fix_date FROM {FH} h""")
def q_fix_history(spark, d):
    """Append the history in two batches to a date-partitioned table and read it back."""
    path = shared_dir(spark, "fix-history")
    h = S.fix_history_input(spark, d)
    H.append_history(h.filter(F.col("fix_id") % 2 == 0), path)
    H.append_history(h.filter(F.col("fix_id") % 2 == 1), path)
    return spark.read.parquet(path).select(*h.columns, "fix_date")


@query("issue_counters", oracle=f"""
WITH iss AS (SELECT issue_id, CASE WHEN issue_id % 3 = 0 THEN 'applied' WHEN issue_id % 3 = 1 THEN 'closed'
                                ELSE 'open' END AS status, issue_id % 4 = 2 AS ai_generated
             FROM (SELECT DISTINCT user_id AS issue_id FROM events) r),
     a AS (SELECT count(*) FILTER (WHERE status = 'open') AS active,
                  count(*) FILTER (WHERE status = 'open' AND ai_generated) AS ai FROM iss)
SELECT active AS active_issues,
  (SELECT count(*) FROM {FH} h WHERE CAST(fixed_at AS DATE) = (SELECT max(CAST(fixed_at AS DATE)) FROM {FH} h2))
    AS fixed_today,
  (SELECT count(*) FROM (SELECT DISTINCT CAST(ts AS DATE) FROM events) s) AS total_scanned,
  CAST(CASE WHEN active = 0 THEN 0 ELSE floor(ai * 100 / active) END AS INTEGER) AS ai_generated_pct
FROM a""")
def q_issue_counters(spark, d):
    r = roots(spark, d)
    issues = H.decide(r.select(F.col("root").alias("issue_id"), F.lit("open").alias("status"),
                               (F.col("root") % 4 == 2).alias("ai_generated")), _decisions(spark, d))
    scans = S.test_results(spark, d).select(F.to_date("ts").alias("scan_day")).distinct()
    return H.issue_counters(issues, S.fix_history_input(spark, d), scans)
