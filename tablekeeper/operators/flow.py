"""The approve-and-apply flow for one versioned table:

check -> issues -> rule suggestions -> decisions -> rate limit -> apply the
allowed repairs as ONE new table version -> verify per rule -> history entries.

All row work runs on executors (one scan per version for all rules, the
limiter, one write); the driver only reads which rules got an allowed repair -
at most one entry per rule of the table - to build the repair: one projection
for fills and rewrites of values, and an anti join per unique rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tablekeeper.functions import text as T
from tablekeeper.operators import checks, fixes, history
from tablekeeper.operators.checks import Rule
from tablekeeper.operators.ratelimit import MAX_FIXES_PER_HOUR, SPAN_SECONDS, rate_limit
from tablekeeper.session import materialize
from tablekeeper.sources.versions import VersionedTable

CLASSES = {"not_null": T.ISSUE_NULL, "unique": T.ISSUE_DUP, "format": T.ISSUE_FORMAT}
_NULLS = "nulls of "            # names of the checks that count a column's NULLs for the entries


def _columns(rule: Rule) -> list[str]:
    return rule.columns or [rule.column]


def _measured(df: DataFrame, table_fqn: str, rules: list[Rule]) -> DataFrame:
    """test, issue, failed, rows and nulls (of the rule's column) of every rule, from one scan."""
    extra = [Rule("not_null", c, _NULLS + c) for c in dict.fromkeys(_columns(r)[0] for r in rules)]
    res = materialize(checks.run_suite({table_fqn: df}, {table_fqn: [*rules, *extra]}), "flow-checks")
    nulls = res.filter(F.col("test_name").startswith(_NULLS)).select(F.col("column").alias("_column"), F.col("failed_rows").alias("nulls"))
    of = F.create_map(*[x for r in rules for x in (F.lit(".".join(checks.rule_name(table_fqn, r))), F.lit(_columns(r)[0]))])
    tests = res.filter(~F.col("test_name").startswith(_NULLS)).withColumn("_column", of[F.col("test_fqn")])
    return tests.join(nulls, "_column").select(F.col("test_fqn").alias("test"), "status", F.col("result").alias("issue"), F.col("failed_rows").alias("failed"),
                                               F.col("total_rows").alias("rows"), "nulls")


def fill_value(df: DataFrame, column: str):
    """What NULLs of the column become, by its type; None where there is no such value."""
    kind = df.schema[column].dataType
    if isinstance(kind, StringType):
        return fixes.DEFAULT_FILL
    return 0 if isinstance(kind, NumericType) else None


def fixable(df: DataFrame, rule: Rule, id_col: str | None) -> bool:
    """Whether the rule's suggestion can be applied to the table."""
    if rule.kind == "not_null":
        return fill_value(df, rule.column) is not None
    if rule.kind == "unique":
        return id_col is not None
    return rule.kind == "format" and isinstance(df.schema[rule.column].dataType, StringType)


def repaired(df: DataFrame, rules: list[Rule], id_col: str | None) -> DataFrame:
    """The suggested repairs of all ``rules`` at once, each as of the table as it is.

    NULLs are filled, the other values of a badly formed column are trimmed and
    put in lower case, and of rows with equal keys those of the least id stay.
    """
    rows = df
    for r in rules:
        if r.kind == "unique":
            gone = fixes.losers(df, _columns(r), id_col)
            rows = rows.withColumn("_key", fixes.key_struct(df, _columns(r)))
            rows = rows.join(gone, (rows["_key"] == gone["_key"]) & (rows[id_col] == gone["_id"]), "left_anti").drop("_key")
    values = {}
    for r in rules:
        if r.kind == "format":
            values[r.column] = F.trim(F.lower(F.col(r.column)))
    for r in rules:
        if r.kind == "not_null":
            fill = F.lit(fill_value(df, r.column)).cast(df.schema[r.column].dataType)
            values[r.column] = F.coalesce(values.get(r.column, F.col(r.column)), fill)
    return rows.withColumns(values).select(*df.columns)


def approve_and_apply(spark: SparkSession, table: VersionedTable, table_fqn: str, rules: list[str | Rule],
                      decisions: DataFrame, fix_rules: DataFrame, max_n: int = MAX_FIXES_PER_HOUR,
                      span_seconds: int = SPAN_SECONDS, history_path: str | None = None, id_col: str | None = None) -> DataFrame:
    """Run the flow; return (and optionally append) one history entry per decided fix.

    rules: not_null, unique and format rules; a column's name stands for its not_null rule.
    decisions: (test, decision, decided_at) - 'approve' / 'reject' per issue test FQN.
    Of several decisions on an issue the last one by time counts.  Approved
    fixes of the table are rate limited per table in decision order; blocked
    ones are recorded with ``allowed`` false and change nothing.  What cannot be
    repaired (a column whose type has no fill value, duplicates of a table
    without ``id_col``) is reported as not fixable.
    """
    checked = [Rule("not_null", r, f"{r}_not_null") if isinstance(r, str) else r for r in rules]
    by_test = {".".join(checks.rule_name(table_fqn, r)): r for r in checked}
    before_v = table.current()
    current = table.read(before_v)
    can = {t: fixable(current, r, id_col) for t, r in by_test.items()}
    told = spark.createDataFrame([(t, CLASSES.get(r.kind, T.ISSUE_UNKNOWN), ", ".join(_columns(r)), can[t]) for t, r in by_test.items()],
                                 "test string, issue_type string, issue_column string, fixable boolean")
    before = _measured(current, table_fqn, checked)
    issues = before.filter(F.col("status") == checks.FAILED).join(told, "test").select(
        F.xxhash64("test").alias("issue_id"), F.lit(table_fqn).alias("table_fqn"), "test", "issue", "issue_type", "issue_column", "fixable",
        F.lit("failed").alias("status"), F.struct("rows", "nulls", "failed").alias("before"))
    sugg = fixes.suggest_fix(issues, fix_rules).select("issue_id", "fix_sql", "ai_generated", "model", "confidence_score", "hours_saved")
    decided = materialize(issues.join(sugg, "issue_id", "left").join(history.last_decisions(decisions, "test"), "test", "inner"), "flow-decided")
    approved = decided.filter((F.col("decision") == "approve") & F.col("fixable"))
    attempts = approved.select(F.col("table_fqn").alias("key"), F.col("decided_at").alias("ts"),
                               F.col("issue_id").alias("attempt_id"), F.lit(True).alias("ok"))
    limited = materialize(rate_limit(attempts, max_n=max_n, span_seconds=span_seconds).select(F.col("attempt_id").alias("issue_id"), "allowed"),
                          "flow-limited")
    # the only driver step: which rules got an allowed repair (bounded by the table's rules)
    plan = sorted(r["test"] for r in approved.join(limited.filter("allowed"), "issue_id").select("test").collect())
    after_v = table.commit(repaired(current, [by_test[t] for t in plan], id_col)) if plan else before_v
    after = _measured(table.read(after_v), table_fqn, checked).select("test", F.struct("rows", "nulls", "failed").alias("after"))
    allowed = F.coalesce("allowed", F.lit(False))
    action = F.when(F.col("decision") != "approve", "rejected").when(~F.col("fixable"), "not fixable").otherwise("approved")
    # fills and removals mend every failing row; of rewritten values some may still fail
    done = F.when(F.col("issue_type") == T.ISSUE_FORMAT, F.greatest(F.col("before.failed") - F.col("after.failed"), F.lit(0))).otherwise(F.col("before.failed"))
    rows = (decided.join(limited, "issue_id", "left").join(after, "test")
            .withColumns({"fix_id": F.xxhash64("test", "decided_at"), "fixed_at": F.col("decided_at").cast("timestamp_ntz"),
                          "table_key": F.xxhash64("table_fqn"), "action": action, "allowed": allowed,
                          "rows_affected": F.when(allowed, done).otherwise(0),
                          "version_before": F.lit(before_v), "version_after": F.lit(after_v)})
            .withColumnRenamed("issue_column", "column_name"))
    out = materialize(history.entries(rows), "flow-rows")
    if history_path:
        history.append_entries(out, history_path)
    return out
