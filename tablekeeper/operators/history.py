"""Fix history: append, summaries, sequences, timelines, decisions, audit
text, notifications and column tags.

History rows (``fix_history``): fix_id, fixed_at, table_fqn, table_key,
rows_affected, ai_generated, hours_saved (NULL = unknown), before_nulls,
after_nulls, severity_score; full entries (``schemas.HISTORY_ENTRY``) also have
action, reverted_at, issue, test, column_name, fix_sql, confidence_score, model,
nested before / after metrics, whether the rate limit allowed the fix, and the
table's versions.  The flow, applied repairs and rollbacks all write full
entries (``append_entries``); ``read_history`` gives both kinds the flat columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeeper import schemas
from tablekeeper.operators.diagnose import severity_band
from tablekeeper.operators.ordered import running

DEFAULT_HOURS = 2          # fixed value: hours credited when a fix carries none
DEFAULT_TAG = "DataQuality.fixed"


def append_history(df: DataFrame, path: str) -> None:
    """Append entries as parquet partitioned by fix date (old files untouched)."""
    (df.withColumn("fix_date", F.to_date("fixed_at"))
     .write.mode("append").partitionBy("fix_date").parquet(path))


def entries(df: DataFrame) -> DataFrame:
    """Rows as full entries (``schemas.HISTORY_ENTRY``): fields that are not there are NULL, flat metrics become nested ones."""
    metric = lambda when, m: F.col(f"{when}_{m}") if f"{when}_{m}" in df.columns else F.lit(None)
    out = []
    for f in schemas.struct(schemas.HISTORY_ENTRY):
        if f.name in df.columns:
            c = F.col(f.name)
        elif f.name in ("before", "after"):
            c = F.struct(*[metric(f.name, m).alias(m) for m in f.dataType.names])
        else:
            c = F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def append_entries(df: DataFrame, path: str) -> None:
    """Append rows of any kind (flow, applied repair, rollback) as full entries, so that one history holds them all."""
    append_history(entries(df), path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a history, whatever version of the schema their files have, with the nested metrics also as flat columns."""
    h = spark.read.option("mergeSchema", "true").parquet(path)
    flat = {f"{when}_{m}": F.col(f"{when}.{m}") for when in ("before", "after") if when in h.columns for m in ("rows", "nulls", "failed")
            if f"{when}_{m}" not in h.columns}
    return h.withColumns(flat)


def history_summary(h: DataFrame) -> DataFrame:
    """Total fixes, total rows fixed, total hours saved (NULL hours count as the default)."""
    return h.agg(F.count(F.lit(1)).alias("total_fixes"),
                 F.coalesce(F.sum("rows_affected"), F.lit(0)).cast("bigint").alias("total_rows_fixed"),
                 F.coalesce(F.sum(F.coalesce("hours_saved", F.lit(DEFAULT_HOURS))), F.lit(0)).cast("bigint")
                 .alias("total_hours_saved"))


def fix_sequence(h: DataFrame) -> DataFrame:
    """'Fix n' per table in time order (ties by fix id)."""
    s = running(h, "table_key", ["fixed_at", "fix_id"], seq_name="n")
    return s.select("fix_id", "table_key", "fixed_at", F.concat(F.lit("Fix "), F.col("n").cast("string"))
                    .alias("label"), "rows_affected")


def running_hours(h: DataFrame) -> DataFrame:
    """Per table, in time order: fixes so far and hours saved so far."""
    s = running(h, "table_key", ["fixed_at", "fix_id"],
                sums={"hours_so_far": F.coalesce("hours_saved", F.lit(DEFAULT_HOURS)).cast("bigint")},
                seq_name="fixes_so_far")
    return s.select("fix_id", "table_key", "fixed_at", "fixes_so_far", F.col("hours_so_far").cast("bigint"))


def fix_timeline(h: DataFrame, action: str = "approved") -> DataFrame:
    """Entries newest first; timestamp as its first 19 ISO characters.  The action is the entry's own
    (approved, rejected, reverted) where entries have one, else ``action``."""
    act = F.coalesce("action", F.lit("")) if "action" in h.columns else F.lit(action or "")
    return (h.select(F.date_format("fixed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "table_fqn",
                     F.upper(act).alias("action"), "rows_affected", "fix_id",
                     "fixed_at")
            .orderBy(F.desc("fixed_at"), F.desc("fix_id")).drop("fixed_at"))


def fixes_over_time(h: DataFrame, unit: str = "day") -> DataFrame:
    period = F.date_trunc(unit, "fixed_at")
    if h.schema["fixed_at"].dataType.typeName() == "timestamp_ntz":
        period = period.cast("timestamp_ntz")      # keep wall-clock periods zone-free
    return (h.groupBy(period.alias("period"))
            .agg(F.count(F.lit(1)).alias("fixes"), F.coalesce(F.sum("rows_affected"), F.lit(0)).cast("bigint")
                 .alias("rows_affected"))
            .orderBy("period"))


def decide(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """approve -> applied, reject -> closed, no decision -> stays open.
    decisions: (issue_id, decision[, decided_at]); the last one of an issue counts."""
    d = last_decisions(decisions, "issue_id").select("issue_id", "decision")
    j = issues.join(d, "issue_id", "left")
    return j.withColumn("status", F.when(F.col("decision") == "approve", "applied")
                        .when(F.col("decision") == "reject", "closed").otherwise(F.col("status")))


def last_decisions(decisions: DataFrame, key: str) -> DataFrame:
    """The last decision per issue by ``decided_at`` (if there; ties by decision): key, decision (lower case), decided_at."""
    at = F.col("decided_at") if "decided_at" in decisions.columns else F.lit(None).cast("timestamp_ntz")
    return (decisions.groupBy(key).agg(F.max(F.struct(at.alias("at"), F.lower("decision").alias("decision"))).alias("d"))
            .select(key, "d.decision", F.col("d.at").alias("decided_at")))


#: fixed values: audit lines of full entries, by column
AUDIT_LINES = [("issue", "Issue"), ("test", "Test"), ("fix_sql", "Fix SQL"), ("confidence_score", "Confidence"),
               ("model", "Model")]


def audit_text(h: DataFrame) -> DataFrame:
    """A text block per history entry, numbered per table in time order; full entries add their own lines.

    The per-table document is these blocks in (table, seq) order; they are
    left as rows instead of being concatenated into one string, so a table
    with a huge history never becomes one oversized value in one task.
    """
    s = running(h, "table_key", ["fixed_at", "fix_id"], seq_name="seq")
    na = F.lit("N/A")
    sev = F.upper(severity_band(F.coalesce("severity_score", F.lit(0))))
    block = F.format_string(
        "Fix - %s\n- Table: %s\n- Severity: %s (%s/100)\n- Impact: %s rows affected\n- Before: %s nulls\n"
        "- After: %s nulls\n- Generated: %s",
        F.date_format("fixed_at", "yyyy-MM-dd HH:mm:ss"), "table_fqn", sev,
        F.coalesce(F.col("severity_score").cast("string"), na),
        F.coalesce(F.col("rows_affected").cast("string"), na),
        F.coalesce(F.col("before_nulls").cast("string"), na),
        F.coalesce(F.col("after_nulls").cast("string"), na),
        F.when(F.col("ai_generated"), "yes").otherwise("no"))
    more = [F.concat(F.lit(f"\n- {label}: "), F.coalesce(F.col(c).cast("string"), na)) for c, label in AUDIT_LINES if c in h.columns]
    return s.select("table_fqn", "seq", "fix_id", F.concat(block, *more).alias("audit"))


def audit_document(h: DataFrame) -> DataFrame:
    """One document per table: its blocks in order, parted by a blank line (for tables whose history fits a value)."""
    return (audit_text(h).groupBy("table_fqn").agg(F.sort_array(F.collect_list(F.struct("seq", "fix_id", "audit"))).alias("b"))
            .select("table_fqn", F.size("b").cast("bigint").alias("entries"),
                    F.array_join(F.transform("b", lambda x: x["audit"]), "\n\n").alias("document")))


# Notification kinds (title, colour) and default routing.
NOTIFY_KINDS = [
    ("issue_detected", "Data Quality Issue Detected", 0xFF0000),
    ("fix_applied", "Fix Applied Successfully", 0x00FF00),
    ("fix_failed", "Fix Application Failed", 0xFFA500),
    ("error", "System Error", 0xFF0000),
]


def notifications(events: DataFrame, routing: DataFrame) -> DataFrame:
    """Message table for events.

    events: event_id, event_type, table_fqn, test, severity, severity_score,
            issue, column_name, rows_affected, before_nulls, after_nulls, error
    routing: event_type, enabled, team (fix_failed and error share the error team)
    Disabled and unknown event types produce no message.
    """
    kinds = events.sparkSession.createDataFrame(NOTIFY_KINDS, "event_type string, title string, color int")
    r = routing.filter(F.col("enabled")).join(kinds, "event_type", "inner")
    j = events.join(r, "event_type", "inner")
    v = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    body = (F.when(F.col("event_type") == "issue_detected", F.format_string(
                "Table: %s\nTest: %s\nSeverity: %s (%s/100)\nIssue: %s", v("table_fqn"), v("test"),
                F.upper(v("severity")), n("severity_score"), v("issue")))
            .when(F.col("event_type") == "fix_applied", F.format_string(
                "Table: %s\nColumn: %s\nRows Affected: %s\nBefore: %s nulls\nAfter: %s nulls", v("table_fqn"),
                v("column_name"), n("rows_affected"), n("before_nulls"), n("after_nulls")))
            .when(F.col("event_type") == "fix_failed", F.format_string("Table: %s\nError: %s", v("table_fqn"),
                                                                         v("error")))
            .otherwise(F.format_string("Error: %s", v("error"))))
    return j.select("event_id", "event_type", F.nullif(F.col("team"), F.lit("")).alias("mention"), "title",
                    "color", body.alias("description"))


def tag_columns(columns: DataFrame, fixed: DataFrame, tag: str = DEFAULT_TAG) -> DataFrame:
    """Add ``tag`` to each fixed column's tag list unless present (set union).

    columns: table_fqn, column, tags array<struct<tagFQN,source,labelType>>
    fixed:   table_fqn, column (the columns a fix touched; repeats are fine)
    Output: every catalogue column with its tags and a status, plus one row per
    fixed column missing from the catalogue (status 'column not found').
    """
    f = fixed.select("table_fqn", "column").distinct().withColumn("_fixed", F.lit(True))
    j = columns.withColumn("_catalogued", F.lit(True)).join(f, ["table_fqn", "column"], "full_outer")
    none = F.array().cast(columns.schema["tags"].dataType)
    new = F.struct(F.lit(tag).alias("tagFQN"), F.lit("Classification").alias("source"),
                   F.lit("Manual").alias("labelType"))
    present = F.exists(F.coalesce("tags", none), lambda t: t["tagFQN"] == F.lit(tag))
    fixed_col = F.coalesce("_fixed", F.lit(False))
    in_cat = F.coalesce("_catalogued", F.lit(False))      # a catalogued column may have no tag list: then it is empty
    tags = F.when(fixed_col & in_cat & ~present, F.array_append(F.coalesce("tags", none), new)).otherwise(F.col("tags"))
    status = (F.when(~in_cat, "column not found").when(~fixed_col, "unchanged")
              .when(present, "already tagged").otherwise("tagged"))
    return j.select("table_fqn", "column", tags.alias("tags"), status.alias("status"))


def issue_counters(issues: DataFrame, history: DataFrame, scans: DataFrame) -> DataFrame:
    """Dashboard counters in one row: active (open) issues, fixes on the latest
    history day, scans run, and the share of open issues whose fix was generated
    (whole percent, truncated; 0 when there are none).  Three one-row aggregates."""
    i = issues.agg(F.count_if(F.col("status") == "open").alias("active_issues"),
                   F.count_if((F.col("status") == "open") & F.col("ai_generated")).alias("_ai"))
    last_day = history.agg(F.max(F.to_date("fixed_at"))).scalar()
    fixed = history.agg(F.count_if(F.to_date("fixed_at") == last_day).alias("fixed_today"))
    return i.select(
        "active_issues",
        fixed.select("fixed_today").scalar().alias("fixed_today"),
        scans.agg(F.count(F.lit(1))).scalar().alias("total_scanned"),
        F.when(F.col("active_issues") == 0, F.lit(0))
         .otherwise(F.floor(F.col("_ai") * 100 / F.col("active_issues"))).cast("int").alias("ai_generated_pct"))
