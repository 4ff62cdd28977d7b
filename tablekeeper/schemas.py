"""Fixed schemas of the tables the engine owns (DDL strings, parsed by Spark).

Operators produce exactly these column names and types (checked in
``tests/test_schemas.py``); inputs that come from elsewhere are read with an
explicit schema or shaped with ``sources.files.conform``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# one row per executed check
CHECK_RESULT = ("test_fqn string, table_fqn string, column string, test_name string, status string, "
                "failed_rows bigint, total_rows bigint, result string")
# test results consumed by root cause and severity
TEST_RESULT = ("result_id bigint, node bigint, table_fqn string, test_name string, test_fqn string, "
               "status string, result string, ts timestamp_ntz")
LINEAGE_EDGE = "src bigint, dst bigint"
REACH = "root bigint, node bigint, depth int"
ROOT_CAUSE = ("root bigint, status string, failing_nodes bigint, failing_results bigint, first_node bigint, "
              "first_depth int, test_name string, test_fqn string, result string")
SEVERITY = ("root bigint, status string, severity_score int, base_score int, failing_tests_score int, "
            "issue_type_score int, downstream_impact_score int, failing_tests_count bigint, issue_type string, "
            "downstream_count bigint, downstream_assets bigint, severity string")
ISSUE = ("issue_id bigint, table_fqn string, test string, issue string, severity string, severity_score int, "
         "failing_tests_count bigint, issue_type string, downstream_count bigint, diagnosis string, fix_sql string, "
         "ai_generated boolean, confidence_score int, expected_rows_affected bigint, hours_saved int, "
         "fix_generated boolean, status string")
FIX_SUGGESTION = ("issue_id bigint, issue string, test_name string, fix_sql string, executable_sql string, "
                  "target_table string, ai_generated boolean, model string, confidence_score int, hours_saved int")
PARSED_ANSWER_FIELDS = ("fix_sql string, has_metrics boolean, confidence_score bigint, "
                        "expected_rows_affected bigint, hours_saved bigint")
FIX_HISTORY = ("fix_id bigint, fixed_at timestamp_ntz, table_fqn string, table_key bigint, rows_affected int, "
               "ai_generated boolean, hours_saved int, before_nulls int, after_nulls int, severity_score int")
FIX_RESULT = ("table_name string, version_before int, version_after int, success boolean, rows_affected bigint, "
              "message string")
HISTORY_ENTRY = ("fix_id bigint, fixed_at timestamp_ntz, table_fqn string, table_key bigint, rows_affected bigint, "
                 "ai_generated boolean, hours_saved int, severity_score int, action string, reverted_at timestamp_ntz, "
                 "issue string, test string, column_name string, fix_sql string, confidence_score int, model string, "
                 "before struct<rows:bigint,nulls:bigint,failed:bigint>, after struct<rows:bigint,nulls:bigint,failed:bigint>, "
                 "allowed boolean, version_before int, version_after int")
ROLLBACK_RESULT = ("table_name string, version_before int, version_after int, success boolean, "
                   "rows_restored bigint, action string")
FIX_IMPACT = ("column_name string, before_nulls bigint, after_nulls bigint, nulls_fixed bigint, "
              "reduction_pct double, before_rows bigint, after_rows bigint")
ATTEMPT = "key bigint, ts timestamp_ntz, attempt_id bigint, ok boolean"
LIMIT_DECISION = ("key bigint, attempt_id bigint, ts timestamp_ntz, ok boolean, window_start timestamp_ntz, "
                  "fixes_before bigint, allowed boolean, counted boolean")
NOTIFICATION = "event_id bigint, event_type string, mention string, title string, color int, description string"
COLUMN_TAGS = ("table_fqn string, column string, "
               "tags array<struct<tagFQN:string,source:string,labelType:string>>, status string")


def struct(ddl: str) -> T.StructType:
    """DDL string -> StructType (all fields nullable, as Spark's outputs are)."""
    return T._parse_datatype_string(ddl)
