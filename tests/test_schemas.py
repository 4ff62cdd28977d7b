"""Owned tables carry exactly their declared schema (names and types)."""

import pytest

import __spark_entry__ as E
from tablekeeper import schemas as S

SF = "/root/testdata/sf0.001"

CASES = [
    ("run_suite", S.CHECK_RESULT), ("check_not_null", S.CHECK_RESULT), ("check_reference", S.CHECK_RESULT),
    ("root_cause", S.ROOT_CAUSE), ("severity", S.SEVERITY), ("trace_downstream", S.REACH),
    ("open_issues", S.ISSUE), ("suggest_fix", S.FIX_SUGGESTION), ("rate_limit", S.LIMIT_DECISION),
    ("stream_rate_limit", S.LIMIT_DECISION), ("notifications", S.NOTIFICATION), ("apply_fix", S.FIX_RESULT),
    ("rollback", S.ROLLBACK_RESULT), ("fix_impact", S.FIX_IMPACT),
]


def _shape(schema):
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


@pytest.mark.parametrize("name,ddl", CASES)
def test_declared_schema(spark, name, ddl):
    df = E.queries()[name](spark, SF)
    assert _shape(df.schema) == _shape(S.struct(ddl))


def test_history_and_parsed_answers(spark):
    h = E.queries()["fix_history"](spark, SF)
    assert _shape(h.drop("fix_date").schema) == _shape(S.struct(S.FIX_HISTORY))
    p = E.queries()["parse_responses"](spark, SF)
    assert _shape(p.drop("answer_id", "answer").schema) == _shape(S.struct(S.PARSED_ANSWER_FIELDS))
