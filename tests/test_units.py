"""Hand-checkable cases: the reference's sample rows, worked severity examples,
edge tables and invariants."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tablekeeper import schemas
from tablekeeper.functions import text as T
from tablekeeper.operators import checks, diagnose, faults, fixes, lineage, profile
from tablekeeper.operators.apply import Fix, apply_fix, rollback
from tablekeeper.operators.checks import Rule
from tablekeeper.operators.ratelimit import rate_limit
from tablekeeper.session import shared_dir
from tablekeeper.sources.versions import VersionedTable

CUSTOMERS = [(1, "a@x.com"), (2, "b@x.com"), (3, None), (4, "d@x.com"), (5, "e@x.com"), (6, "f@x.com"),
             (7, "g@x.com")]
ITEMS = [(1, 1, Decimal("19.99"), Decimal("0.00")), (2, 2, Decimal("5.00"), Decimal("1.00")),
         (3, 1, Decimal("0.00"), Decimal("29.99"))]


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_sample_probes(spark):
    c = spark.createDataFrame(CUSTOMERS, "id long, email string")
    assert _one(checks.check_not_null(c, "email", "shop.customers"))["failed_rows"] == 1
    orders = spark.createDataFrame([(1, 10), (2, None), (3, 11), (4, None)], "id long, billing_address_id long")
    assert _one(checks.check_not_null(orders, "billing_address_id", "shop.orders"))["failed_rows"] == 2
    items = spark.createDataFrame(ITEMS, "id long, quantity int, unit_price decimal(10,2), discount_amount decimal(10,2)")
    r = _one(checks.check_expression(items, "unit_price > 0", "unit_price", "shop.order_items", "price_positive"))
    assert r["failed_rows"] == 1 and r["status"] == "Failed"
    total = items.filter("id = 3").select(F.expr("quantity * unit_price - discount_amount").alias("t"))
    assert _one(total)["t"] == Decimal("-29.99")


def test_null_semantics(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "id long, k string")
    assert _one(checks.check_unique(df, ["k"], "t"))["failed_rows"] == 1          # NULLs never collide
    assert _one(checks.check_expression(df, "k = 'x'", "k", "t", "e"))["failed_rows"] == 0  # NULL passes
    parent = spark.createDataFrame([("x",)], "k string")
    assert _one(checks.check_reference(df, "k", parent, "k", "t"))["failed_rows"] == 0


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "id long, email string")
    p = profile.profile(df).collect()
    assert [r["total_rows"] for r in p] == [0, 0] and all(r["null_pct"] is None for r in p)
    assert _one(checks.check_unique(df, ["email"], "t"))["failed_rows"] == 0
    assert fixes.dedupe(df, ["email"], "id").count() == 0


def _severity(spark, tests, n_edges, params):
    res = spark.createDataFrame([(0, name, f"s.d.m.t0.c.{name}", "Failed", "r", i) for i, name in enumerate(tests)],
                                "node long, test_name string, test_fqn string, status string, result string, result_id long")
    edges = spark.createDataFrame([(0, i + 1) for i in range(n_edges)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "root long")
    return _one(diagnose.severity(res, edges, roots, params))


def test_severity_worked_examples(spark):
    d, e = diagnose.DEFAULT_SEVERITY, diagnose.EXAMPLE_SEVERITY
    r = _severity(spark, ["email_not_null"], 2, d)
    assert (r["severity_score"], r["severity"]) == (61, "medium")
    assert _severity(spark, ["email_not_null"], 2, e)["severity_score"] == 80
    dup = [f"dup_{i}_duplicate" for i in range(5)]
    assert _severity(spark, dup, 6, d)["severity_score"] == 80
    r = _severity(spark, dup, 6, e)
    assert (r["severity_score"], r["severity"]) == (100, "high")


def test_severity_not_failed(spark):
    res = spark.createDataFrame([(0, "x_check", "f", "Success", "r", 1)],
                                "node long, test_name string, test_fqn string, status string, result string, result_id long")
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    r = _one(diagnose.severity(res, edges, spark.createDataFrame([(0,)], "root long")))
    assert r["severity_score"] == 0 and r["base_score"] is None and r["severity"] == "low"


def test_cyclic_lineage_min_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "root long")
    got = {(r["node"], r["depth"]) for r in lineage.trace(edges, roots, "down", 5).collect()}
    assert got == {(2, 1), (3, 1)}
    up = {(r["node"], r["depth"]) for r in lineage.trace(edges, roots, "up", 5).collect()}
    assert up == {(3, 1), (2, 2)}


def test_dedupe_modes_and_idempotence(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (None, "a")], "id long, k string")
    keep = fixes.dedupe(df, ["k"], "id", "keep")
    assert sorted(r["id"] or 0 for r in keep.collect()) == [0, 1, 3, 4]
    group = fixes.dedupe(df, ["k"], "id", "group")
    assert sorted(r["id"] or 0 for r in group.collect()) == [0, 1, 3]
    assert fixes.dedupe(keep, ["k"], "id").count() == keep.count()


def test_fill_then_rollback_restores(spark):
    vt = VersionedTable(spark, shared_dir(spark, "t"))
    c = spark.createDataFrame(CUSTOMERS, "id long, email string")
    vt.commit(c)
    r = _one(apply_fix(spark, vt, Fix("fill_null", "email"), "customers"))
    assert r["success"] and r["rows_affected"] == 1 and r["version_after"] == 2
    assert vt.read().filter("email IS NULL").count() == 0
    rb = _one(rollback(spark, vt, 1, "id", ["email"], "customers"))
    assert rb["rows_restored"] == 1
    assert sorted(vt.read().collect()) == sorted(c.collect())


def test_failed_fix_keeps_version(spark):
    vt = VersionedTable(spark, shared_dir(spark, "t"))
    vt.commit(spark.createDataFrame(CUSTOMERS, "id long, email string"))
    r = _one(apply_fix(spark, vt, Fix("fill_null", "no_such_column"), "customers"))
    assert not r["success"] and vt.current() == 1


def test_exact_share(spark):
    df = spark.range(0, 1001).withColumnRenamed("id", "k")
    chosen = df.filter(faults.exact_share_predicate(df, "k", 0.4))
    assert chosen.count() == 400
    dup = df.union(df.filter("k < 10"))   # tied keys are chosen together
    n = dup.filter(faults.exact_share_predicate(dup, "k", 0.4)).select("k").distinct().count()
    assert n in (404, 405, 400, 401, 402, 403)


def _attempts(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, base + dt.timedelta(seconds=s), i, ok) for i, (k, s, ok) in enumerate(rows)],
                                 "key long, ts timestamp_ntz, attempt_id long, ok boolean")


def test_rate_limit_fold(spark):
    rows = [(1, 0, True), (1, 10, True), (1, 20, True), (1, 30, False), (1, 3600, False), (1, 3610, True),
            (1, 3620, True), (1, 3630, True), (2, 5, True), (2, 7205, True)]
    out = {r["attempt_id"]: r for r in rate_limit(_attempts(spark, rows), max_n=2, span_seconds=3600).collect()}
    assert [out[i]["allowed"] for i in range(8)] == [True, True, False, False, True, True, True, False]
    # the failed attempt at 3600 moved the window start
    assert out[4]["window_start"] == dt.datetime(2024, 1, 1, 1, 0, 0)
    assert out[9]["allowed"] and out[9]["fixes_before"] == 0


def test_parse_responses(spark):
    texts = [("a", "SQL Fix: UPDATE t SET x = 1;\n\nMETRICS:\nconfidence_score: 90\nexpected_rows_affected: 12\n"
                   "hours_saved: 3"),
             ("b", "-- updated_at column\nDELETE FROM t;"),
             ("c", "UPDATE t SET x=1;\nMETRICS:\nconfidence_score: high\nhours_saved: 4\nhours_saved: x")]
    df = fixes.parse_responses(spark.createDataFrame(texts, "id string, answer string"), "answer")
    got = {r["id"]: r for r in df.collect()}
    assert got["a"]["fix_sql"] == "UPDATE t SET x = 1;" and got["a"]["confidence_score"] == 90
    assert got["a"]["expected_rows_affected"] == 12 and got["a"]["hours_saved"] == 3
    assert got["b"]["fix_sql"] == "DELETE FROM t;" and not got["b"]["has_metrics"]
    assert got["b"]["confidence_score"] == 50 and got["b"]["hours_saved"] == 0
    assert got["c"]["confidence_score"] == 50 and got["c"]["hours_saved"] == 4


def test_issue_column_and_label(spark):
    rows = [("svc.db.mart.customers.customer_email.email_not_null", "email_not_null", "svc.db.mart.customers"),
            ("svc.db.mart", "customer_id_duplicate", "svc.db.mart.customers"),
            ("", "phone_format_check", "x"),
            ("", "check test", "x"),
            ("svc.db.mart.orders.orders.format_check", "zip_check", "svc.db.mart.orders")]
    df = spark.createDataFrame(rows, "fqn string, name string, tbl string")
    got = [(r["c"], r["l"]) for r in df.select(T.issue_column("fqn", "name", "tbl").alias("c"),
                                                 T.issue_label("name", "fqn").alias("l")).collect()]
    assert got == [("customer_email", "missing values"), ("customer_id", "duplicate records"),
                   ("phone_format_check", "format mismatch"), ("unknown column", "data quality"),
                   ("zip_check", "data quality")]


def test_clean_message(spark):
    rows = [('Here is a specific, detailed explanation of the data quality issue: "We found 3 nulls."',),
            ("Here is a specific, detailed explanation of the data quality issue:  We found 4.  ",),
            ('  "plain" ',)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string").transform(lambda d: T.with_clean_message(d, "m", "c")).select("c").collect()]
    assert got == ["We found 3 nulls.", "We found 4.", "plain"]


def test_run_suite_fuses_and_reports(spark):
    c = spark.createDataFrame(CUSTOMERS, "id long, email string")
    rules = {"shop.customers": [Rule("not_null", "email", "email_not_null"),
                                Rule("format", "email", "email_format", r"^[a-z]@x\.com$"),
                                Rule("unique", "id", "id_unique")]}
    out = {r["test_name"]: r for r in checks.run_suite({"shop.customers": c}, rules).collect()}
    assert out["email_not_null"]["status"] == "Failed" and out["email_format"]["failed_rows"] == 0
    assert out["id_unique"]["status"] == "Success" and out["id_unique"]["total_rows"] == 7


def test_rate_limit_wall_clock_across_dst(spark):
    """Wall-clock timestamps: elapsed time must not depend on the session zone."""
    rows = [(1, dt.datetime(2024, 3, 10, 1, 30), 0, True), (1, dt.datetime(2024, 3, 10, 2, 29), 1, True),
            (1, dt.datetime(2024, 3, 10, 2, 31), 2, True)]
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, attempt_id long, ok boolean")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = {r["attempt_id"]: r["allowed"] for r in rate_limit(df, max_n=1, span_seconds=3600).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == {0: True, 1: False, 2: True}


def test_approve_and_apply_flow(spark):
    from tablekeeper.operators.flow import approve_and_apply
    from tablekeeper.plans.q_fixes import rule_table
    vt = VersionedTable(spark, shared_dir(spark, "flow"))
    vt.commit(spark.createDataFrame([(1, None, None, None), (2, "x", None, "z"), (3, None, "y", None)],
                                    "id long, a string, b string, c string"))
    t = "shop.t"
    decisions = spark.createDataFrame(
        [(f"{t}.a.a_not_null", "approve", dt.datetime(2024, 1, 1, 0, 0, 0)),
         (f"{t}.b.b_not_null", "approve", dt.datetime(2024, 1, 1, 0, 0, 10)),
         (f"{t}.c.c_not_null", "reject", dt.datetime(2024, 1, 1, 0, 0, 20))],
        "test string, decision string, decided_at timestamp_ntz")
    out = {r["column_name"]: r for r in approve_and_apply(spark, vt, t, ["id", "a", "b", "c"], decisions,
                                                          rule_table(spark), max_n=1, span_seconds=3600).collect()}
    assert (out["a"]["action"], out["a"]["allowed"], out["a"]["rows_affected"]) == ("approved", True, 2)
    assert (out["b"]["action"], out["b"]["allowed"], out["b"]["rows_affected"]) == ("approved", False, 0)
    assert (out["c"]["action"], out["c"]["allowed"]) == ("rejected", False)
    now = vt.read()
    assert vt.current() == 2 and now.filter("a IS NULL").count() == 0 and now.filter("b IS NULL").count() == 2


def test_apply_dedupe_and_format_fixes(spark):
    vt = VersionedTable(spark, shared_dir(spark, "t"))
    vt.commit(spark.createDataFrame([(1, "a@x.com"), (2, "a@x.com"), (3, "B@X.COM "), (4, None), (5, None)],
                                    "id long, email string"))
    r = _one(apply_fix(spark, vt, Fix("dedupe", "email", keys=["email"], id_col="id"), "c"))
    assert r["success"] and r["rows_affected"] == 1 and vt.read().count() == 4      # NULL e-mails are kept
    r = _one(apply_fix(spark, vt, Fix("fix_format", "email", valid=r"^[a-z]+@[a-z]+\.com$",
                                      pattern=r"^\s*(\S+)\s*$", replacement="$1"), "c"))
    assert r["success"] and r["rows_affected"] == 1 and r["version_after"] == 3
    assert sorted(x["email"] or "" for x in vt.read().collect()) == ["", "", "B@X.COM", "a@x.com"]


def test_versioned_commit_verification_keeps_pointer(spark):
    import pytest
    vt = VersionedTable(spark, shared_dir(spark, "t"))
    vt.commit(spark.range(3))
    with pytest.raises(RuntimeError):
        vt.commit(spark.range(5), expected_rows=4)
    assert vt.current() == 1 and vt.read().count() == 3
    assert vt.commit(spark.range(7), expected_rows=7) == 3 and vt.read().count() == 7


def test_edge_all_null_unknown_test_missing_node(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, email string")
    p = {r["column_name"]: r for r in profile.profile(df).collect()}
    assert p["email"]["null_pct"] == 100.0 and p["id"]["null_pct"] == 0.0
    assert _one(checks.check_not_null(df, "email", "t"))["failed_rows"] == 2
    assert fixes.fill_nulls(df, "email", "x").filter("email IS NULL").count() == 0
    # a failing test whose name matches no class: scored as 'unknown' with no type points
    res = spark.createDataFrame([(0, "row_count", "s.d.m.t0.c.row_count", "Failed", "r", 1)],
                                "node long, test_name string, test_fqn string, status string, result string, result_id long")
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    r = _one(diagnose.severity(res, edges, spark.createDataFrame([(0,)], "root long")))
    assert r["issue_type"] == "unknown" and r["issue_type_score"] == 0 and r["severity_score"] == 30 + 5 + 3
    # an edge to a node missing from the catalogue: dropped from named edges, id kept by the lookup
    nodes = spark.createDataFrame([(0, "svc.db.mart.a")], "id long, fqn string")
    assert lineage.named_edges(edges, nodes).count() == 0
    names = {r["id"]: r["name"] for r in lineage.resolve_name(spark.createDataFrame([(0,), (1,)], "id long"),
                                                              nodes).collect()}
    assert names == {0: "svc.db.mart.a", 1: "1"}


def test_apply_fix_runs_the_repair_once(spark, tmp_path, monkeypatch):
    """One call of the repair, one write; a fill and a format rewrite count their rows as they pass."""
    from tablekeeper.operators import apply
    rows = [(1, "a@x.com"), (2, None), (3, "A B"), (4, None), (5, "a@x.com"), (6, "a@x.com"), (7, "Q")]
    vt = VersionedTable(spark, str(tmp_path / "once"))
    vt.commit(spark.createDataFrame(rows, "id long, email string").repartition(3))
    calls, real = [], apply.repaired
    monkeypatch.setattr(apply, "repaired", lambda df, fix: calls.append(fix.kind) or real(df, fix))
    got = [apply.apply_fix(spark, vt, fix, "t").first() for fix in (
        Fix("fix_format", "email", valid="^[a-z]+@x[.]com$", pattern="[A-Z ]+", replacement="z"), Fix("fill_null", "email"),
        Fix("dedupe", "email", keys=["email"], id_col="id"))]
    assert [(r["success"], r["rows_affected"], r["version_after"]) for r in got] == [(True, 2, 2), (True, 2, 3), (True, 4, 4)]
    assert calls == ["fix_format", "fill_null", "dedupe"]
    assert {r["id"] for r in vt.read().collect()} == {1, 2, 3}


def test_dedupe_moves_no_key_text(spark):
    """The losers come from two narrow tables: the aggregate and its exchange hold digests, the table is scanned twice."""
    df = spark.createDataFrame([(i, "long text " * 50 + str(i % 7)) for i in range(50)] + [(None, "x"), (99, None), (98, None)], "id long, body string")
    gone = fixes.losers(df, ["body"], "id")
    assert gone.schema["_key"].dataType.simpleString() == "struct<k0:binary>"
    assert {r["_id"] for r in gone.collect()} == set(range(7, 50))
    assert "body" not in gone._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"] for r in fixes.dedupe(df, ["body"], "id").collect()} == {*range(7), None, 98, 99}
    assert {r["id"] for r in fixes.dedupe(df, ["body"], "id", "group").collect()} == {*range(7), None, 98}


def test_payload_severity_and_cause(spark):
    import json
    case = lambda n: {"name": n, "testCaseFQN": f"s.d.m.t.c.{n}", "result": "r"}
    node = lambda n, *tests: {"fullyQualifiedName": n, "failingTestCases": {"testCaseResults": [case(t) for t in tests]}}
    edges = lambda *to: {"downstreamEdges": [{"fromEntity": "a", "toEntity": t} for t in to]}
    full = {"status": "failed", "upstreamAnalysis": {"failingUpstreamNodes": [node("n1", "row_count", "x_duplicate", "x_null"), node("n2", "y_null")]},
            "lineage": edges("b", "b", "c")}
    rows = [(1, json.dumps(full)), (2, json.dumps({"status": "failed", "lineage": edges("b")})), (3, json.dumps({"status": "success"})),
            (4, json.dumps({"status": "failed", "upstreamAnalysis": {"failingUpstreamNodes": [node("n3")]}})), (5, "no json"), (6, None),
            (7, json.dumps({"status": "failed", "upstreamAnalysis": {"failingUpstreamNodes": []}}))]
    p = diagnose.read_payloads(spark.createDataFrame(rows, "id long, j string"), "j", "id")
    got = {r["root"]: tuple(r)[1:] for r in diagnose.payload_severity(p).collect()}
    assert got[1] == ("failed", 30 + 15 + 15 + 9, 30, 15, 15, 9, 3, "duplicates", 3, 2, "medium")
    assert got[2] == ("failed", 0, 30, 0, 0, 0, 0, "unknown", 0, 1, "low")           # no failing node: 0, the base shown
    assert got[7] == ("failed", 0, 30, 0, 0, 0, 0, "unknown", 0, 0, "low")
    assert got[4] == ("failed", 30, 30, 0, 0, 0, 0, "unknown", 0, 0, "low")          # a node without tests
    for i in (3, 5, 6):
        assert got[i] == ("success", 0, None, None, None, None, None, None, None, 0, "low")
    cause = {r["root"]: tuple(r)[1:] for r in diagnose.payload_cause(p).collect()}
    assert cause[1] == ("failed", 2, 4, "n1", "row_count", "s.d.m.t.c.row_count", "r") and cause[2] == ("failed", 0, 0, None, None, None, None)
    assert cause[3] == ("success", 0, 0, None, None, None, None)


def test_one_history_for_flow_repairs_and_rollbacks(spark):
    """Entries of all three feed the timeline, the audit and the summary together."""
    from tablekeeper.operators import history
    from tablekeeper.operators.flow import approve_and_apply
    from tablekeeper.plans.q_fixes import rule_table
    vt, path = VersionedTable(spark, shared_dir(spark, "history-table")), shared_dir(spark, "history")
    vt.commit(spark.createDataFrame([(1, "A@x.com"), (2, None), (3, " a@x.com"), (4, None), (5, "dup"), (6, "dup"), (7, "dup")], "id long, email string"))
    rules = [Rule("not_null", "email", "email_not_null"), Rule("format", "email", "email_format", "^[a-z]+@x.com$"), Rule("unique", "email", "email_duplicate")]
    at = dt.datetime(2024, 1, 1)
    decisions = spark.createDataFrame([(f"s.t.email.{n}", "approve", at + dt.timedelta(minutes=i)) for i, n in
                                       enumerate(("email_not_null", "email_format", "email_duplicate"))], "test string, decision string, decided_at timestamp_ntz")
    out = {r["test"]: r for r in approve_and_apply(spark, vt, "s.t", rules, decisions, rule_table(spark), history_path=path, id_col="id").collect()}
    assert {r["id"]: r["email"] for r in vt.read().collect()} == {1: "a@x.com", 2: fixes.DEFAULT_FILL, 3: "a@x.com", 4: fixes.DEFAULT_FILL, 5: "dup"}
    assert {t.split(".")[-1]: r["rows_affected"] for t, r in out.items()} == {"email_not_null": 2, "email_format": 2, "email_duplicate": 2}
    assert (out["s.t.email.email_duplicate"]["before"]["rows"], out["s.t.email.email_duplicate"]["after"]["rows"]) == (7, 5)
    apply_fix(spark, vt, Fix("dedupe", "email", keys=["email"], id_col="id"), "s.t", {"fix_id": 77, "test": "s.t.email.email_duplicate"}, path)
    rollback(spark, vt, 1, "id", ["email"], "s.t", {"fix_id": 78}, path)
    h = history.read_history(spark, path)
    assert set(schemas.struct(schemas.HISTORY_ENTRY).names) <= set(h.columns)
    line = [r["action"] for r in history.fix_timeline(h).collect()]
    assert line[:2] == ["REVERTED", "APPLIED"] and line[2:] == ["APPROVED"] * 3
    assert history.history_summary(h).first()["total_fixes"] == 5
    told = [r["audit"] for r in history.audit_text(h).collect()]
    assert len(told) == 5 and any("- Before: 2 nulls" in a and "Fix SQL: UPDATE" in a for a in told)
    assert history.running_hours(h.withColumn("hours_saved", F.coalesce("hours_saved", F.lit(2)))).count() == 5
