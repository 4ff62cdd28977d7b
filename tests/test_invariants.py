"""Invariants from the test strategy: counts add up, repairs are idempotent,
severity is bounded and monotone, the batch limiter equals the streaming one."""

from tablekeeper.plans.arrivals import arrival_files
import itertools

from pyspark.sql import functions as F

from tablekeeper.operators import diagnose, fixes, profile
from tablekeeper.operators.ratelimit import rate_limit
from tablekeeper.plans import standins as S
from tablekeeper.session import shared_dir
from tablekeeper.streaming import monitor as M

SF = "/root/testdata/sf0.001"


def test_nulls_plus_non_nulls_is_rows(spark):
    for r in profile.profile(S.customer_spiked(spark, SF)).collect():
        assert r["null_count"] + r["non_null_count"] == r["total_rows"]


def test_fill_leaves_no_nulls_and_keeps_rows(spark):
    c = S.customer_spiked(spark, SF)
    f = fixes.fill_nulls(c, "email", fixes.DEFAULT_FILL)
    assert f.count() == c.count()
    assert f.filter(F.col("email").isNull()).count() == 0
    assert fixes.fill_nulls(f, "email", "x").exceptAll(f).count() == 0


def _sev(spark, n_tests, n_edges, params):
    res = spark.createDataFrame(
        [(0, f"t{i}_not_null", f"s.d.m.t0.c.t{i}", "Failed", "r", i) for i in range(n_tests)]
        + [(0, "ok_check", "s.d.m.t0.c.ok", "Success", "r", 99)],
        "node long, test_name string, test_fqn string, status string, result string, result_id long")
    edges = spark.createDataFrame([(0, i + 1) for i in range(n_edges)] or [(5, 6)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "root long")
    return diagnose.severity(res, edges, roots, params).first()["severity_score"]


def test_severity_bounded_and_monotone(spark):
    for params in (diagnose.DEFAULT_SEVERITY, diagnose.EXAMPLE_SEVERITY):
        grid = {(t, e): _sev(spark, t, e, params) for t, e in itertools.product([0, 1, 6], [0, 7])}
        assert all(0 <= v <= params.max_total_score for v in grid.values())
        assert all(grid[(0, e)] == 0 for e in [0, 7])          # nothing failed
        for (t, e), v in grid.items():
            for (t2, e2), v2 in grid.items():
                if t >= 1 and t2 >= t and e2 >= e:
                    assert v2 >= v


def test_batch_limiter_equals_streaming_limiter(spark):
    att = S.fix_attempts(spark, SF)
    batch = {r["attempt_id"]: (r["window_start"], r["fixes_before"], r["allowed"])
             for r in rate_limit(att, max_n=2, span_seconds=86400).collect()}
    src = shared_dir(spark, "arrive")
    arrival_files(att, "ts", src, 4)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink = shared_dir(spark, "sink")
    M.run_rate_limit(stream, sink, {"availableNow": True}, max_n=2, span_seconds=86400).awaitTermination()
    streamed = {r["attempt_id"]: (r["window_start"], r["fixes_before"], r["allowed"])
                for r in spark.read.parquet(sink).collect()}
    assert batch == streamed


def test_dedupe_twice_is_once(spark):
    p = S.customer_spiked(spark, SF)
    once = fixes.dedupe(p, ["email"], "c_custkey", "group")
    twice = fixes.dedupe(once, ["email"], "c_custkey", "group")
    assert sorted(once.collect()) == sorted(twice.collect())


