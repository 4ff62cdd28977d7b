"""NULL keys, times and flags; hot failing nodes; versions that survive a crash; the flow's decisions."""

import contextlib
import datetime as dt

import pytest
from pyspark.sql import Window, functions as F

from tablekeeper import schemas
from tablekeeper.operators import diagnose, history, lineage
from tablekeeper.operators.apply import Fix, apply_fix, rollback
from tablekeeper.operators.flow import approve_and_apply
from tablekeeper.operators.ordered import ranges, running
from tablekeeper.operators.ratelimit import rate_limit
from tablekeeper.plans.q_fixes import rule_table
from tablekeeper.session import shared_dir
from tablekeeper.sources.files import append_to
from tablekeeper.sources.versions import VersionedTable
from tablekeeper.streaming import monitor as M

BASE = dt.datetime(2024, 1, 1)


@contextlib.contextmanager
def _conf(spark, settings):
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def attempts(spark, rows):
    at = [(k, None if s is None else BASE + dt.timedelta(seconds=s), i, ok) for i, (k, s, ok) in enumerate(rows)]
    return spark.createDataFrame(at, "key long, ts timestamp_ntz, attempt_id long, ok boolean")


ROWS = [(1, 0, True), (1, None, True), (1, 5, None), (1, 6, True), (1, 7, True), (None, 0, True), (None, 1, True), (None, 2, True),
        (2, None, True), (1, 4000, None), (2, None, None)]
#: fixes before (None: in no window), allowed, counted
WANT = {0: (0, True, True), 1: (None, False, False), 2: (1, True, False), 3: (1, True, True), 4: (2, False, False),
        5: (0, True, True), 6: (1, True, True), 7: (2, False, False), 8: (None, False, False), 9: (0, True, False),
        10: (None, False, False)}


def told(df):
    return {r["attempt_id"]: (r["fixes_before"], r["allowed"], r["counted"]) for r in df.collect()}


def test_rate_limit_keeps_every_attempt(spark):
    out = rate_limit(attempts(spark, ROWS), max_n=2, span_seconds=3600)
    assert told(out) == WANT
    assert {r["attempt_id"] for r in out.where("key IS NULL").collect()} == {5, 6, 7}


def test_stream_limiter_agrees(spark):
    src, sink = shared_dir(spark, "null-limit-src"), shared_dir(spark, "null-limit-sink")
    df = attempts(spark, ROWS)
    df.coalesce(1).write.parquet(src)
    q = M.run_rate_limit(spark.readStream.schema(df.schema).parquet(src), sink, {"availableNow": True}, max_n=2, span_seconds=3600)
    q.awaitTermination()
    assert told(spark.read.parquet(sink)) == WANT


def test_rate_limit_all_untimed(spark):
    assert rate_limit(attempts(spark, [(1, None, True)] * 3)).where("allowed").count() == 0


def test_running_keeps_null_keys_and_times(spark):
    rows = [("a", 3, 10), ("a", None, 1), (None, 2, 5), ("a", 1, 2), (None, None, 7), ("a", None, 1)]
    df = spark.createDataFrame([(k, t, i, v) for i, (k, t, v) in enumerate(rows)], "k string, t long, i long, v long")
    out = running(df, "k", ["t", "i"], sums={"s": F.col("v")})
    assert {(r["i"], r["seq"], r["s"]) for r in out.collect()} == {(1, 1, 1), (5, 2, 2), (3, 3, 4), (0, 4, 14), (4, 1, 7), (2, 2, 12)}


def test_running_splits_a_hot_instant(spark):
    """A third of the rows in one second of one key: they lie in several ranges, and no task numbers more than a range."""
    hot = spark.range(6000).select(F.lit("hot").alias("k"), F.lit(7).alias("t"), (F.col("id") * 7919 % 6007).alias("i"))
    rest = spark.range(12000).select(F.format_string("k%02d", F.col("id") % 40).alias("k"), (F.col("id") % 500).cast("int").alias("t"), "id")
    df = hot.union(rest).withColumn("v", F.when(F.col("i") % 3 > 0, F.col("i"))).repartition(9)
    with _conf(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}):
        cut = ranges(df, ["k", "t", "i"], "hot-ranges")
        sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
        assert len(sizes) >= 10 and max(sizes) < 4000
        assert cut.where("k = 'hot'").select("_range").distinct().count() >= 3
        out = running(df, "k", ["t", "i"], sums={"s": F.col("v")})
        w = Window.partitionBy("k").orderBy("t", "i")
        want = df.select("*", F.row_number().over(w).cast("bigint").alias("seq"), F.sum("v").over(w).alias("s"))
        assert out.columns == ["k", "t", "i", "v", "seq", "s"]
        assert out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0


def test_hot_failing_node_shared_by_many_roots(spark):
    roots = spark.range(1, 41).select(F.col("id").alias("root"))
    edges = roots.select(F.lit(1000).alias("src"), F.col("root").alias("dst"))       # one source of all roots
    results = spark.range(500).select(F.lit(1000).alias("node"), F.when(F.col("id") % 2 == 0, "email_not_null").otherwise("row_count").alias("test_name"),
                                      F.format_string("svc.db.s.t.c.t%03d", "id").alias("test_fqn"), F.lit("Failed").alias("status"),
                                      F.lit("r").alias("result"), F.col("id").alias("result_id"))
    results = results.unionByName(results.limit(1).withColumn("node", F.lit(None).cast("int")))
    seen = diagnose.failing_upstream(results, edges, roots)
    assert seen.count() == 40                                                          # one row a root, not 500
    rc = diagnose.root_cause(results, edges, roots).collect()
    assert {(r["status"], r["failing_nodes"], r["failing_results"], r["first_node"], r["test_fqn"]) for r in rc} == {
        ("failed", 1, 500, 1000, "svc.db.s.t.c.t000")}
    s = diagnose.severity(results, edges, roots).collect()
    assert {(r["failing_tests_count"], r["issue_type"]) for r in s} == {(500, "null_values")}


def test_unnamed_nodes_stay_apart(spark):
    center = spark.createDataFrame([(1, "s.d.m.a", None, None)], "center long, center_fqn string, center_name string, center_type string")
    nodes = spark.createDataFrame([(1, 2, None, None, None), (1, 3, None, "n3", "TABLE")], "center long, id long, fqn string, name string, type string")
    up = spark.createDataFrame([(1, 2, 1), (1, 3, 1)], "center long, from_id long, to_id long")
    got, edges = lineage.lineage_graph(center, nodes, up, up.limit(0))
    assert {(r["id"], r["label"], r["type"]) for r in got.collect()} == {("s.d.m.a", "a", "UNKNOWN"), ("2", "2", "UNKNOWN"), ("3", "n3", "TABLE")}
    assert {(r["from"], r["to"]) for r in edges.collect()} == {("2", "s.d.m.a"), ("3", "s.d.m.a")}


def test_catalogued_column_without_tags(spark):
    cols = spark.createDataFrame([("t", "a", None), ("t", "b", None)], "table_fqn string, column string, tags array<struct<tagFQN:string,source:string,labelType:string>>")
    fixed = spark.createDataFrame([("t", "a"), ("t", "x")], "table_fqn string, column string")
    got = {r["column"]: (r["status"], r["tags"]) for r in history.tag_columns(cols, fixed).collect()}
    assert got["a"][0] == "tagged" and got["a"][1][0]["tagFQN"] == history.DEFAULT_TAG
    assert got["b"] == ("unchanged", None) and got["x"][0] == "column not found"


def test_last_decision_counts(spark):
    issues = spark.createDataFrame([(1, "open")], "issue_id long, status string")
    d = spark.createDataFrame([(1, "approve", BASE), (1, "REJECT", BASE + dt.timedelta(hours=1))], "issue_id long, decision string, decided_at timestamp_ntz")
    assert [r["status"] for r in history.decide(issues, d).collect()] == ["closed"]


def test_append_refuses_unknown_columns(spark):
    path = shared_dir(spark, "append")
    append_to(spark.range(2), path)
    with pytest.raises(ValueError, match="more"):
        append_to(spark.range(2).withColumn("more", F.lit(1)), path)
    assert spark.read.parquet(path).count() == 2


def versions(spark, rows, schema):
    vt = VersionedTable(spark, shared_dir(spark, "versions"))
    vt.commit(spark.createDataFrame(rows, schema))
    return vt


def test_crash_between_write_and_pointer(spark, monkeypatch):
    vt = versions(spark, [(1, "a")], "id long, email string")

    def crash(self, version):
        raise OSError("the driver is gone")

    monkeypatch.setattr(VersionedTable, "_point_to", crash)
    with pytest.raises(OSError):
        vt.commit(spark.createDataFrame([(2, "b")], "id long, email string"))
    monkeypatch.undo()
    again = VersionedTable(spark, vt.root)
    assert again.current() == 1 and again.read().collect()[0]["id"] == 1
    assert again.commit(spark.createDataFrame([(3, "c")], "id long, email string")) == 3 and again.read().first()["id"] == 3
    again.restore(1)
    assert again.current() == 1


def test_lost_rows_are_noticed(spark):
    vt = versions(spark, [(1, "a")], "id long, email string")
    with pytest.raises(RuntimeError, match="expected 5"):
        vt.commit(vt.read(), expected_rows=5)
    assert vt.current() == 1


def test_infrastructure_errors_raise(spark, monkeypatch):
    vt = versions(spark, [(1, None)], "id long, email string")
    monkeypatch.setattr(VersionedTable, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("store is gone")))
    with pytest.raises(OSError):
        apply_fix(spark, vt, Fix("fill_null", "email"), "t")


def test_rollback_of_dedupe_counts_and_records(spark):
    vt = versions(spark, [(1, "a"), (2, "a"), (3, "b")], "id long, email string")
    assert apply_fix(spark, vt, Fix("dedupe", "email", keys=["email"], id_col="id"), "t").first()["rows_affected"] == 1
    path = shared_dir(spark, "reverts")
    assert rollback(spark, vt, 1, "id", ["email"], "t", {"test": "unique"}, path).first()["rows_restored"] == 1
    h = spark.read.parquet(path)
    row = h.first()
    assert (row["action"], row["test"], row["rows_affected"]) == ("reverted", "unique", 1) and row["reverted_at"] is not None
    assert history.fix_timeline(h).first()["action"] == "REVERTED"
    assert set(schemas.struct(schemas.HISTORY_ENTRY).names) <= set(h.columns)


def test_flow_takes_the_last_decision_and_types(spark):
    vt = versions(spark, [(1, None, None, None), (2, "x", 5, BASE)], "id long, email string, n long, at timestamp_ntz")
    test = lambda c: f"svc.db.m.t.{c}.{c}_not_null"
    later = BASE + dt.timedelta(minutes=1)
    d = spark.createDataFrame([(test("email"), "approve", BASE), (test("email"), "reject", later), (test("n"), "approve", BASE),
                               (test("at"), "approve", BASE)], "test string, decision string, decided_at timestamp_ntz")
    out = {r["column_name"]: r for r in approve_and_apply(spark, vt, "svc.db.m.t", ["id", "email", "n", "at"], d, rule_table(spark)).collect()}
    assert (out["email"]["action"], out["email"]["rows_affected"]) == ("rejected", 0)
    assert (out["n"]["action"], out["n"]["rows_affected"]) == ("approved", 1)
    assert (out["at"]["action"], out["at"]["rows_affected"]) == ("not fixable", 0)
    now = vt.read().orderBy("id").collect()
    assert now[0]["email"] is None and now[0]["n"] == 0 and now[0]["at"] is None


def test_no_folder_on_a_cluster_is_an_error(spark, monkeypatch):
    from tablekeeper import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
