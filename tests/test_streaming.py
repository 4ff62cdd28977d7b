"""Streaming pieces: idempotent batch sink, arrival order, stateful limiter."""

from tablekeeper.plans.arrivals import arrival_files
import datetime as dt
import functools
import glob
import random

from pyspark.sql import DataFrame, functions as F

from tablekeeper.operators import checks
from tablekeeper.operators.checks import Rule
from tablekeeper.operators.ratelimit import rate_limit
from tablekeeper.session import shared_dir
from tablekeeper.sources.versions import VersionedTable
from tablekeeper.streaming import monitor as M
from tablekeeper.streaming.state import BatchState, summed

BASE = dt.datetime(2024, 1, 1)


def test_batch_sink_rewrite_is_idempotent(spark):
    sink = shared_dir(spark, "sink")
    write = M._write_batch(sink)
    batch = spark.range(5)
    write(batch, 0)
    write(batch, 0)          # the same batch re-run after a failure
    write(spark.range(3), 1)
    assert spark.read.parquet(sink).count() == 8


def test_arrival_files_are_time_ordered(spark):
    rows = [(i, BASE + dt.timedelta(minutes=7 * i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    path = shared_dir(spark, "arrivals")
    arrival_files(df, "ts", path, 4)
    files = sorted(glob.glob(path.replace("file:", "") + "/*.parquet"),
                   key=lambda f: __import__("os").path.getmtime(f))
    spans = [spark.read.parquet(f).agg(F.min("ts"), F.max("ts")).first() for f in files]
    assert len(spans) == 4
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_stream_limiter_matches_batch_and_tolerates_older_rows(spark):
    rows = [(1, 0, True), (1, 10, True), (1, 20, True), (1, 3600, True), (1, 3590, True), (2, 5, True)]
    df = spark.createDataFrame([(k, BASE + dt.timedelta(seconds=s), i, ok) for i, (k, s, ok) in enumerate(rows)],
                               "key long, ts timestamp_ntz, attempt_id long, ok boolean")
    src = shared_dir(spark, "limit-src")
    # first file: attempts up to 3600 s; second file: one attempt older than the new anchor
    df.filter("attempt_id < 4 OR attempt_id = 5").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink = shared_dir(spark, "limit-sink")
    ck = shared_dir(spark, "limit-ckpt")
    q = M.run_rate_limit(stream, sink, {"availableNow": True}, checkpoint=ck, max_n=2, span_seconds=3600)
    q.awaitTermination()
    df.filter("attempt_id = 4").write.mode("append").parquet(src)
    # the query resumes from its checkpoint: only the new file is read, state carries over
    again = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = M.run_rate_limit(again, sink, {"availableNow": True}, checkpoint=ck, max_n=2, span_seconds=3600)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == len(rows)
    got = {r["attempt_id"]: r["allowed"] for r in out.collect()}
    # attempt 3 opened a new window at 3600 s; attempt 4 (3590 s, older than the anchor)
    # counts as inside that window: one fix so far, so it is still allowed
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}


def suite_rules(parent):
    return [Rule("not_null", "email", "email_not_null"), Rule("expression", "v", "v_positive", "v > 0"),
            Rule("format", "email", "email_format", "^[a-z]+@x$"), Rule("generated", "w", "w_generated", "v * 2"),
            Rule("unique", "id", "id_unique"), Rule("unique", "email", "email_unique"), Rule("unique", "id", "pair_unique", columns=["id", "email"]),
            Rule("reference", "p", "p_exists", (parent, "pk"))]


def monitored_rows(seed, n=60):
    rnd = random.Random(seed)
    return [(rnd.choice([None, *range(25)]), rnd.choice([None, "a@x", "b@x", "bad", f"u{seed}@x"]), v, v * 2 + (v % 9 == 0), rnd.choice([None, 1, 2, 3, 4, 9]))
            for v in (rnd.randrange(-3, 30) for _ in range(n))]


MONITORED = "id long, email string, v long, w long, p int"


def totals(df):
    return {r["test_fqn"]: (r["failed_rows"], r["total_rows"], r["status"]) for r in df.collect()}


def test_keyed_monitor_equals_suite(spark):
    """Five batches, one run twice, a restart, snapshots of the state, a parent that gains and then loses keys."""
    parent = VersionedTable(spark, shared_dir(spark, "monitor-parent"))
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "pk long")
    parent.commit(keys(1, 2))
    sink, state = shared_dir(spark, "monitor-sink"), shared_dir(spark, "monitor-state")
    batches = [spark.createDataFrame(monitored_rows(i) if i != 2 else [], MONITORED) for i in range(6)]

    def run(i):
        m = M.KeyedMonitor(spark, "s.t", suite_rules(parent), sink, state)      # a new one each time: a restart
        m.state.every = m.versions.every = 2
        m.run(batches[i], i)

    def as_suite(upto):
        so_far = functools.reduce(DataFrame.unionByName, batches[:upto])
        return totals(checks.run_suite({"s.t": so_far, "p": parent.read()}, {"s.t": suite_rules("p")}))

    run(0)
    assert totals(M.monitor_totals(spark, sink)) == as_suite(1)
    run(1)
    run(1)                                 # the same batch after a failure
    run(2)
    assert totals(M.monitor_totals(spark, sink)) == as_suite(3)
    parent.commit(keys(1, 2, 3, 9))        # earlier orphans get a parent
    run(3)
    run(3)
    assert totals(M.monitor_totals(spark, sink)) == as_suite(4)
    parent.commit(keys(2, 3, 9))           # and others lose theirs
    run(4)
    run(5)
    assert totals(M.monitor_totals(spark, sink)) == as_suite(6)
    assert M.KeyedMonitor(spark, "s.t", suite_rules(parent), sink, state).state._numbers("snapshot", "upto")


def test_monitor_stream_restarts(spark):
    src, sink, ck = (shared_dir(spark, x) for x in ("mon-src", "mon-sink", "mon-ck"))
    parent = spark.createDataFrame([(1,), (2,)], "pk long")
    parts = [spark.createDataFrame(monitored_rows(i), MONITORED).coalesce(1) for i in (10, 11)]
    for part in parts:
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(src)
        M.monitor(stream, "s.t", suite_rules(parent), sink, {"availableNow": True}, checkpoint=ck).awaitTermination()
    assert totals(M.monitor_totals(spark, sink)) == totals(checks.run_suite({"s.t": parts[0].unionByName(parts[1])}, {"s.t": suite_rules(parent)}))


def test_state_counts_a_repeated_batch_once(spark):
    state = BatchState(spark, shared_dir(spark, "state"), "k string, n bigint", ["k"], summed(["k"], "n"), every=3)
    change = lambda *r: spark.createDataFrame(list(r), "k string, n bigint")
    assert state.before(0).count() == 0
    for b in range(9):
        state.write(b, change(("a", 1), (None, 2), ("gone", 1 if b % 2 == 0 else -1)))
        state.write(b, change(("a", 2), (None, 2), ("gone", 1 if b % 2 == 0 else -1)))        # replaces the first
        got = {r["k"]: r["n"] for r in state.before(b + 1).collect()}
        assert got == {"a": 2 * (b + 1), None: 2 * (b + 1), **({"gone": 1} if b % 2 == 0 else {})}
    assert state._numbers("snapshot", "upto") == [3, 6] and state._numbers("delta", "batch_id") == list(range(3, 9))
    assert [r["n"] for r in state.before(9, change((None, 0))).collect()] == [18]


def test_stream_limiter_with_small_blocks(spark):
    """A hot key over several batches, decided in blocks of a few attempts: as the batch form over all of them."""
    rnd = random.Random(2)
    rows = [(rnd.choice([0, 0, 0, 1, None]), BASE + dt.timedelta(seconds=60 * i + rnd.randrange(50)), i, rnd.random() < 0.7) for i in range(240)]
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, attempt_id long, ok boolean")
    src, sink = shared_dir(spark, "hot-src"), shared_dir(spark, "hot-sink")
    arrival_files(df, "ts", src, 3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        M.run_rate_limit(stream, sink, {"availableNow": True}, max_n=2, span_seconds=1800).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got, want = spark.read.parquet(sink).drop("batch_id"), rate_limit(df, max_n=2, span_seconds=1800)
    assert got.exceptAll(want).count() == 0 and got.count() == len(rows)
