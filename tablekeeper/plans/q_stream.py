"""Queries: batch rate limiter and the three streaming operators.

Streaming queries lay the driver table out as time-ordered arrival files,
run the stream to completion with ``availableNow`` and return what the sink
received, read back as a batch DataFrame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeeper.operators.checks import Rule
from tablekeeper.operators.ratelimit import rate_limit
from tablekeeper.plans import standins as S
from tablekeeper.plans.arrivals import arrival_files
from tablekeeper.plans.q_checks import EMAIL_FORMAT, _row_sql, _unique_sql
from tablekeeper.plans.q_profile import pct_sql
from tablekeeper.plans.registry import query, table
from tablekeeper.session import shared_dir
from tablekeeper.streaming import monitor as M

LIMIT_MAX, LIMIT_SPAN = 2, 86400
ARRIVAL_BATCHES = 6


def _limit_sql(max_n: int, span_s: int, source: str = S.FIX_ATTEMPTS_SQL) -> str:
    span = span_s * 1_000_000
    reset = f"(a.t - s.anchor_t >= {span})"
    c = f"(CASE WHEN {reset} THEN 0 ELSE s.after END)"
    return f"""
WITH RECURSIVE a AS (SELECT key, ts, attempt_id, ok, epoch_us(ts) AS t,
                       row_number() OVER (PARTITION BY key ORDER BY ts, attempt_id) AS rn FROM {source} x),
s AS (SELECT key, rn, attempt_id, ts, ok, t AS anchor_t, ts AS anchor_ts, CAST(0 AS BIGINT) AS before,
             (0 < {max_n}) AS allowed, CAST(CASE WHEN ok AND 0 < {max_n} THEN 1 ELSE 0 END AS BIGINT) AS after
      FROM a WHERE rn = 1
      UNION ALL
      SELECT a.key, a.rn, a.attempt_id, a.ts, a.ok,
        CASE WHEN {reset} THEN a.t ELSE s.anchor_t END, CASE WHEN {reset} THEN a.ts ELSE s.anchor_ts END,
        {c}, {c} < {max_n}, {c} + CASE WHEN a.ok AND {c} < {max_n} THEN 1 ELSE 0 END
      FROM s JOIN a ON a.key = s.key AND a.rn = s.rn + 1)
SELECT key, attempt_id, ts, ok, anchor_ts AS window_start, before AS fixes_before, allowed, (allowed AND ok) AS counted
FROM s"""


@query("rate_limit", oracle=_limit_sql(LIMIT_MAX, LIMIT_SPAN))
def q_rate_limit(spark, d):
    return rate_limit(S.fix_attempts(spark, d), max_n=LIMIT_MAX, span_seconds=LIMIT_SPAN)


# attempts with NULL keys, times and flags; the recursion runs over keys made non-NULL
NULLS_SQL = f"""(SELECT CASE WHEN attempt_id % 13 = 0 THEN -1 ELSE key END AS key, ts, attempt_id,
  coalesce(CASE WHEN attempt_id % 17 = 0 THEN NULL ELSE ok END, false) AS ok FROM {S.FIX_ATTEMPTS_SQL} y
  WHERE attempt_id % 11 <> 0)"""


def attempts_with_nulls(spark, d):
    i = F.col("attempt_id")
    return S.fix_attempts(spark, d).select(F.when(i % 13 != 0, F.col("key")).alias("key"), F.when(i % 11 != 0, F.col("ts")).alias("ts"),
                                           "attempt_id", F.when(i % 17 != 0, F.col("ok")).alias("ok"))


@query("rate_limit_nulls", oracle=f"""
SELECT nullif(key, -1) AS key, attempt_id, ts, CASE WHEN attempt_id % 17 = 0 THEN NULL ELSE ok END AS ok, window_start,
  fixes_before, allowed, counted FROM ({_limit_sql(LIMIT_MAX, LIMIT_SPAN, NULLS_SQL)}) z
UNION ALL SELECT CASE WHEN attempt_id % 13 = 0 THEN NULL ELSE key END, attempt_id, NULL,
  CASE WHEN attempt_id % 17 = 0 THEN NULL ELSE ok END, NULL, NULL, false, false FROM {S.FIX_ATTEMPTS_SQL} x
  WHERE attempt_id % 11 = 0""")
def q_rate_limit_nulls(spark, d):
    return rate_limit(attempts_with_nulls(spark, d), max_n=LIMIT_MAX, span_seconds=LIMIT_SPAN)


def _arrive(spark, df, ts):
    """The table as a stream arriving in time order: time-ranged files; a
    micro-batch takes as many consecutive files as the input has scan splits
    (at most the cluster's cores)."""
    src = shared_dir(spark, "arrivals")
    # files per batch follow the input's size (its scan splits), up to the cluster's cores
    per_batch = max(1, min(spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))
    arrival_files(df, ts, src, ARRIVAL_BATCHES * per_batch)
    return (spark.readStream.schema(spark.read.parquet(src).schema)
            .option("maxFilesPerTrigger", per_batch).parquet(src))


@query("stream_rate_limit", oracle=_limit_sql(LIMIT_MAX, LIMIT_SPAN))
def q_stream_rate_limit(spark, d):
    stream = _arrive(spark, S.fix_attempts(spark, d), "ts")
    sink = shared_dir(spark, "limit-sink")
    q = M.run_rate_limit(stream, sink, {"availableNow": True}, max_n=LIMIT_MAX, span_seconds=LIMIT_SPAN)
    q.awaitTermination()
    return spark.read.parquet(sink).drop("batch_id")


def email_events(spark, d):
    """Events with a contact column that is missing on error events."""
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
                    .otherwise(F.format_string("user%d@example.com", "user_id")).alias("customer_email"))


NULL_RATE_SPAN = "1 hour"


@query("stream_null_rate", oracle=f"""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
  count(*) AS rows, count(*) FILTER (WHERE event_type = 'error') AS nulls,
  {pct_sql("count(*) FILTER (WHERE event_type = 'error')", "count(*)")} AS null_pct
FROM events GROUP BY 1""")
def q_stream_null_rate(spark, d):
    stream = _arrive(spark, email_events(spark, d), "ts")
    sink = shared_dir(spark, "null-rate-sink")
    q = M.run_null_rate(stream, "customer_email", "ts", sink, span=NULL_RATE_SPAN, delay="1 hour",
                        trigger={"availableNow": True})
    q.awaitTermination()
    return M.null_rate_result(spark, sink)


MONITOR_TABLE = "svc.db.mart.customer"


MONITOR_NATIONS = 20      # the parent table lacks the nations from here on


def monitor_rules(spark, d):
    """One rule of every kind that a stream has: row-local, unique over two columns, reference."""
    nations = table(spark, d, "nation").filter(F.col("n_nationkey") < MONITOR_NATIONS)
    return [Rule("not_null", "email", "email_not_null"), Rule("format", "email", "email_format_check", EMAIL_FORMAT),
            Rule("expression", "c_acctbal", "balance_not_negative", "c_acctbal >= 0"),
            Rule("unique", "c_nationkey", "segment_unique", columns=["c_nationkey", "c_mktsegment"]),
            Rule("unique", "email", "email_unique"), Rule("reference", "c_nationkey", "nation_exists", (nations, "n_nationkey"))]


MONITOR_SQL = " UNION ALL ".join([
    _row_sql(MONITOR_TABLE, "email", "email_not_null", "email IS NULL", S.CUSTOMER_SPIKED_SQL + " c"),
    _row_sql(MONITOR_TABLE, "email", "email_format_check", f"email IS NOT NULL AND NOT regexp_matches(email, '{EMAIL_FORMAT}')",
             S.CUSTOMER_SPIKED_SQL + " c"),
    _row_sql(MONITOR_TABLE, "c_acctbal", "balance_not_negative", "(c_acctbal >= 0) = false", S.CUSTOMER_SPIKED_SQL + " c"),
    _unique_sql(MONITOR_TABLE, ["c_nationkey", "c_mktsegment"], "segment_unique", S.CUSTOMER_SPIKED_SQL + " c"),
    _unique_sql(MONITOR_TABLE, ["email"], "email_unique", S.CUSTOMER_SPIKED_SQL + " c"),
    _row_sql(MONITOR_TABLE, "c_nationkey", "nation_exists",
             f"c_nationkey IS NOT NULL AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < {MONITOR_NATIONS})",
             S.CUSTOMER_SPIKED_SQL + " c")])


@query("stream_monitor", oracle=f'SELECT test_fqn, table_fqn, "column", test_name, failed_rows, total_rows, status FROM ({MONITOR_SQL}) m')
def q_stream_monitor(spark, d):
    """Checks run on each arriving batch of the customer table, keyed ones against all batches before; totals over all batches."""
    stream = _arrive(spark, S.customer_spiked(spark, d), "c_custkey")
    sink = shared_dir(spark, "monitor-sink")
    q = M.monitor(stream, MONITOR_TABLE, monitor_rules(spark, d), sink, trigger={"availableNow": True})
    q.awaitTermination()
    return M.monitor_totals(spark, sink).drop("batches")
