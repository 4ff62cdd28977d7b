"""Structured Streaming: check monitor, windowed null rate, rate limiter.

Sinks are written per micro-batch into ``<sink>/batch_id=<n>`` with overwrite,
so a batch that is re-run after a failure replaces its own output instead of
duplicating it (exactly-once results with an at-least-once trigger).
Checkpoints go to the shared checkpoint folder.
"""

from __future__ import annotations

import functools
import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeeper.operators.checks import (
    ROW_LOCAL, KeySet, Rule, SharedScan, common_type, key_of, result_rows, rule_name, type_of)
from tablekeeper.operators.profile import pct
from tablekeeper.operators.ratelimit import MAX_FIXES_PER_HOUR, SPAN_SECONDS, limit_state, rate_limit
from tablekeeper.session import shared_dir
from tablekeeper.sources.versions import VersionedTable
from tablekeeper.streaming.state import BatchState, latest, summed

POLL_INTERVAL = "30 seconds"   # fixed value: the reference's auto-scan interval


def _write_batch(sink: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    return write


_STARTING = threading.Lock()


def _start(writer, spark: SparkSession, state_partitions: int | None):
    """Start a stateful query with ``state_partitions`` state-store partitions.

    A stateful query fixes its partition count at its first start (later runs
    take it from the checkpoint).  The default is the cluster's parallelism
    (total executor cores), not the session's shuffle setting, which is sized
    for batch shuffles.  The setting is applied around ``start()`` only: the
    query clones the session configuration when it starts.
    """
    n = state_partitions or spark.sparkContext.defaultParallelism
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    with _STARTING:        # starts of this library take turns, so that each clones and restores its own setting
        spark.conf.set(key, str(n))
        try:
            return writer.start()
        finally:
            spark.conf.set(key, old)


def _run(query_df: DataFrame, sink: str, output_mode: str, trigger: dict, checkpoint: str | None = None,
         state_partitions: int | None = None):
    spark = query_df.sparkSession
    ck = checkpoint or shared_dir(spark, "stream-ckpt")
    w = (query_df.writeStream.outputMode(output_mode).foreachBatch(_write_batch(sink))
         .option("checkpointLocation", ck).trigger(**trigger))
    return _start(w, spark, state_partitions)


KEY_STATE = "key_set string, key string, n bigint"


def _parent_version(parent) -> int | None:
    return parent.current() if isinstance(parent, VersionedTable) else None


def _parent_keys(parent, own: KeySet, version: int | None) -> DataFrame:
    """Distinct keys of a parent table, as the state holds them."""
    df = parent.read(version) if isinstance(parent, VersionedTable) else parent
    scan = SharedScan(df, [own], [])
    return scan.counts.filter(f"{scan.is_set(own)} AND {scan.full(own)}").select(F.expr(scan.text(own)).alias("key"))


class KeyedMonitor:
    """Checks each batch against all that came before it.

    The rows of a batch are read once, for all rules (``SharedScan``).  The number
    of rows of every key goes into the state as the batch's change; what a batch
    adds to a rule's failures then depends on the state of its own keys only:

    * unique: all rows of a key that was there before, all but one of a new one;
    * reference: the rows of keys without a parent.  Where the parent is a
      ``VersionedTable``, rows of earlier batches whose key has been added to it
      since the last batch come off, and those whose key is gone come on, so that
      the sum is as of the parent's present version.

    So the failures of all batches add up to those of the suite over all rows.
    """

    def __init__(self, spark: SparkSession, table_fqn: str, rules: list[Rule], sink: str, state: str):
        self.spark, self.fqn, self.rules, self.sink = spark, table_fqn, rules, sink
        self.state = BatchState(spark, f"{state}/keys", KEY_STATE, ["key_set", "key"], summed(["key_set", "key"], "n"))
        self.versions = BatchState(spark, f"{state}/parents", "rule bigint, version bigint", ["rule"], latest(["rule"], ["version"]))
        self.local = [r for r in rules if r.kind in ROW_LOCAL]

    def _keys(self, batch: DataFrame) -> dict[int, tuple[KeySet, KeySet | None]]:
        """By rule: its key and its parent's."""
        out = {}
        for i, r in enumerate(self.rules):
            if r.kind == "unique":
                out[i] = key_of(batch, r), None
            elif r.kind == "reference":
                parent, pk = r.arg
                df = parent.read() if isinstance(parent, VersionedTable) else parent
                kind = common_type(type_of(batch, r.column), type_of(df, pk))
                out[i] = KeySet(((r.column, kind),)), KeySet(((pk, kind),))
        return out

    def _counts(self, batch: DataFrame, batch_id: int, scan: SharedScan) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
        """(key counts of the batch as the state's change, rows and local failures by rule)."""
        inside = [f"IF({scan.is_set(k)}, named_struct('key_set', '{k.name}', 'key', IF({scan.full(k)}, {scan.text(k)}, NULL), 'n', n), NULL)"
                  for k in scan.keys]
        whole = F.expr(f"IF({scan.is_set(None)}, named_struct('key_set', '', 'key', to_json(array(n{''.join(f', _f{j}' for j in range(len(self.local)))})), "
                       "'n', 0L), NULL)")
        rows = scan.counts.select(F.coalesce(*[F.expr(x) for x in inside], whole).alias("r")).select("r.*")
        written = self.state.write(batch_id, rows)
        told = written.filter("key_set = ''").first()          # one row of as many numbers as there are rules
        numbers = json.loads(told["key"]) if told else [0] * (1 + len(self.local))
        failed = iter(numbers[1:])
        return written.filter("key_set <> ''"), {i: (next(failed), numbers[0]) for i, r in enumerate(self.rules) if r.kind in ROW_LOCAL}

    def _moved(self, i: int, key: KeySet, own: KeySet, batch_id: int, now: int | None) -> DataFrame | None:
        """What the parent's new version changes about the rows of earlier batches (one row: failed)."""
        last = self.versions.before(batch_id).filter(F.col("rule") == i).first()
        if now is None or last is None or last["version"] == now:
            return None
        parent = self.rules[i].arg[0]
        old, new = _parent_keys(parent, own, last["version"]), _parent_keys(parent, own, now)
        changed = old.join(new, "key", "left_anti").withColumn("by", F.lit(1)).unionByName(new.join(old, "key", "left_anti").withColumn("by", F.lit(-1)))
        changed = changed.withColumn("key_set", F.lit(key.name))
        return (self.state.before(batch_id, changed).join(changed, ["key_set", "key"])
                .agg(F.coalesce(F.sum(F.col("n") * F.col("by")), F.lit(0)).alias("failed")))

    def run(self, batch: DataFrame, batch_id: int) -> None:
        keys = self._keys(batch)
        scan = SharedScan(batch, [k for k, _ in keys.values()], self.local)
        counts, local = self._counts(batch, batch_id, scan)
        spark = self.spark
        parts = [spark.range(len(self.rules)).selectExpr("CAST(id AS INT) AS rule", "0L AS failed", "0L AS total")]
        if local:
            values = ", ".join(f"({i}, {f}L, {n}L)" for i, (f, n) in local.items())
            parts.append(spark.sql(f"SELECT * FROM VALUES {values} AS t(rule, failed, total)"))
        uniques = {k.name for i, (k, _) in keys.items() if self.rules[i].kind == "unique"}
        if uniques:
            mine = counts.filter(F.col("key_set").isin(*uniques))
            before = self.state.before(batch_id, mine.filter("key IS NOT NULL")).select("key_set", "key", F.lit(True).alias("seen"))
            j = mine.join(before, ["key_set", "key"], "left").groupBy("key_set").agg(
                F.expr("sum(IF(key IS NULL, 0, IF(seen, n, n - 1))) AS failed"), F.expr("sum(n) AS total"))
            for i, (k, _) in keys.items():
                if self.rules[i].kind == "unique":
                    parts.append(j.filter(F.col("key_set") == k.name).select(F.lit(i).alias("rule"), "failed", "total"))
        versions = []
        for i, (k, own) in keys.items():
            if own is not None:
                parent = self.rules[i].arg[0]
                now = _parent_version(parent)
                mine = counts.filter(F.col("key_set") == k.name)
                hit = mine.join(_parent_keys(parent, own, now).withColumn("hit", F.lit(True)), "key", "left")
                parts.append(hit.agg(F.expr("sum(IF(key IS NULL OR hit, 0, n)) AS failed"), F.expr("sum(n) AS total"))
                             .select(F.lit(i).alias("rule"), F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("total", F.lit(0)).alias("total")))
                moved = self._moved(i, k, own, batch_id, now)
                if moved is not None:
                    parts.append(moved.select(F.lit(i).alias("rule"), "failed", F.lit(0).alias("total")))
                if now is not None:
                    versions.append((i, now))
        if versions:
            self.versions.write(batch_id, spark.createDataFrame(versions, "rule bigint, version bigint"))
        found = functools.reduce(DataFrame.unionByName, parts).groupBy("rule").agg(F.sum("failed").alias("failed"), F.sum("total").alias("total"))
        result_rows(found, [rule_name(self.fqn, r) for r in self.rules]).withColumn("batch_id", F.lit(batch_id)) \
            .write.mode("overwrite").parquet(f"{self.sink}/batch_id={batch_id}")


def monitor(stream: DataFrame, table_fqn: str, rules: list[Rule], sink: str, trigger: dict | None = None,
            checkpoint: str | None = None, state: str | None = None):
    """Run the checks of ``rules`` on every arriving batch, keyed ones against all batches so far.

    A reference's parent is a DataFrame or a ``VersionedTable``.  State and
    checkpoint belong together: a restart takes up both.
    """
    spark = stream.sparkSession
    ck = checkpoint or shared_dir(spark, "monitor-ckpt")
    keyed = KeyedMonitor(spark, table_fqn, rules, sink, state or f"{ck}-state")
    return (stream.writeStream.foreachBatch(keyed.run).option("checkpointLocation", ck)
            .trigger(**(trigger or {"processingTime": POLL_INTERVAL})).start())


def monitor_totals(spark: SparkSession, sink: str) -> DataFrame:
    """Totals over all monitored batches per test: what batches add to a test's failures adds up."""
    r = spark.read.parquet(sink)
    return (r.groupBy("test_fqn", "table_fqn", "column", "test_name")
            .agg(F.sum("failed_rows").cast("bigint").alias("failed_rows"),
                 F.sum("total_rows").cast("bigint").alias("total_rows"),
                 F.count_distinct("batch_id").alias("batches"))
            .withColumn("status", F.when(F.col("failed_rows") > 0, "Failed").otherwise("Success")))


def windowed_null_rate(stream: DataFrame, column: str, ts: str, span: str = POLL_INTERVAL,
                       delay: str = "1 hour") -> DataFrame:
    """Null count and share of ``column`` per tumbling event-time window.
    Rows later than the watermark are dropped; state of closed windows is purged."""
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return (s.groupBy(F.window("_ts", span).alias("w"))
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(column).isNull()).alias("nulls")))


def run_null_rate(stream: DataFrame, column: str, ts: str, sink: str, span: str = POLL_INTERVAL,
                  delay: str = "1 hour", trigger: dict | None = None, checkpoint: str | None = None,
                  state_partitions: int | None = None):
    agg = windowed_null_rate(stream, column, ts, span, delay)
    return _run(agg, sink, "update", trigger or {"processingTime": POLL_INTERVAL}, checkpoint, state_partitions)


def null_rate_result(spark: SparkSession, sink: str) -> DataFrame:
    """Latest value of every window written in update mode (an aggregate per window)."""
    r = spark.read.parquet(sink)
    last = r.groupBy("w").agg(F.max_by(F.struct("rows", "nulls"), "batch_id").alias("v"))
    return last.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                       F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                       F.col("v.rows").alias("rows"), F.col("v.nulls").alias("nulls"),
                       pct(F.col("v.nulls"), F.col("v.rows")).alias("null_pct"))


# ---------------------------------------------------------------- limiter
def run_rate_limit(stream: DataFrame, sink: str, trigger: dict, checkpoint: str | None = None, state: str | None = None,
                   key: str = "key", ts: str = "ts", attempt_id: str = "attempt_id", ok: str = "ok",
                   max_n: int = MAX_FIXES_PER_HOUR, span_seconds: int = SPAN_SECONDS):
    """The limiter across micro-batches: each batch goes through the parallel batch form, from the anchor and count that
    the last batch with its key left.

    Attempts must arrive in time order per key across batches; those older than
    the key's anchor count as inside its window.  No task holds a key's batch:
    blocks of it are decided side by side.  The state is one row (anchor, count)
    per key, written under the batch's number.
    """
    spark = stream.sparkSession
    ck = checkpoint or shared_dir(spark, "limit-ckpt")
    kind = stream.schema[key].dataType.simpleString()
    kept = BatchState(spark, state or f"{ck}-state", f"key {kind}, anchor_us bigint, count bigint", ["key"], latest(["key"], ["anchor_us", "count"]))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        before = kept.before(batch_id, batch.select(F.col(key).alias("key"))).select("key", "anchor_us", "count")
        rate_limit(batch, key, ts, attempt_id, ok, max_n, span_seconds, state=before).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        kept.write(batch_id, limit_state(spark.read.parquet(f"{sink}/batch_id={batch_id}")))

    return stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", ck).trigger(**trigger).start()
