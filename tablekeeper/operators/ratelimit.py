"""Fix-rate limiter over whole attempt tables.

Semantics per key, attempts in (ts, attempt_id) order, state (anchor, count):
* the anchor starts at the key's first attempt;
* an attempt at least ``span`` seconds after the anchor moves the anchor to
  itself and zeroes the count - whether or not it then succeeds;
* an attempt is blocked when count >= max_n; an allowed, successful attempt
  adds one to the count.

NULLs: no attempt is lost.  A NULL key is a key of its own; a NULL ``ok`` counts
as not successful; an attempt without a time lies in no window, so it is not
allowed, starts none, and comes out with NULL ``window_start`` and
``fixes_before``.

So the attempts of a key split into windows [a_i, a_{i+1}) where a_{i+1} is the
first attempt at or after a_i + span, and an attempt is allowed iff fewer than
max_n successful ones precede it in its window.  The chain of anchors is a fold
over all attempts of a key; it is computed in blocks:

1. attempts are sorted by (key, time, id) over ranges and cut into blocks of
   consecutive attempts of one key (at most one Arrow batch), written once.
   Most keys lie inside one block and are decided there;
2. a block of a key that goes on has a map: whatever anchor enters, the first
   attempt at or after anchor + span becomes one and the chain goes on to the
   end of the block.  The map lists, per first attempt, the anchor and count
   that leave; neighbours with the same result are one entry;
3. maps of ``GROUP`` neighbouring ranges are composed to one map, for all groups
   side by side; then one pass over the groups of a key gives each group the
   anchor and count that enter it;
4. with these, every block is decided, group by group.

The number of jobs is fixed: neither the time span nor the length of a chain
changes it.  ``state`` (key, anchor_us, count) carries on from earlier attempts,
as the streaming form does; attempts older than the anchor then count as inside
its window.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablekeeper.session import materialize

MAX_FIXES_PER_HOUR = 10    # fixed values: the reference's limiter defaults
SPAN_SECONDS = 3600
GROUP = 32                 # ranges whose maps are composed by one task

OUT_COLUMNS = ["key", "attempt_id", "ts", "ok", "window_start", "fixes_before", "allowed", "counted"]
NO_ANCHOR = -(1 << 61)     # a span after it lies before all times


def micros(df: DataFrame, ts: str):
    """Microseconds since the epoch, independent of the session time zone for
    wall-clock (timestamp_ntz) columns; instants (timestamp) use their UTC value."""
    c = F.col(ts)
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        # calendar arithmetic only: days since the epoch plus the time of day
        # (timestamp_diff / casts to timestamp would go through the session zone)
        return (F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000
                + F.hour(c).cast("bigint") * 3_600_000_000 + F.minute(c).cast("bigint") * 60_000_000
                + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint"))
    return F.unix_micros(c.cast("timestamp"))


# ------------------------------------------------------------------ inside a block
def exit_map(t: np.ndarray, ok: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(upto, leave, held) of sorted attempts: where the first attempt at or after anchor + span lies at or before
    ``upto`` (and after the entry before), the anchor ``leave`` and its count ``held`` leave the block."""
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    u = t[first]
    after = np.searchsorted(u, u + span)
    end = np.where(after < len(u), after, np.arange(len(u)))
    while True:                                   # doubling: each round follows the chain twice as far
        further = end[end]
        if np.array_equal(further, end):
            break
        end = further
    oks = np.r_[0, np.cumsum(ok)]
    last = np.r_[end[:-1] != end[1:], True]
    return u[last], u[end[last]], oks[-1] - oks[first[end[last]]]


def decide(t: np.ndarray, ok: np.ndarray, span: int, anchor: int, count: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(anchor of each attempt, successful attempts before it in its window, anchor and count that leave)."""
    times, oks = t.tolist(), np.r_[0, np.cumsum(ok)]
    starts, i = [], bisect_left(times, anchor + span)
    while i < len(times):
        starts.append(i)
        i = bisect_left(times, times[i] + span, i + 1)
    begun = np.array([0, *starts])
    window = np.searchsorted(begun[1:], np.arange(len(t)), side="right")
    anchors = np.r_[anchor, t[begun[1:]]]
    base = np.r_[-count, oks[begun[1:]]]
    return anchors[window], oks[:-1] - base[window], int(anchors[-1]), int(oks[-1] - base[-1])


def _starts(v: pa.Array) -> np.ndarray:
    """Where a new key starts in sorted keys; NULLs, and NaNs, are one key each."""
    a, b = v.slice(1), v.slice(0, len(v) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(v.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return np.flatnonzero(np.r_[True, ~np.asarray(same, dtype=bool)])


def _times(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    ok = pc.fill_null(rows.field("ok"), False)
    return rows.field("t").to_numpy(zero_copy_only=False), ok.to_numpy(zero_copy_only=False)


# ------------------------------------------------------------------ blocks, maps, groups
def _cut(schema: pa.Schema, span: int, prune: bool):
    """Attempts sorted by key, time and id as blocks.  ``prune``: whatever enters is older than the block, so entries of its
    map more than a span after its first attempt are never met."""
    def exits(t, ok):
        m = exit_map(t, ok, span)
        return tuple(x[:np.searchsorted(m[0], t[0] + span) + 1] for x in m) if prune else m

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key")
            rows = pa.StructArray.from_arrays([batch.column(c) for c in ("attempt_id", "ts", "t", "ok")], ["attempt_id", "ts", "t", "ok"])
            t, ok = _times(rows)
            start = _starts(key.field(0))
            n = len(start)
            bounds = np.r_[start, len(t)]
            # what stands at an end of the batch may go on in the next one; anything else is a whole key
            maps = {i: exits(t[bounds[i]:bounds[i + 1]], ok[bounds[i]:bounds[i + 1]]) for i in {0, n - 1}}
            oks = np.r_[0, np.cumsum(ok)]
            column = lambda j: pa.array([maps[i][j] if i in maps else [] for i in range(n)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(start)), pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(number, number + n), pa.int64()),
                 pa.array([i not in maps for i in range(n)]), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows),
                 pa.array(t[start], pa.int64()), column(0), column(1), column(2), pa.array(oks[bounds[1:]] - oks[start], pa.int64())], schema=schema)
            number += n
    return cut


def _grouped(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[bool, pa.RecordBatch, int]]:
    """(whether another group begins, batch, row) of sorted rows; ``by`` names the group's columns."""
    last = None
    for batch in batches:
        told = list(zip(*[batch.column(c).to_pylist() for c in by]))
        for i, at in enumerate(told):
            at = repr(at)
            yield at != last, batch, i
            last = at


def _map(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    read = lambda c: batch.column(c)[i].values.to_numpy()
    return read("upto"), read("leave"), read("held"), batch.column("oks")[i].as_py()


def _through(anchor: np.ndarray, count: np.ndarray, m, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and counts after a map."""
    upto, leave, held, oks = m
    i = np.searchsorted(upto, anchor + span)
    hit = i < len(upto)
    i = np.minimum(i, len(upto) - 1)
    return np.where(hit, leave[i], anchor), np.where(hit, held[i], count + oks)


def _compose(schema: pa.Schema, span: int, prune: bool):
    """The maps of each (key, group) as one."""
    def out(key, group, upto, leave, held, oks):
        last = np.r_[(leave[:-1] != leave[1:]) | (held[:-1] != held[1:]), True]
        lists = [pa.array([x[last]], pa.list_(pa.int64())) for x in (upto, leave, held)]
        return pa.RecordBatch.from_arrays([key, pa.array([group], pa.int32()), *lists, pa.array([oks], pa.int64())], schema=schema)

    def compose(batches):
        now = first = None
        for new, batch, i in _grouped(batches, "key", "group"):
            m = _map(batch, i)
            if new:
                if now:
                    yield out(*now)
                now = (batch.column("key").slice(i, 1), batch.column("group")[i].as_py(), *m)
                first = batch.column("first")[i].as_py()
                continue
            key, group, upto, leave, held, oks = now
            leave, held = _through(leave, held, m, span)
            beyond = m[0] > upto[-1]             # entered before the group, first met in this block
            if prune and upto[-1] >= first + span:
                beyond[:] = False
            now = (key, group, np.r_[upto, m[0][beyond]], np.r_[leave, m[1][beyond]], np.r_[held, m[2][beyond]], oks + m[3])
        if now:
            yield out(*now)
    return compose


def _enter(schema: pa.Schema, span: int):
    """What enters each group of a key, in one pass over the groups' maps."""
    def enter(batches):
        anchor = count = None
        for new, batch, i in _grouped(batches, "key"):
            if new:
                anchor, count = np.array([batch.column("anchor_us")[i].as_py()]), np.array([batch.column("count")[i].as_py()])
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, 1), batch.column("group").slice(i, 1),
                                              pa.array(anchor, pa.int64()), pa.array(count, pa.int64())], schema=schema)
            anchor, count = _through(anchor, count, _map(batch, i), span)
    return enter


def _decided(schema: pa.Schema, span: int):
    """The attempts of blocks with the anchor and count of each; a block of the same key and group goes on from the one before."""
    def run(batches):
        last = anchor = count = None
        for batch in batches:
            told = [repr(x) for x in zip(batch.column("key").to_pylist(), batch.column("group").to_pylist())]
            start_at, start_n = batch.column("anchor_us").to_pylist(), batch.column("count").to_pylist()
            column = batch.column("rows")
            rows = column.flatten()
            t, ok = _times(rows)
            bounds = np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy())]
            at, before = [], []
            for i, group in enumerate(told):
                if group != last:
                    last, anchor, count = group, start_at[i], start_n[i]
                here = slice(bounds[i], bounds[i + 1])
                x, n, anchor, count = decide(t[here], ok[here], span, anchor, count)
                at.append(x)
                before.append(n)
            if at:
                keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(told)), np.diff(bounds))))
                yield pa.RecordBatch.from_arrays([keys, *[rows.field(c) for c in ("attempt_id", "ts", "t", "ok")],
                                                  pa.array(np.concatenate(at), pa.int64()), pa.array(np.concatenate(before), pa.int64())], schema=schema)
    return run


def _schemas(att: DataFrame) -> dict[str, T.StructType]:
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    lists = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("upto", "leave", "held")]
    key, attempt = att.schema["key"], [att.schema[c] for c in ("attempt_id", "ts", "t", "ok")]
    group = T.StructField("group", T.IntegerType())
    return {"block": T.StructType([key, T.StructField("part", T.IntegerType()), *longs("number"), T.StructField("whole", T.BooleanType()),
                                   T.StructField("rows", T.ArrayType(T.StructType(attempt))), *longs("first"), *lists, *longs("oks")]),
            "group": T.StructType([key, group, *lists, *longs("oks")]),
            "enter": T.StructType([key, group, *longs("anchor_us", "count")]),
            "decided": T.StructType([key, *attempt, *longs("anchor_us", "before")])}


def _decisions(att: DataFrame, span: int, state: DataFrame | None) -> DataFrame:
    """key, attempt_id, ts, t, ok, anchor_us, before of attempts (key struct, attempt_id, ts, t, ok), all timed."""
    schema = _schemas(att)
    arrow = {k: to_arrow_schema(v) for k, v in schema.items()}
    blocks = materialize(att.repartitionByRange("key", "t", "attempt_id").sortWithinPartitions("key", "t", "attempt_id")
                         .mapInArrow(_cut(arrow["block"], span, prune=state is None), schema["block"]), "limit-blocks")
    begin = [F.lit(NO_ANCHOR).alias("anchor_us"), F.lit(0).cast("bigint").alias("count")]
    if state is None:
        blocks = blocks.select("*", *begin)
    else:
        seeds = state.select(F.struct(F.col("key").cast(att.schema["key"].dataType[0].dataType).alias("v")).alias("key"),
                             F.col("anchor_us").alias("_a"), F.col("count").alias("_n"))
        blocks = blocks.join(seeds, "key", "left").select(
            *[c for c in blocks.columns], F.coalesce("_a", F.lit(NO_ANCHOR)).alias("anchor_us"), F.coalesce("_n", F.lit(0)).alias("count"))
    blocks = blocks.withColumn("group", F.floor(F.col("part") / GROUP).cast("int"))
    decided = lambda b: b.select("key", "group", "rows", "anchor_us", "count").mapInArrow(_decided(arrow["decided"], span), schema["decided"])
    here = decided(blocks.filter("whole"))
    on = blocks.filter("NOT whole")
    maps = (on.select("key", "group", "part", "number", "first", "upto", "leave", "held", "oks").repartition("key", "group")
            .sortWithinPartitions("key", "group", "part", "number").mapInArrow(_compose(arrow["group"], span, prune=state is None), schema["group"]))
    seeds = on.groupBy("key").agg(F.first("anchor_us").alias("anchor_us"), F.first("count").alias("count"))
    enter = (maps.join(seeds, "key").repartition("key").sortWithinPartitions("key", "group")
             .mapInArrow(_enter(arrow["enter"], span), schema["enter"]))
    entered = (on.drop("anchor_us", "count").join(enter, ["key", "group"]).repartition("key", "group")
               .sortWithinPartitions("key", "group", "part", "number"))
    return here.unionByName(decided(entered))


def rate_limit(attempts: DataFrame, key: str = "key", ts: str = "ts", attempt_id: str = "attempt_id",
               ok: str = "ok", max_n: int = MAX_FIXES_PER_HOUR, span_seconds: int = SPAN_SECONDS,
               state: DataFrame | None = None) -> DataFrame:
    """Per attempt: window start, successful fixes before it in the window,
    allowed (not blocked) and counted (allowed and successful).

    ``state`` (key, anchor_us, count; one row a key) is what earlier attempts left."""
    # the key travels in a struct, which is never NULL, so that a NULL key joins like any other
    every = attempts.select(F.struct(F.col(key).alias("v")).alias("key"), F.col(ts).alias("ts"), micros(attempts, ts).alias("t"),
                            F.col(attempt_id).alias("attempt_id"), F.col(ok).cast("boolean").alias("ok"))
    untimed = every.filter(F.col("t").isNull()).select(
        "key.v", "attempt_id", "ts", "ok", F.col("ts").alias("window_start"), F.lit(None).cast("bigint").alias("fixes_before"),
        F.lit(False).alias("allowed"), F.lit(False).alias("counted")).withColumnRenamed("v", "key")
    timed = every.filter(F.col("t").isNotNull()).select("key", "attempt_id", "ts", "t", "ok")
    r = _decisions(timed, int(span_seconds) * 1_000_000, state)
    allowed = F.col("before") < max_n
    out = r.select(
        F.col("key.v").alias("key"), "attempt_id", "ts", "ok", F.timestamp_add("MICROSECOND", F.col("anchor_us") - F.col("t"), "ts").alias("window_start"),
        F.least("before", F.lit(max_n)).cast("bigint").alias("fixes_before"), allowed.alias("allowed"),
        (allowed & F.coalesce("ok", F.lit(False))).alias("counted"))
    return out.unionByName(untimed)


def limit_state(decisions: DataFrame, ts: str = "ts") -> DataFrame:
    """What decisions leave for the attempts after them: key, anchor_us, count, one row a key with a timed attempt."""
    d = decisions.filter(F.col("window_start").isNotNull())
    d = d.select("key", micros(d, "window_start").alias("anchor_us"), (F.col("fixes_before") + F.col("counted").cast("bigint")).alias("count"))
    return d.groupBy("key").agg(F.max(F.struct("anchor_us", "count")).alias("s")).select("key", "s.anchor_us", "s.count")
