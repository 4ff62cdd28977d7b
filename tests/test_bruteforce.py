"""Parallel operators against plain-Python brute force on random small inputs.

Inputs are drawn with one hot key holding a large share of the rows, ties in
time, and cycles in lineage, to exercise the skew-splitting paths.
"""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablekeeper.operators import fixes, lineage
from tablekeeper.operators.ordered import running
from tablekeeper.operators.ratelimit import limit_state, rate_limit

SEEDS = [1, 2, 3]
BASE = dt.datetime(2024, 1, 1)


def _attempt_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(rnd.randint(40, 120)):
        key = 0 if rnd.random() < 0.4 else rnd.randint(1, 6)        # key 0 is hot
        sec = rnd.choice([rnd.randint(0, 6 * 3600), rnd.randint(0, 60) * 600])  # many exact ties
        rows.append((key, BASE + dt.timedelta(seconds=sec, microseconds=rnd.choice([0, 0, 5])), i,
                     rnd.random() < 0.7))
    return rows


def _fold(rows, max_n, span_s):
    out = {}
    by_key = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    for key, rs in by_key.items():
        rs.sort(key=lambda r: (r[1], r[2]))
        anchor, count = rs[0][1], 0
        for k, ts, i, ok in rs:
            if (ts - anchor).total_seconds() >= span_s:
                anchor, count = ts, 0
            allowed = count < max_n
            out[i] = (anchor, count, allowed)
            if allowed and ok:
                count += 1
    return out


@pytest.mark.parametrize("seed", SEEDS)
def test_rate_limit_equals_sequential_fold(spark, seed):
    rows = _attempt_rows(seed)
    max_n, span = random.Random(seed).choice([(1, 900), (2, 1800), (3, 3600)])
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, attempt_id long, ok boolean")
    got = {r["attempt_id"]: (r["window_start"], r["fixes_before"], r["allowed"])
           for r in rate_limit(df, max_n=max_n, span_seconds=span).collect()}
    assert got == _fold(rows, max_n, span)


@pytest.mark.parametrize("seed", SEEDS)
def test_running_equals_window(spark, seed):
    rows = _attempt_rows(seed)
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, attempt_id long, ok boolean")
    r = running(df, "key", ["ts", "attempt_id"],
                sums={"oks": F.col("ok").cast("bigint")}, seq_name="n")
    got = {x["attempt_id"]: (x["n"], x["oks"]) for x in r.collect()}
    want = {}
    by_key = {}
    for row in rows:
        by_key.setdefault(row[0], []).append(row)
    for rs in by_key.values():
        rs.sort(key=lambda x: (x[1], x[2]))
        oks = 0
        for n, (_, _, i, ok) in enumerate(rs, 1):
            oks += int(ok)
            want[i] = (n, oks)
    assert got == want


@pytest.mark.parametrize("seed", SEEDS)
def test_dedupe_equals_min_id_per_key(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, "a", "a", "a", "b", "c"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k string")
    for mode in ("keep", "group"):
        got = sorted(r["id"] for r in fixes.dedupe(df, ["k"], "id", mode).collect())
        mins = {}
        for i, k in rows:
            if k is None and mode == "keep":
                continue
            mins[k] = min(mins.get(k, i), i)
        want = sorted(i for i, k in rows if (k is None and mode == "keep") or mins.get(k) == i)
        assert got == want


@pytest.mark.parametrize("seed", SEEDS)
def test_trace_equals_bfs(spark, seed):
    rnd = random.Random(seed)
    edges = list({(rnd.randint(0, 15), rnd.randint(0, 15)) for _ in range(40)})
    roots = [0, 1, 2]
    depth = 3
    e = spark.createDataFrame(edges, "src long, dst long")
    r = spark.createDataFrame([(x,) for x in roots], "root long")
    got = {(x["root"], x["node"], x["depth"]) for x in lineage.trace(e, r, "down", depth).collect()}
    want = set()
    for root in roots:
        seen, frontier = {root: 0}, [root]
        for d in range(1, depth + 1):
            nxt = []
            for n in frontier:
                for s, t in edges:
                    if s == n and t not in seen:
                        seen[t] = d
                        nxt.append(t)
            frontier = nxt
        want |= {(root, n, d) for n, d in seen.items() if d > 0}
    assert got == want


@pytest.mark.parametrize("seed", [7, 8])
def test_rate_limit_sub_second_instants(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(150):
        key = 0 if rnd.random() < 0.5 else rnd.randint(1, 3)
        us = rnd.choice([rnd.randint(0, 3_000_000), rnd.randint(55_000_000, 65_000_000), 1_000_000])
        rows.append((key, BASE + dt.timedelta(microseconds=us), i, rnd.random() < 0.6))
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, attempt_id long, ok boolean")
    got = {r["attempt_id"]: (r["window_start"], r["fixes_before"], r["allowed"])
           for r in rate_limit(df, max_n=2, span_seconds=1).collect()}
    assert got == _fold(rows, 2, 1)


@pytest.fixture
def tiny_blocks(spark):
    """Blocks of a few attempts, more ranges than one task composes."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.shuffle.partitions": "45"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("span", [1, 40, 600, 100_000])
def test_rate_limit_across_blocks_and_groups(spark, tiny_blocks, span):
    rnd = random.Random(span)
    rows = [(rnd.choice([0, 0, 0, 1, 2, 3 + i]), BASE + dt.timedelta(seconds=rnd.choice([rnd.randrange(9000), 500])), i, rnd.random() < 0.6)
            for i in range(1100)]
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, attempt_id long, ok boolean").repartition(6)
    got = {r["attempt_id"]: (r["window_start"], r["fixes_before"], r["allowed"]) for r in rate_limit(df, max_n=2, span_seconds=span).collect()}
    assert got == _fold(rows, 2, span)


def test_rate_limit_goes_on_from_state(spark, tiny_blocks):
    """Attempts in three parts, each from what the part before left; the last one has attempts older than the anchor."""
    rnd = random.Random(5)
    at = lambda lo, hi: BASE + dt.timedelta(seconds=rnd.randrange(lo, hi))
    parts = [[(rnd.choice([0, 0, 1, 2]), at(lo, hi), 1000 * p + i, rnd.random() < 0.6) for i in range(150)]
             for p, (lo, hi) in enumerate([(0, 3000), (3000, 7000), (6000, 9000)])]
    want, state, got, kept = {}, {}, {}, None
    for part in parts:
        for key in {r[0] for r in part}:
            for _, ts, i, ok in sorted((r for r in part if r[0] == key), key=lambda r: (r[1], r[2])):
                anchor, count = state.get(key, (ts, 0))
                if (ts - anchor).total_seconds() >= 700:
                    anchor, count = ts, 0
                want[i] = (anchor, min(count, 3), count < 3)
                state[key] = (anchor, count + (ok and count < 3))
        df = spark.createDataFrame(part, "key long, ts timestamp_ntz, attempt_id long, ok boolean").repartition(4)
        out = rate_limit(df, max_n=3, span_seconds=700, state=kept).cache()
        got.update({r["attempt_id"]: (r["window_start"], r["fixes_before"], r["allowed"]) for r in out.collect()})
        left = {r["key"]: r for r in limit_state(out).collect()}
        kept = spark.createDataFrame([(k, int((a - BASE).total_seconds()) * 10 ** 6 + 1704067200 * 10 ** 6, n) for k, (a, n) in state.items()],
                                     "key long, anchor_us long, count long")
        assert {(r["key"], r["anchor_us"], r["count"]) for r in kept.collect() if r["key"] in left} == {tuple(r) for r in left.values()}
    assert got == want


@pytest.mark.parametrize("seed", [11, 12])
def test_exact_share_equals_md5_order(spark, seed):
    import hashlib
    from tablekeeper.operators.faults import exact_share_predicate, share_count
    rnd = random.Random(seed)
    keys = [rnd.randint(0, 400) for _ in range(700)] + [None] * 5      # repeats and NULL keys
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for share in (0.4, 0.13):
        got = {r["k"] for r in df.filter(exact_share_predicate(df, "k", share)).collect()}
        ordered = sorted((hashlib.md5(str(k).encode()).hexdigest(), k) for k in keys if k is not None)
        n = share_count(len(ordered), share)
        assert got == {k for _, k in ordered[:n]}
