"""Mixing: targets against their definition, invariants of flight and landing, reruns, odd rows."""

import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tablekeeper.llm import mixing as M
from tablekeeper.llm.queries import QUERIES

WORD = re.compile(M.WORD)


def shared_out(sizes, weights=(1, 2, 3), most=3):
    """Targets by the definition: share by weight, cut at the limit, share the excess among those below."""
    total, target = sum(sizes), [0.0] * len(sizes)
    w = [weights[i % 3] for i in range(len(sizes))]
    below, rest = set(range(len(sizes))), float(total)
    while rest > 1e-9 and below:
        share = {i: rest * w[i] / sum(w[j] for j in below) for i in below}
        rest = 0.0
        for i in list(below):
            target[i] += share[i]
            if target[i] > most * sizes[i]:
                rest += target[i] - most * sizes[i]
                target[i] = float(most * sizes[i])
                below.discard(i)
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets_by_definition(spark, seed):
    rng = random.Random(seed)
    names = sorted({"".join(rng.choices("aZé漢😀￿", k=3)) for _ in range(rng.choice([1, 4, 30]))}) + [None] * (seed % 2)
    sizes = [rng.choice([0, 1, 10, 10, 5000, 10 ** rng.randrange(7)]) for _ in names]
    df = spark.createDataFrame(list(zip(names, sizes, [1] * len(names))), "source string, source_size long, documents long").repartition(3)
    got = {r["source"]: r["target"] for r in M.targets(df).collect()}
    assert [got[n] for n in names] == pytest.approx(shared_out(sizes), rel=1e-9)


def test_flight_keeps_totals_and_leaves_two():
    rng = random.Random(3)
    for n in (1, 2, 3, 50, 400):
        size = [rng.choice([0, 1, 7, 7, 300, 20000]) for _ in range(n)]
        key, share = [bytes([i % 256, i // 256]) for i in range(n)], rng.random()
        p = [share] * n
        left = M.fly(size, key, p, list(range(n)))
        assert len(left) <= 2 and all(x in (0.0, 1.0) for i, x in enumerate(p) if i not in left)
        assert sum(a * b for a, b in zip(p, size)) == pytest.approx(share * sum(size), abs=1e-3)
        assert sum(p) == pytest.approx(share * n, abs=1e-4)


def test_flight_keeps_expectations():
    """Each document's share over many flights, as the hashes of other keys give other flights."""
    size, taken, runs = [3, 10, 4, 4, 900, 25, 0, 61], [0.0] * 8, 3000
    for run in range(runs):
        p = [0.3] * 8
        M.fly(size, [run.to_bytes(4, "little") + bytes([i]) for i in range(8)], p, list(range(8)))
        taken = [a + b for a, b in zip(taken, p)]
    assert [t / runs for t in taken] == pytest.approx([0.3] * 8, abs=0.04)


def test_landing_is_the_best_of_all():
    rng = random.Random(8)
    for _ in range(20):
        size, p = [rng.randrange(1, 900) for _ in range(9)], [rng.random() for _ in range(9)]
        want = sum(a * b for a, b in zip(size, p))
        least = min(abs(sum(a * b for a, b in zip(size, way)) - want) for way in itertools.product((0, 1), repeat=9))
        M.land(size, p, list(range(9)))
        assert set(p) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(size, p)) - want) == pytest.approx(least, abs=1e-5)


def mixed_rows(spark, docs, tmp_path, name="documents"):
    docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return QUERIES["op12_source_mixing"](spark, f"{tmp_path}/{name}").collect()


def test_query_over_many_documents(spark, tmp_path):
    """A source of several blocks, one of a few documents, one at its limit, one without words; and the same rows dealt otherwise."""
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 20, 60])), "hot") for i in range(9000)]
    rows += [(10000 + i, "x y z " * rng.randrange(1, 90), "few") for i in range(40)]
    rows += [(20000 + i, "a b " * 3, "none") for i in range(9)] + [(30000 + i, " \n", "void") for i in range(5)] + [(40000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed_rows(spark, docs.repartition(5), tmp_path)
    size = {d: len(WORD.findall(t or "")) for d, t, _ in rows}
    source = {d: s for d, _, s in rows}
    total, taken, n, copies = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for d in size:
        total[source[d]] += size[d]
        n[source[d]] += 1
    names = sorted(s for s in total if s is not None) + [None]
    target = dict(zip(names, shared_out([total[s] for s in names])))
    assert len(got) == len(rows) and len({r["doc_id"] for r in got}) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["target"] == pytest.approx(target[s], abs=1e-6)
        times = target[s] / total[s] if total[s] else 0
        assert r["taken"] in {int(times + k) * r["size"] for k in (-1e-9, 1e-9, 1)} and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        copies[s] += r["taken"] // r["size"] if r["size"] else 0
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 + target[s] / 10000
        assert s == "void" or s is None or abs(copies[s] - n[s] * target[s] / total[s]) <= 10
    again = mixed_rows(spark, docs.orderBy(F.rand(1)).repartition(11), tmp_path, "again")
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_repeated_rows_are_taken_evenly(spark, tmp_path):
    rows = [(1, "a b c", "x")] * 900 + [(2, "a b c", "x"), (3, "q", "y"), (None, "a", "x"), (None, "a", "x"), (None, "b", "y")]
    got = mixed_rows(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), tmp_path)
    assert len(got) == len(rows)
    ones = [r["taken"] // 3 for r in got if r["doc_id"] == 1]
    assert len(ones) == 900 and max(ones) - min(ones) <= 1
    assert abs(sum(r["taken"] for r in got if r["source_size"] > 100) - next(r["target"] for r in got if r["doc_id"] == 1)) <= 3


def test_mixture_holds_what_is_taken(spark, documents):
    mixed = M.mix(documents)
    out = M.mixture(documents, mixed)
    assert out.columns == documents.columns
    words = lambda r: len(WORD.findall(r["text"] or ""))
    want = collections.Counter()
    for r in M.by_row(mixed).collect():
        want[r["doc_id"]] += r["taken"]
    got = collections.Counter()
    for r in out.collect():
        got[r["doc_id"]] += words(r)
    assert +got == +want


def test_odd_tables(spark, clashing, nothing):
    assert M.by_row(M.mix(nothing)).count() == 0
    assert M.by_row(M.mix(clashing)).count() == clashing.count()
