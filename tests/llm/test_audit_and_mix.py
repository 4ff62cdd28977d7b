"""Filter audit and mixing: brute force, invariants and odd rows."""

import collections
import itertools
import random
import re

import pytest

from tablekeeper.llm.filter_audit import Lattice, filter_audit, interactions

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """(part, set of letters, doc_id) of each (doc_id, text, source)."""
    for d, text, source in rows:
        x = text or ""
        ws = WORD.findall(x)
        f = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", x)) > 2 * len(x),
             "D": bool(re.search(r"[#$%&*|]", x)),
             "E": d is not None and any(o is not None and o < d and (y or "") == x for o, y, _ in rows)}
        yield source or "", {k for k, v in f.items() if v}, d


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t in labels if t == 1 and d is not None}
    parts = collections.defaultdict(list)
    for part, f, d in fails(rows):
        parts[part].append((f, d))
    out, by_letter = [], collections.Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                gone = [bool(f & set(order[:step - 1])) for f, _ in docs]
                here = [d for (f, d), g in zip(docs, gone) if letter in f and not g]
                by_letter[part, letter] += len(here)
                out.append((part, "".join(order), step, letter, sum(not f & set(order[:step]) for f, _ in docs), len(here),
                            sum(letter in f and g for (f, _), g in zip(docs, gone)), sum(f == {letter} for f, _ in docs),
                            sum(d in good for d in here), sum(d in bad for d in here)))
    return sorted((*r, by_letter[r[0], r[3]]) for r in out)


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(2)
    word = lambda: rng.choice("ab cd ef gh").strip() + str(rng.randrange(500))
    rows = []
    for i in range(120):
        text = " ".join((word() if rng.random() < 0.6 else "the") for _ in range(rng.choice([3, 150, 199, 200, 260])))
        rows.append((i, text.upper() if rng.random() < 0.3 else text + ("#" if rng.random() < 0.3 else ""), rng.choice(["x", "y", None, ""])))
    rows += [(200 + i, rows[rng.randrange(20)][1], "x") for i in range(30)]           # copies
    rows += [(300, None, None), (301, "", "y"), (None, "", "y"), (None, rows[0][1], "x"), (302, " \n\t", None), (5, rows[5][1], "y"),
             (5, rows[5][1], "x"), (303, "É" * 98 + "AB", "z"), (304, "É" * 97 + "ABC", "z")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 310, 2)] + [(4, 1, 0), (4, 0, None), (None, 1, 1)]
    return rows, labels


def test_audit_against_brute_force(spark, audited):
    rows, labels = audited
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, part int, n int").repartition(5)
    got = filter_audit(docs, spark.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_audit_sums(spark, documents):
    """For each order, what is removed and what is left are all documents; Shapley sums to 120 times what any filter removes."""
    rows = filter_audit(documents, spark.createDataFrame([], LABELS)).collect()
    size = collections.Counter(r["source"] or "" for r in documents.select("source").collect())
    for part in size:
        mine = [r for r in rows if r["part"] == part]
        assert len(mine) == 600
        for order in {r["filter_order"] for r in mine}:
            steps = sorted((r for r in mine if r["filter_order"] == order), key=lambda r: r["step"])
            assert sum(r["removed"] for r in steps) + steps[-1]["kept"] == size[part]
        shapley = {r["filter"]: r["shapley"] for r in mine}
        left = next(r["kept"] for r in mine if r["step"] == 5)
        assert sum(shapley.values()) == 120 * (size[part] - left)


def test_audit_odd_tables(spark, clashing, nothing):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert filter_audit(nothing, labels).count() == 0
    assert filter_audit(clashing, labels).count() % 600 == 0


def test_lattice_counts_orders():
    assert Lattice(5).forward[31] == Lattice(5).backward[0] == 120
    some = Lattice(4, [(0, 1), (0, 2)])
    orders = [o for o in itertools.permutations(range(4)) if o.index(0) < o.index(1) and o.index(0) < o.index(2)]
    assert [tuple(f for _, f in o) for o in some.orders()] == orders
    for s, f in some.edges:
        assert some.through(s, f) == sum(set(o[:o.index(f)]) == {k for k in range(4) if s >> k & 1} for o in orders)
    with pytest.raises(ValueError):
        Lattice(2, [(0, 1), (1, 0)])


def test_orders_that_must_be_kept(spark):
    sets = spark.createDataFrame([("p", 3, 4, 1, 0), ("p", 1, 2, 0, 0), ("p", 0, 5, 0, 0)], "part string, failing int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): r for r in interactions(sets, "XY", [("Y", "X")]).collect()}
    assert set(got) == {("YX", 1), ("YX", 2)}
    assert (got["YX", 1]["removed"], got["YX", 2]["removed"], got["YX", 2]["redundant"], got["YX", 2]["shapley"]) == (4, 2, 4, 2)
