"""Audit of how filters interact: what each removes in every order, by counting paths through the lattice of subsets.

A state of the lattice is the set of filters applied so far, an edge applies
one more.  Documents reach it only as counts: every document is one of the
2^k sets of filters that it fails, so a part of the table (its rows of one
source) is at most 2^k rows.  On the edge (S, f) a document that fails the set
m is removed if m holds f and no filter of S; it is redundant there if m holds
f and some filter of S.

The counts forward (orders that reach a state from the empty set) and backward
(orders that leave it to the full set) come from one sweep of the lattice each;
an edge lies in forward(S) * backward(S with f) orders, which weights what it
removes for the Shapley sums, and the steps of every order are read from the
same edges.  ``before`` may demand that some filters come before others: paths
that break it are counted nowhere, and only orders that keep it are listed.

At scale: the texts are read once, into a written table of one narrow row a
document.  Equal texts meet as hashes: the smallest doc_id of each hash is an
aggregate that a task combines before it sends, and comes back by (hash,
doc_id), so a text that a third of all documents share is spread like any
other; rows without doc_id are spread by a salt in the join with the labels.
The lattice has 2^k k / 2 edges whatever the data.

Nulls and odd rows: null texts are empty, null sources the empty string; a row
without doc_id has no smaller doc_id and no label; rows of equal doc_id and
text are both first; several labels of a doc_id count as good or toxic if any
is; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablekeeper.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
#: rows without doc_id are spread over so many keys in the join with the labels
SALT = 4096


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides by itself: A to D."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n_words, n_upper = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n_words < 200, "B": F.size(F.array_distinct(words)) * 100 < n_words * 50,
            "C": n_upper * 100 > F.length(text) * 2, "D": text.rlike(r"[#$%&*|]")}


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, copy (hash of the text) and own (bits of the filters A to D that it fails), written as a table."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"))
    own = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(F.col("text")).values())), F.lit(0))
    return materialize(read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("copy"), own.alias("own")), "filter-audit")


def failing_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failing (bits of A to E), n, good, toxic: documents by the set of filters that they fail."""
    rows = judged(docs)
    first = rows.where("doc_id IS NOT NULL").groupBy("copy").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["copy", "doc_id"], "left")
    copied = F.col("doc_id").isNotNull() & F.col("first").isNull()
    rows = (rows.select("doc_id", "part", (F.col("own") + F.when(copied, 16).otherwise(0)).alias("failing"),
                        F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("copy"), F.lit(SALT))).otherwise(0).alias("salt"))
            .groupBy("doc_id", "part", "failing", "salt").agg(F.count(F.lit(1)).alias("n")))
    told = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                 F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")).withColumn("salt", F.lit(0).cast("long")))
    rows = rows.join(told, ["doc_id", "salt"], "left")
    return rows.groupBy("part", "failing").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("toxic"))


class Lattice:
    """Subsets of k filters as bits, with the counts of orders that reach and leave each."""

    def __init__(self, k: int, before: Sequence[tuple[int, int]] = ()):
        self.k, self.full = k, (1 << k) - 1
        needs = [sum(1 << a for a, b in set(before) if b == f) for f in range(k)]
        self.edges = [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1 and needs[f] & ~s == 0]
        self.forward, self.backward = [0] * (1 << k), [0] * (1 << k)
        self.forward[0] = self.backward[self.full] = 1
        for s, f in self.edges:                    # smaller states first: all edges into s have been walked
            self.forward[s | 1 << f] += self.forward[s]
        for s, f in reversed(self.edges):
            self.backward[s] += self.backward[s | 1 << f]
        if not self.forward[self.full]:
            raise ValueError("no order keeps all of `before`")

    def through(self, s: int, f: int) -> int:
        """Orders that apply f just after the filters of s."""
        return self.forward[s] * self.backward[s | 1 << f]

    def orders(self):
        """Every order, as its edges."""
        after: dict[int, list[int]] = {}
        for s, f in self.edges:
            after.setdefault(s, []).append(f)

        def walk(s, path):
            if s == self.full:
                yield path
            for f in after.get(s, ()):
                yield from walk(s | 1 << f, [*path, (s, f)])
        return walk(0, [])


def _edge_counts(sets: DataFrame, lattice: Lattice) -> DataFrame:
    """part, state, filter and the counts of that edge; a row of every edge for every part."""
    table = [(m, s, f, lattice.through(s, f), m & (s | 1 << f) == 0, bool(m >> f & 1) and not m & s,
              bool(m >> f & 1) and bool(m & s), m == 1 << f) for m in range(1 << lattice.k) for s, f in lattice.edges]
    spark = sets.sparkSession
    edges = spark.createDataFrame(table, "failing int, state int, filter int, orders long, stays boolean, goes boolean, "
                                         "went boolean, alone boolean")
    total = lambda c, n: F.sum(F.when(F.col(c), F.col(n)).otherwise(0))
    return (sets.join(F.broadcast(edges), "failing").groupBy("part", "state", "filter", "orders")
            .agg(total("stays", "n").alias("kept"), total("goes", "n").alias("removed"), total("went", "n").alias("redundant"),
                 total("alone", "n").alias("unique_fails"), total("goes", "good").alias("good_lost"), total("goes", "toxic").alias("toxic_lost")))


def interactions(sets: DataFrame, names: str = "ABCDE", before: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Per part, order and step: part, filter_order, step, filter and the step's counts.

    ``sets`` has part, failing, n, good, toxic; bit i of failing is filter ``names[i]``.
    shapley is what the step's filter removes, summed over all orders.
    """
    lattice = Lattice(len(names), [(names.index(a), names.index(b)) for a, b in before])
    counts = _edge_counts(sets, lattice)
    shapley = (counts.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
               .withColumnsRenamed({"part": "_part", "filter": "_filter"}))
    spark: SparkSession = sets.sparkSession
    steps = spark.createDataFrame([("".join(names[f] for _, f in order), step, s, f) for order in lattice.orders()
                                   for step, (s, f) in enumerate(order, 1)], "filter_order string, step int, state int, filter int")
    out = counts.join(shapley, (F.col("part") == F.col("_part")) & (F.col("filter") == F.col("_filter")))
    letter = F.substring(F.lit(names), F.col("filter") + 1, F.lit(1))
    return (out.join(F.broadcast(steps), ["state", "filter"])
            .select("part", "filter_order", "step", letter.alias("filter"),
                    *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]))


def filter_audit(docs: DataFrame, labels: DataFrame, before: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The audit of the filters A to E over the documents, by source."""
    return interactions(failing_sets(docs, labels), "ABCDE", before)
