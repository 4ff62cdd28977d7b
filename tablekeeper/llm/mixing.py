"""Mixing sources to target weights by the cube method.

Every source has a target of words.  A document of a source of target t and
size s should be there t / s times: the whole part of that is taken of each of
its documents, the fraction p is the probability of one more.  Which documents
get it is a balanced sample: all start at p, and a vector of probabilities is
moved, in the null-space of the constraints (the source's words and its number
of documents), until one document after another reaches 0 or 1.  No move
changes the totals.

The flight goes over three documents at a time, the fewest that leave a move
for two constraints, in blocks of at most about ``BLOCK`` documents of a
source.  The few documents that a block leaves undecided meet again with those of
the source's other blocks, until a source is one block.  That last block first
puts ``LANDING`` documents aside, the largest and some of all sizes, flies the
others to two at most, drops the constraint on documents and moves on for words
alone, and lands by trying all ways to decide what is left, for the least error
in words, then in documents.  (A flight hardly moves a document far larger than
the two beside it, so large ones would be left to the end; among documents of
all sizes some way meets the words nearly always.)  Up to the landing every
document's expected share is kept; the landing, of at most 15 documents a
source, goes for the totals instead.

Targets: the words of all documents are shared by the sources' weights; a
target stops at ``most`` times its source's size, and what is above is shared
again by weight among the others until none is above.

At scale: texts are read once, for their sizes and hashes.  A hot source is dealt
to blocks by a hash of its documents.  Rows that are alike in source, doc_id
and text are one unit: equal sizes can be moved against each other without any
change of the totals, so all of a unit's copies but one are decided at once.  A
source's place among all sources comes from ranges of the sorted sources.  Every
random choice is a hash of the documents in it, so reruns agree whatever the
partitions.

Nulls and odd rows: null texts have size 0; null sources are a source of their
own, the last; a null doc_id is an id like others; sources without words have
target 0 and give nothing; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablekeeper.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
#: documents of a block, documents put aside for the landing, and the largest ones among these
BLOCK, LANDING, LARGEST = 4096, 14, 5
EPS = 1e-9


def units(docs: DataFrame) -> DataFrame:
    """Rows alike in source, doc_id and text: source, doc_id, copy (hash of the text), size in words, rows; a written table."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("copy"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    return materialize(each.groupBy("source", "doc_id", "copy", "size").agg(F.count(F.lit(1)).alias("rows")), "mixing-units")


def placed(sources: DataFrame) -> DataFrame:
    """The sources with their place in order of code points, null last, from 0."""
    ranges = materialize(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
                         .withColumns({"_id": F.monotonically_increasing_id()}), "mixing-sources")
    ranges = ranges.withColumn("_range", F.shiftright("_id", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)     # one row a range
    first = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_from")).select(
        F.col("_range"), "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranges.join(first, "_range").withColumn("place", F.col("_before") + F.col("_id") - F.col("_from")).select(*sources.columns, "place")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, documents, target and times (target over size) of each source."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = materialize(placed(sources).withColumn("weight", weight), "mixing-weights")
    limit = F.col("source_size") * most
    level = 0.0                    # words a weight; it only rises, and each round puts more sources at their limit
    while True:
        at_limit = limit <= F.col("weight") * F.lit(level)
        total, fixed, free = s.agg(F.sum("source_size"), F.sum(F.when(at_limit, limit)), F.sum(F.when(~at_limit, F.col("weight")))).first()
        share = ((total or 0) - (fixed or 0)) / free if free else level
        if share <= level:
            break
        level = share
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(float(level)))
    return s.withColumn("target", target).select(
        "source", "source_size", "documents", "target",
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("times"))


# ------------------------------------------------------------------ flight and landing
def chance(*of: bytes) -> float:
    """A number in [0, 1) from the documents that it decides."""
    return int.from_bytes(hashlib.blake2b(b"".join(of), digest_size=7).digest(), "little") / (1 << 56)


def _move(p: list[float], u: list[float], toss: float) -> list[float]:
    """p moved along u or against it to the first bound; both ways have their chance, so that no expectation changes."""
    there = min(((1 - x) / d if d > 0 else x / -d) for x, d in zip(p, u) if abs(d) > EPS)
    back = min((x / d if d > 0 else (1 - x) / -d) for x, d in zip(p, u) if abs(d) > EPS)
    step = there if toss * (there + back) < back else -back
    moved = [x + step * d for x, d in zip(p, u)]
    return [0.0 if x < EPS else 1.0 if x > 1 - EPS else x for x in moved]


def _null_vector(sizes: list[int]) -> list[float] | None:
    """A move of documents that keeps their words and, for three, their number."""
    if len(sizes) == 3:
        a, b, c = sizes
        if a == b == c:
            return [1.0, -1.0, 0.0]
        widest = max(abs(b - c), abs(c - a), abs(a - b))
        return [(b - c) / widest, (c - a) / widest, (a - b) / widest]
    a, b = sizes
    if a == b:
        return [1.0, -1.0]
    return [1.0, -a / b] if b >= a else [-b / a, 1.0]


def fly(size: list[int], key: list[bytes], p: list[float], order: list[int], width: int = 3) -> list[int]:
    """Moves p in place until fewer than ``width`` documents of ``order`` are undecided; returns those."""
    held: list[int] = []
    for i in order:
        if 0 < p[i] < 1:
            held.append(i)
        while len(held) == width:
            u = _null_vector([size[j] for j in held])
            for j, x in zip(held, _move([p[j] for j in held], u, chance(*[key[j] for j in held]))):
                p[j] = x
            held = [j for j in held if 0 < p[j] < 1]
    return held


def land(size: list[int], p: list[float], left: list[int]) -> None:
    """Decides the documents left: least error in words, then in documents, then the first way."""
    if not left:
        return
    ways = np.arange(1 << len(left))
    words, count = np.zeros(len(ways)), np.zeros(len(ways))
    for bit, i in enumerate(left):
        taken = ways >> bit & 1
        words += taken * size[i]
        count += taken
    off = np.abs(words - sum(p[i] * size[i] for i in left)).round(6), np.abs(count - sum(p[i] for i in left)).round(6)
    best = int(np.lexsort((ways, off[1], off[0]))[0])
    for bit, i in enumerate(left):
        p[i] = float(best >> bit & 1)


def decide(size: list[int], key: list[bytes], p: list[float], last: bool) -> None:
    """One block, in place: decided but for two documents at most, or wholly if it is the ``last`` of its source."""
    order = sorted(range(len(p)), key=lambda i: (hashlib.blake2b(key[i], digest_size=8).digest(), key[i]))
    if not last:
        fly(size, key, p, order)
        return
    undecided = sorted((i for i in order if 0 < p[i] < 1), key=lambda i: -size[i])
    some, n = LANDING - LARGEST, max(0, len(undecided) - LARGEST)
    places = {*range(LARGEST), *(LARGEST + k * n // some for k in range(some))} if n > some else range(len(undecided))
    aside = [undecided[k] for k in places if k < len(undecided)]
    flown = [i for i in order if 0 < p[i] < 1 and i not in set(aside)]
    land(size, p, fly(size, key, p, fly(size, key, p, flown), width=2) + aside)


FLOWN = "source string, doc_id long, copy binary, size long, p double"


def _keys(rows: dict) -> list[bytes]:
    return [struct.pack("<qB", d or 0, d is None) + c for d, c in zip(rows["doc_id"], rows["copy"])]


def _flown(table: pa.Table) -> pa.Table:
    last = table.column("blocks")[0].as_py() <= 1
    rows = table.select(["source", "doc_id", "copy", "size", "p"]).to_pydict()
    decide(rows["size"], _keys(rows), rows["p"], last)
    return pa.table(rows, pa.schema([("source", pa.string()), ("doc_id", pa.int64()), ("copy", pa.binary()), ("size", pa.int64()), ("p", pa.float64())]))


def flown(undecided: DataFrame) -> DataFrame:
    """Units (source, doc_id, copy, size, p) with every p moved to 0 or 1.

    In each round a source of one block is decided wholly, any other keeps two undecided units a block.
    """
    done = None
    while True:
        per_source = materialize(undecided.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "mixing-blocks")
        more = (per_source.agg(F.max("blocks")).first()[0] or 0) > 1
        dealt = undecided.join(per_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "copy"), "blocks"))
        moved = dealt.groupBy("source", "block").applyInArrow(_flown, FLOWN)
        if more:
            moved = materialize(moved, "mixing-flight")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        decided = moved.where(~open_)
        done = decided if done is None else done.unionByName(decided)
        if not more:
            return done
        undecided = moved.where(open_)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per unit (rows alike in source, doc_id and text): source, doc_id, copy, size, rows, copies (of all its rows together),
    source_size, target."""
    u = units(docs)
    s = materialize(targets(u.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("documents")),
                            weights, most), "mixing-targets")
    each = u.join(s.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor("times")
    share = (F.col("times") - whole) * F.col("rows")                 # of all rows of the unit, beyond the whole part
    sure = F.floor(share + EPS)
    p = F.when(share - sure > EPS, share - sure).otherwise(0.0)
    each = each.select("source", "doc_id", "copy", "size", "rows", "source_size", "target",
                       (whole * F.col("rows") + sure).alias("sure"), p.alias("p"))
    each = materialize(each, "mixing-shares")
    drawn = (flown(each.where("p > 0").select("source", "doc_id", "copy", "size", "p")).where("p = 1")
             .select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("copy").alias("_c")))
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("copy") == F.col("_c"))
    return each.join(drawn, same, "left").select(
        "source", "doc_id", "copy", "size", "rows", (F.col("sure") + F.when(F.col("_c").isNotNull(), 1).otherwise(0)).alias("copies"),
        "source_size", "target")


def by_row(mixed: DataFrame) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, copies, taken (words)."""
    rows = mixed.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    copies = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("row") < F.col("copies") % F.col("rows"), 1).otherwise(0)
    return (rows.withColumn("n", copies.cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", F.col("n").alias("copies"), (F.col("n") * F.col("size")).alias("taken")))


def mixture(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: rows of the documents (one of each unit's), as often as they are taken."""
    taken = (mixed.where("copies > 0").select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("copy").alias("_c"), F.col("copies").alias("_n")))
    text = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    one = (docs.withColumns({"_copy": text, "_id": F.col("doc_id").cast("long")}).groupBy("source", "_id", "_copy")
           .agg(F.first(F.struct(*docs.columns)).alias("_row")))
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_copy") == F.col("_c"))
    return one.join(taken, same).select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))), "_row").select("_row.*")
