"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct ``shingle``-word runs.
Documents with equal sets form a class; only classes are compared, so a group
of copies of any size is one row.  Two classes are linked if their sets have
Jaccard similarity of at least ``percent`` / 100, counted on the whole sets.

1. Sketch: the ``K`` smallest hashes of a set.
2. Inverted lists: a class enters a list for each run of ``RUN`` neighbouring
   retained hashes; a sketch that holds its whole set is read as a ring.  Pairs
   of lists of at most ``SHORT`` classes give overlaps.  Two sketches of
   similarity 0.8 share about 30 lists; that they share fewer than
   ``MIN_OVERLAP`` has a chance below 1e-6, and for sets of at most K shingles
   that they share none is impossible.
3. The sketch of the union, which two sketches give exactly, estimates the
   similarity; pairs more than six standard errors too low go.
4. The rest is verified on the whole sets.

Longer lists are not paired.  A linked pair that meets in no short list meets
in long lists only, so both classes are in ``MIN_LONG`` or more of those (the
chance of fewer is below 1e-5 a pair); where one of the sets has K shingles or
less, and the other so at most K * 100 / percent, one shared list is all that is
sure, and one long list is enough.  Such classes, say near copies of one text or
texts that mostly consist of one passage, are gathered by long lists and
compared exactly: by prefix filtering on their rarest shingles in chunks of
about ``CHUNK`` shingles, pair of chunks by pair of chunks, and only links that
join two parts of a pair's graph come out.

Linked classes are joined to components by label propagation with pointer
jumping over written tables; no link or component reaches the driver.

Nulls and odd rows: a null or empty text, or one without words, has an empty
set and no link; rows of one doc_id count as one document; a null doc_id has no
link, a null component and is kept; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekeeper.llm.blocks import SPACES, Block, ids_out, if_few, iter_blocks, mix, run_hash, write_bucketed
from tablekeeper.session import materialize

K, RUN = 64, 3
SHORT, MIN_OVERLAP, MIN_LONG = 48, 3, 5
CHUNK = 1 << 19
PERCENT = 80


def shingle_sets(block: Block, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes of all documents one after another, first index of each document, sizes)."""
    w = block.words(SPACES, lower=True)
    n = block.count(w)
    at = w.whole_windows(shingle)
    doc, value = [w.doc[at]], [run_hash(w.hash, shingle)[at] if at.size else np.empty(0, np.uint64)]
    first = np.cumsum(n) - n
    for k in range(1, shingle):      # fewer words: the whole sequence is the shingle
        few = np.flatnonzero(n == k)
        if few.size:
            doc.append(few)
            value.append(run_hash(w.hash, k)[first[few]])
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(doc.size, np.bool_)
    new[1:] = (np.diff(doc) != 0) | (np.diff(value) != 0)
    doc, value = doc[new], value[new]
    size = np.bincount(doc, minlength=block.ids.size)
    return value, np.cumsum(size) - size, size


def _sums(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
    return total[first + size] - total[first]


def sketches(docs: DataFrame, shingle: int, k: int = K) -> DataFrame:
    """doc_id, n (size of the set), h1 and h2 (hash of the set), sketch (its k smallest hashes, little-endian)."""
    def run(batches):
        for block in iter_blocks(batches):
            value, first, size = shingle_sets(block, shingle)
            kept = np.minimum(size, k)
            yield pa.RecordBatch.from_arrays(
                [ids_out(block.ids), pa.array(size, pa.int64()), pa.array(_sums(mix(value), first, size).view(np.int64)),
                 pa.array(_sums(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first, size).view(np.int64)),
                 pa.array([value[a: a + n].tobytes() for a, n in zip(first.tolist(), kept.tolist())], pa.binary())],
                ["doc_id", "n", "h1", "h2", "sketch"])

    return _text_of(docs).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch binary")


def _text_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _runs(sketch: np.ndarray, n: int, k: int) -> np.ndarray:
    """Keys of the runs of RUN neighbouring retained hashes; none for sets too small for a link to another set."""
    if n <= RUN:
        return np.empty(0, np.uint64)
    return run_hash(np.concatenate([sketch, sketch[: RUN - 1]]) if n <= k else sketch, RUN)


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each is there."""
    pairs, times = np.unique(np.stack([a, b]), axis=1, return_counts=True)
    return pairs[0], pairs[1], times


def _overlaps(classes: DataFrame, k: int, parts: int) -> DataFrame:
    """Rows (a, b) with the number of short lists that a pair shares, and of long lists in which class b has leader a.

    A list's leader is its smallest class, so the lists of one large cluster
    have few leaders among them: a class comes out once a leader, not once a list.

    Each task sends at most SHORT + 1 classes of a key on; more are enough to
    call the list long.  The task itself names those it holds back.
    """
    def send(batches):
        for batch in batches:
            ids = batch.column("class").to_numpy()
            keys = [_runs(np.frombuffer(s.as_buffer(), "<u8"), n, k)
                    for s, n in zip(batch.column("sketch"), batch.column("n").to_pylist())]
            who = np.repeat(ids, [x.size for x in keys])
            key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            order = np.lexsort((who, key))
            key, who = key[order], who[order]
            new = np.ones(key.size, np.bool_)
            new[1:] = np.diff(key) != 0
            start = np.flatnonzero(new)
            nth = np.arange(key.size) - np.repeat(start, np.diff(np.append(start, key.size)))
            part = (mix(key) % np.uint64(parts)).astype(np.int64)
            sent = nth <= SHORT
            by = np.argsort(part[sent], kind="stable")
            p, kk, ww = part[sent][by], key[sent][by], who[sent][by]
            cut = np.flatnonzero(np.diff(p, prepend=-1))
            ends = np.append(cut[1:], p.size)
            lead = who[start][np.cumsum(new) - 1] if start.size else who
            lead, held, times = _counted(lead[~sent], who[~sent])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(p[cut], np.full(held.size, -1))),
                 pa.array([kk[a:b].tobytes() for a, b in zip(cut, ends)] + [None] * held.size, pa.binary()),
                 pa.array([ww[a:b].astype("<i8").tobytes() for a, b in zip(cut, ends)] + [None] * held.size, pa.binary()),
                 pa.array(np.append(np.zeros(cut.size, np.int64), lead)), pa.array(np.append(np.zeros(cut.size, np.int64), held)),
                 pa.array(np.append(np.zeros(cut.size, np.int64), times))],
                ["part", "keys", "classes", "leader", "class", "times"])

    def meet(key, table):
        keys = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in table.column("keys")])
        who = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in table.column("classes")])
        order = np.lexsort((who, keys))
        keys, who = keys[order], who[order]
        new = np.ones(keys.size, np.bool_)
        new[1:] = np.diff(keys) != 0
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, keys.size))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in np.unique(size[(size > 1) & (size <= SHORT)]).tolist():
            own = start[size == n]
            i, j = np.triu_indices(n, 1)
            a.append(who[own[:, None] + i].ravel())
            b.append(who[own[:, None] + j].ravel())
        a, b = np.concatenate(a), np.concatenate(b)
        apart = a != b
        a, b, times = _counted(a[apart], b[apart])
        long_ = np.repeat(size > SHORT, size)
        lead, of, lists = _counted(np.repeat(who[start], size)[long_], who[long_])
        return pa.table({"a": pa.array(np.append(a, lead)), "b": pa.array(np.append(b, of)), "times": pa.array(np.append(times, lists)),
                         "long": pa.array(np.append(np.zeros(a.size, np.bool_), np.ones(lead.size, np.bool_)))})

    sent = materialize(classes.select("class", "n", "sketch").mapInArrow(
        send, "part long, keys binary, classes binary, leader long, class long, times long"), "sketch-lists")
    met = (sent.where("part >= 0").select("part", "keys", "classes").groupBy("part")
           .applyInArrow(meet, "a long, b long, times long, long boolean"))
    held = sent.where("part < 0").select(F.col("leader").alias("a"), F.col("class").alias("b"), "times", F.lit(True).alias("long"))
    return materialize(met.unionAll(held), "sketch-overlaps")


def union_estimate(sa: np.ndarray, na: int, sb: np.ndarray, nb: int, k: int = K) -> tuple[float, int]:
    """Similarity from the bottom-k sketch of the union, and how many hashes it rests on."""
    union = np.union1d(sa, sb)
    if na > k or nb > k:
        union = union[: min(k if na > k else union.size, k if nb > k else union.size)]
    both = np.intersect1d(sa, sb, assume_unique=True)
    return (float(np.searchsorted(both, union[-1], side="right")) / union.size if union.size else 0.0), union.size


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose estimate is not more than six standard errors below the bound."""
    def run(batches):
        for batch in batches:
            keep = []
            for na, sa, nb, sb in zip(batch.column("na").to_pylist(), batch.column("sa"), batch.column("nb").to_pylist(),
                                      batch.column("sb")):
                if 100 * min(na, nb) < percent * max(na, nb):
                    keep.append(False)
                    continue
                j, m = union_estimate(np.frombuffer(sa.as_buffer(), "<u8"), na, np.frombuffer(sb.as_buffer(), "<u8"), nb, k)
                p = percent / 100
                keep.append(j >= p - 6 * (p * (1 - p) / max(1, m)) ** 0.5 if max(na, nb) > k else j >= p - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """class and set (sorted hashes) of the wanted documents' texts."""
    def run(batches):
        for block in iter_blocks(batches):
            value, first, size = shingle_sets(block, shingle)
            yield pa.RecordBatch.from_arrays(
                [ids_out(block.ids), pa.array([value[a: a + n].tobytes() for a, n in zip(first.tolist(), size.tolist())],
                                              pa.binary())], ["class", "set"])

    return _text_of(docs).join(wanted.select(F.col("class").alias("doc_id")), "doc_id", "left_semi").mapInArrow(
        run, "class long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs linked on their whole sets; a pair travels with one set, and a's set joins its pairs once."""
    rows = (pairs.join(sets.select(F.col("class").alias("b"), "set"), "b").select("a", "b", "set")
            .unionAll(pairs.select("a").distinct().join(sets.select(F.col("class").alias("a"), "set"), "a")
                      .select("a", F.lit(None).cast("long").alias("b"), "set")))

    def run(table):
        owns = [np.frombuffer(s.as_buffer(), "<u8") for s, b in zip(table.column("set"), table.column("b")) if b.as_py() is None]
        a, b = [], []
        for s, other in zip(table.column("set"), table.column("b").to_pylist()):
            if other is None:
                continue
            x = np.frombuffer(s.as_buffer(), "<u8")
            if any(_linked(own, x, percent) for own in owns):
                b.append(other)
                a.append(table.column("a")[0].as_py())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("a").applyInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(x.size, y.size) < percent * max(x.size, y.size):
        return False
    both = np.intersect1d(x, y, assume_unique=True).size
    return 100 * both >= percent * (x.size + y.size - both)


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = int(parent[i])
    return i


def link_group(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span the same components as all links between classes of a group.

    Classes are compared where they share one of their rarest shingles: of two
    sets with the wanted similarity, the first n - ceil(percent n / 100) + 1 in
    any fixed order have one in common.  Sets differ, and each is compared with
    larger ones and with those of its size, smallest first, so that the base of
    many short variants joins them before they meet each other.  ``side``:
    classes of side 0 were compared with each other elsewhere, and so were those
    of side 1, unless all are of one side.
    """
    size = np.array([s.size for s in sets])
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    _, value, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(size.size), size)
    order = np.lexsort((value, times[value], owner))           # each set from its rarest shingle on
    first = np.cumsum(size) - size
    nth = np.arange(flat.size) - first[owner]
    head = nth < (size - -(-percent * size // 100) + 1)[owner]
    ranked = value[order]
    hv, ho = ranked[head], owner[head]
    stride = int(size.max(initial=0)) + 1
    at = hv * stride + size[ho]                                 # by shingle, then by size
    by = np.argsort(at, kind="stable")
    at, ho = at[by], ho[by]
    of = owner[head]
    low = size + (100 * (size - 1) < percent * (size + 1))      # different sets of one size may be too small for a link
    high = np.minimum(100 * size // percent, stride - 1)
    begin = np.searchsorted(at, ranked[head] * stride + low[of])
    end = np.maximum(begin, np.searchsorted(at, ranked[head] * stride + high[of], "right"))
    cut = np.searchsorted(of, np.arange(size.size + 1))
    two, flag = bool(side.min(initial=0) != side.max(initial=0)), np.zeros(times.size, np.bool_)
    part, links = np.arange(size.size), []
    label = part.copy()
    for i in np.argsort(size, kind="stable").tolist():
        near = [ho[x:y] for x, y in zip(begin[cut[i]: cut[i + 1]].tolist(), end[cut[i]: cut[i + 1]].tolist()) if x < y]
        if not near:
            continue
        other = np.unique(np.concatenate(near))
        label_i = _find(part, i)
        other = other[label[other] != label_i]
        if two:
            other = other[side[other] != side[i]]
        if not other.size:
            continue
        own = value[first[i]: first[i] + size[i]]
        flag[own] = True
        n = size[other]
        start = np.cumsum(n) - n
        both = np.add.reduceat(flag[value[np.repeat(first[other] - start, n) + np.arange(int(n.sum()))]], start, dtype=np.int64)
        flag[own] = False
        linked = other[100 * both >= percent * (size[i] + n - both)]
        if not linked.size:
            continue
        for j in linked.tolist():
            x, y = _find(part, i), _find(part, j)
            if x != y:
                part[y] = x
                links.append((int(ids[i]), int(ids[j])))
        while True:                                             # flatten, so that label is the root
            up = part[part]
            if (up == part).all():
                break
            part = up
        label = part.copy()
    return links


def _gathered(long_: DataFrame, sets: DataFrame, size: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Links between classes that long lists gather."""
    together = components(long_.select("a", "b").distinct())
    member = materialize(together.select(F.col("node").alias("class"), F.col("component").alias("cluster")), "long-lists")
    sizes = (member.join(size, "class").groupBy("cluster").agg(F.sum("n").alias("total"))
             .select("cluster", F.ceil(F.col("total") / chunk).cast("int").alias("chunks")))
    dealt = member.join(sizes, "cluster").withColumn("i", F.expr("int(pmod(xxhash64(class), chunks))"))
    pairs = (dealt.select("class", "cluster", "i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
             .select("class", "cluster", F.least("i", "o").alias("p"), F.greatest("i", "o").alias("q"),
                     (F.col("i") > F.col("o")).cast("int").alias("side")))

    def run(table):
        got = link_group(table.column("class").to_numpy(), [np.frombuffer(s.as_buffer(), "<u8") for s in table.column("set")],
                         table.column("side").to_numpy(), percent)
        return pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([y for _, y in got], pa.int64())})

    return pairs.join(sets, "class").groupBy("cluster", "p", "q").applyInArrow(run, "a long, b long")


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """node and component (its smallest reachable node) of every node of a table of links (a, b).

    Hash-to-min with pointer jumping: each round a node takes the smallest
    label of its neighbours and of its label; ends when no label changes.
    Neighbours are gathered by partial aggregation, so a hub costs a row a task.
    """
    both = materialize(links.where("a <> b").select("a", "b").unionAll(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .distinct(), "links")
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                        .select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = (both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("m")))
        # a root whose members see a smaller label hooks on to it
        hooked = (label.join(near, "node").groupBy(F.col("component").alias("root")).agg(F.min("m").alias("h")))
        step = (label.join(near, "node").join(hooked, F.col("component") == F.col("root"), "left")
                .select("node", "component", F.least("component", "m", "h").alias("next")))
        up = step.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        new = materialize(step.join(up, "next", "left").select("node", F.col("component").alias("old"),
                                                               F.least("next", "jump").alias("component")), "labels")
        label = new.select("node", "component")
        if new.where("old <> component").limit(1).count() == 0:
            return label
    raise RuntimeError(f"components not settled after {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, k: int = K, chunk: int = CHUNK) -> DataFrame:
    """Per document: n_shingles, component_id (smallest doc_id reachable over links) and kept."""
    sk = materialize(sketches(docs, shingle, k), "sketches")
    classes = write_bucketed(sk.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "h1", "h2")
                             .agg(F.min("doc_id").alias("class"), F.min("sketch").alias("sketch")), "class", "classes")
    parts = max(1, classes.count() * k // (1 << 21))
    seen = _overlaps(classes, k, parts)
    size = classes.select(F.col("class"), "n")
    led = materialize(seen.where("long").groupBy("a", "b").agg(F.sum("times").alias("lists")), "long-list-leaders")
    often = (led.groupBy(F.col("b").alias("class")).agg(F.sum("lists").alias("lists")).join(size, "class")
             .where((F.col("lists") >= MIN_LONG) | (F.col("n") * percent <= 100 * k)).select("class"))
    often = materialize(often, "often")
    # a task's leader ties the classes that it held back to the list, whether or not it is compared itself
    ties = often.unionAll(led.select(F.col("a").alias("class"))).distinct()
    long_ = led.join(ties.withColumnRenamed("class", "b"), "b", "left_semi").select("a", "b")
    short = (seen.where("NOT long").groupBy("a", "b").agg(F.sum("times").alias("times")))
    small = (F.least("na", "nb") <= k)
    short = (short.join(size.withColumnRenamed("n", "na").withColumnRenamed("class", "a"), "a")
             .join(size.withColumnRenamed("n", "nb").withColumnRenamed("class", "b"), "b")
             .where((F.col("times") >= MIN_OVERLAP) | small)
             .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"))
    likely = materialize(_estimated(short, classes, k, percent), "likely-pairs")
    wanted = likely.select(F.col("a").alias("class")).unionAll(likely.select("b")).unionAll(often).distinct()
    sets = write_bucketed(_whole_sets(docs, if_few(wanted, "wanted"), shingle), "class", "whole-sets")
    links = _verified(likely, sets, percent).unionAll(_gathered(long_, sets, size, percent, chunk))
    found = components(materialize(links, "verified-links"))
    of_class = (classes.select("n", "h1", "h2", F.col("class"))
                .join(found, F.col("class") == F.col("node"), "left")
                .select(F.col("n").alias("cn"), F.col("h1").alias("c1"), F.col("h2").alias("c2"),
                        F.coalesce("component", "class").alias("component_id")))
    own = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    out = sk.select("doc_id", "n", "h1", "h2").join(
        of_class, own & (F.col("n") == F.col("cn")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents kept, one of each group, with all their columns; rows of one doc_id stay or go together."""
    gone = if_few(near_duplicates(docs, shingle, percent).where("NOT kept").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti")
