"""Substring de-duplication with prefix-partitioned suffix trees over words.

Suffixes start at words and matter down to a depth of ``window`` words, cut at
two depths (4 and ``window`` words) where the tree may have nodes; the first
edge is labelled by a hash of its words (32 bits), the node at full depth by one
of all words down to it (64 bits).

1. Each block sorts its suffixes and keeps one per path: the first, which has
   the smallest doc_id, as the block's documents are in order of doc_id.
2. A histogram of first edges (``CELLS`` cells, a fixed size) splits the
   suffixes into groups of about ``GROUP`` entries by prefixes of variable
   length: four words, and for cells over a group's size the whole depth.
3. Each group's subtree is built by sorting and common prefixes of neighbours;
   its internal nodes of full depth are the repeats, and each node's smallest
   doc_id decides.  A copy that a third of all documents hold is one entry per
   block here.
4. One bit per entry goes back to its block: whether the path also starts in a
   smaller doc_id.  The block marks the windows and their words.

Two different windows share a path with a chance of 2^-64 if they begin with the
same four words, and of 2^-96 otherwise: a beginning with a million
continuations errs with a chance of 3e-8, one with a billion of 3 percent.

Nulls and odd rows: a null text has no words; rows with one doc_id never remove
each other's words; a null doc_id counts as larger than all others and is kept
as null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekeeper.llm.blocks import (Block, Words, each_block, expand, ids_out, kept_bytes, mix, planes, run_hash,
                                    squeeze, unplanes, write_blocks)

WINDOW = 13
CELLS = 4096
GROUP = 1 << 21


def _paths(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each full window: its first word, the label of the first edge with half of the node's, and the other half."""
    at = w.whole_windows(window)
    if not at.size:
        return at, np.empty(0, np.uint64), np.empty(0, np.uint32)
    top = np.uint64(32)
    first, whole = run_hash(w.hash, max(1, window // 3))[at], run_hash(w.hash, window)[at]
    return at, (first >> top << top) | (whole >> top), whole.astype(np.uint32)


def _entries(block: Block, window: int):
    """The block's distinct paths in order: (words, window starts sorted by path, which are first of a path, paths)."""
    w = block.words()
    at, head, tail = _paths(w, window)
    order = np.lexsort((tail, head))      # stable: equal paths stay in order of documents
    at, head, tail = at[order], head[order], tail[order]
    new = np.ones(at.size, np.bool_)
    new[1:] = (np.diff(head) != 0) | (np.diff(tail) != 0)
    return w, at, new, head[new], tail[new]


def _cell(head: np.ndarray) -> np.ndarray:
    return (head >> np.uint64(52)).astype(np.int64)


def _histogram(block: Block, window: int) -> bytes:
    w = block.words()
    _, head, _ = _paths(w, window)
    return np.bincount(_cell(head), minlength=CELLS).astype("<u4").tobytes()


def _plan(blocks: DataFrame, group: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first group and into how many groups it is split by its whole depth."""
    def add(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for x in b.column("note"):
                total += np.frombuffer(x.as_buffer(), "<u4")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS)), pa.array(total)], ["cell", "n"])

    rows = blocks.select("note").mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CELLS, np.int64)
    for r in rows:
        n[r["cell"]] = r["n"]
    parts = np.maximum(1, -(-n // group))
    first, at, held = np.zeros(CELLS, np.int64), -1, group
    for c in range(CELLS):
        if held + n[c] > group or parts[c] > 1:
            at, held = at + 1, 0
        first[c] = at
        held += int(n[c])
        if parts[c] > 1:
            at, held = at + int(parts[c]) - 1, group
    return first, parts


def _groups(head: np.ndarray, tail: np.ndarray, first: np.ndarray, parts: np.ndarray) -> np.ndarray:
    cell = _cell(head)
    out = first[cell]
    split = np.flatnonzero(parts[cell] > 1)
    if split.size:
        whole = mix(head[split] ^ (tail[split].astype(np.uint64) << np.uint64(20)))
        out[split] += (whole % parts[cell[split]].astype(np.uint64)).astype(np.int64)
    return out


def _subtree(head: np.ndarray, tail: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which suffixes lie below an internal node of full depth that holds a smaller document.

    Neighbours in sorted order have a common prefix of 0 to 2 edges; the
    maximal runs with both in common are the deepest internal nodes.
    """
    order = np.lexsort((tail, head))
    h, t, d = head[order], tail[order], doc[order]
    node = np.ones(h.size, np.bool_)
    node[1:] = (np.diff(h) != 0) | (np.diff(t) != 0)
    start = np.flatnonzero(node)
    least = np.minimum.reduceat(d, start) if start.size else d
    out = np.empty(h.size, np.bool_)
    out[order] = least[np.cumsum(node) - 1] < d
    return out


def _repeats(blocks: DataFrame, window: int, plan) -> DataFrame:
    """Per block and group: one bit per entry, whether its path starts in a smaller doc_id elsewhere."""
    def send(batches):
        for _, _, number, block in each_block(batches):
            w, at, new, head, tail = _entries(block, window)
            g = _groups(head, tail, *plan.value)
            by = np.argsort(g, kind="stable")
            doc = w.doc[at[new]][by]
            head, tail, g = head[by], tail[by], g[by]
            cut = np.flatnonzero(np.diff(g, prepend=-1))
            ends = np.append(cut[1:], g.size)
            if cut.size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[cut]), pa.array(np.full(cut.size, number)),
                     pa.array([_pack(head[a:b], tail[a:b], block.ids, doc[a:b]) for a, b in zip(cut, ends)], pa.binary())],
                    ["part", "block", "entries"])

    def build(key, table):
        heads, tails, ids = zip(*(_unpack(x.as_buffer()) for x in table.column("entries")))
        flags = _subtree(np.concatenate(heads), np.concatenate(tails), np.concatenate(ids))
        parts = np.split(flags, np.cumsum([x.size for x in heads])[:-1])
        return pa.table({"block": table.column("block"), "part": pa.array([key[0].as_py()] * len(parts), pa.int64()),
                         "bits": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})

    return (blocks.select("block", "doc_id", "ends", "body")
            .mapInArrow(send, "part long, block long, entries binary")
            .groupBy("part").applyInArrow(build, "block long, part long, bits binary"))


def _pack(head: np.ndarray, tail: np.ndarray, ids: np.ndarray, doc: np.ndarray) -> bytes:
    """Sorted paths with their doc_ids: steps from path to path, the ids that occur, and one index into them per path."""
    seen, index = np.unique(doc, return_inverse=True)
    return squeeze(np.array([head.size, seen.size], "<u4").tobytes() + planes(np.diff(head, prepend=np.uint64(0)))
                   + planes(tail) + planes(np.diff(ids[seen], prepend=0)) + planes(index.astype("<u4")))


def _unpack(raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = expand(raw)
    n, docs = np.frombuffer(raw, "<u4", 2).tolist()
    tail = unplanes(raw, "<u4", n, 8 + 8 * n)
    ids = np.cumsum(unplanes(raw, "<i8", docs, 8 + 12 * n))
    return np.cumsum(unplanes(raw, "<u8", n, 8)), tail, ids[unplanes(raw, "<u4", n, 8 + 12 * n + 8 * docs)]


def _covered(w: Words, start: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(w.start.size + 1, np.int64)
    edge[start] += 1
    edge[start + window] -= 1
    return np.cumsum(edge[:-1]) > 0


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def substring_dedup(docs: DataFrame, window: int = WINDOW, group: int = GROUP, texts: bool = True) -> DataFrame:
    """Per document: n_words, n_removed, the sha256 of the kept words joined by one space, and that text.

    A word goes if a window that covers it also starts in a document with a
    smaller doc_id; all windows are judged on the input.  ``texts=False``
    leaves ``kept`` null.
    """
    blocks = write_blocks(docs, lambda b: _histogram(b, window))
    plan = docs.sparkSession.sparkContext.broadcast(_plan(blocks, group))   # two arrays of CELLS numbers
    bits = (_repeats(blocks, window, plan).groupBy("block")
            .agg(F.sort_array(F.collect_list(F.struct("part", "bits"))).alias("answers")))   # one per group of the block

    def finish(batches):
        for batch, i, _, block in each_block(batches):
            w, at, new, head, tail = _entries(block, window)
            answers = batch.column("answers")[i].as_py() or []
            keep = np.ones(w.start.size, np.bool_)
            if at.size:
                first = np.zeros(head.size, np.bool_)
                g = _groups(head, tail, *plan.value)
                by = np.argsort(g, kind="stable")
                size = np.unique(g, return_counts=True)[1]
                first[by] = np.concatenate([np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=n)
                                            for a, n in zip(answers, size.tolist(), strict=True)]).astype(np.bool_)
                path = np.cumsum(new) - 1
                own = w.doc[at]
                # the first of a path goes by its bit, others if their document's id is larger or by that bit
                later = block.ids[own] > block.ids[own[new]][path]
                keep = ~_covered(w, at[first[path] | later], window)
            n = block.count(w)
            removed = np.bincount(w.doc[~keep], minlength=n.size)
            out, a, b = kept_bytes(block, w, keep)
            raw = out.tobytes()
            runs = [raw[x:y] for x, y in zip(a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays(
                [ids_out(block.ids), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in runs]),
                 pa.array([x.decode() for x in runs] if texts else [None] * n.size, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return (blocks.select("block", "doc_id", "ends", "body").join(bits, "block", "left")
            .mapInArrow(finish, OUT))
