"""Benchmark decontamination with suffix arrays of the training text.

Each block of documents is a shard with a suffix array over its words.  Every
suffix of every benchmark item is binary-searched in every shard, all suffixes
at once: the range of shard suffixes that share its first d words is narrowed
word by word, which ends with the longest verbatim match and all its places.

A window is ``window`` consecutive words of an item; an item of fewer words,
but not none, is one window.  A document's word inside any occurrence of a
window is hit.  Documents with n_hit > 0 and ``share_inverse`` * n_hit >=
n_words are contaminated.

Documents never leave their task, so copies and hot sources cost nothing
extra.  The benchmark is the stated query set: up to ``BROADCAST_BYTES`` of
its text it is broadcast; beyond, it is cut into chunks of that size, and each
pair of shard and chunk is a row of work of its own.

Nulls and odd rows: a null text has no words; items without words or with a
null item_id match nothing; repeated item_ids count as one item; repeated
document rows come out once each; a null doc_id stays null.  An empty
benchmark hits nothing; no documents give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekeeper.llm.blocks import (NON_ALNUM, Block, Words, each_block, ids_out, if_few, iter_blocks, make_block,
                                    write_blocks)

WINDOW = 13
SHARE_INVERSE = 20
BROADCAST_BYTES = 32 << 20


@dataclass
class Items:
    """Benchmark items: word hashes one item after another, and each word's item, place and words left."""
    hash: np.ndarray
    item: np.ndarray
    at: np.ndarray
    left: np.ndarray
    ids: list


def make_items(rows: list[tuple[int, str]]) -> Items:
    ids = np.array([r[0] for r in rows], np.int64)
    block = make_block(ids, pa.array([r[1] for r in rows], pa.string()).cast(pa.large_binary()))
    w = block.words(NON_ALNUM, lower=True)
    n = block.count(w)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    at = np.arange(w.start.size) - first[w.doc]
    return Items(word_keys(w), w.doc, at, n[w.doc] - at, block.ids.tolist())


def word_keys(words: Words) -> np.ndarray:
    """Word hashes; 0 stands for the end of a document."""
    return np.maximum(words.hash, np.uint64(1))


def suffix_array(key: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` words or more, by rank doubling of those still tied.

    ``left``: words from each place to the end of its document; ends sort first.
    """
    sa = np.argsort(key, kind="stable")
    first = np.concatenate([[True], np.diff(key[sa]) != 0]) if sa.size else np.empty(0, np.bool_)
    rank = np.empty(sa.size, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(sa.size), 0)) + 1
    h = 1
    while h < depth:
        alone = first & np.append(first[1:], True)
        tied = np.flatnonzero(~alone)
        if not tied.size:
            break
        idx = sa[tied]
        own, nxt = rank[idx], np.zeros(idx.size, np.int64)
        inside = left[idx] > h
        nxt[inside] = rank[idx[inside] + h]
        order = np.lexsort((nxt, own))
        idx, own, nxt = idx[order], own[order], nxt[order]
        sa[tied] = idx
        new = np.concatenate([[True], (np.diff(own) != 0) | (np.diff(nxt) != 0)])
        first[tied] = new
        rank[idx] = tied[np.maximum.accumulate(np.where(new, np.arange(idx.size), 0))] + 1
        h *= 2
    return sa


def search(key: np.ndarray, left: np.ndarray, sa: np.ndarray, items: Items, window: int):
    """For every item suffix: longest match (words) with one range of the suffix array, and the range at window depth.

    Returns (depth, lo, hi, win_lo, win_hi); a window range is empty unless the whole window occurs.
    """
    q = items.hash.size
    need = np.minimum(window, np.where(items.at == 0, items.left, window))
    sorted_first = key[sa]
    lo = np.searchsorted(sorted_first, items.hash, "left")
    hi = np.searchsorted(sorted_first, items.hash, "right")
    depth = (hi > lo).astype(np.int64)
    win_lo, win_hi = np.zeros(q, np.int64), np.zeros(q, np.int64)
    alive = np.flatnonzero(hi > lo)
    d = 1
    while alive.size:
        done = alive[need[alive] == d]
        win_lo[done], win_hi[done] = lo[done], hi[done]
        alive = alive[items.left[alive] > d]
        if not alive.size:
            break
        word, a, b = items.hash[alive + d], lo[alive], hi[alive]

        def bound(upper: bool):
            x, y = a.copy(), b.copy()
            while True:
                open_ = np.flatnonzero(x < y)
                if not open_.size:
                    return x
                mid = (x[open_] + y[open_]) >> 1
                at = sa[mid]
                have = np.where(left[at] > d, key[np.minimum(at + d, key.size - 1)], np.uint64(0))
                right = have <= word[open_] if upper else have < word[open_]
                x[open_[right]] = mid[right] + 1
                y[open_[~right]] = mid[~right]

        new_lo, new_hi = bound(False), bound(True)
        on = new_hi > new_lo
        alive = alive[on]
        lo[alive], hi[alive] = new_lo[on], new_hi[on]
        d += 1
        depth[alive] = d
    return depth, lo, hi, win_lo, win_hi


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    n = hi - lo
    which = np.repeat(np.arange(lo.size), n)
    return np.arange(which.size) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


def _shard(block: Block, depth: int):
    w = block.words(NON_ALNUM, lower=True)
    n = block.count(w)
    key = word_keys(w)
    left = np.cumsum(n)[w.doc] - np.arange(w.start.size)
    return w, n, key, left, suffix_array(key, left, depth)


def _hits(block: Block, items: Items, window: int):
    """Hit flags of the block's words and distinct pairs (document index, item index)."""
    w, n, key, left, sa = _shard(block, max(window, int(items.left.max(initial=1))))
    _, _, _, lo, hi = search(key, left, sa, items, window)
    found = np.flatnonzero(hi > lo)
    size = np.minimum(window, items.left[found])
    mark = np.zeros(key.size + 1, np.int64)
    lo, hi, item = lo[found], hi[found], items.item[found]
    _, one = np.unique(np.stack([lo, size]), axis=1, return_index=True)   # equal windows have equal ranges
    k, which = _spread(lo[one], hi[one])
    np.add.at(mark, sa[k], 1)
    np.add.at(mark, sa[k] + size[one][which], -1)
    pairs = [np.empty(0, np.int64)]
    for part in np.array_split(np.arange(lo.size), max(1, int((hi - lo).sum()) >> 20)):
        k, which = _spread(lo[part], hi[part])
        pairs.append(np.unique(w.doc[sa[k]] * len(items.ids) + item[part][which]))
    pairs = np.unique(np.concatenate(pairs))
    return n, np.cumsum(mark[:-1]) > 0, w.doc, pairs


OUT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
       "item_ids array<long>")
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                        ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
                        ("item_ids", pa.list_(pa.int64()))])


def _rows(ids: np.ndarray, n: np.ndarray, hit: np.ndarray, of_doc: list[set], share_inverse: int) -> pa.RecordBatch:
    listed = [sorted(map(str, s)) for s in of_doc]
    return pa.RecordBatch.from_arrays(
        [ids_out(ids), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in listed], pa.int64()),
         pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]),
         pa.array((hit > 0) & (share_inverse * hit >= n)), pa.array([[int(y) for y in x] for x in listed],
                                                                    pa.list_(pa.int64()))], schema=_OUT_ARROW)


def _item_sets(n_docs: int, pairs: np.ndarray, ids: list) -> list[set]:
    out = [set() for _ in range(n_docs)]
    for p in pairs.tolist():
        out[p // len(ids)].add(ids[p % len(ids)])
    return out


def _collect_items(benchmark: DataFrame) -> Items:
    """Only for a benchmark within the checked bound."""
    return make_items([(r[0], r[1]) for r in benchmark.collect()])


def _clean(benchmark: DataFrame) -> DataFrame:
    return (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
            .where("item_id IS NOT NULL AND text IS NOT NULL"))


def _text_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share_inverse: int = SHARE_INVERSE,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, the items with occurring windows, and whether it is contaminated."""
    bench = _clean(benchmark)
    size = bench.select(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= broadcast_bytes:
        items = docs.sparkSession.sparkContext.broadcast(_collect_items(bench))

        def run(batches):
            for block in iter_blocks(batches):
                n, flags, doc, pairs = _hits(block, items.value, window)
                hit = np.bincount(doc[flags], minlength=n.size)
                yield _rows(block.ids, n, hit, _item_sets(n.size, pairs, items.value.ids), share_inverse)

        return _text_of(docs).mapInArrow(run, OUT)

    def chunk(batches):
        rows, held = [], 0
        for b in batches:
            for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.append(r)
                held += len(r[1])
                if held >= broadcast_bytes // 4:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make_items(rows))], pa.binary())], ["items"])
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make_items(rows))], pa.binary())], ["items"])

    def pair(batches):
        for batch, i, number, block in each_block(batches):
            items = pickle.loads(batch.column("items")[i].as_py())
            n, flags, doc, pairs = _hits(block, items, window)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([block.ids], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())),
                 pa.array([np.packbits(flags).tobytes()], pa.binary()),
                 pa.array([pickle.dumps((pairs // len(items.ids), [items.ids[p] for p in (pairs % len(items.ids)).tolist()]))],
                          pa.binary())], ["block", "doc_id", "n", "hit", "pairs"])

    def merge(table):
        ids = table.column("doc_id")[0].values.to_numpy(zero_copy_only=False)
        n = table.column("n")[0].values.to_numpy(zero_copy_only=False)
        flags, sets = np.zeros(int(n.sum()), np.bool_), [set() for _ in range(ids.size)]
        for i in range(table.num_rows):
            flags |= np.unpackbits(np.frombuffer(table.column("hit")[i].as_py(), np.uint8), count=flags.size).astype(np.bool_)
            for d, item in zip(*pickle.loads(table.column("pairs")[i].as_py())):
                sets[d].add(item)
        hit = np.bincount(np.repeat(np.arange(ids.size), n)[flags], minlength=ids.size)
        return pa.Table.from_batches([_rows(ids, n, hit, sets, share_inverse)])

    chunks = bench.mapInArrow(chunk, "items binary")
    return (write_blocks(docs).drop("note").crossJoin(chunks)
            .mapInArrow(pair, "block long, doc_id array<long>, n array<long>, hit binary, pairs binary")
            .groupBy("block").applyInArrow(merge, OUT))


def longest_matches(docs: DataFrame, benchmark: DataFrame, min_words: int = WINDOW) -> DataFrame:
    """Longest verbatim matches of at least min_words words: one row per item suffix, shard and place.

    A match that starts one word earlier in the item and in the document
    contains this one, so only left-maximal matches are listed.  The benchmark
    must be within ``BROADCAST_BYTES``.
    """
    bench = _clean(benchmark)
    if (bench.select(F.sum(F.octet_length("text"))).first()[0] or 0) > BROADCAST_BYTES:
        raise ValueError("longest_matches takes a benchmark of at most BROADCAST_BYTES; pass it in parts")
    items = docs.sparkSession.sparkContext.broadcast(_collect_items(bench))

    def run(batches):
        it = items.value
        for block in iter_blocks(batches):
            w, n, key, left, sa = _shard(block, max(min_words, int(it.left.max(initial=1))))
            depth, lo, hi, _, _ = search(key, left, sa, it, min_words)
            found = np.flatnonzero(depth >= min_words)
            k, which = _spread(lo[found], hi[found])
            at, q = sa[k], found[which]
            first = np.cumsum(n) - n
            place = at - first[w.doc[at]]
            inner = (place > 0) & (it.at[q] > 0)
            inner[inner] = key[at[inner] - 1] == it.hash[q[inner] - 1]
            at, q, place = at[~inner], q[~inner], place[~inner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(it.ids, np.int64)[it.item[q]]), pa.array(it.at[q]), pa.array(depth[q]),
                 ids_out(block.ids[w.doc[at]]), pa.array(place)], ["item_id", "item_word", "words", "doc_id", "doc_word"])

    return _text_of(docs).mapInArrow(run, "item_id long, item_word long, words long, doc_id long, doc_word long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                        share_inverse: int = SHARE_INVERSE) -> DataFrame:
    """The documents that are not contaminated, with all their columns; a null doc_id stays."""
    bad = contamination(docs, benchmark, window, share_inverse).where("contaminated AND doc_id IS NOT NULL").select("doc_id")
    return docs.join(if_few(bad.distinct(), "contaminated"), "doc_id", "left_anti")
