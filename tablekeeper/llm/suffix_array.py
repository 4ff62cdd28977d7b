"""Suffix-array de-duplication of byte strings.

A byte goes if a ``LENGTH``-byte string covers it that also starts earlier, in
a smaller doc_id or at an earlier place of the same document.

1. Segments.  Every window of ``LENGTH`` bytes has a key: the smallest hash of
   its ``GRAM``-byte grams.  Neighbouring windows with one key form a segment.
   Equal windows have equal keys, so they meet if segments are dealt by key.
   Equal segments of a block are sent once.
2. Keys alone (40 bits of them) are counted first: a key that one block holds,
   once, has no repeat, and its segment stays at home.
3. The other segments are dealt into shards of about ``SHARD`` bytes.  A shard's
   suffix array is made by induced sorting: suffixes are classified as
   smaller (S) or larger (L) than their successors; the leftmost-S substrings
   are sorted by inducing L from them and S from L, and named; names that
   still tie are ranked over the shorter string of names; from the sorted
   leftmost-S suffixes all others are induced in one pass each way.  Both
   passes go bucket by bucket, all suffixes of a bucket at once.
4. Permuted common prefixes: each window is compared, in text order, with its
   predecessor in the array, up to ``LENGTH`` bytes.  In each run of equal
   windows all but the first in order of documents have an earlier start.
5. One bit per window goes back to its block, which marks the bytes.

Order needs only the first ``LENGTH`` bytes, so the names are ranked over that
depth and not beyond.

Nulls and odd rows: a null text is empty; a null doc_id counts as larger than
all others and stays null; rows with one doc_id count as documents that follow
each other; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablekeeper.llm.blocks import Block, each_block, expand, ids_out, mix, planes, span_hash, squeeze, unplanes, write_blocks
from tablekeeper.llm.decontaminate import suffix_array as rank_names
from tablekeeper.llm.meeting import KEY_BITS, answers_by_block, cuts, shared_bits, shared_keys
from tablekeeper.session import materialize

LENGTH, GRAM = 100, 32
BLOCK_BYTES = 1 << 20
SHARD = 2 << 20


# ---- induced sorting -------------------------------------------------------------------------------------------

def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; the last symbol is the only smallest."""
    n = t.size
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    step[-1] = 1
    decides = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(decides[::-1])[::-1]
    return step[nxt] > 0


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes from leftmost-S suffixes in a given order: L from left to right, then S from right to left."""
    first = [[] for _ in range(alphabet)]       # leftmost-S suffixes by symbol
    order = np.argsort(t[lms], kind="stable")
    sorted_ = lms[order]
    cut = np.searchsorted(t[sorted_], np.arange(alphabet + 1))
    for c in np.unique(t[lms]).tolist():
        first[c] = sorted_[cut[c]: cut[c + 1]]
    large: list = [[] for _ in range(alphabet)]

    def push(out: list, at: np.ndarray, want_small: bool, here: int) -> np.ndarray:
        """Predecessors of the wanted type to the ends of their buckets; those of this bucket come back."""
        p = at[at > 0] - 1
        p = p[small[p] == want_small]
        sym = t[p]
        o = np.argsort(sym, kind="stable")
        p, sym = p[o], sym[o]
        edge = np.flatnonzero(np.diff(sym, prepend=-1)) if sym.size else []
        own = p[:0]
        for a, b in zip(edge, [*edge[1:], sym.size]):
            out[sym[a]].append(p[a:b])
            if sym[a] == here:
                own = p[a:b]
        return own

    empty = np.empty(0, lms.dtype)
    for c in range(alphabet):
        wave = np.concatenate(large[c]) if large[c] else empty
        while wave.size:
            wave = push(large, wave, False, c)
        if len(first[c]):
            push(large, first[c], False, c)
    lower: list = [[] for _ in range(alphabet)]
    out: list = [None] * alphabet
    for c in range(alphabet - 1, -1, -1):
        wave = np.concatenate(lower[c]) if lower[c] else empty
        while wave.size:
            wave = push(lower, wave, True, c)
        l_part = np.concatenate(large[c]) if large[c] else empty
        s_part = np.concatenate(lower[c])[::-1] if lower[c] else empty
        if l_part.size:
            push(lower, l_part[::-1], True, c)
        out[c] = (l_part, s_part)
    out[t[-1]] = (empty, np.array([t.size - 1], lms.dtype))
    return np.concatenate([x for pair in out for x in pair])


def induced_sort(t: np.ndarray, alphabet: int, depth: int) -> np.ndarray:
    """Suffix array of t (its last symbol smallest and unique), in order of the first ``depth`` symbols at least."""
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if lms.size < 2:
        return _induce(t, small, lms, alphabet)
    order = _induce(t, small, lms, alphabet)
    is_lms = np.zeros(t.size, np.bool_)
    is_lms[lms] = True
    sorted_ = order[is_lms[order]]
    nth = np.empty(t.size, np.int32)
    nth[lms] = np.arange(lms.size)
    length = np.append(np.diff(lms) + 1, 1)             # up to and with the next one's first symbol
    raw = np.ascontiguousarray(t.astype("<u2")).view(np.uint8)
    label = span_hash(raw, 2 * lms.astype(np.int64), 2 * length.astype(np.int64))[nth[sorted_]]
    new = np.ones(sorted_.size, np.bool_)
    new[1:] = (np.diff(label) != 0) | (np.diff(length[nth[sorted_]]) != 0)
    name = np.empty(lms.size, np.uint64)
    name[nth[sorted_]] = np.cumsum(new).astype(np.uint64)
    if not new.all():
        sorted_ = lms[rank_names(name, np.arange(lms.size, 0, -1), depth)]
    return _induce(t, small, sorted_, alphabet)


# ---- segments --------------------------------------------------------------------------------------------------

def _sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over each n neighbours."""
    have, out = 1, x
    while 2 * have <= n:
        out = least(out[:-have], out[have:])
        have *= 2
    return least(out[: x.size - n + 1], out[n - have:]) if n > have else out


def _minima(block: Block, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the block's grams, the least of each window, and which windows lie inside one document."""
    body = block.body
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eight = np.ndarray(body.size + 1, np.dtype("<u8"), padded, strides=(1,))
    odd, n = np.uint64(0x9E3779B97F4A7C15), body.size - gram + 1
    h = eight[:n] * odd
    h ^= eight[gram - 8: gram - 8 + n]
    h = mix(h)
    if gram > 16:                                      # the middle: bytes 8 to gram - 8
        inner = eight[8: 8 + n] * odd
        inner ^= eight[gram - 16: gram - 16 + n]
        inner = mix(inner)
        inner *= odd
        h ^= inner
        del inner
        h = mix(h)
    least = _sliding(h, length - gram + 1, np.minimum)
    ok = np.zeros(body.size + 1, np.int8)
    has = block.end - block.start >= length
    ok[block.start[has]] += 1
    ok[block.end[has] - length + 1] -= 1
    return h, least, np.cumsum(ok[: least.size], dtype=np.int8) > 0


def _begins(least: np.ndarray, ok: np.ndarray) -> np.ndarray:
    new = ok.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
    return new


def block_keys(block: Block, length: int, gram: int) -> np.ndarray:
    """The short keys of the block's segments, as ``Segments.keys`` has them, without what only the segments need."""
    if block.body.size <= length:
        return np.empty(0, np.uint64)
    _, least, ok = _minima(block, length, gram)
    return np.unique(least[_begins(least, ok)] >> np.uint64(64 - KEY_BITS))


class Segments:
    """The block's segments: first window, windows, key, document; and which must be looked at at all."""

    def __init__(self, block: Block, length: int, gram: int):
        body, grams = block.body, length - gram + 1
        self.length = length
        self.start = self.count = self.doc = np.empty(0, np.int64)
        self.key, self.twice = np.empty(0, np.uint64), np.empty(0, np.bool_)
        if body.size <= length:
            pass
        else:
            h, least, ok = _minima(block, length, gram)
            new = _begins(least, ok)
            last = ok.copy()
            last[:-1] &= new[1:] | ~ok[1:]
            self.start = np.flatnonzero(new)
            self.count = np.flatnonzero(last) - self.start + 1
            self.key = least[self.start]
            self.doc = np.searchsorted(block.end, self.start, side="right")
            del ok, new, last
            # segments that hold one gram twice may repeat within themselves
            most = _sliding(least, grams, np.maximum) if least.size >= grams else np.empty(0, np.uint64)
            inner = h[grams - 1: grams - 1 + most.size]
            at = np.concatenate([np.arange(min(grams - 1, h.size)), np.flatnonzero(inner == most) + grams - 1,
                                 np.arange(max(grams - 1, grams - 1 + most.size), h.size)])
            del least, most, inner
            by = at[np.argsort(h[at], kind="stable")]
            same = np.flatnonzero(h[by[1:]] == h[by[:-1]])
            a, b = by[same], by[same + 1]
            del h, at, by, same
            lo = np.searchsorted(self.start + self.count + grams - 2, b, "left")
            hi = np.searchsorted(self.start, a, "right")
            mark = np.zeros(self.start.size + 1, np.int64)
            np.add.at(mark, lo[hi > lo], 1)
            np.add.at(mark, hi[hi > lo], -1)
            self.twice = np.cumsum(mark[:-1]) > 0
        self.bytes = self.count + length - 1
        whole = span_hash(body, self.start, self.bytes) if self.start.size else self.key
        order = np.lexsort((self.start, whole, self.key))
        k, w = self.key[order], whole[order]
        copy = np.zeros(order.size, np.bool_)
        copy[1:] = (k[1:] == k[:-1]) & (w[1:] == w[:-1])
        self.copy = np.empty(order.size, np.bool_)
        self.copy[order] = copy                        # an equal segment stands earlier in the block
        short = self.short
        seen, which, times = np.unique(short[~self.copy], return_inverse=True, return_counts=True)
        self.keys = seen                               # distinct short keys, in order
        self.home = np.zeros(seen.size, np.bool_)      # looked at even if no other block has the key
        self.home[times > 1] = True
        self.home[np.searchsorted(seen, short[self.twice & ~self.copy])] = True

    @property
    def short(self) -> np.ndarray:
        return self.key >> np.uint64(64 - KEY_BITS)

    def wanted(self, shared: np.ndarray) -> np.ndarray:
        """Segments to send, given for each distinct key whether another block has it."""
        use = shared | self.home
        return np.flatnonzero(~self.copy & use[np.searchsorted(self.keys, self.short)]) if self.keys.size else self.start


def _sent(seg: Segments, shared: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments to send by part, and their parts."""
    own = seg.wanted(shared)
    part = (mix(seg.short[own]) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    return own[by], part[by]


def earlier_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For texts in order of documents, flags of the windows that also start earlier."""
    flags = [np.zeros(max(0, len(x) - length + 1), np.bool_) for x in texts]
    seen: dict[bytes, int] = {}
    distinct = []
    for i, x in enumerate(texts):
        if x in seen:
            flags[i][:] = True
        else:
            seen[x] = i
            distinct.append(i)
    size = np.array([len(texts[i]) + 1 for i in distinct], np.int64)
    end = np.cumsum(size)
    t = np.ones(int(end[-1]) + 1, np.uint16)            # 1 parts the texts, 0 ends them
    raw = np.frombuffer(b"\n".join(texts[i] for i in distinct) + b"\n", np.uint8)
    t[:-1] = raw
    t[:-1] += 2
    t[end - 1] = 1
    t[-1] = 0
    begin = end - size
    window = np.zeros(t.size + 1, np.int8)
    fits = size > length
    np.add.at(window, begin[fits], 1)
    np.add.at(window, end[fits] - length, -1)
    window = np.cumsum(window[:-1], dtype=np.int8) > 0
    sa = induced_sort(t, 258, length)
    sa = sa[window[sa]]
    before = np.full(t.size, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.flatnonzero(before >= 0)                    # in text order
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(raw.size + 1, np.dtype("<u8"), padded, strides=(1,))
    for off in [*range(0, length - 7, 8), max(0, length - 8)]:
        at = at[eight[at + off] == eight[before[at] + off]]
    same = np.zeros(t.size, np.bool_)
    same[at] = True
    head = ~same[sa]
    run = np.cumsum(head) - 1
    least = np.minimum.reduceat(sa, np.flatnonzero(head)) if sa.size else sa
    late = np.zeros(t.size, np.bool_)
    late[sa] = sa > (least[run] if sa.size else sa)
    for i, b in zip(distinct, begin.tolist()):
        flags[i] = late[b: b + flags[i].size]
    return flags


def _earlier(blocks: DataFrame, length: int, gram: int, key_parts: int, parts: int) -> DataFrame:
    """Per block and part: bits of the windows of the segments sent, in the order sent."""
    def send(batches):
        for batch, i, number, block in each_block(batches):
            seg = Segments(block, length, gram)
            own, part = _sent(seg, shared_bits(batch.column("answers")[i].as_py(), seg.keys, key_parts), parts)
            raw = block.body.tobytes()
            for a, b in cuts(part):
                s, n, d = seg.start[own[a:b]], seg.bytes[own[a:b]], block.ids[seg.doc[own[a:b]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[a])]), pa.array([number]), pa.array([squeeze(
                        np.array([b - a], "<u4").tobytes() + planes(np.diff(s, prepend=0)) + planes(n.astype("<u4"))
                        + planes(np.diff(d, prepend=0)) + b"".join(raw[x: x + y] for x, y in zip(s.tolist(), n.tolist())))],
                        pa.binary())], ["part", "block", "segments"])

    def build(key, table):
        block, at, text, doc = [], [], [], []
        for number, x in zip(table.column("block").to_pylist(), table.column("segments")):
            raw = expand(x.as_buffer())
            m = int(np.frombuffer(raw, "<u4", 1)[0])
            size = unplanes(raw, "<u4", m, 4 + 8 * m).tolist()
            block += [number] * m
            at.append(np.cumsum(unplanes(raw, "<i8", m, 4)))
            doc.append(np.cumsum(unplanes(raw, "<i8", m, 4 + 12 * m)))
            p = 4 + 20 * m
            for n in size:
                text.append(raw[p: p + n])
                p += n
        block, at, doc = np.array(block), np.concatenate(at), np.concatenate(doc)
        order = np.lexsort((at, block, doc))
        flags = earlier_windows([text[i] for i in order.tolist()], length)
        back = np.empty(order.size, np.int64)
        back[order] = np.arange(order.size)
        ends = np.cumsum(np.unique(np.cumsum(np.diff(block, prepend=block[0]) != 0), return_counts=True)[1]).tolist()
        numbers = [int(block[e - 1]) for e in ends]
        bits = [squeeze(np.packbits(np.concatenate([flags[back[i]] for i in range(a, e)])).tobytes())
                for a, e in zip([0, *ends], ends)]
        return pa.table({"block": pa.array(numbers, pa.int64()), "part": pa.array([key[0].as_py()] * len(ends), pa.int64()),
                         "bits": pa.array(bits, pa.binary())})

    return (blocks.mapInArrow(send, "part long, block long, segments binary")
            .groupBy("part").applyInArrow(build, "block long, part long, bits binary"))


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def byte_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, texts: bool = True,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans (maximal removed runs), the sha256 of the kept bytes, and those bytes.

    ``texts=False`` leaves ``kept`` null.  8 <= gram <= 32, gram <= length.  The
    longer the grams, the fewer keys are shared by texts that have no window in common.
    """
    if not 8 <= gram <= min(32, length):
        raise ValueError("grams have 8 to 32 bytes and are no longer than windows")
    blocks = write_blocks(docs, lambda b: np.array([b.body.size], "<i8").tobytes(), block_bytes).drop("note")
    n_blocks = blocks.select("block").count()
    total = n_blocks * block_bytes
    key_parts = max(1, total // (32 << 20))
    answers = materialize(shared_keys(blocks, lambda b: block_keys(b, length, gram), key_parts), "key-answers")
    parts = max(1, total // shard)       # segments overlap, but only those that may repeat are sent
    first = blocks.join(answers, "block", "left")
    bits = materialize(answers_by_block(_earlier(first, length, gram, key_parts, parts)), "window-answers")

    def finish(batches):
        for batch, i, _, block in each_block(batches):
            seg = Segments(block, length, gram)
            own, part = _sent(seg, shared_bits(batch.column("answers")[i].as_py(), seg.keys, key_parts), parts)
            late = np.zeros(block.body.size + 1, np.int64)

            def mark(a: np.ndarray, n: np.ndarray) -> None:
                np.add.at(late, a, 1)
                np.add.at(late, a + n + length - 1, -1)

            copies = np.flatnonzero(seg.copy)
            mark(seg.start[copies], seg.count[copies])
            for (a, b), answer in zip(cuts(part), batch.column("windows")[i].as_py() or [], strict=True):
                n = seg.count[own[a:b]]
                flags = np.unpackbits(np.frombuffer(expand(answer["bits"]), np.uint8), count=int(n.sum())).astype(np.bool_)
                at = np.repeat(seg.start[own[a:b]] - (np.cumsum(n) - n), n) + np.arange(flags.size)
                mark(at[flags], np.ones(int(flags.sum()), np.int64))
            gone = np.cumsum(late[:-1]) > 0
            before = np.concatenate([[0], np.cumsum(gone)])
            removed = before[block.end] - before[block.start]
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            heads = np.concatenate([[0], np.cumsum(head)])
            raw = block.body[~gone].tobytes()            # the newline after a document is never removed
            keep = (block.end - block.start) - removed
            end = np.cumsum(keep + 1) - 1
            runs = [raw[x:y] for x, y in zip((end - keep).tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays(
                [ids_out(block.ids), pa.array(block.end - block.start), pa.array(removed),
                 pa.array(heads[block.end] - heads[block.start]), pa.array([hashlib.sha256(x).hexdigest() for x in runs]),
                 pa.array(runs if texts else [None] * len(runs), pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    second = first.join(bits.withColumnRenamed("answers", "windows"), "block", "left")
    return second.mapInArrow(finish, OUT)
