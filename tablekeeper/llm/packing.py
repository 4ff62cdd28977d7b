"""Best-fit packing of token sequences by bin completion.

Every document is tokenized, closed with an end id, and cut into pieces of at
most ``max_tokens`` (the remainder first, so that the rest are full).  Full
pieces are sequences of their own.  The others are dealt into groups of about
``GROUP`` pieces, and each group is packed by branch and bound: the largest
piece opens a sequence; its undominated fillings are tried in order of waste; a
branch whose waste shows that it can't beat the incumbent is cut; the incumbent
starts as the best-fit-decreasing packing, or where that misses the lower bound
as the better one of it and ``folded``.  Of the fillings of an opening the
search tries the largest single piece, the ``wide`` fullest pairs and a few
triples, filled up.  The search of a group ends at the lower bound, or after two
openings a sequence and ``nodes`` more, with the best packing found by then.

Pieces are dealt by their place in the written piece table, so a doc_id or a
source that holds a third of the rows fills all groups alike.  A group can lose
at most a part of one sequence against packing all pieces at once.

Nulls and odd rows: a null or empty text is one piece with the end id alone; a
null doc_id stays null; repeated rows are packed each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekeeper.session import materialize

MAX_TOKENS = 1024
GROUP = 8192
END_ID = 2
#: fixed value: the special token of the vocabulary and its id
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
LONG_RUN = 10_000
BLANKS = re.compile(rf"\s{{{LONG_RUN}}}")


@lru_cache(maxsize=4)
def byte_bpe(path: str | None = None) -> Callable[[str], list[int]]:
    """The ids of byte_bpe_50k.json without added tokens, from the same vocabulary's rank file.

    The special token's own string becomes its id, as that file has it.  Texts
    with a run of ``LONG_RUN`` blanks go to the tokenizers library with that
    file itself: the rank file's matcher backtracks through such a run, and ends
    the process on one of a million.
    """
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer
    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    whole = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(P.path("byte_bpe_50k.json")))

    def encode(text: str) -> list[int]:
        if BLANKS.search(text):
            return whole().encode(text, add_special_tokens=False).ids
        head, *rest = text.split(SPECIAL)
        ids = plain(head)
        for part in rest:
            ids = [*ids, SPECIAL_ID, *plain(part)]
        return ids

    return encode


PIECES = "deal long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, path: str | None = None,
           keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents; ``ids`` (little-endian unsigned 32-bit) only if asked for."""
    def run(batches):
        from pyspark import TaskContext
        at = TaskContext.get().partitionId() << 36
        encode = byte_bpe(path)
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                edges = [0, *range(tokens.size % max_tokens or max_tokens, tokens.size + 1, max_tokens)]
                if tokens.size <= max_tokens:
                    edges = [0, tokens.size]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    raw = tokens[a:b].tobytes()
                    doc.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw))
                    ids.append(raw if keep_ids else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(at, at + len(doc)), pa.int64()), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                 pa.array(ids, pa.binary())], ["deal", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            at += len(doc)

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES))


def lower_bound(count: np.ndarray, size: int) -> int:
    """Sequences that any packing needs: by volume, and by pieces too large to share one."""
    n = np.arange(count.size) * count
    most = -(-int(n.sum()) // size)
    below = np.concatenate([[0], np.cumsum(count)])
    volume = np.concatenate([[0], np.cumsum(n)])
    for k in range(1, size // 2 + 1):
        large = below[size + 1] - below[size - k + 1]                       # over size - k: no room for a piece of k
        half = below[size - k + 1] - below[size // 2 + 1]                   # over half, up to size - k
        room = half * size - (volume[size - k + 1] - volume[size // 2 + 1])
        small = volume[size // 2 + 1] - volume[k]                           # from k up to half
        most = max(most, int(large + half + max(0, -(-(small - room) // size))))
    return most


def best_fit(count: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Best-fit decreasing: each piece into the fullest sequence that has room."""
    open_, bins = [[] for _ in range(size + 1)], []
    least = np.zeros(size + 1, np.bool_)
    for length in np.flatnonzero(count)[::-1].tolist():
        for _ in range(int(count[length])):
            room = int(np.argmax(least[length:])) + length
            if least[room]:
                b = open_[room].pop()
                least[room] = bool(open_[room])
            else:
                b, room = len(bins), size
                bins.append([])
            bins[b].append(length)
            room -= length
            open_[room].append(b)
            least[room] = room > 0
    return [tuple(b) for b in bins]


def _folds(items: np.ndarray, k: int) -> np.ndarray:
    """k * t ascending lengths as t rows of k with sums as equal as their ranks make them.

    Pairs: the smallest with the largest.  Threes: the largest third turned by
    half its length beside the smallest one, so that the ranks of these pairs
    add up to each number once; the largest such sum meets the smallest of the
    middle third.  More: pairs in one order beside rows of the rest in the other.
    """
    t = items.size // k
    if k == 1:
        return items[:, None]
    if k == 3:
        pairs = np.column_stack([items[:t], np.roll(items[2 * t:], -(t // 2))])
        return np.hstack([pairs[np.argsort(pairs.sum(1), kind="stable")], items[t: 2 * t][::-1, None]])
    outer = np.column_stack([items[:t], items[::-1][:t]])
    if k == 2:
        return outer
    inner = _folds(items[t: items.size - t], k - 2)
    return np.hstack([outer[np.argsort(outer.sum(1), kind="stable")], inner[np.argsort(-inner.sum(1), kind="stable")]])


def folded(count: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """The smallest pieces in sequences of k alike, as many as have room, and best fit for the rest; the best k and share.

    Best fit spends the small pieces beside the largest ones, which is wasteful
    where hardly any two middling pieces fit together.
    """
    items = np.repeat(np.arange(count.size), count)
    best: list[tuple[int, ...]] = []
    for k in range(2, min(9, items.size + 1)):
        low, high = 0, items.size // k
        while low < high:                      # the most rows of which all have room, as far as bisection sees
            t = (low + high + 1) // 2
            low, high = (t, high) if _folds(items[: k * t], k).sum(1).max() <= size else (low, t - 1)
        for t in {low, (low + items.size // k) // 2, low * 9 // 10} - {0}:
            rows = _folds(items[: k * t], k)
            rows = rows[rows.sum(1) <= size]
            rest = count.copy()
            np.subtract.at(rest, rows.ravel(), 1)
            found = [*map(tuple, np.sort(rows, axis=1)[:, ::-1].tolist()), *best_fit(rest, size)]
            if not best or len(found) < len(best):
                best = found
    return best


def _pairs(have: np.ndarray, before: np.ndarray, count: np.ndarray, room: int, wide: int) -> list[tuple[int, ...]]:
    """The fullest pairs for ``room``: for each larger piece the largest smaller one that fits beside it."""
    a = np.flatnonzero(have[: room + 1])
    b = np.where((2 * a <= room) & (count[a] > 1), a, before[np.minimum(a - 1, room - a)])
    a, b = a[b > 0], b[b > 0]
    best = np.lexsort((a, a + b))[::-1][:wide]
    return list(zip(a[best].tolist(), b[best].tolist()))


def fillings(count: np.ndarray, room: int, waste: int, wide: int = 4) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill ``room`` with at most ``waste`` left, least left first, then of fewest pieces.

    One piece dominates every filling of no larger sum.  What still has room
    for a piece after three is filled up with the largest that fit.
    """
    have = count[: room + 1] > 0
    before = np.maximum.accumulate(np.where(have, np.arange(have.size), 0))
    one = int(before[-1])
    if one in (0, room):
        if room - one <= waste:
            yield (one,) if one else ()
        return
    found = [(one,), *(pairs := _pairs(have, before, count, room, wide))]
    if not pairs or sum(pairs[0]) < room:
        for a in np.flatnonzero(have)[::-1][:6].tolist():
            count[a] -= 1
            h = have.copy()
            h[a] = count[a] > 0
            found += [(a, *p) for p in _pairs(h, np.maximum.accumulate(np.where(h, np.arange(h.size), 0)), count,
                                              room - a, 2)]
            count[a] += 1
    full = set()
    for f in found:
        f, left, rest = list(f), room - sum(f), None
        while (x := int(before[left])) > 0:
            if rest is None:
                rest = count[: room + 1].copy()
                np.subtract.at(rest, f, 1)
            fit = np.flatnonzero(rest[: left + 1])
            if not fit.size:
                break
            f.append(int(fit[-1]))
            rest[fit[-1]] -= 1
            left -= int(fit[-1])
        full.add(tuple(sorted(f, reverse=True)))
    for f in sorted(full, key=lambda f: (-sum(f), len(f), [-x for x in f])):
        if room - sum(f) > waste:
            return
        if len(f) == 1 or sum(f) > one:
            yield f


def bin_completion(count: np.ndarray, size: int, nodes: int = 2000) -> list[tuple[int, ...]]:
    """Pack count[length] pieces of each length; the sequences as tuples of lengths."""
    best = best_fit(count, size)
    bound = lower_bound(count, size)
    if len(best) <= bound or not best:
        return best
    best = min(best, folded(count, size), key=len)
    if len(best) <= bound:
        return best
    nodes += 2 * len(best)
    count = count.copy()
    total = int((np.arange(count.size) * count).sum())
    slack = (len(best) - 1) * size - total      # the waste that a better packing may have
    path: list[tuple[tuple[int, ...], Iterator, int]] = []
    wasted = 0

    def largest() -> int:
        present = np.flatnonzero(count)
        return int(present[-1]) if present.size else 0

    def options(top: int) -> Iterator:
        return fillings(count, size - top, max(0, slack - wasted))

    top = largest()
    count[top] -= 1
    stack: list[list] = [[top, options(top), None, 0]]
    while stack and nodes > 0:
        level = stack[-1]
        if level[2] is not None:                # take the former choice back
            for x in level[2]:
                count[x] += 1
            wasted -= level[3]
            level[2] = None
        nodes -= 1
        choice = next(level[1], None)
        if choice is None:
            count[level[0]] += 1
            stack.pop()
            continue
        level[2], level[3] = choice, size - level[0] - sum(choice)
        for x in choice:
            count[x] -= 1
        wasted += level[3]
        if wasted > slack:
            continue
        top = largest()
        if top:
            count[top] -= 1
            stack.append([top, options(top), None, 0])
            continue
        best = [(x[0], *x[2]) for x in stack]   # all packed with less than the incumbent
        if len(best) <= bound:
            break
        slack = (len(best) - 1) * size - total
    return best


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, path: str | None = None,
         group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids."""
    cut = materialize(pieces(docs, max_tokens, end_id, path, keep_ids), "pieces")
    short = cut.where(F.col("length") < max_tokens)
    groups = max(1, round(short.count() / group))

    def solve(key, table):
        length = table.column("length").to_numpy()
        order = np.argsort(length, kind="stable")
        count = np.bincount(length, minlength=max_tokens + 1)
        next_ = np.cumsum(count) - count        # the next unused piece of each length
        sequence, offset = np.empty(length.size, np.int64), np.empty(length.size, np.int64)
        for k, lengths in enumerate(bin_completion(count, max_tokens)):
            at = 0
            for x in lengths:
                i = order[next_[x]]
                next_[x] += 1
                sequence[i], offset[i] = k, at
                at += x
        return pa.table({"deal": table.column("deal"), "sequence_id": pa.array(2 * (key[0].as_py() * (1 << 32) + sequence)),
                         "offset": pa.array(offset)})

    # a task a group: by their size alone, few tasks would get all of them
    placed = (short.select("deal", "length", F.expr(f"pmod(xxhash64(deal), {groups})").alias("part"))
              .repartition(groups, "part").groupBy("part").applyInArrow(solve, "deal long, sequence_id long, offset long"))
    full = (cut.where(F.col("length") == max_tokens)
            .select(*[c for c in cut.columns if c != "deal"], (2 * F.col("deal") + 1).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset")))
    return (short.join(placed, "deal").drop("deal").unionByName(full)
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"))


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from pieces that carry their ids; at most max_tokens ids a row."""
    return (packed.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
            .select("sequence_id", F.expr("reduce(p.ids, X'', (a, b) -> concat(a, b))").alias("ids"),
                    F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets")))
