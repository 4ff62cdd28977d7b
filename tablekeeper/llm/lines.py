"""Line de-duplication by a deletion-neighbourhood join over words.

A line's words are its runs of other characters than ASCII white space, in
lower case (A-Z).  Two lines are alike if their word sequences are equal
(``MIN_WORDS`` words or more) or differ by one word put in, left out or changed
(both of ``MIN_FUZZY`` words or more).  A line goes if an earlier line, of a
smaller doc_id or further up in its document, is alike; all lines are judged on
the input, so the earliest of alike lines stays.

1. Variants: each line emits the hash of its words and, within the edit bound,
   the hash of its words without the j-th, for each j.
2. Alike lines share a variant: the same j for a changed word, a whole line and
   a shortened one for a word put in.  That is checked by j, so the join on
   equal variants also verifies the edit distance.
3. A block settles its own lines first and keeps, for each variant and j, the
   earliest.  Of those it sends only variants that another block has too, with
   their documents; a line of a third of all documents is one entry a block.
4. A bit per entry comes back: whether an alike line is earlier elsewhere.

Nulls and odd rows: a null or empty text has no lines; a null doc_id counts as
larger than all others and stays null; rows of one doc_id follow each other;
lines of fewer words stay; empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tablekeeper.llm.blocks import (SPACES, Block, carried, each_block, expand, ids_out, mix, planes, squeeze, unplanes,
                                    write_blocks)
from tablekeeper.llm.meeting import KEY_BITS, answers_by_block, cuts, key_part, shared_bits, shared_keys
from tablekeeper.session import materialize

MIN_WORDS, MIN_FUZZY = 4, 8
PART = 1 << 21
BLOCK_BYTES = 2 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))


class Lines:
    """Lines of a block and their variants, sorted by variant, j (0: the whole line) and line."""

    def __init__(self, block: Block, min_words: int, min_fuzzy: int):
        w = block.words(SPACES, lower=True)
        self.end = np.flatnonzero(block.body == 10)
        self.start = np.concatenate([[0], self.end[:-1] + 1])
        self.doc = np.searchsorted(block.end, self.start, side="left")
        first = np.searchsorted(w.start, self.start)
        self.words = np.searchsorted(w.start, self.end) - first
        m = w.start.size
        power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m, _R)]))
        back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m + 1, _R_INVERSE)]))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * power[:-1])])
        own = np.flatnonzero(self.words >= min_words)
        s, n = first[own], self.words[own]
        whole = (total[s + n] - total[s]) * back[s]
        fuzzy = n >= min_fuzzy
        line = np.repeat(own[fuzzy], n[fuzzy])
        a = first[line]
        j = np.arange(line.size) - np.repeat(np.cumsum(n[fuzzy]) - n[fuzzy], n[fuzzy])
        less = (total[a + j] - total[a]) * back[a] + (total[a + self.words[line]] - total[a + j + 1]) * back[a + 1]
        size = np.concatenate([n, self.words[line] - 1]).astype(np.uint64)
        variant = mix(np.concatenate([whole, less]) ^ mix(size))
        j = np.concatenate([np.zeros(own.size, np.int64), j + 1]).astype(np.int32)
        line = np.concatenate([own, line]).astype(np.int32)
        order = np.lexsort((line, j, variant))
        self.variant, self.j, self.line = variant[order], j[order], line[order]
        self.first = np.ones(order.size, np.bool_)
        self.first[1:] = (np.diff(self.variant) != 0) | (np.diff(self.j) != 0)

    @property
    def short(self) -> np.ndarray:
        return self.variant >> np.uint64(64 - KEY_BITS)

    def keys(self) -> np.ndarray:
        short = self.short
        return short[np.flatnonzero(np.diff(short, prepend=~short[:1]))] if short.size else short


def alike_earlier(v: np.ndarray, k: np.ndarray, o: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Which entries, sorted by variant v and place k, have an alike entry of a smaller order o.

    f: whole lines long enough for an edit.
    """
    if not v.size:
        return np.empty(0, np.bool_)
    group = np.ones(v.size, np.bool_)
    group[1:] = np.diff(v) != 0
    same = group.copy()
    same[1:] |= np.diff(k) != 0
    start, g = np.flatnonzero(same), np.cumsum(group) - 1
    big = np.iinfo(o.dtype).max
    own = np.minimum.reduceat(o, start)[np.cumsum(same) - 1]
    whole = np.minimum.reduceat(np.where((k == 0) & f, o, big), np.flatnonzero(group))[g]
    cut = np.minimum.reduceat(np.where(k > 0, o, big), np.flatnonzero(group))[g]
    return (own < o) | ((k > 0) & (whole < o)) | ((k == 0) & f & (cut < o))


def _sent(lines: Lines, shared: np.ndarray, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.flatnonzero(lines.first)
    if own.size:
        own = own[shared[np.searchsorted(keys, lines.short[own])]]
    return own, key_part(lines.short[own], parts)


def _earlier(blocks: DataFrame, key_parts: int, parts: int, min_words: int, min_fuzzy: int) -> DataFrame:
    def send(batches):
        for batch, i, number, block in each_block(batches):
            lines = Lines(block, min_words, min_fuzzy)
            keys = lines.keys()
            own, part = _sent(lines, shared_bits(batch.column("answers")[i].as_py(), keys, key_parts), keys, parts)
            runs = cuts(part)
            if runs:
                doc, size = lines.doc[lines.line[own]], lines.words[lines.line[own]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[a]) for a, _ in runs]), pa.array([number] * len(runs)),
                     pa.array([_pack(lines.variant[own[a:b]], lines.j[own[a:b]], size[a:b] >= min_fuzzy, block.ids, doc[a:b])
                               for a, b in runs], pa.binary())], ["part", "block", "entries"])

    def build(key, table):
        each = [_unpack(x.as_buffer()) for x in table.column("entries")]
        variant, j, fuzzy, ids = map(np.concatenate, zip(*each))
        size = [x[0].size for x in each]
        block = np.repeat(table.column("block").to_numpy(), size)
        by = np.lexsort((block, ids))
        new = np.ones(by.size, np.bool_)
        new[1:] = (np.diff(ids[by]) != 0) | (np.diff(block[by]) != 0)
        order = np.empty(by.size, np.int64)
        order[by] = np.cumsum(new)            # documents in order, those of one id by block
        by = np.lexsort((j, variant))
        flags = np.empty(by.size, np.bool_)
        flags[by] = alike_earlier(variant[by], j[by], order[by], fuzzy[by])
        bits = np.split(flags, np.cumsum(size)[:-1])
        return pa.table({"block": table.column("block"), "part": pa.array([key[0].as_py()] * len(size), pa.int64()),
                         "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})

    return answers_by_block(blocks.mapInArrow(send, "part long, block long, entries binary")
                            .groupBy("part").applyInArrow(build, "block long, part long, bits binary"))


def _pack(variant, j, fuzzy, ids, doc) -> bytes:
    seen, index = np.unique(doc, return_inverse=True)
    return squeeze(np.array([variant.size, seen.size], "<u4").tobytes() + planes(np.diff(variant, prepend=np.uint64(0)))
                   + planes(j.astype("<u4")) + planes(np.diff(ids[seen], prepend=0)) + planes(index.astype("<u4"))
                   + np.packbits(fuzzy).tobytes())


def _unpack(raw):
    raw = expand(raw)
    n, docs = np.frombuffer(raw, "<u4", 2).tolist()
    at = 8 + 12 * n + 8 * docs
    ids = np.cumsum(unplanes(raw, "<i8", docs, 8 + 12 * n))
    return (np.cumsum(unplanes(raw, "<u8", n, 8)), unplanes(raw, "<u4", n, 8 + 8 * n).astype(np.int64),
            np.unpackbits(np.frombuffer(raw, np.uint8, -1, at + 4 * n), count=n).astype(np.bool_), ids[unplanes(raw, "<u4", n, at)])


OUT = "doc_id long, n_lines long, n_removed long, kept_sha256 string, kept string, emptied boolean"


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_fuzzy: int = MIN_FUZZY, texts: bool = True) -> DataFrame:
    """Per document: n_lines (with a word), n_removed, the sha256 of the kept lines joined by newlines, that text, and
    whether it had lines with a word and lost them all.

    ``texts=False`` leaves ``kept`` null.
    """
    def rows(batch, i, ids, n, removed, runs):
        return pa.RecordBatch.from_arrays(
            [ids_out(ids), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
             pa.array([hashlib.sha256(x).hexdigest() for x in runs], pa.string()),
             pa.array([x.decode() if texts else None for x in runs], pa.string()), pa.array((n > 0) & (n == removed))],
            ["doc_id", "n_lines", "n_removed", "kept_sha256", "kept", "emptied"])

    return _judged(write_blocks(docs, None, BLOCK_BYTES).drop("note"), min_words, min_fuzzy, rows, OUT)


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_fuzzy: int = MIN_FUZZY) -> DataFrame:
    """The documents, each row with its own kept lines as text; rows that had lines with a word and lost them all go.

    Rows that lose no line pass as they are; ``n_chars``, if there, follows the
    texts that do.  The other columns travel in the row's block, as neither a
    doc_id nor a text need be unique.
    """
    names = [c for c in docs.columns if c != "text"]
    carry = [F.col(c).alias(f"_{k}") for k, c in enumerate(names)] + [F.col("text").isNull().alias("_none")]
    schema = T.StructType([*docs.select(*carry).schema, T.StructField("_kept", T.BinaryType()), T.StructField("_cut", T.BooleanType())])

    def rows(batch, i, ids, n, removed, runs):
        own = carried(batch, i)
        own = (own.append_column("_kept", pa.array(runs, pa.binary())).append_column("_cut", pa.array(removed > 0))
               .filter(pa.array((n == 0) | (n > removed))).combine_chunks())
        return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in own.columns], own.column_names)

    out = _judged(write_blocks(docs, None, BLOCK_BYTES, carry), min_words, min_fuzzy, rows, schema)
    kept = F.when(~F.col("_none"), F.col("_kept").cast("string"))
    place = {c: F.col(f"_{k}") for k, c in enumerate(names)}
    if "n_chars" in place:
        place["n_chars"] = F.when(F.col("_cut"), F.length(kept).cast("long")).otherwise(place["n_chars"])
    return out.select(*[(kept if c == "text" else place[c]).alias(c) for c in docs.columns])


def _judged(blocks: DataFrame, min_words: int, min_fuzzy: int, rows, schema) -> DataFrame:
    """Rows that ``rows`` makes of each block: (batch, row, ids, lines with a word, lines removed, kept text) of its documents."""
    n_blocks = blocks.select("block").count()
    key_parts = max(1, n_blocks * BLOCK_BYTES // (8 << 20))      # a part has about two million keys at most
    first = blocks.join(materialize(shared_keys(blocks, lambda b: Lines(b, min_words, min_fuzzy).keys(), key_parts),
                                    "variant-answers"), "block", "left")
    parts = max(1, n_blocks * (BLOCK_BYTES // 16) // PART)      # entries sent are fewer than a sixteenth of the bytes
    bits = materialize(_earlier(first, key_parts, parts, min_words, min_fuzzy), "line-answers")

    def finish(batches):
        for batch, i, _, block in each_block(batches):
            lines = Lines(block, min_words, min_fuzzy)
            keys = lines.keys()
            own, part = _sent(lines, shared_bits(batch.column("answers")[i].as_py(), keys, key_parts), keys, parts)
            gone = np.zeros(lines.start.size, np.bool_)
            if lines.line.size:
                gone[lines.line[alike_earlier(lines.variant, lines.j, lines.line, lines.words[lines.line] >= min_fuzzy)]] = True
                late = np.zeros(lines.line.size, np.bool_)
                for (a, b), x in zip(cuts(part), batch.column("lines")[i].as_py() or [], strict=True):
                    late[own[a:b]] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(np.bool_)
                gone[lines.line[late]] = True
            n = np.bincount(lines.doc[lines.words > 0], minlength=block.ids.size)
            removed = np.bincount(lines.doc[gone], minlength=block.ids.size)
            edge = np.zeros(block.body.size + 1, np.int8)
            edge[lines.start[gone]] += 1
            edge[lines.end[gone] + 1] -= 1
            keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
            raw = block.body[keep].tobytes()
            size = np.concatenate([[0], np.cumsum(keep)])
            a, b = size[block.start], size[block.end + 1]
            runs = [raw[x: max(x, y - 1)] for x, y in zip(a.tolist(), b.tolist())]
            yield rows(batch, i, block.ids, n, removed, runs)

    return first.join(bits.withColumnRenamed("answers", "lines"), "block", "left").mapInArrow(finish, schema)
