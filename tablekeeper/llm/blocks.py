"""Blocks of documents, and words in them, as numpy arrays.

A block is a run of whole documents of one input split, closed as soon as it
holds ``block_bytes`` of UTF-8.  Within a block documents are ordered by
doc_id, so the first occurrence of anything is the one with the smallest id.
A document longer than a block is a block of its own.

Nulls: a null text is an empty text.  A null doc_id sorts after every other
id (``NULL_ID``) and comes out as null again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tablekeeper.session import materialize, shared_dir

NULL_ID = np.iinfo(np.int64).max
BLOCK_BYTES = 4 << 20

#: fixed values: bytes that part words, by the two word rules in use
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"                      # words [^\x20\x09-\x0D]+
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+


def _lut(parting: bytes) -> np.ndarray:
    t = np.ones(256, np.bool_)
    t[list(parting)] = False
    return t


_IN_WORD = {SPACES: _lut(SPACES), NON_ALNUM: _lut(NON_ALNUM)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: _MASK[n] keeps the first n bytes of a little-endian word of eight
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_R = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def span_hash(body: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of body[start : start + length], eight bytes at a time."""
    padded = np.empty(body.size + 8, np.uint8)
    padded[: body.size] = body
    padded[body.size:] = 0
    eight = np.ndarray(body.size + 1, np.dtype("<u8"), padded, strides=(1,))
    h = mix(length.astype(np.uint64) * _R + _M2)
    todo, at, left = slice(None), start, length
    while True:
        part = eight[at] & _MASK[np.minimum(left, 8)]
        h[todo] = mix(h[todo] * _R ^ part)
        more = np.flatnonzero(left > 8)
        if not more.size:
            return h
        todo = more if isinstance(todo, slice) else todo[more]
        at, left = at[more] + 8, left[more] - 8


def run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """For each i a hash of h[i], ..., h[i + n - 1] (shorter by n - 1 than h)."""
    m = h.size - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= _R
        out += h[j: j + m]
    return mix(out)


@dataclass
class Words:
    """Words of a block in order: byte start, byte length, index of the document."""
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    body: np.ndarray

    @cached_property
    def hash(self) -> np.ndarray:
        return span_hash(self.body, self.start, self.length)

    def whole_windows(self, n: int) -> np.ndarray:
        """Which words start a window of n words of one document."""
        if self.start.size < n:
            return np.empty(0, np.intp)
        return np.flatnonzero(self.doc[: self.doc.size - n + 1] == self.doc[n - 1:])


@dataclass
class Block:
    """Documents of a block: ids ascending; document i is body[start[i] : end[i]], a newline after it."""
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    body: np.ndarray

    def words(self, parting: bytes = SPACES, lower: bool = False) -> Words:
        body = _LOWER[self.body] if lower else self.body
        inside = np.zeros(body.size + 2, np.int8)
        inside[1:-1] = _IN_WORD[parting][body]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(self.end, start, side="right")
        return Words(start, end - start, doc, body)

    def count(self, words: Words) -> np.ndarray:
        return np.bincount(words.doc, minlength=self.ids.size)


def make_block(ids: np.ndarray, texts: pa.Array) -> Block:
    """A block of (id, text) rows; rows of one id keep their order."""
    order = np.argsort(ids, kind="stable")
    parts, start, end, at = [], [], [], 0
    for i in order:
        b = texts[int(i)].as_buffer()
        n = 0 if b is None else b.size
        start.append(at)
        if n:
            parts.append(b)
        parts.append(b"\n")
        end.append(at + n)
        at += n + 1
    return Block(ids[order], np.array(start, np.int64), np.array(end, np.int64),
                 np.frombuffer(b"".join(parts), np.uint8))


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)


def ids_out(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def iter_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id",
                text_col: str = "text") -> Iterator[Block]:
    """Blocks of a stream of (id, text) batches."""
    ids, texts, size = [], [], 0
    for batch in batches:
        text = batch.column(text_col).cast(pa.large_binary())
        own = ids_of(batch.column(id_col))
        lengths = np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1])
        first, total = 0, 0
        for i, n in enumerate(lengths.tolist()):
            total += n
            if size + total >= block_bytes:
                yield make_block(np.concatenate([*ids, own[first: i + 1]]),
                                 pa.concat_arrays([*texts, text.slice(first, i + 1 - first)]))
                ids, texts, size, first, total = [], [], 0, i + 1, 0
        if first < len(text):
            ids.append(own[first:])
            texts.append(text.slice(first))
            size += total
    if ids:
        yield make_block(np.concatenate(ids), pa.concat_arrays(texts))


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def planes(a: np.ndarray) -> bytes:
    """The array's bytes by significance, so that its zero high bytes compress to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: str, n: int, at: int = 0) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n)


BLOCK_SCHEMA = "block long, doc_id array<long>, ends array<long>, body binary, note binary"
_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
                          ("body", pa.binary()), ("note", pa.binary())])


def read_block(batch: pa.RecordBatch, i: int) -> tuple[int, Block]:
    """Row i of a block table."""
    ids = batch.column("doc_id")[i].values.to_numpy(zero_copy_only=False)
    end = batch.column("ends")[i].values.to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64)
    body = np.frombuffer(expand(batch.column("body")[i].as_buffer()), np.uint8)
    return batch.column("block")[i].as_py(), Block(ids, start, end, body)


def write_blocks(docs: DataFrame, note: Callable[[Block], bytes] | None = None,
                 block_bytes: int = BLOCK_BYTES, carry: list[Column] | None = None) -> DataFrame:
    """The documents as a written table with one row per block.

    Operators that come back to a block need it to be the same each time,
    whichever executor reads it, so the table is written once to the shared
    folder.  Building it needs no shuffle; it is bucketed by block, so that
    joining answers to it moves the answers only.  ``note`` may add a few bytes
    of statistics per block; with ``carry`` the note holds these columns of the
    block's rows instead, for ``carried``.
    """
    carrying = bool(carry)                  # columns themselves can't go to a task
    rows: list[pa.RecordBatch] = []         # read and not yet in a block; a block is a run of rows

    def seen(batches):
        for batch in batches:
            rows.append(batch)
            yield batch

    def carry_of(b: Block) -> bytes:
        table = pa.Table.from_batches(rows)
        own = table.slice(0, b.ids.size).combine_chunks()
        rows[:] = table.slice(b.ids.size).to_batches()
        order = np.argsort(ids_of(pa.concat_arrays(own.column("doc_id").chunks)), kind="stable")
        sink = pa.BufferOutputStream()
        own = own.drop_columns(["doc_id", "text"]).take(pa.array(order)).combine_chunks()
        with pa.ipc.new_stream(sink, own.schema) as out:
            out.write_table(own)
        return squeeze(sink.getvalue())

    def pack(batches):
        from pyspark import TaskContext
        at = TaskContext.get().partitionId() << 32
        rows.clear()
        for k, b in enumerate(iter_blocks(seen(batches) if carrying else batches, block_bytes)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([at + k], pa.int64()), pa.array([b.ids], pa.list_(pa.int64())),
                 pa.array([b.end], pa.list_(pa.int64())), pa.array([squeeze(b.body, 3)], pa.binary()),
                 pa.array([carry_of(b) if carrying else note(b) if note else b""], pa.binary())],
                schema=_BLOCK_ARROW)

    spark = docs.sparkSession
    path = shared_dir(spark, "blocks")
    name = "blocks_" + path.rsplit("-", 1)[1]
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(carry or []))
        .mapInArrow(pack, BLOCK_SCHEMA).write.format("parquet").option("compression", "none")   # bodies are compressed
        .option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name))
    return spark.table(name)


def carried(batch: pa.RecordBatch, i: int) -> pa.Table:
    """The columns that row i of a block table carries, in the order of its documents."""
    return pa.ipc.open_stream(expand(batch.column("note")[i].as_buffer())).read_all()


def write_bucketed(df: DataFrame, key: str, purpose: str) -> DataFrame:
    """A written table dealt by key once, so that joins on the key move the other side only."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    name, n = "bucketed_" + path.rsplit("-", 1)[1], int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


#: ids that are broadcast at most: 32 MB of them
FEW_IDS = 4_000_000


def if_few(ids: DataFrame, purpose: str) -> DataFrame:
    """A written table of ids, to be broadcast if its counted rows are few; else joins are Spark's choice.

    Joined to documents, few ids so come to the texts instead of moving them.
    """
    written = materialize(ids, purpose)
    return F.broadcast(written) if written.count() <= FEW_IDS else written


def each_block(batches: Iterator[pa.RecordBatch]):
    """(batch, row, block number, block) of every row of a block table."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield (batch, i, *read_block(batch, i))


def kept_bytes(block: Block, words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: (buffer, start, end) of the documents' runs."""
    start, length = words.start[keep], words.length[keep]
    edge = np.zeros(block.body.size + 2, np.int8)
    edge[start] += 1
    edge[start + length + 1] -= 1     # the byte after a word stays as its space
    body = block.body.copy()
    body[start + length] = 32
    out = body[np.cumsum(edge[: body.size], dtype=np.int8).astype(np.bool_)]
    size = np.bincount(words.doc[keep], weights=length + 1, minlength=block.ids.size).astype(np.int64)
    end = np.cumsum(size)
    return out, end - size, np.maximum(end - 1, end - size)
