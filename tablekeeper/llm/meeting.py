"""Which keys of a block other blocks have too.

Each block sends its distinct keys, 40 bits of each, as steps in sorted order
(about three bytes a key) to the part of the key range they lie in; a bit a key
comes back.  What no other block has stays at home.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekeeper.llm.blocks import Block, each_block, expand, planes, squeeze, unplanes

KEY_BITS = 40


def cuts(part: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal values."""
    cut = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    return list(zip(cut, [*cut[1:], part.size]))


def key_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of keys, so that sorted keys are sorted by part."""
    return (keys * np.uint64(parts) >> np.uint64(KEY_BITS)).astype(np.int64)


def shared_keys(blocks: DataFrame, keys_of: Callable[[Block], np.ndarray], parts: int) -> DataFrame:
    """Per block its answers, one a part: bits of the block's distinct keys (sorted), whether another block has the key."""
    def send(batches):
        for _, _, number, block in each_block(batches):
            keys = keys_of(block)
            part = key_part(keys, parts)
            if keys.size:
                runs = cuts(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[a]) for a, _ in runs]), pa.array([number] * len(runs)),
                     pa.array([squeeze(np.array([b - a], "<u4").tobytes() + planes(np.diff(keys[a:b], prepend=np.uint64(0))))
                               for a, b in runs], pa.binary())], ["part", "block", "keys"])

    def count(key, table):
        each = []
        for x in table.column("keys"):
            raw = expand(x.as_buffer())
            each.append(np.cumsum(unplanes(raw, "<u8", int(np.frombuffer(raw, "<u4", 1)[0]), 4)))
        every = np.concatenate(each)
        every.sort()
        shared = every[1:][every[1:] == every[:-1]]
        del every
        shared = shared[np.diff(shared, prepend=~shared[:1]) != 0]       # each once
        here = lambda x: shared[np.minimum(np.searchsorted(shared, x), shared.size - 1)] == x
        bits = [here(x) if shared.size else np.zeros(x.size, np.bool_) for x in each]
        return pa.table({"block": table.column("block"), "part": pa.array([key[0].as_py()] * len(each), pa.int64()),
                         "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})

    return answers_by_block(blocks.select("block", "doc_id", "ends", "body").mapInArrow(send, "part long, block long, keys binary")
                            .groupBy("part").applyInArrow(count, "block long, part long, bits binary"))


def answers_by_block(bits: DataFrame) -> DataFrame:
    """A block's answers in order of part; there are at most as many as parts."""
    return bits.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "bits"))).alias("answers"))


def shared_bits(answers, keys: np.ndarray, parts: int) -> np.ndarray:
    """For each of the block's keys whether another block has it."""
    size = [b - a for a, b in cuts(key_part(keys, parts))]
    each = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=n) for a, n in zip(answers or [], size, strict=True)]
    return np.concatenate(each).astype(np.bool_) if each else np.empty(0, np.bool_)
