"""State across micro-batches, as a table of changes.

``<root>/delta/batch_id=<n>`` holds what batch n changed, written with
overwrite: a batch that runs again after a failure reads only the batches
before it and replaces its own change, so every batch counts once.  Every
``every`` batches the changes so far are merged into
``<root>/snapshot/upto=<n>`` (all batches before n), which bounds the number of
tables that a batch reads; what lies before the snapshot before that is deleted.

A batch reads the state of the keys that it has: the keys meet the state in
a semi join, which AQE turns into a broadcast of the batch's keys as long as
they are few, so a small batch moves no row of a large state.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeeper.operators.ordered import null_safe
from tablekeeper.sources.versions import _fs

Merge = Callable[[DataFrame], DataFrame]


def latest(keys: list[str], values: list[str]) -> Merge:
    """The values of the last batch that has the key."""
    def merge(df: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*values, "batch_id"), "batch_id").alias("s")
        return df.groupBy(*keys).agg(last).select(*keys, "s.*")
    return merge


def summed(keys: list[str], value: str) -> Merge:
    """The sum of all batches' changes; keys whose changes cancel out are gone."""
    def merge(df: DataFrame) -> DataFrame:
        out = df.groupBy(*keys).agg(F.sum(value).alias(value), F.max("batch_id").alias("batch_id"))
        return out.filter(F.col(value) != 0)
    return merge


@dataclass
class BatchState:
    spark: SparkSession
    root: str
    schema: str                 # of the changes, without batch_id
    keys: list[str]
    merge: Merge
    every: int = 32

    def _numbers(self, kind: str, name: str) -> list[int]:
        """Numbers of the complete tables of a kind."""
        fs, p = _fs(self.spark, f"{self.root}/{kind}")
        if not fs.exists(p):
            return []
        found = [(re.fullmatch(rf"{name}=(\d+)", st.getPath().getName()), st.getPath()) for st in fs.listStatus(p)]
        jvm = self.spark.sparkContext._jvm
        return sorted(int(m[1]) for m, path in found if m and fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")))

    def _changes(self, batch_id: int) -> DataFrame | None:
        """All changes before a batch, with their batch_id; None if there are none."""
        base = max((n for n in self._numbers("snapshot", "upto") if n <= batch_id), default=0)
        paths = [(f"{self.root}/delta/batch_id={n}", n) for n in self._numbers("delta", "batch_id") if base <= n < batch_id]
        read = self.spark.read.schema(f"{self.schema}, batch_id bigint")
        out = read.parquet(f"{self.root}/snapshot/upto={base}") if base else None
        if paths:
            deltas = read.option("basePath", f"{self.root}/delta").parquet(*[p for p, _ in paths])
            out = deltas if out is None else out.unionByName(deltas)
        return out

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], f"{self.schema}, batch_id bigint")

    def before(self, batch_id: int, only: DataFrame | None = None) -> DataFrame:
        """The state before a batch, of the keys of ``only`` if given."""
        changes = self._changes(batch_id)
        if changes is None:
            return self.empty()
        if only is not None:
            wanted = only.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
            changes = changes.join(wanted, null_safe(self.keys, [f"_{k}" for k in self.keys]), "left_semi")
        return self.merge(changes)

    def write(self, batch_id: int, delta: DataFrame) -> DataFrame:
        """Write what a batch changed, after merging the batches before it where it is time to; returns it read back."""
        self._compact(batch_id)
        path = f"{self.root}/delta/batch_id={batch_id}"
        delta.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def _compact(self, batch_id: int) -> None:
        snapshots = [n for n in self._numbers("snapshot", "upto") if n <= batch_id]
        base = max(snapshots, default=0)
        if batch_id - base < self.every:
            return
        self.before(batch_id).write.mode("overwrite").parquet(f"{self.root}/snapshot/upto={batch_id}")
        # a batch that is run again lies after ``base``
        for kind, name, numbers in (("snapshot", "upto", [n for n in snapshots if n < base]),
                                    ("delta", "batch_id", [n for n in self._numbers("delta", "batch_id") if n < base])):
            for n in numbers:
                fs, p = _fs(self.spark, f"{self.root}/{kind}/{name}={n}")
                fs.delete(p, True)
