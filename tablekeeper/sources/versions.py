"""Versioned tables: row changes without UPDATE.

A table lives under ``<root>/v=<n>/`` (parquet).  Which version is current is
told by pointer files ``<root>/_pointers/<k>-v<n>``: each move adds one, empty
and never changed, and the highest k counts.  Creating a file is one step, so a
crash at any moment leaves the old version or the new one current, never none.
A change writes a complete new version, verifies its row count, and only then
adds the pointer.  Readers never see a half-written version; rollback is a new
pointer to an older version, whose files are never touched.

Pointers are listed and created through the Hadoop FileSystem of the
session, so the same code works on a local disk, HDFS or an object store.
Single writer per table is assumed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_POINTER = re.compile(r"(\d+)-v(\d+)")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@dataclass
class VersionedTable:
    spark: SparkSession
    root: str

    @property
    def pointers(self) -> str:
        return f"{self.root.rstrip('/')}/_pointers"

    def _moves(self) -> list[tuple[int, int]]:
        """(move, version) of all pointers, in order."""
        fs, p = _fs(self.spark, self.pointers)
        names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(m[1]), int(m[2])) for m in map(_POINTER.fullmatch, names) if m)

    def _point_to(self, version: int) -> None:
        moves = self._moves()
        fs, p = _fs(self.spark, f"{self.pointers}/{(moves[-1][0] if moves else 0) + 1}-v{version}")
        fs.create(p, False).close()      # fails if another writer made the same move

    def version_path(self, n: int) -> str:
        return f"{self.root.rstrip('/')}/v={n}"

    def current(self) -> int | None:
        moves = self._moves()
        return moves[-1][1] if moves else None

    def latest_written(self) -> int:
        fs, p = _fs(self.spark, self.root)
        if not fs.exists(p):
            return 0
        best = 0
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith("v=") and name[2:].isdigit():
                best = max(best, int(name[2:]))
        return best

    def read(self, version: int | None = None) -> DataFrame:
        v = self.current() if version is None else version
        if v is None:
            raise FileNotFoundError(f"no version of {self.root}")
        return self.spark.read.parquet(self.version_path(v))

    def rows(self, version: int) -> int:
        """Rows of a version, from the footers of its files."""
        return self.spark.read.parquet(self.version_path(version)).count()

    def commit(self, df: DataFrame, expected_rows: int | None = None) -> int:
        """Write ``df`` as the next version, verify its row count, then move the pointer.

        The count is that of the rows handed to the write, observed as they
        pass, or ``expected_rows`` where the caller knows it.
        """
        n = self.latest_written() + 1
        path = self.version_path(n)
        seen = Observation(f"version-{n}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
        want = seen.get["rows"] if expected_rows is None else expected_rows
        got = self.rows(n)
        if got != want:
            raise RuntimeError(f"version {n} of {self.root} has {got} rows, expected {want}")
        self._point_to(n)
        return n

    def restore(self, version: int) -> int:
        """Make an older version current again (rollback)."""
        fs, p = _fs(self.spark, self.version_path(version))
        if not fs.exists(p):
            raise FileNotFoundError(self.version_path(version))
        self._point_to(version)
        return version


def replace_table(table: VersionedTable, df: DataFrame) -> int:
    """TRUNCATE/DELETE-then-reload as a new version; the old one stays readable until the swap."""
    return table.commit(df)
