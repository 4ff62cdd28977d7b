"""Order-dependent numbering and running totals that survive a hot key.

A plain ``row_number() OVER (PARTITION BY key ORDER BY ts)`` sorts every row of
a key inside one task, and a bucket of time only helps as long as no instant is
hot.  Here the whole table is one sequence in order of (key, order columns),
cut into ranges of about equal numbers of rows:

1. rows are dealt to ranges by sampled boundaries over key and order columns
   and written once with the number of their range (``ranges``); a key, or
   one second of a key, that holds a third of the rows is as many ranges as
   its rows fill;
2. per (range, key) counts and sums are partial aggregates, and a window over
   these rows gives what earlier ranges hold of a key: only the first key of a
   range can have begun before it, so at most one row a range has any;
3. a window by (range, key) numbers the rows inside each range.

Result = what earlier ranges hold + running values inside the range, exactly
the single-window answer.  Rows that agree in the key and all order columns
fall into one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekeeper.session import materialize


def ranges(df: DataFrame, by: list[str], purpose: str) -> DataFrame:
    """``df`` as a written table, dealt to ranges in order of ``by`` (NULLs first); ``_range`` numbers them in that order.

    The boundaries are sampled, so they differ from run to run: what depends on
    them reads this one table.
    """
    return materialize(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), purpose)


def null_safe(left: list[str], right: list[str]) -> Column:
    match = F.lit(True)
    for a, b in zip(left, right):
        match = match & F.col(a).eqNullSafe(F.col(b))
    return match


def running(df: DataFrame, key: str | list[str], order: list[str], sums: dict[str, Column] | None = None,
            seq_name: str = "seq") -> DataFrame:
    """Add ``seq_name`` (1-based position per key in ``order``) and a running sum
    column per entry of ``sums`` (name -> value expression).

    No row is lost: rows with a NULL key are a key of their own, and rows with
    a NULL order column come first in their key, as NULLs sort first.
    """
    sums = sums or {}
    keys = [key] if isinstance(key, str) else list(key)
    b = df
    for name, expr in sums.items():
        b = b.withColumn(f"_v_{name}", expr)
    rows = ranges(b, [*keys, *order], "running")
    held = rows.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("_range", *keys, F.sum("_n").over(earlier).alias("_before"),
                         *[F.sum(f"_s_{n}").over(earlier).alias(f"_before_{n}") for n in sums]).filter("_before IS NOT NULL")
    on = ["_range", *keys]
    for c in on:
        before = before.withColumnRenamed(c, f"_on_{c}")
    # one row a range at most
    out = rows.join(F.broadcast(before), null_safe(on, [f"_on_{c}" for c in on]), "left")
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    within = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn(seq_name, (F.coalesce("_before", F.lit(0)) + F.row_number().over(inside)).cast("bigint"))
    for n in sums:
        here = F.sum(f"_v_{n}").over(within)
        out = out.withColumn(n, F.coalesce(F.col(f"_before_{n}") + here, f"_before_{n}", here))
    return out.select(*[c for c in df.columns if c not in (seq_name, *sums)], seq_name, *sums)
