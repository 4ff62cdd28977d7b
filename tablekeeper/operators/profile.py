"""Table metrics and profiles: row counts, null counts, null shares, samples.

Every metric over one table is computed in a single aggregate pass (one
partial aggregate per map task, one tiny shuffle); several metrics or
columns never mean several scans.  Wide results are turned into rows with
``unpivot`` on the one-row aggregate, not on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _null_count(c: str) -> Column:
    return F.count_if(F.col(c).isNull())


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """round(100 * part / whole, digits), half up, as DOUBLE; NULL when whole is 0.

    Rounded in exact decimal arithmetic (floor((part*2*10^(d+2) + whole) /
    (2*whole))), so no binary fraction decides a tie.
    """
    scale = 2 * 10 ** (digits + 2)
    k = F.floor((part.cast("decimal(38,0)") * F.lit(scale) + whole) / (whole.cast("decimal(38,0)") * 2))
    return F.when(whole > 0, (k.cast("double") / F.lit(float(10 ** digits))))


def table_metrics(df: DataFrame, column: str | None = None) -> DataFrame:
    """One row: total_rows and null_count of ``column`` (0 without a column)."""
    nulls = _null_count(column) if column else F.lit(0).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total_rows"), nulls.alias("null_count"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: total_rows, null_count, non_null_count, null_pct (one scan)."""
    columns = columns or df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")] + [_null_count(c).alias(f"_n{i}") for i, c in enumerate(columns)]
    wide = df.agg(*aggs)
    stack = wide.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("null_count"))
        for i, c in enumerate(columns)])).alias("s"))
    return stack.select(
        F.col("s.ordinal").cast("int").alias("ordinal"),
        F.col("s.column_name").alias("column_name"),
        F.col("_rows").alias("total_rows"),
        F.col("s.null_count").alias("null_count"),
        (F.col("_rows") - F.col("s.null_count")).alias("non_null_count"),
        pct(F.col("s.null_count"), F.col("_rows")).alias("null_pct"),
    )


def row_count_report(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """UNION ALL of labelled row counts, one aggregate per table."""
    out = None
    for label, df in tables:
        part = df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(label).alias("info"), "count")
        out = part if out is None else out.unionByName(part)
    return out


def null_pct_report(tables: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Per labelled table: null count and null share of one column, one pass each.

    The reference divides by a scalar sub-query over the same table; here the
    numerator and the denominator come from the same aggregate.
    """
    out = None
    for label, df, col in tables:
        part = df.agg(_null_count(col).alias("null_count"), F.count(F.lit(1)).alias("_rows")).select(
            F.lit(label).alias("info"), "null_count", pct(F.col("null_count"), F.col("_rows")).alias("null_percentage"))
        out = part if out is None else out.unionByName(part)
    return out


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def non_null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def sample_rows(df: DataFrame, id_col: str, n: int = 10, column: str | None = None,
                ids: DataFrame | list | None = None) -> DataFrame:
    """Up to ``n`` rows ordered by id: NULL rows of ``column``, rows of given ids, or any.

    ``ids`` may be a short Python list (``isin``) or a DataFrame of ids
    (semi join, for lists of any length).  The limit is the feature here: a
    top-n by id (TakeOrderedAndProject keeps n rows per task, then n overall).
    """
    if ids is not None:
        if isinstance(ids, DataFrame):
            key = ids.columns[0]
            right = ids.select(F.col(key).alias("_id")).distinct()
            df = df.join(right, df[id_col] == right["_id"], "left_semi")
        else:
            df = df.filter(F.col(id_col).isin(list(ids)))
        return df.orderBy(id_col).limit(n)
    if column is not None:
        return df.filter(F.col(column).isNull()).orderBy(id_col).limit(n)
    return df.limit(n)


def profile_tables(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """``profile`` of many tables at once (one aggregate per table), labelled by table."""
    out = None
    for name, df in tables:
        part = profile(df).select(F.lit(name).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out
