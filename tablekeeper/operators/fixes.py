"""Repairs and their measurement.

Rule-based suggestions replace generated ones; the generated-answer parser
still exists for answers that come as text.  Every repair returns a new
DataFrame (a new table version when written through ``sources.versions``);
nothing is updated in place.

Scale notes
* ``dedupe`` reads the table twice: once for a slim table of keys and ids, in
  which the losers are found by an aggregate per key, and once to drop them
  with an anti join - no window sorts a hot key inside one task and long key
  values are not shuffled.
* ``before_after`` joins two versions on the row id; ``fix_impact`` profiles
  both versions with one aggregate each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeeper.functions import text as T
from tablekeeper.operators.checks import _all_not_null, key_value, type_of
from tablekeeper.operators.profile import pct
from tablekeeper.session import materialize

# Default fill value and the rule table used in place of generated fixes.
DEFAULT_FILL = "unknown@example.com"
FIX_RULES = [
    # issue_type, statement template, confidence, hours saved
    (T.ISSUE_NULL, "UPDATE {table} SET {column} = 'unknown@example.com' WHERE {column} IS NULL;", 92, 2),
    (T.ISSUE_DUP, "DELETE FROM {table} WHERE id NOT IN (SELECT MIN(id) FROM {table} GROUP BY {column});", 88, 3),
    (T.ISSUE_FORMAT, "UPDATE {table} SET {column} = TRIM(LOWER({column})) WHERE {column} IS NOT NULL;", 75, 1),
]
RULES_MODEL = "rules"


def fill_nulls(df: DataFrame, column: str, value) -> DataFrame:
    v = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(column, F.when(F.col(column).isNull(), v.cast(df.schema[column].dataType))
                         .otherwise(F.col(column)))


def losers(df: DataFrame, keys: list[str], id_col: str, null_keys: str = "keep") -> DataFrame:
    """(_key, _id) of the rows that a dedupe removes, ``_key`` as ``key_struct`` makes it.

    One scan writes key and id of every row that can lose; long key values go
    into it as 256-bit digests, fixed-width ones as they are.  The minimum per
    key is a partial aggregate (a hot key is one row a task), and the
    candidates meet it by key.
    """
    can = F.col(id_col).isNotNull()
    if null_keys == "keep":
        can = can & _all_not_null(keys)
    cand = materialize(df.filter(can).select(key_struct(df, keys).alias("_key"), F.col(id_col).alias("_id")), "dedupe-candidates")
    first = cand.groupBy("_key").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return cand.join(first, "_key").filter(F.col("_id") != F.col("_first")).select("_key", "_id").distinct()


def key_struct(df: DataFrame, keys: list[str]) -> Column:
    """The key as one value that is never NULL, so that keys with NULL parts meet as GROUP BY has it."""
    return F.struct(*[F.expr(key_value((k, type_of(df, k)))).alias(f"k{i}") for i, k in enumerate(keys)])


def dedupe(df: DataFrame, keys: list[str], id_col: str, null_keys: str = "keep") -> DataFrame:
    """Keep, per key, the rows carrying the minimum id (``DELETE ... WHERE id NOT IN
    (SELECT MIN(id) ... GROUP BY key)`` as a keep-set).

    null_keys="keep": rows with a NULL key part are never duplicates (UNIQUE semantics).
    null_keys="group": NULL keys form one group, as GROUP BY does.
    Rows with a NULL id are kept (``NULL NOT IN (...)`` is not true).

    A second scan drops the losers with an anti join on (key, id) - broadcast by
    AQE when they are few; no exchange on the way holds a long key value.
    """
    if null_keys not in ("keep", "group"):
        raise ValueError(null_keys)
    gone = losers(df, keys, id_col, null_keys)
    rows = df.withColumn("_key", key_struct(df, keys))
    return rows.join(gone, (rows["_key"] == gone["_key"]) & (rows[id_col] == gone["_id"]), "left_anti").select(*df.columns)


def fix_format(df: DataFrame, column: str, valid: str, pattern: str, replacement: str) -> DataFrame:
    """Rewrite values that do not match ``valid`` with regexp_replace(pattern, replacement)."""
    c = F.col(column)
    return df.withColumn(column, F.when(c.isNotNull() & ~c.rlike(valid), F.regexp_replace(c, pattern, replacement))
                         .otherwise(c))


def suggest_fix(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """One suggestion per failed issue from the rule table (joined on issue type).

    issues: (issue_id, table_fqn, test, issue, issue_type, issue_column, status)
    rules:  (issue_type, template, confidence_score, hours_saved); Spark picks the
    join by the table's measured size.
    """
    failed = issues.filter(F.col("status") == "failed")
    j = failed.join(rules, "issue_type", "left")
    table = F.regexp_replace(F.col("table_fqn"), r"^.*\.([^.]+\.[^.]+)$", "$1")
    sql = F.replace(F.replace(F.col("template"), F.lit("{table}"), F.col("table_fqn")), F.lit("{column}"),
                    F.col("issue_column"))
    return j.select(
        "issue_id", F.col("issue").alias("issue"), F.col("test").alias("test_name"),
        F.when(F.col("template").isNotNull(), sql).alias("fix_sql"),
        F.when(F.col("template").isNotNull(), T.rewrite_fqn(sql)).alias("executable_sql"),
        table.alias("target_table"),
        F.lit(False).alias("ai_generated"), F.lit(RULES_MODEL).alias("model"),
        F.coalesce(F.col("confidence_score"), F.lit(50)).cast("int").alias("confidence_score"),
        F.coalesce(F.col("hours_saved"), F.lit(0)).cast("int").alias("hours_saved"),
    )


def parse_responses(df: DataFrame, text_col: str, null_count: str | None = None) -> DataFrame:
    """Batch parse of generated answers: SQL part and the three metrics.

    ``null_count`` names the column with the null count of the issue's column:
    an answer without a metrics block is then estimated from it, as in
    ``fix_estimates`` (rows = nulls, hours = max(1, nulls div 100)).
    """
    t = F.col(text_col)
    block = T.metric_block(t)
    metric = {k: T.metric_from_block(t, block, k) for k in T.METRIC_KEYS}
    if null_count:
        n = F.coalesce(F.col(null_count).cast("bigint"), F.lit(0).cast("bigint"))
        for k, v in (("expected_rows_affected", n), ("hours_saved", F.greatest(F.lit(1).cast("bigint"), (n / 100).cast("bigint")))):
            metric[k] = F.when(T.has_metrics(t), metric[k]).otherwise(v)
    return df.select(
        *df.columns,
        T.fix_sql_part(t).alias("fix_sql"),
        T.has_metrics(t).alias("has_metrics"),
        *[c.alias(k) for k, c in metric.items()],
    )


def fix_estimates(metrics: DataFrame, null_col: str = "null_count") -> DataFrame:
    """Fallback estimates from real metrics: rows = null count,
    hours = max(1, nulls div 100), confidence 50."""
    n = F.col(null_col)
    return metrics.select(
        "*", n.cast("bigint").alias("expected_rows_affected"),
        F.greatest(F.lit(1), (n / 100).cast("bigint")).cast("int").alias("hours_saved"),
        F.lit(50).alias("confidence_score"))


def before_after(before: DataFrame, after: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Rows whose value in any of ``columns`` changed, old and new side by side."""
    b = before.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"before_{c}") for c in columns])
    a = after.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"after_{c}") for c in columns])
    j = b.join(a, "_id", "inner")
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    return j.filter(changed).withColumnRenamed("_id", id_col)


def changed_rows(before: DataFrame, after: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Ids whose values in ``columns`` differ between two versions, or that only one version has."""
    side = lambda df, p: df.select(F.col(id_col).alias(f"{p}_id"), F.struct(*columns).alias(f"{p}_v"), F.lit(True).alias(f"{p}_in"))
    j = side(before, "b").join(side(after, "a"), F.col("b_id").eqNullSafe(F.col("a_id")), "full_outer")
    return j.filter(F.col("b_in").isNull() | F.col("a_in").isNull() | ~F.col("b_v").eqNullSafe(F.col("a_v"))).select(
        F.coalesce("b_id", "a_id").alias(id_col))


def fix_impact(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Nulls before/after, their difference, % reduction (1 decimal, only when
    there were nulls) and row counts - one aggregate per version."""
    b = before.agg(F.count_if(F.col(column).isNull()).alias("before_nulls"), F.count(F.lit(1)).alias("before_rows"))
    a = after.agg(F.count_if(F.col(column).isNull()).alias("after_nulls"), F.count(F.lit(1)).alias("after_rows"))
    j = b.select("*", a.select("after_nulls").scalar().alias("after_nulls"),
                 a.select("after_rows").scalar().alias("after_rows"))
    return j.select(
        F.lit(column).alias("column_name"), "before_nulls", "after_nulls",
        (F.col("before_nulls") - F.col("after_nulls")).alias("nulls_fixed"),
        pct(F.col("before_nulls") - F.col("after_nulls"), F.col("before_nulls"), 1).alias("reduction_pct"),
        "before_rows", "after_rows")
