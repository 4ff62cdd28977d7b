"""Apply an approved fix as a new table version; roll back to an older one.

The row work (the repair, the counts, the changed-row comparison) runs on
executors; the driver only moves the version pointer and keeps the few
numbers of the result row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import AnalysisException, ArithmeticException, IllegalArgumentException, NumberFormatException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablekeeper import schemas
from tablekeeper.operators import fixes, history
from tablekeeper.sources.versions import VersionedTable

RESULT_SCHEMA = schemas.FIX_RESULT


@dataclass
class Fix:
    kind: str                      # fill_null | dedupe | fix_format
    column: str
    value: object = fixes.DEFAULT_FILL
    keys: list[str] = field(default_factory=list)
    id_col: str | None = None
    null_keys: str = "keep"
    valid: str | None = None
    pattern: str | None = None
    replacement: str | None = None


def changes(fix: Fix) -> Column | None:
    """What tells of a row that the repair changes it; None where it removes rows."""
    c = F.col(fix.column)
    if fix.kind == "fill_null":
        return c.isNull()
    if fix.kind == "fix_format":
        return c.isNotNull() & ~c.rlike(fix.valid) & (F.regexp_replace(c, fix.pattern, fix.replacement) != c)
    return None


def repaired(df: DataFrame, fix: Fix) -> DataFrame:
    if fix.kind == "fill_null":
        return fixes.fill_nulls(df, fix.column, fix.value)
    if fix.kind == "dedupe":
        return fixes.dedupe(df, fix.keys or [fix.column], fix.id_col, fix.null_keys)
    if fix.kind == "fix_format":
        return fixes.fix_format(df, fix.column, fix.valid, fix.pattern, fix.replacement)
    raise ValueError(fix.kind)


def _entry(spark: SparkSession, values: dict, path: str) -> None:
    fields = schemas.struct(schemas.HISTORY_ENTRY)
    history.append_entries(spark.createDataFrame([tuple(values.get(f.name) for f in fields)], fields), path)


def apply_fix(spark: SparkSession, table: VersionedTable, fix: Fix, name: str, entry: dict | None = None,
              history_path: str | None = None) -> DataFrame:
    """Write the repaired table as its next version; the repair runs once, its changed rows are observed on the way.

    A repair of values is one pass from the old version to the new one, so what
    is observed is what is written.  For a repair that removes rows the count
    is that of the old version's files less that of the new one's.

    With ``history_path`` the history gets an entry with action 'applied' (or
    'failed'); ``entry`` has fields of ``schemas.HISTORY_ENTRY``.
    """
    before = table.current()
    try:
        src = table.read()
        seen, changed = Observation(), changes(fix)
        watched = src if changed is None else src.observe(seen, F.count_if(changed).alias("rows_affected"))
        after = table.commit(repaired(watched, fix))
        affected = table.rows(before) - table.rows(after) if changed is None else seen.get["rows_affected"]
        row = (name, before, after, True, int(affected), f"Fix applied: {affected} rows affected")
    except (AnalysisException, NumberFormatException, ArithmeticException, IllegalArgumentException, ValueError, KeyError) as e:
        # the fix itself is wrong: reported, the old version stays current; a lost executor or store raises
        row = (name, before, before, False, 0, f"Fix failed: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    if history_path:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        _entry(spark, {"table_fqn": name, "column_name": fix.column, **(entry or {}), "action": "applied" if row[3] else "failed", "fixed_at": now,
                       "rows_affected": row[4], "allowed": True, "version_before": before, "version_after": row[2]}, history_path)
    return spark.createDataFrame([row], RESULT_SCHEMA)


def rollback(spark: SparkSession, table: VersionedTable, to_version: int, id_col: str, columns: list[str],
             name: str, entry: dict | None = None, history_path: str | None = None) -> DataFrame:
    """Restore ``to_version``; rows_restored = rows that differ between the two versions, with those that
    only one of them has (a removed duplicate comes back).

    With ``history_path`` the history gets an entry with action 'reverted' and
    its time; ``entry`` names the fix that is taken back (fields of
    ``schemas.HISTORY_ENTRY``).
    """
    current = table.current()
    restored = fixes.changed_rows(table.read(current), table.read(to_version), id_col, columns).count()
    table.restore(to_version)
    if history_path:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        _entry(spark, {"table_fqn": name, **(entry or {}), "action": "reverted", "reverted_at": now, "fixed_at": now, "rows_affected": restored,
                       "version_before": current, "version_after": to_version}, history_path)
    return spark.createDataFrame([(name, current, to_version, True, restored, "reverted")],
                                 schemas.ROLLBACK_RESULT)
