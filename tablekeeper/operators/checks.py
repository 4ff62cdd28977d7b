"""Data-quality checks.

Every check returns rows of ``CHECK_SCHEMA``: test_fqn, table_fqn, column,
test_name, status ('Success' / 'Failed'), failed_rows, total_rows, result.

Scale notes
* Row-local checks (not-null, expression, format, generated column) over one
  table are fused into ONE aggregate: one scan, partial counts per task.
* Uniqueness counts rows per key with partial aggregates (a key holding a third
  of the table collapses before the shuffle); long key values are counted by
  their 256-bit digests, so they never move.  Where the duplicate keys
  themselves are asked for, rows are first counted per 64-bit hash and only
  those whose hash repeats are grouped by their real key values.
* Referential checks first count child rows per foreign key (partial
  aggregation again), then join only those distinct keys against the
  distinct parent keys (a left join with a match flag; ``orphan_keys`` is the
  anti-join form): a hot foreign key costs one row in the join.
* A suite over several tables reads each table once (``SharedScan``): grouping
  sets give the row-local failures and the distinct keys of all keyed rules
  together, and a reference's parent may be another table of the suite.
* SQL semantics for NULL: UNIQUE, FOREIGN KEY and CHECK all pass on NULL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeeper import schemas

SUCCESS, FAILED = "Success", "Failed"

CHECK_COLUMNS = ["test_fqn", "table_fqn", "column", "test_name", "status", "failed_rows", "total_rows", "result"]
CHECK_SCHEMA = schemas.CHECK_RESULT


def _row(df_agg: DataFrame, table_fqn: str, column: str, test_name: str) -> DataFrame:
    """Turn an aggregate with ``failed_rows``/``total_rows`` into a check row."""
    return df_agg.select(
        F.lit(f"{table_fqn}.{column}.{test_name}").alias("test_fqn"),
        F.lit(table_fqn).alias("table_fqn"),
        F.lit(column).alias("column"),
        F.lit(test_name).alias("test_name"),
        F.when(F.col("failed_rows") > 0, F.lit(FAILED)).otherwise(F.lit(SUCCESS)).alias("status"),
        F.col("failed_rows").cast("bigint").alias("failed_rows"),
        F.col("total_rows").cast("bigint").alias("total_rows"),
        F.format_string("%d of %d rows failed %s", F.col("failed_rows"), F.col("total_rows"),
                        F.lit(test_name)).alias("result"),
    )


# ------------------------------------------------------------ row-local checks
def not_null_failures(column: str) -> Column:
    return F.col(column).isNull()


def expression_failures(predicate: str | Column) -> Column:
    """Rows where the predicate is FALSE; NULL passes, as a SQL CHECK does."""
    p = F.expr(predicate) if isinstance(predicate, str) else predicate
    return F.coalesce(~p, F.lit(False))


def format_failures(column: str, regex: str) -> Column:
    """Non-NULL values that do not match ``regex`` (give an anchored pattern)."""
    return F.col(column).isNotNull() & ~F.col(column).rlike(regex)


def generated_failures(column: str, expression: str | Column) -> Column:
    """Stored value differs from the generation expression (NULL-safe)."""
    e = F.expr(expression) if isinstance(expression, str) else expression
    return ~F.col(column).eqNullSafe(e)


@dataclass
class Rule:
    """One declared rule.  kind: not_null | unique | reference | expression | format | generated."""
    kind: str
    column: str
    test_name: str
    arg: object = None          # predicate / regex / expression / (parent_df, parent_key)
    columns: list[str] = field(default_factory=list)  # unique: key columns (default [column])


def _failure_expr(rule: Rule) -> Column:
    if rule.kind == "not_null":
        return not_null_failures(rule.column)
    if rule.kind == "expression":
        return expression_failures(rule.arg)
    if rule.kind == "format":
        return format_failures(rule.column, rule.arg)
    if rule.kind == "generated":
        return generated_failures(rule.column, rule.arg)
    raise ValueError(rule.kind)


ROW_LOCAL = {"not_null", "expression", "format", "generated"}


def fused_row_checks(df: DataFrame, table_fqn: str, rules: list[Rule]) -> DataFrame:
    """All row-local rules of one table in one aggregate, then one row per rule."""
    aggs = [F.count(F.lit(1)).alias("_total")]
    aggs += [F.count_if(_failure_expr(r)).alias(f"_f{i}") for i, r in enumerate(rules)]
    wide = df.agg(*aggs)
    rows = wide.select("_total", F.explode(F.array(*[
        F.struct(F.lit(f"{table_fqn}.{r.column}.{r.test_name}").alias("test_fqn"),
                 F.lit(r.column).alias("column"), F.lit(r.test_name).alias("test_name"),
                 F.col(f"_f{i}").alias("failed_rows"))
        for i, r in enumerate(rules)])).alias("r"))
    return rows.select(
        F.col("r.test_fqn").alias("test_fqn"), F.lit(table_fqn).alias("table_fqn"),
        F.col("r.column").alias("column"), F.col("r.test_name").alias("test_name"),
        F.when(F.col("r.failed_rows") > 0, F.lit(FAILED)).otherwise(F.lit(SUCCESS)).alias("status"),
        F.col("r.failed_rows").alias("failed_rows"), F.col("_total").alias("total_rows"),
        F.format_string("%d of %d rows failed %s", F.col("r.failed_rows"), F.col("_total"),
                        F.col("r.test_name")).alias("result"))


def check_not_null(df: DataFrame, column: str, table_fqn: str, test_name: str | None = None) -> DataFrame:
    return fused_row_checks(df, table_fqn, [Rule("not_null", column, test_name or f"{column}_not_null")])


def check_expression(df: DataFrame, predicate: str, column: str, table_fqn: str, test_name: str) -> DataFrame:
    return fused_row_checks(df, table_fqn, [Rule("expression", column, test_name, predicate)])


def check_format(df: DataFrame, column: str, regex: str, table_fqn: str, test_name: str | None = None) -> DataFrame:
    return fused_row_checks(df, table_fqn, [Rule("format", column, test_name or f"{column}_format_check", regex)])


def check_generated(df: DataFrame, column: str, expression: str, table_fqn: str,
                    test_name: str | None = None) -> DataFrame:
    return fused_row_checks(df, table_fqn, [Rule("generated", column, test_name or f"{column}_generated", expression)])


# ------------------------------------------------------------ keyed checks
def _all_not_null(columns: list[str]) -> Column:
    c = F.col(columns[0]).isNotNull()
    for x in columns[1:]:
        c = c & F.col(x).isNotNull()
    return c


def key_hash_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per 64-bit hash of the key (NULL hash for keys with a NULL part).
    Only 8-byte hashes are shuffled, whatever the size of the key values."""
    h = F.when(_all_not_null(columns), F.xxhash64(*[F.col(c) for c in columns]))
    return df.select(h.alias("_kh")).groupBy("_kh").agg(F.count(F.lit(1)).alias("_hn"))


def has_wide_key(df: DataFrame, columns: list[str]) -> bool:
    """Keys with a variable-width (string/binary) part are worth a hash pre-pass;
    fixed-width keys are as cheap to shuffle as their hash."""
    return any(df.schema[c].dataType.typeName() in ("string", "binary") for c in columns)


def duplicate_candidates(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Rows whose key hash occurs more than once - the only rows that can be
    duplicates.  The hash set is small when duplicates are rare, and AQE then
    broadcasts it, so unique rows (and their long key values) never move.
    For fixed-width keys the rows are returned as they are."""
    if counts is None and not has_wide_key(df, columns):
        return df
    counts = counts if counts is not None else key_hash_counts(df, columns)
    multi = counts.filter(F.col("_kh").isNotNull() & (F.col("_hn") > 1)).select("_kh")
    h = F.when(_all_not_null(columns), F.xxhash64(*[F.col(c) for c in columns]))
    return df.withColumn("_kh", h).join(multi, "_kh", "left_semi").drop("_kh")


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key groups with more than one row (groups with a NULL key part are skipped).
    Exact: candidates are grouped by the real key values."""
    cand = duplicate_candidates(df.filter(_all_not_null(columns)), columns)
    return cand.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def check_unique(df: DataFrame, columns: list[str], table_fqn: str, test_name: str | None = None) -> DataFrame:
    """failed_rows = surplus rows (rows beyond the first of each duplicate key).

    One scan: rows are counted per key, partial counts first, so a hot key is
    one row a task; long key values are counted by their digests.
    """
    rule = Rule("unique", columns[0], test_name or f"{'_'.join(columns)}_unique", columns=columns)
    return run_suite({table_fqn: df}, {table_fqn: [rule]})


def orphan_keys(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Distinct child keys missing from the parent, with their row counts."""
    per_key = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(F.col(pk).alias("_pk")).distinct()
    return per_key.join(keys, per_key["_fk"] == keys["_pk"], "left_anti")


def check_reference(child: DataFrame, fk: str, parent: DataFrame, pk: str, table_fqn: str,
                    test_name: str | None = None) -> DataFrame:
    """Child rows whose non-NULL key has no parent.  One scan of the child:
    rows are counted per key, and only distinct keys meet the parent keys."""
    name = test_name or f"{fk}_references_{pk}"
    per_key = child.groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(F.col(pk).alias("_pk")).distinct().withColumn("_hit", F.lit(True))
    j = per_key.join(keys, per_key["_fk"] == keys["_pk"], "left")
    agg = j.agg(
        F.coalesce(F.sum(F.when(F.col("_fk").isNotNull() & F.col("_hit").isNull(), F.col("n"))), F.lit(0))
        .alias("failed_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"))
    return _row(agg, table_fqn, fk, name)


def orphan_assets(nodes: DataFrame, edges: DataFrame, node_id: str = "id",
                  src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes that appear on neither end of any lineage edge."""
    a = edges.select(F.col(src).alias("_e")).distinct()
    b = edges.select(F.col(dst).alias("_e")).distinct()
    out = nodes.join(a, nodes[node_id] == a["_e"], "left_anti")
    return out.join(b, out[node_id] == b["_e"], "left_anti")


# ------------------------------------------------------------ one scan per table
Spec = tuple[str, str]          # a key column and the type that it is compared in
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def common_type(a: str, b: str) -> str:
    """The type in which a foreign key and the parent's key are compared."""
    if a == b:
        return a
    if a in _WHOLE and b in _WHOLE:
        return "bigint"
    numeric = lambda t: t in _WHOLE or t in ("float", "double") or t.startswith("decimal")
    return "double" if numeric(a) and numeric(b) else "string"


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _digested(spec: Spec) -> bool:
    """Long values (text, binary) are grouped as their SHA-256 digest, so that they are never shuffled."""
    return spec[1] in ("string", "binary")


def key_value(spec: Spec) -> str:
    """SQL of a key column as it is grouped."""
    c = f"CAST(`{spec[0]}` AS {spec[1]})"
    return f"unhex(sha2(CAST({c} AS BINARY), 256))" if _digested(spec) else c


@dataclass(frozen=True)
class KeySet:
    """A key of a table: its columns with their types."""
    specs: tuple[Spec, ...]

    @property
    def name(self) -> str:
        return ",".join(f"{c}:{t}" for c, t in self.specs)


def key_of(df: DataFrame, rule: Rule, pk_type: str | None = None) -> KeySet:
    """The key that a unique or reference rule looks at."""
    columns = (rule.columns or [rule.column]) if rule.kind == "unique" else [rule.column]
    return KeySet(tuple((c, common_type(type_of(df, c), pk_type) if pk_type else type_of(df, c)) for c in columns))


class SharedScan:
    """All rules of one table from one scan.

    GROUPING SETS over every key that a rule needs (its distinct keys with
    their numbers of rows serve uniqueness, the child's and the parent's side of
    references) and the empty set (totals and failures of the row-local rules).
    Partial aggregates combine before the shuffle, so a hot key is one row a
    task, and long keys travel as digests.
    """

    def __init__(self, df: DataFrame, keys: list[KeySet], local: list[Rule]):
        self.keys, self.local = list(dict.fromkeys(keys)), local
        self.specs = list(dict.fromkeys(s for k in self.keys for s in k.specs))
        at = {s: f"_k{i}" for i, s in enumerate(self.specs)}
        self.columns = {k: [at[s] for s in k.specs] for k in self.keys}
        rows = df.select(*[F.expr(key_value(s)).alias(at[s]) for s in self.specs], *[_failure_expr(r).alias(f"_l{i}") for i, r in enumerate(local)])
        told = [F.expr("count(1) AS n"), *[F.expr(f"count_if(_l{i}) AS _f{i}") for i in range(len(local))]]
        if not self.keys:
            self.counts = rows.agg(*told).withColumn("_set", F.lit(0).cast("bigint"))
            return
        sets = [self.columns[k] for k in self.keys] + [[]]
        self.counts = rows.groupingSets(sets, *at.values()).agg(F.expr("grouping_id() AS _set"), *told)

    # the rest is SQL over ``counts``, as text: plans of many rules are built far faster so
    def set_id(self, key: KeySet | None) -> int:
        """What ``_set`` holds for a key (None: the empty set): a bit for each column that is not in it, first column highest."""
        within = self.columns[key] if key else []
        return sum(1 << (len(self.specs) - 1 - i) for i in range(len(self.specs)) if f"_k{i}" not in within)

    def is_set(self, key: KeySet | None) -> str:
        return f"_set = {self.set_id(key)}"

    def full(self, key: KeySet) -> str:
        """No part of the key is NULL."""
        return "(" + " AND ".join(f"{c} IS NOT NULL" for c in self.columns[key]) + ")"

    def text(self, key: KeySet) -> str:
        """The key as one value that differs for different keys."""
        own = [f"hex({c})" if _digested(spec) else c for c, spec in zip(self.columns[key], key.specs)]
        if len(own) == 1:
            return f"CAST({own[0]} AS STRING)"
        return "to_json(struct(" + ", ".join(f"{c} AS c{i}" for i, c in enumerate(own)) + "))"


def _part(when: str, rule: int, key: str = "NULL", child: str = "0", parent: str = "false", failed: str = "0", total: str = "0") -> str:
    """SQL of what a row of counts says about a rule, where ``when`` holds."""
    number = lambda c: f"CAST({c} AS BIGINT)"
    return (f"IF({when}, named_struct('rule', {rule}, 'key', CAST({key} AS STRING), 'child', {number(child)}, 'parent', {parent}, "
            f"'failed', {number(failed)}, 'total', {number(total)}), NULL)")


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def result_rows(found: DataFrame, names: list[tuple[str, str, str]]) -> DataFrame:
    """Check rows from (rule, failed, total), rule being a place in ``names``."""
    named = [F.expr(f"array({', '.join(_quoted(n[j]) for n in names)})[rule]").alias(c) for j, c in enumerate(("table_fqn", "column", "test_name"))]
    return (found.select(*named, F.expr("CAST(failed AS BIGINT) AS failed_rows"), F.expr("CAST(total AS BIGINT) AS total_rows"))
            .selectExpr("concat_ws('.', table_fqn, column, test_name) AS test_fqn", "table_fqn", "column", "test_name",
                        f"IF(failed_rows > 0, '{FAILED}', '{SUCCESS}') AS status", "failed_rows", "total_rows",
                        "format_string('%d of %d rows failed %s', failed_rows, total_rows, test_name) AS result"))


def rule_name(fqn: str, rule: Rule) -> tuple[str, str, str]:
    column = "_".join(rule.columns or [rule.column]) if rule.kind == "unique" else rule.column
    return fqn, column, rule.test_name


def run_suite(tables: dict[str, DataFrame], rules: dict[str, list[Rule]]) -> DataFrame:
    """Run every rule with one scan per table.

    A reference's parent is a table of the suite by its name, (name, key), which
    then gives its keys from its own scan, or a DataFrame, (df, key), which is
    one table more.  The distinct keys of child and parent meet in one
    aggregate by (rule, key); all other results are sums of what the scans give.
    """
    if not tables:
        raise ValueError("run_suite needs at least one table")
    spark = next(iter(tables.values())).sparkSession
    listed = [(fqn, r) for fqn, rs in rules.items() for r in rs]
    if not listed:
        return spark.createDataFrame([], CHECK_SCHEMA)
    frames, keys, parts = dict(tables), {fqn: [] for fqn in tables}, {fqn: [] for fqn in tables}
    for i, (fqn, r) in enumerate(listed):
        if r.kind == "unique":
            k = key_of(frames[fqn], r)
            keys[fqn].append(k)
            parts[fqn].append(lambda s, k=k, i=i: _part(s.is_set(k), i, total="n", failed=f"IF({s.full(k)}, n - 1, 0)"))
        elif r.kind == "reference":
            parent, pk = r.arg
            if not isinstance(parent, str):
                name = f"parent {i}"
                frames[name], keys[name], parts[name], parent = parent, [], [], name
            kind = common_type(type_of(frames[fqn], r.column), type_of(frames[parent], pk))
            child, own = KeySet(((r.column, kind),)), KeySet(((pk, kind),))
            keys[fqn].append(child)
            keys[parent].append(own)
            parts[fqn] += [lambda s, k=child, i=i: _part(f"{s.is_set(k)} AND {s.full(k)}", i, key=s.text(k), child="n"),
                           lambda s, k=child, i=i: _part(f"{s.is_set(k)} AND NOT {s.full(k)}", i, total="n")]
            parts[parent].append(lambda s, k=own, i=i: _part(f"{s.is_set(k)} AND {s.full(k)}", i, key=s.text(k), parent="true"))
        else:
            j = sum(x.kind in ROW_LOCAL for f, x in listed[:i] if f == fqn)
            parts[fqn].append(lambda s, i=i, j=j: _part(s.is_set(None), i, failed=f"_f{j}", total="n"))
    # a row of nothing for every rule, so that rules over empty tables come out too
    told = spark.range(len(listed)).selectExpr("CAST(id AS INT) AS rule", "CAST(NULL AS STRING) AS key", "0L AS child", "false AS parent",
                                               "0L AS failed", "0L AS total")
    for fqn, df in frames.items():
        if parts[fqn]:
            scan = SharedScan(df, keys[fqn], [r for f, r in listed if f == fqn and r.kind in ROW_LOCAL])
            said = f"filter(array({', '.join(p(scan) for p in parts[fqn])}), x -> x IS NOT NULL)"
            told = told.unionByName(scan.counts.selectExpr(f"inline({said})"))
    met = told.groupBy("rule", "key").agg(F.expr("sum(child) AS child"), F.expr("max(parent) AS parent"), F.expr("sum(failed) AS failed"),
                                          F.expr("sum(total) AS total"))
    found = met.groupBy("rule").agg(F.expr("sum(failed + IF(parent, 0, child)) AS failed"), F.expr("sum(total + child) AS total"))
    return result_rows(found, [rule_name(*x) for x in listed]).select(*CHECK_COLUMNS)
