"""Queries: CSV round trip, table resolution, appends, replace, declared
schemas, added columns, JSON payloads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekeeper.plans import standins as S
from tablekeeper.plans.registry import query, table
from tablekeeper.session import shared_dir
from tablekeeper.sources import files
from tablekeeper.sources.versions import VersionedTable, replace_table

CUSTOMER_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("src_csv", oracle="SELECT * FROM customer")
def q_src_csv(spark, d):
    """Write the customer table as CSV with a header, read it back into the declared schema."""
    path = shared_dir(spark, "csv")
    files.write_csv(table(spark, d, "customer"), path)
    return files.read_csv(spark, path, CUSTOMER_SCHEMA)


@query("src_table", oracle="SELECT * FROM orders")
def q_src_table(spark, d):
    """A four-part name resolves to schema.table, which the catalog maps to a location."""
    catalog = lambda name: f"{d.rstrip('/')}/{name.split('.')[1]}.parquet"
    return files.read_table(spark, "svc.db.raw.orders", catalog)


@query("sink_append", oracle="SELECT * FROM orders")
def q_sink_append(spark, d):
    """Two appends; the second lists its columns in another order and is bound by name."""
    path = shared_dir(spark, "append")
    o = table(spark, d, "orders")
    files.append_to(o.filter(F.col("o_orderkey") % 2 == 0), path)
    files.append_to(o.filter(F.col("o_orderkey") % 2 == 1).select(*reversed(o.columns)), path)
    return spark.read.parquet(path)


@query("sink_replace", oracle="SELECT * FROM orders WHERE o_orderstatus = 'F'")
def q_sink_replace(spark, d):
    """Load, then replace the table's contents; readers see the new version only after the swap."""
    vt = VersionedTable(spark, shared_dir(spark, "replace"))
    o = table(spark, d, "orders")
    replace_table(vt, o)
    replace_table(vt, vt.read().filter(F.col("o_orderstatus") == "F"))
    return vt.read()


DECLARED = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("email", T.StringType()),
    T.StructField("tier", T.StringType()), T.StructField("is_active", T.BooleanType()),
    T.StructField("balance", T.DecimalType(12, 2)),
])
DEFAULTS = {"email": "none@example.com", "tier": "standard", "is_active": True}


@query("conform_defaults", oracle=f"""
SELECT c_custkey AS id, email, 'standard' AS tier, true AS is_active, CAST(round(c_acctbal * 100) / 100 AS DECIMAL(12,2))
  AS balance FROM {S.CUSTOMER_SPIKED_SQL} c""")
def q_conform_defaults(spark, d):
    """Declared types and defaults: omitted columns get their default, explicit NULL e-mails stay NULL."""
    src = S.customer_spiked(spark, d).select(F.col("c_custkey").alias("id"), "email",
                                             (F.round(F.col("c_acctbal") * 100) / 100).alias("balance"))
    return files.conform(src, DECLARED, DEFAULTS)


@query("add_column", oracle="SELECT *, CAST(NULL AS VARCHAR) AS customer_email FROM customer")
def q_add_column(spark, d):
    c = files.add_column_if_missing(table(spark, d, "customer"), "customer_email", "string")
    return files.add_column_if_missing(c, "c_name", "string")


def payloads(spark, d):
    """Diagnosis payloads as JSON text, one per event (failed events carry one
    failing node with two failing tests; others none)."""
    e = table(spark, d, "events")
    name = F.element_at(F.array(*[F.lit(x) for x in S.TEST_NAMES]), (F.col("event_id") % 4 + 1).cast("int"))
    fqn = F.format_string("svc.db.mart.t%d", "user_id")
    tc = lambda n: F.format_string('{"name": "%s", "testCaseFQN": "%s.%s", "result": "%s rows"}',
                                   n, fqn, n, F.floor("value").cast("bigint"))
    edges = F.when(F.col("event_id") % 3 == 0, F.lit("[]")).when(
        F.col("event_id") % 3 == 1, F.lit('[{"fromEntity": "a", "toEntity": "b"}]')).otherwise(
        F.lit('[{"fromEntity": "a", "toEntity": "b"}, {"fromEntity": "a", "toEntity": "c"}]'))
    failed = F.format_string(
        '{"status": "failed", "upstreamAnalysis": {"failingUpstreamNodesCount": 1, "failingUpstreamNodes": '
        '[{"fullyQualifiedName": "%s", "failingTestCases": {"testCaseResults": [%s, %s]}}]}, '
        '"lineage": {"downstreamEdges": %s}}', fqn, tc(name), tc(F.lit("row_count")), edges)
    ok = F.format_string('{"status": "success", "upstreamAnalysis": {"failingUpstreamNodesCount": 0, '
                         '"failingUpstreamNodes": []}, "lineage": {"downstreamEdges": %s}}', edges)
    return e.select("event_id", F.when(F.col("event_type") == "error", failed).otherwise(ok).alias("payload"))


def _flat_sql(pos: int) -> str:
    name = "name" if pos == 0 else "'row_count'"
    return (f"SELECT event_id, 'failed' AS status, de AS downstream_edges, 0 AS node_pos, "
            f"'svc.db.mart.t' || CAST(user_id AS VARCHAR) AS node_fqn, {pos} AS test_pos, {name} AS test_name, "
            f"'svc.db.mart.t' || CAST(user_id AS VARCHAR) || '.' || {name} AS test_fqn, "
            f"CAST(v AS VARCHAR) || ' rows' AS result FROM e WHERE event_type = 'error'")


@query("flatten_diagnosis", oracle=f"""
WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS v,
             ['email_not_null','id_duplicate_check','phone_format_check','row_count'][event_id % 4 + 1] AS name,
             CAST(event_id % 3 AS INTEGER) AS de FROM events)
{_flat_sql(0)} UNION ALL {_flat_sql(1)}
UNION ALL
SELECT event_id, 'success', de, NULL, NULL, NULL, NULL, NULL, NULL FROM e WHERE event_type <> 'error'""")
def q_flatten_diagnosis(spark, d):
    return files.flatten_diagnosis(payloads(spark, d), "payload", "event_id")


@query("event_props", oracle="""
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def q_event_props(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", files.json_field("props", "$.k", "int").alias("k"))
