"""Queries: lineage tracing, impact, named edges, graph tables, FQN parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeeper.functions import text as T
from tablekeeper.operators import lineage
from tablekeeper.plans import standins as S
from tablekeeper.plans.registry import query, table
from tablekeeper.session import materialize


def roots(spark, d):
    """Tables under diagnosis: every node that has test results."""
    return S.test_results(spark, d).select(F.col("node").alias("root")).distinct()


ROOTS_SQL = "(SELECT DISTINCT user_id AS root FROM events)"


def _reach_sql(direction: str, depth: int, roots_sql: str = ROOTS_SQL) -> str:
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    return (f"(WITH RECURSIVE t(root, node, depth) AS (SELECT root, root, 0 FROM {roots_sql} r "
            f"UNION ALL SELECT t.root, e.{b}, t.depth + 1 FROM t JOIN {S.LINEAGE_EDGES_SQL} e ON e.{a} = t.node "
            f"WHERE t.depth < {depth}) SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM t "
            f"GROUP BY root, node)")


UP3_SQL = _reach_sql("up", 3)
DOWN1_SQL = _reach_sql("down", 1)
DOWN2_SQL = _reach_sql("down", 2)


@query("trace_downstream", oracle=f"SELECT * FROM {DOWN2_SQL} x WHERE depth > 0")
def q_trace_downstream(spark, d):
    return lineage.trace(S.lineage_edges(spark, d), roots(spark, d), "down", 2)


@query("trace_upstream", oracle=f"SELECT * FROM {UP3_SQL} x WHERE depth > 0")
def q_trace_upstream(spark, d):
    return lineage.trace(S.lineage_edges(spark, d), roots(spark, d), "up", 3)


def downstream_impact_sql(roots_sql: str = ROOTS_SQL) -> str:
    return f"""(SELECT r.root, CAST(coalesce(count(e.dst), 0) AS BIGINT) AS downstream_edges,
  CAST(count(DISTINCT e.dst) AS BIGINT) AS downstream_assets
FROM {roots_sql} r LEFT JOIN {_reach_sql("down", 1, roots_sql)} re ON re.root = r.root
LEFT JOIN {S.LINEAGE_EDGES_SQL} e ON e.src = re.node GROUP BY r.root)"""


DOWNSTREAM_IMPACT_SQL = downstream_impact_sql()


@query("downstream_impact", oracle=f"SELECT * FROM {DOWNSTREAM_IMPACT_SQL} x")
def q_downstream_impact(spark, d):
    return lineage.downstream_impact(S.lineage_edges(spark, d), roots(spark, d), 2)


@query("lineage_named_edges", oracle=f"""
SELECT e.src, e.dst, a.fqn AS from_name, b.fqn AS to_name FROM {S.LINEAGE_EDGES_SQL} e
JOIN (SELECT c_custkey AS id, 'svc.db.mart.t' || CAST(c_custkey AS VARCHAR) AS fqn FROM customer
      WHERE c_mktsegment <> 'MACHINERY') a ON e.src = a.id
JOIN (SELECT c_custkey AS id, 'svc.db.mart.t' || CAST(c_custkey AS VARCHAR) AS fqn FROM customer
      WHERE c_mktsegment <> 'MACHINERY') b ON e.dst = b.id""")
def q_lineage_named_edges(spark, d):
    return lineage.named_edges(S.lineage_edges(spark, d), known_nodes(spark, d), node_id="id", node_name="fqn")


def known_nodes(spark, d):
    """Node catalogue for name look-up (one segment of assets is not catalogued: its edges cannot resolve)."""
    return all_nodes(spark, d).filter(F.col("segment") != "MACHINERY").drop("segment")


def graph_nodes(spark, d):
    """The whole catalogue; some assets lack a full name, a name or a type."""
    n, k = all_nodes(spark, d).drop("segment"), F.col("id")
    return n.select("id", F.when(k % 10 != 7, F.col("fqn")).alias("fqn"), F.when(k % 10 != 6, F.col("name")).alias("name"),
                    F.when(k % 10 != 5, F.col("type")).alias("type"))


GRAPH_NODES_SQL = """(SELECT c_custkey AS id,
  CASE WHEN c_custkey % 10 = 7 THEN CAST(c_custkey AS VARCHAR) ELSE 'svc.db.mart.t' || CAST(c_custkey AS VARCHAR) END AS fqn,
  CASE WHEN c_custkey % 10 = 6 THEN 't' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS name,
  CASE WHEN c_custkey % 10 = 5 THEN 'UNKNOWN' WHEN c_mktsegment = 'BUILDING' THEN 'PIPELINE' ELSE 'TABLE' END AS type
  FROM customer)"""


def all_nodes(spark, d):
    c = table(spark, d, "customer").withColumn("segment", F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), F.format_string("svc.db.mart.t%d", "c_custkey").alias("fqn"),
                    F.col("c_name").alias("name"),
                    F.when(F.col("c_mktsegment") == "BUILDING", "PIPELINE").otherwise("TABLE").alias("type"), "segment")


KNOWN_NODES_SQL = """(SELECT c_custkey AS id, 'svc.db.mart.t' || CAST(c_custkey AS VARCHAR) AS fqn, c_name AS name,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'PIPELINE' ELSE 'TABLE' END AS type FROM customer
  WHERE c_mktsegment <> 'MACHINERY')"""


def graph_inputs(spark, d):
    edges = S.lineage_edges(spark, d)
    r = roots(spark, d)
    up_reach = lineage.trace(edges, r, "up", 2, include_self=True)      # edges into nodes at depth < 3
    up_e = up_reach.join(edges.withColumnRenamed("dst", "node"), "node").select(
        F.col("root").alias("center"), F.col("src").alias("from_id"), F.col("node").alias("to_id"))
    down_e = lineage.impact_edges(edges, r, 2).select(
        F.col("root").alias("center"), F.col("src").alias("from_id"), F.col("dst").alias("to_id"))
    # each answer feeds the node union, the direction flags and the edge table:
    # write it once instead of re-running the traces for every use
    up_e = materialize(up_e, "graph-up-edges")
    down_e = materialize(down_e, "graph-down-edges")
    ends = (up_e.select("center", F.col("from_id").alias("id"))
            .unionByName(up_e.select("center", F.col("to_id").alias("id")))
            .unionByName(down_e.select("center", F.col("from_id").alias("id")))
            .unionByName(down_e.select("center", F.col("to_id").alias("id")))
            .unionByName(r.select(F.col("root").alias("center"), F.col("root").alias("id"))).distinct())
    nodes = materialize(ends.join(graph_nodes(spark, d), "id"), "graph-nodes")
    cust = table(spark, d, "customer")
    center = r.join(cust, r["root"] == cust["c_custkey"]).select(
        F.col("root").alias("center"), F.format_string("svc.db.mart.t%d", "root").alias("center_fqn"),
        F.col("c_name").alias("center_name"), F.lit("TABLE").alias("center_type"))
    return center, nodes, up_e, down_e


GRAPH_CTE = f"""
up_e AS (SELECT u.root AS center, e.src AS from_id, e.dst AS to_id FROM {_reach_sql('up', 2)} u
         JOIN {S.LINEAGE_EDGES_SQL} e ON e.dst = u.node),
down_e AS (SELECT u.root AS center, e.src AS from_id, e.dst AS to_id FROM {DOWN1_SQL} u
           JOIN {S.LINEAGE_EDGES_SQL} e ON e.src = u.node),
ends AS (SELECT DISTINCT center, id FROM (SELECT center, from_id AS id FROM up_e UNION ALL SELECT center, to_id FROM up_e
         UNION ALL SELECT center, from_id FROM down_e UNION ALL SELECT center, to_id FROM down_e
         UNION ALL SELECT root, root FROM {ROOTS_SQL} rr) x),
nodes AS (SELECT ends.center, k.* FROM ends JOIN {GRAPH_NODES_SQL} k ON k.id = ends.id),
ctr AS (SELECT r.root AS center, 'svc.db.mart.t' || CAST(r.root AS VARCHAR) AS center_fqn, c.c_name AS center_name,
        'TABLE' AS center_type FROM {ROOTS_SQL} r JOIN customer c ON c.c_custkey = r.root),
upn AS (SELECT u.center, n.fqn, n.name AS label, n.type FROM up_e u JOIN nodes n ON n.center = u.center AND n.id = u.from_id),
dnn AS (SELECT u.center, n.fqn, n.name AS label, n.type FROM down_e u JOIN nodes n ON n.center = u.center AND n.id = u.to_id),
allnodes AS (
  SELECT center, center_fqn AS fqn, center_name AS label, center_type AS type, true AS is_center, 'center' AS direction, 0 AS rnk FROM ctr
  UNION ALL SELECT center, fqn, label, type, false, 'upstream', 1 FROM upn
  UNION ALL SELECT center, fqn, label, type, false, 'downstream', 2 FROM dnn
  UNION ALL SELECT n.center, n.fqn, n.name, n.type, false,
    CASE WHEN EXISTS (SELECT 1 FROM up_e u WHERE u.center = n.center AND u.from_id = n.id) THEN 'upstream'
         WHEN EXISTS (SELECT 1 FROM down_e u WHERE u.center = n.center AND u.to_id = n.id) THEN 'downstream'
         ELSE 'unknown' END, 3 FROM nodes n)"""


@query("lineage_graph", oracle=f"""
WITH {GRAPH_CTE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY center, fqn ORDER BY rnk, direction, label, type, is_center) AS rn
           FROM allnodes)
SELECT center, fqn AS id, label, type, is_center, direction FROM ranked WHERE rn = 1""")
def q_lineage_graph(spark, d):
    return lineage.lineage_graph(*graph_inputs(spark, d))[0]


@query("lineage_graph_edges", oracle=f"""
WITH {GRAPH_CTE},
ed AS (SELECT u.center, u.fqn AS "from", c.center_fqn AS "to", 'data flow' AS label, 0 AS rnk FROM upn u JOIN ctr c USING (center)
       UNION ALL SELECT u.center, c.center_fqn, u.fqn, 'impacts', 1 FROM dnn u JOIN ctr c USING (center)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY center, "from", "to" ORDER BY rnk, label) AS rn FROM ed)
SELECT center, "from", "to", label FROM ranked WHERE rn = 1""")
def q_lineage_graph_edges(spark, d):
    return lineage.lineage_graph(*graph_inputs(spark, d))[1]


def fqn_inputs(spark, d):
    """Dotted names of 1 to 6 parts cut from test FQNs."""
    tr = S.test_results(spark, d)
    parts = F.split("test_fqn", r"\.")
    return tr.select("result_id", F.array_join(F.slice(parts, 1, (F.col("result_id") % 6 + 1).cast("int")), ".")
                     .alias("fqn"))


FQN_INPUTS_SQL = f"""(SELECT result_id, array_to_string(string_split(test_fqn, '.')[1:result_id % 6 + 1], '.') AS fqn
  FROM {S.TEST_RESULTS_SQL} t)"""


@query("fqn_parts", oracle=f"""
SELECT result_id, fqn,
  CASE WHEN len(string_split(fqn, '.')) > 0 THEN string_split(fqn, '.')[1] ELSE 'default' END AS service,
  CASE WHEN len(string_split(fqn, '.')) > 1 THEN string_split(fqn, '.')[2] ELSE 'default' END AS database,
  CASE WHEN len(string_split(fqn, '.')) > 2 THEN string_split(fqn, '.')[3] ELSE 'mart' END AS schema,
  CASE WHEN len(string_split(fqn, '.')) > 3 THEN string_split(fqn, '.')[4] ELSE 'customers' END AS "table"
FROM {FQN_INPUTS_SQL} f""")
def q_fqn_parts(spark, d):
    f = fqn_inputs(spark, d)
    return f.select("result_id", "fqn", *T.fqn_parts("fqn"))


@query("resolve_node_names", oracle=f"""
SELECT e.id, coalesce(k.fqn, CAST(e.id AS VARCHAR)) AS name
FROM (SELECT DISTINCT dst AS id FROM {S.LINEAGE_EDGES_SQL} x) e LEFT JOIN {KNOWN_NODES_SQL} k ON k.id = e.id""")
def q_resolve_node_names(spark, d):
    """Single-id lookup: every edge target by its catalogue name, or its id when unknown."""
    ids = S.lineage_edges(spark, d).select(F.col("dst").alias("id")).distinct()
    return lineage.resolve_name(ids, known_nodes(spark, d).select("id", "fqn"), "id", "id", "fqn")
