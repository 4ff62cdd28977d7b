"""Lineage: bounded-depth tracing, impact counts, graph tables.

``trace`` is a breadth-first frontier loop written as DataFrame joins: each
hop joins the current frontier to the edge list, drops (root, node) pairs
already visited (anti join) and keeps the minimum depth.  The loop runs
``max_depth`` hops at most (the reference asks for 2-3).  The visited set
is read twice per hop (to extend the frontier and to drop revisits), so it is
cut from its lineage every second hop by writing it as a table into the
cluster's checkpoint folder (``session.materialize``): the plan never holds more than four
copies of a hop (identical copies share one shuffle through exchange reuse).  A node with a huge fan-out is a skewed join key; AQE's skew-join
split handles it, and frontier rows are de-duplicated before each join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeeper.functions.text import last_part
from tablekeeper.session import materialize

_CUT_EVERY = 2
UNKNOWN_TYPE = "UNKNOWN"


def trace(edges: DataFrame, roots: DataFrame, direction: str = "down", max_depth: int = 2,
          src: str = "src", dst: str = "dst", root_col: str = "root", include_self: bool = False,
          cut_every: int = _CUT_EVERY) -> DataFrame:
    """All nodes within ``max_depth`` hops of each root: (root, node, depth = minimum hops).

    direction "down" follows src -> dst, "up" follows dst -> src.  Cycles are
    safe: a (root, node) pair is expanded once, at its smallest depth.
    ``cut_every=0`` leaves the cuts to a caller that writes the result itself.
    """
    if direction not in ("down", "up"):
        raise ValueError(direction)
    a, b = (src, dst) if direction == "down" else (dst, src)
    hop = edges.select(F.col(a).alias("node"), F.col(b).alias("_to")).filter(
        F.col("node").isNotNull() & F.col("_to").isNotNull()).distinct()
    seeds = roots.select(F.col(root_col).alias("root")).filter(F.col("root").isNotNull()).distinct()
    visited = seeds.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    for d in range(1, max_depth + 1):
        frontier = visited.filter(F.col("depth") == d - 1).select("root", "node")
        nxt = (frontier.join(hop, "node", "inner")
               .select("root", F.col("_to").alias("node")).distinct())
        nxt = nxt.join(visited.select("root", "node"), ["root", "node"], "left_anti")
        visited = visited.unionByName(nxt.select("root", "node", F.lit(d).alias("depth")))
        # each hop reads the visited set twice, so the plan doubles per hop; a reliable
        # checkpoint every second hop keeps it at most four copies deep
        if cut_every and d % cut_every == 0 and d < max_depth:
            visited = materialize(visited, "trace")
    out = visited if include_self else visited.filter(F.col("depth") > 0)
    return out.select("root", "node", F.col("depth").cast("int").alias("depth"))


def impact_edges(edges: DataFrame, roots: DataFrame, max_depth: int = 2, src: str = "src", dst: str = "dst",
                 root_col: str = "root") -> DataFrame:
    """Edges of each root's downstream lineage graph: edges leaving a node at depth < max_depth."""
    reach = trace(edges, roots, "down", max_depth - 1, src, dst, root_col, include_self=True) if max_depth > 0 \
        else None
    if reach is None:
        return edges.limit(0).select(F.lit(None).alias("root"), src, dst)
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("dst"))
    return reach.join(e, "node", "inner").select("root", F.col("node").alias("src"), "dst")


def downstream_impact(edges: DataFrame, roots: DataFrame, max_depth: int = 2, src: str = "src",
                      dst: str = "dst", root_col: str = "root") -> DataFrame:
    """Per root: downstream edge count (severity) and distinct non-NULL targets (display)."""
    ie = impact_edges(edges, roots, max_depth, src, dst, root_col)
    # two-level count: (root, target) first, so a root with a huge downstream set is
    # spread by target before the per-root totals combine map-side
    per_target = ie.groupBy("root", "dst").agg(F.count(F.lit(1)).alias("n"))
    counted = per_target.groupBy("root").agg(F.sum("n").alias("downstream_edges"),
                                             F.count("dst").alias("downstream_assets"))
    r = roots.select(F.col(root_col).alias("root")).distinct()
    return (r.join(counted, "root", "left")
            .select("root", F.coalesce("downstream_edges", F.lit(0)).cast("bigint").alias("downstream_edges"),
                    F.coalesce("downstream_assets", F.lit(0)).cast("bigint").alias("downstream_assets")))


def named_edges(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst",
                node_id: str = "id", node_name: str = "fqn") -> DataFrame:
    """Edges with both ends resolved to node names; edges with an unknown end drop."""
    n1 = nodes.select(F.col(node_id).alias("_a"), F.col(node_name).alias("from_name"))
    n2 = nodes.select(F.col(node_id).alias("_b"), F.col(node_name).alias("to_name"))
    j = edges.join(n1, edges[src] == n1["_a"], "inner").join(n2, edges[dst] == n2["_b"], "inner")
    return j.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "from_name", "to_name")


def resolve_name(ids: DataFrame, nodes: DataFrame, id_col: str = "id", node_id: str = "id",
                 node_name: str = "fqn") -> DataFrame:
    """Single-id lookup: the node's name, or the id itself when the node is unknown."""
    n = nodes.select(F.col(node_id).alias("_nid"), F.col(node_name).alias("_nname"))
    j = ids.join(n, ids[id_col] == n["_nid"], "left")
    return j.withColumn("name", F.coalesce(F.col("_nname"), F.col(id_col).cast("string"))).drop("_nid", "_nname")


def lineage_graph(center: DataFrame, nodes: DataFrame, up_edges: DataFrame, down_edges: DataFrame
                  ) -> tuple[DataFrame, DataFrame]:
    """Graph tables for display, per center.

    center: (center, center_fqn, center_name, center_type)
    nodes: (center, id, fqn, name, type) - the nodes array of each lineage answer
    up_edges / down_edges: (center, from_id, to_id) - edges of each answer

    Nodes: the center first, then upstream ``from`` ends, then downstream
    ``to`` ends, then leftover nodes (direction from edge membership, else
    'unknown'); each fqn once per center, first direction wins.  Edge ends
    missing from ``nodes`` are skipped.  Edges: upstream edges become
    (from -> center, 'data flow'), downstream (center -> to, 'impacts');
    duplicate (from, to) pairs keep the first label.
    """
    # a node without a full name goes by its id, one without a name by the last part of its full name
    fqn = F.coalesce("fqn", F.col("id").cast("string"))
    nmap = nodes.select("center", F.col("id").alias("nid"), fqn.alias("nfqn"), F.coalesce("name", last_part(fqn)).alias("nname"),
                        F.coalesce("type", F.lit(UNKNOWN_TYPE)).alias("ntype"))
    cfqn = F.coalesce("center_fqn", F.col("center").cast("string"))
    c = center.select("center", cfqn.alias("fqn"), F.coalesce("center_name", last_part(cfqn)).alias("label"),
                      F.coalesce("center_type", F.lit(UNKNOWN_TYPE)).alias("type"), F.lit(True).alias("is_center"),
                      F.lit("center").alias("direction"), F.lit(0).alias("rank"))
    up = (up_edges.select("center", F.col("from_id").alias("nid")).join(nmap, ["center", "nid"])
          .select("center", F.col("nfqn").alias("fqn"), F.col("nname").alias("label"),
                  F.col("ntype").alias("type"), F.lit(False).alias("is_center"),
                  F.lit("upstream").alias("direction"), F.lit(1).alias("rank")))
    down = (down_edges.select("center", F.col("to_id").alias("nid")).join(nmap, ["center", "nid"])
            .select("center", F.col("nfqn").alias("fqn"), F.col("nname").alias("label"),
                    F.col("ntype").alias("type"), F.lit(False).alias("is_center"),
                    F.lit("downstream").alias("direction"), F.lit(2).alias("rank")))
    up_ids = up_edges.select("center", F.col("from_id").alias("nid")).distinct().withColumn("_up", F.lit(True))
    down_ids = down_edges.select("center", F.col("to_id").alias("nid")).distinct().withColumn("_down", F.lit(True))
    rest = (nmap.join(up_ids, ["center", "nid"], "left").join(down_ids, ["center", "nid"], "left")
            .select("center", F.col("nfqn").alias("fqn"), F.col("nname").alias("label"), F.col("ntype").alias("type"),
                    F.lit(False).alias("is_center"),
                    F.when(F.col("_up"), "upstream").when(F.col("_down"), "downstream").otherwise("unknown")
                    .alias("direction"), F.lit(3).alias("rank")))
    allnodes = c.unionByName(up).unionByName(down).unionByName(rest)
    # first occurrence per (center, fqn): min over (rank, direction) is an aggregate, not a window,
    # so a center with a huge neighbourhood still combines map-side
    first = allnodes.groupBy("center", "fqn").agg(
        F.min(F.struct("rank", "direction", "label", "type", "is_center")).alias("f"))
    node_table = first.select("center", F.col("fqn").alias("id"), F.col("f.label").alias("label"),
                              F.col("f.type").alias("type"), F.col("f.is_center").alias("is_center"),
                              F.col("f.direction").alias("direction"))
    cf = center.select("center", cfqn.alias("cfqn"))
    e_up = (up.select("center", F.col("fqn").alias("from")).join(cf, "center")
            .select("center", "from", F.col("cfqn").alias("to"), F.lit("data flow").alias("label"),
                    F.lit(0).alias("rank")))
    e_down = (down.select("center", F.col("fqn").alias("to")).join(cf, "center")
              .select("center", F.col("cfqn").alias("from"), "to", F.lit("impacts").alias("label"),
                      F.lit(1).alias("rank")))
    edge_table = (e_up.unionByName(e_down).groupBy("center", "from", "to")
                  .agg(F.min(F.struct("rank", "label")).alias("f"))
                  .select("center", "from", "to", F.col("f.label").alias("label")))
    return node_table, edge_table
