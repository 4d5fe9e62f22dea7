"""Queries for graphs: the supply graph of the given tables and the relationship graph of control entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.catalog import nested
from weftwork.catalog.registry import duck, query
from weftwork.catalog.views import ENTRIES
from weftwork.plans import graph as G
from weftwork.plans import lineage as N

c = F.col
_E = f"({duck(ENTRIES)})"

# Acyclic: part → supplier → nation → region.
SUPPLY = """
SELECT DISTINCT 'P' || CAST(l_partkey AS STRING) AS src, 'S' || CAST(l_suppkey AS STRING) AS dst FROM {lineitem}
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'N' || CAST(s_nationkey AS STRING) FROM {supplier}
UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING) FROM {nation}
"""
# With cycles: users in blocks of ten step to one of the next three of their block, round and round except in every
# third block, which only goes up; high values lead on to the next block or to a leaf, so components form chains.
STEPS = """
SELECT DISTINCT 'U' || CAST(user_id AS STRING) AS src,
  CASE WHEN value > 480 THEN 'V' || CAST(CAST(floor(value) AS BIGINT) AS STRING)
       WHEN value > 400 OR (block % 3 = 0 AND step < user_id) THEN 'U' || CAST(user_id + 10 AS STRING)
       ELSE 'U' || CAST(step AS STRING) END AS dst
FROM (SELECT *, block * 10 + (user_id + 1 + event_id % 3) % 10 AS step
      FROM (SELECT *, CAST(floor(user_id / 10) AS BIGINT) AS block FROM {events}) b) e
"""


@query("neighbours", f"SELECT src AS node, dst AS neighbour FROM ({duck(SUPPLY)}) e UNION SELECT dst, src FROM ({duck(SUPPLY)}) e")
def neighbours(t):
    return G.neighbours(t.sql(SUPPLY))


@query("reachability", f"""
WITH RECURSIVE e AS ({duck(SUPPLY)}), seen(node) AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_size < 3
  UNION SELECT dst FROM e JOIN seen ON src = node) SELECT node FROM seen""")
def reachability(t):
    seeds = t.part.filter("p_size < 3").select(F.concat(F.lit("P"), c("p_partkey").cast("string")).alias("node"))
    return G.reachable(t.sql(SUPPLY), seeds)


_TREE = """SELECT 'T' || CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS STRING) AS src, 'T' || CAST(s_suppkey AS STRING) AS dst FROM {supplier} WHERE s_suppkey > 1
UNION ALL SELECT 'T' || CAST(s_suppkey AS STRING), 'T' || CAST(s_suppkey + 3 AS STRING) FROM {supplier} WHERE s_suppkey > 0"""


@query("hop_path", f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({duck(_TREE)}) x), walk(node, hops, path) AS (SELECT 'T1', 0, ['T1']
  UNION SELECT node, hops, path FROM (
    SELECT dst AS node, hops + 1 AS hops, list_append(path, dst) AS path,
      row_number() OVER (PARTITION BY dst ORDER BY list_append(path, dst)) AS rn FROM walk JOIN e ON src = node) n WHERE rn = 1 AND hops < 40),
best AS (SELECT node, min(hops) AS hops FROM walk GROUP BY 1)
SELECT b.node, b.hops, min(array_to_string(path, '>')) AS path FROM best b JOIN walk w ON w.node = b.node AND w.hops = b.hops GROUP BY 1, 2""")
def hop_path(t):
    out = G.shortest_paths(t.sql(_TREE), "T1")
    return out.select("node", "hops", F.array_join("path", ">").alias("path"))


@query("levels", """
WITH RECURSIVE lv(k, level) AS (SELECT s_suppkey, CASE WHEN s_suppkey < 2 THEN s_nationkey % 4 ELSE -1 END FROM supplier WHERE s_suppkey < 2
  UNION ALL SELECT s_suppkey, greatest(level + 1, s_nationkey % 4) FROM supplier JOIN lv ON CAST(floor(s_suppkey / 2) AS BIGINT) = k WHERE s_suppkey > 1)
SELECT 'T' || CAST(k AS VARCHAR) AS node, level FROM lv""")
def levels(t):
    name = lambda k: F.concat(F.lit("T"), k.cast("bigint").cast("string"))
    deps = t.supplier.filter("s_suppkey > 1").select(name(c("s_suppkey")).alias("node"), name(F.floor(c("s_suppkey") / 2)).alias("depends_on"))
    ranks = t.supplier.select(name(c("s_suppkey")).alias("node"), (c("s_nationkey") % 4).alias("rank"))
    return G.levels(deps, ranks)


@query("workflow_levels", """
WITH RECURSIVE t AS (SELECT s_suppkey AS k, 'wf' || CAST(s_nationkey % 3 AS VARCHAR) AS workflow, s_nationkey * 10 AS o FROM supplier),
r AS (SELECT k, workflow, dense_rank() OVER (PARTITION BY workflow ORDER BY o) - 1 AS rank FROM t),
lv(k, workflow, level) AS (SELECT k, workflow, rank FROM r UNION SELECT c.k, c.workflow, level + 1 FROM lv p JOIN r c ON CAST(floor(c.k / 2) AS BIGINT) = p.k AND c.workflow = p.workflow AND c.k > 1)
SELECT workflow, 'T' || CAST(k AS VARCHAR) AS task, max(level) AS level FROM lv GROUP BY 1, 2""")
def workflow_levels(t):
    name = lambda k: F.concat(F.lit("T"), k.cast("bigint").cast("string"))
    tasks = t.supplier.select(F.concat(F.lit("wf"), (c("s_nationkey") % 3).cast("string")).alias("workflow"), name(c("s_suppkey")).alias("task"), (c("s_nationkey") * 10).alias("execution_order"))
    deps = t.supplier.filter("s_suppkey > 1").select(name(c("s_suppkey")).alias("task"), name(F.floor(c("s_suppkey") / 2)).alias("depends_on"))
    return G.workflow_levels(tasks, deps).withColumn("level", c("level").cast("bigint"))


@query("cycles", f"""
WITH RECURSIVE e AS (SELECT src, dst FROM ({duck(STEPS)}) x WHERE src <> dst), walk(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM walk JOIN e ON b = src)
SELECT DISTINCT a AS node FROM walk WHERE a = b""")
def cycles(t):
    return G.cycle_members(t.sql(STEPS))


@query("degree_report", f"""
WITH e AS (SELECT DISTINCT src, dst FROM ({duck(SUPPLY)}) x), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
i AS (SELECT dst AS node, count(*) AS fan_in FROM e GROUP BY 1), o AS (SELECT src AS node, count(*) AS fan_out FROM e GROUP BY 1)
SELECT node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) >= 2 AS is_fan_in, coalesce(fan_out, 0) >= 2 AS is_fan_out,
  fan_in IS NULL AS source_only, fan_out IS NULL AS no_consumer FROM n LEFT JOIN i USING (node) LEFT JOIN o USING (node)""")
def degree_report(t):
    return G.degree_report(t.sql(SUPPLY))


_EDGES = f"""
SELECT DISTINCT 'recipe:' || recipe AS "from", 'table:' || target AS "to", 'writes' AS kind FROM {_E} e
UNION SELECT 'table:' || source_1, 'recipe:' || recipe, 'source' FROM {_E} e UNION SELECT 'table:' || source_2, 'recipe:' || recipe, 'source' FROM {_E} e
UNION SELECT 'table:' || lookup_1, 'recipe:' || recipe, 'lookup' FROM {_E} e"""


@query("graph_edges", _EDGES)
def graph_edges(t):
    return G.graph_edges(nested.entries(t))


def _paths(t):
    """Recipe files exist for the entries that are not of layer QDM."""
    return nested.entries(t).filter("layer <> 'QDM'").select("recipe", F.concat_ws("/", "mapping_xml_dir", "recipe").alias("path"))


@query("graph_nodes", f"""
WITH e AS (SELECT * FROM {_E} x), named AS (SELECT target AS t, entry_order, layer, 0 AS reader FROM e UNION ALL SELECT source_1, entry_order, layer, 1 FROM e
  UNION ALL SELECT source_2, entry_order, layer, 1 FROM e UNION ALL SELECT lookup_1, entry_order, layer, 1 FROM e),
modes AS (SELECT target AS t, arg_min(write_mode, entry_order) AS write_mode, arg_min(partition_type, entry_order) AS partition_type FROM e GROUP BY 1)
SELECT 'recipe:' || recipe AS id, 'recipe' AS kind, layer, coalesce(CASE WHEN layer <> 'QDM' THEN mapping_xml_dir END, '-') AS mapping_path,
  layer <> 'QDM' AS has_recipe, workflow, execution_order, '-' AS write_mode, '-' AS partition_type FROM e
UNION ALL SELECT 'table:' || t, 'table', arg_min(layer, (reader, entry_order)), '-', FALSE, '-', -1, coalesce(any_value(write_mode), '-'),
  coalesce(any_value(partition_type), '-') FROM named LEFT JOIN modes USING (t) GROUP BY t""")
def graph_nodes(t):
    out = G.graph_nodes(nested.entries(t), _paths(t))
    dash = lambda n: F.coalesce(n, F.lit("-")).alias(n)
    return out.select("id", "kind", "layer", dash("mapping_path"), F.coalesce("has_recipe", F.lit(False)).alias("has_recipe"), dash("workflow"),
                      F.coalesce("execution_order", F.lit(-1)).alias("execution_order"), dash("write_mode"), dash("partition_type"))


@query("recipe_dependencies", f"""
WITH e AS ({_EDGES}) SELECT DISTINCT r."to" AS recipe, w."from" AS depends_on FROM e r JOIN e w ON r."from" = w."to"
WHERE r.kind IN ('source', 'lookup') AND w.kind = 'writes' AND r."to" <> w."from" """)
def recipe_dependencies(t):
    return G.recipe_deps(G.graph_edges(nested.entries(t)))


@query("workflow_clusters", f"SELECT CASE WHEN trim(workflow) = '' THEN 'UNGROUPED' ELSE workflow END AS workflow, recipe FROM {_E} e")
def workflow_clusters(t):
    return G.clusters(G.graph_nodes(nested.entries(t), _paths(t)))


@query("connector_lineage", """
SELECT 'm_' || CAST(o_orderkey AS VARCHAR) AS mapping, 'TGT' AS target_instance, f AS target_field, 'SRC' AS source_instance, s AS source_field
FROM orders, (VALUES ('KEY', 'ID'), ('TOTAL', 'PRICE'), ('TOTAL', 'TAX'), ('CODE', 'STATUS')) m(f, s)
WHERE f <> 'CODE' OR o_orderstatus = 'P'""")
def connector_lineage(t):
    """One mapping an order: source → expression (inst. EXP1 of EXP) → filter → target; CODE is linked only for status P.

    Ports have names beyond plain words, and expressions name others in texts and comments."""
    mapping = F.concat(F.lit("m_"), c("o_orderkey").cast("string")).alias("mapping")
    links = [("SRC", "ID", "EXP1", "AÑO"), ("SRC", "PRICE", "EXP1", "PRICE"), ("SRC", "TAX", "EXP1", "TAX$Ñ#"), ("EXP1", "OUT_ID", "FIL", "ID"),
             ("EXP1", "GROSS", "FIL", "GROSS"), ("FIL", "ID", "TGT", "KEY"), ("FIL", "GROSS", "TGT", "TOTAL")]
    text = ["from_instance", "from_field", "to_instance", "to_field"]
    rows = lambda items, names: F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, i)]) for i in items])).alias("x")
    connectors = t.orders.select(mapping, rows(links, text)).select("mapping", "x.*").union(
        t.orders.filter("o_orderstatus = 'P'").select(mapping, *[F.lit(v).alias(n) for n, v in zip(text, ("SRC", "STATUS", "TGT", "CODE"))]))
    ports = [("EXP", "AÑO", None), ("EXP", "PRICE", None), ("EXP", "TAX$Ñ#", None), ("EXP", "OUT_ID", "LPAD(AÑO, 9, 'PRICE''s') -- PRICE"),
             ("EXP", "NET", "PRICE * 1"), ("EXP", "GROSS", "NET /* AÑO\n */ + TAX$Ñ# // AÑO"), ("FIL", "ID", None), ("FIL", "GROSS", None)]
    placed = t.orders.select(mapping, rows(ports, ["transformation", "name", "expression"])).select("mapping", "x.*")
    kinds = [("SRC", "SRC", "SOURCE"), ("EXP1", "EXP", "TRANSFORMATION"), ("FIL", "FIL", "TRANSFORMATION"), ("TGT", "TGT", "TARGET")]
    instances = t.orders.select(mapping, rows(kinds, ["name", "transformation", "type"])).select("mapping", "x.*")
    return N.connector_lineage(connectors, placed, instances)


_PAIRS = """SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id,
  CASE l_suppkey % 5 WHEN 0 THEN 'filter' WHEN 1 THEN 'storedProcedure' WHEN 2 THEN 'java' WHEN 3 THEN 'storedProcedure' ELSE 'union' END AS existing,
  CASE l_linenumber WHEN 1 THEN 'router' WHEN 2 THEN 'storedProcedure' WHEN 3 THEN 'table' WHEN 4 THEN 'aggregator' ELSE 'storedProcedure' END AS candidate,
  l_quantity FROM {lineitem}"""


@query("fan_in_verdict", f"""
SELECT id, candidate, CASE WHEN candidate = 'table' OR bool_or(existing = 'java' AND l_quantity > 10) THEN 'warn'
  WHEN candidate IN ('router', 'aggregator') AND bool_or(l_quantity > 10) THEN 'block'
  WHEN candidate = 'storedProcedure' AND bool_or(existing IN ('filter', 'union') AND l_quantity > 10) THEN 'block' ELSE 'ok' END AS verdict
FROM ({duck(_PAIRS)}) p GROUP BY 1, 2""")
def fan_in_verdict(t):
    pairs = t.sql(_PAIRS).select("id", "candidate", F.when(c("l_quantity") > 10, c("existing")).alias("existing"))
    return N.fan_in_verdict(pairs)




@query("source_rename", """
SELECT CAST(p_partkey AS VARCHAR) AS mapping, CAST(n AS INT) AS pos,
  CASE WHEN p_size % 2 = 0 THEN 'ODS_' || upper(replace(p_name, ' ', '_')) ELSE 'DWH_' || p_type END AS new_target,
  CASE WHEN p_size % 2 = 0 AND n = 1 THEN 'STG_' || upper(replace(p_name, ' ', '_'))
       WHEN n = 0 THEN 'FF_' || p_type WHEN n = 1 THEN 'FF_' || upper(replace(p_name, ' ', '_')) || '_D'
       WHEN p_size % 2 = 0 THEN 'STG_' || upper(p_type) ELSE 'ODS_' || upper(p_type) END AS new_source
FROM part, (VALUES (0), (1), (2)) i(n)""")
def source_rename(t):
    target = F.when(c("p_size") % 2 == 0, F.concat(F.lit("STG_"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))).otherwise(F.concat(F.lit("DWH_"), "p_type"))
    name = F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))
    sources = F.array(F.concat(F.lit("FF_"), "p_type"), F.concat(F.lit("FF_"), name, F.lit("_D")), F.concat(F.lit("STG_"), F.upper("p_type")))
    rows = t.part.select(c("p_partkey").cast("string").alias("mapping"), target.alias("target"), F.posexplode(sources).alias("pos", "source"))
    return N.rename_sources(rows)
