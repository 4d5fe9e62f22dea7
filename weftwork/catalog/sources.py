"""Queries for scans. File scans read what Spark has just written from the given tables into the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.catalog import nested
from weftwork.catalog.registry import duck, query
from weftwork.catalog.views import DIRTY, ENTRIES, RUNS
from weftwork.session import fresh_path
from weftwork.sources import files
from weftwork.sources import tables as T

c = F.col


@query("table_source", "SELECT n_nationkey AS N_NATIONKEY, n_name AS N_NAME, n_regionkey AS N_REGIONKEY FROM nation")
def table_source(t):
    return T.table_source(t.spark, "NATION", t.root, primary_keys=["n_nationkey"])


@query("apply_schema", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, TRY_CAST(num_s AS DECIMAL(18,2)) AS num_s, TRY_CAST(o_custkey AS BIGINT) AS o_custkey,
  CAST(round(o_totalprice, 2) AS DECIMAL(38,9)) AS o_totalprice, o_orderdate FROM ({duck(DIRTY)}) d""")
def apply_schema(t):
    df = t.sql(DIRTY).withColumn("o_totalprice", F.round("o_totalprice", 2))
    return T.apply_schema(df, [("o_orderkey", "varchar2"), ("num_s", "number(p,s)", 18, 2), ("o_custkey", "number(p)", 10),
                               ("o_totalprice", "number"), ("o_orderdate", "date")])


@query("snapshot_scan", f"""
SELECT recipe_filename, run_date, avg_job_duration_in_mins_sec AS dur, status, job_id, cluster_name, app_start_iso, message
FROM ({duck(RUNS)}) r""")
def snapshot_scan(t):
    return files.snapshot_scan(t.spark, nested.snapshot_files(t)).select(
        "recipe_filename", "run_date", c("avg_job_duration_in_mins_sec").alias("dur"), "status", "job_id", "cluster_name", "app_start_iso", "message")


@query("control_scan", f"""
SELECT layer, mapping_xml_dir || '/o''dir, x' AS dir, recipe, workflow, target, execution_order,
  source_1 || ':' || CAST(active_1 AS VARCHAR) || ':' || CAST(offset_1 AS VARCHAR) || ',' || source_2 || ':true:0' AS sources,
  CASE WHEN lookup_1 = 'LKP_0' THEN '' ELSE lookup_1 END AS lookups, target || ':' || write_mode AS modes,
  target || ':' || partition_type || ':LOAD_DATE:' AS parts, 'loaded' AS state FROM ({duck(ENTRIES)}) e WHERE execution_order <> 3
UNION ALL SELECT '', '', '', '', '', CAST(count(*) AS INT), '', '', '', '', 'skipped' FROM ({duck(ENTRIES)}) e WHERE execution_order = 3""")
def control_scan(t):
    found, skipped = files.control_scan(t.spark, nested.control_files(t))
    joined = lambda arr, *fields: F.array_join(F.transform(arr, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ",")
    loaded = found.select(
        "layer", c("mapping_xml_dir").alias("dir"), "recipe", "workflow", "target", "execution_order",
        joined("sources", "table", "active", "day_offset").alias("sources"), F.array_join("lookup_tables", ",").alias("lookups"),
        joined("targets_write_mode", "target_table", "write_mode").alias("modes"),
        joined("target_partition", "target_table", "partition_type", "partition_key", "subpartition_key").alias("parts"), F.lit("loaded").alias("state"))
    blank = F.lit("")
    bad = skipped.agg(F.count("*").cast("int").alias("n")).select(
        *[blank.alias(x) for x in ("layer", "dir", "recipe", "workflow", "target")], c("n").alias("execution_order"),
        *[blank.alias(x) for x in ("sources", "lookups", "modes", "parts")], F.lit("skipped").alias("state"))
    return loaded.unionByName(bad)


@query("ddl_scan", """
SELECT 'mapping=m_' || CAST(s_suppkey AS VARCHAR) AS dir, pos, 'C' || CAST(pos AS VARCHAR) || '_' || s_name AS "column",
  CASE WHEN pos = 0 THEN 'INT64' ELSE 'STRING' END AS type, CASE WHEN s_acctbal < 0 THEN 'REQUIRED' ELSE 'NULLABLE' END AS mode
FROM supplier, (VALUES (0), (1)) p(pos)""")
def ddl_scan(t):
    root = fresh_path(t.spark, "ddl")
    column = lambda i, kind: F.struct(F.when(c("s_acctbal") < 0, "REQUIRED").otherwise("NULLABLE").alias("mode"),
                                      F.concat(F.lit(f"C{i}_"), "s_name").alias("name"), F.lit(kind).alias("type"), F.lit("").alias("description"))
    docs = t.supplier.select(F.concat(F.lit("ODS/mapping=m_"), c("s_suppkey").cast("string"), F.lit("/TABLE_"), c("s_suppkey").cast("string"), F.lit(".json")).alias("path"),
                             F.to_json(F.array(column(0, "INT64"), column(1, "STRING"))).alias("document"))
    files.write_documents(docs, root)
    return files.ddl_scan(t.spark, root).select("dir", "pos", "column", "type", "mode")


@query("mapping_xml_scan", """
SELECT 'connector' AS kind, 'm_' || CAST(s_suppkey AS VARCHAR) AS owner, 'SRC' AS a, 'EXP' AS b, s_name AS v FROM supplier
UNION ALL SELECT 'port', 'm_' || CAST(s_suppkey AS VARCHAR), 'EXP', 'OUTPUT', 'upper(' || s_name || ')' FROM supplier
UNION ALL SELECT 'attribute', 'm_' || CAST(s_suppkey AS VARCHAR), 'EXP', 'Tracing', CAST(s_nationkey AS VARCHAR) FROM supplier
UNION ALL SELECT 'instance', 'm_' || CAST(s_suppkey AS VARCHAR), 'EXP', 'Expression', 'TRANSFORMATION' FROM supplier""")
def mapping_xml_scan(t):
    """Mappings written with Spark's XML writer, one element a supplier, read back as flat tables."""
    root = fresh_path(t.spark, "xml")
    port = F.struct(c("s_name").alias("_NAME"), F.lit("string").alias("_DATATYPE"), F.lit("OUTPUT").alias("_PORTTYPE"),
                    F.concat(F.lit("upper("), "s_name", F.lit(")")).alias("_EXPRESSION"))
    step = F.struct(F.lit("EXP").alias("_NAME"), F.lit("Expression").alias("_TYPE"), F.array(port).alias("TRANSFORMFIELD"),
                    F.array(F.struct(F.lit("Tracing").alias("_NAME"), c("s_nationkey").cast("string").alias("_VALUE"))).alias("TABLEATTRIBUTE"))
    link = F.struct(F.lit("SRC").alias("_FROMINSTANCE"), c("s_name").alias("_FROMFIELD"), F.lit("EXP").alias("_TOINSTANCE"), c("s_name").alias("_TOFIELD"))
    item = F.struct(F.lit("EXP").alias("_NAME"), F.lit("EXP").alias("_TRANSFORMATION_NAME"), F.lit("Expression").alias("_TRANSFORMATION_TYPE"),
                    F.lit("TRANSFORMATION").alias("_TYPE"))
    (t.supplier.select(F.concat(F.lit("m_"), c("s_suppkey").cast("string")).alias("_NAME"), F.array(step).alias("TRANSFORMATION"),
                       F.array(item).alias("INSTANCE"), F.array(link).alias("CONNECTOR"))
     .write.format("xml").option("rootTag", "FOLDER").option("rowTag", "MAPPING").save(root))
    return _flat_xml(files.mapping_xml_scan(t.spark, root, encoding="UTF-8", names="*"))


def _flat_xml(x):
    row = lambda df, kind, owner, a, b, v: df.select(F.lit(kind).alias("kind"), c(owner).alias("owner"), c(a).alias("a"), c(b).alias("b"), c(v).alias("v"))
    return (row(x["connectors"], "connector", "mapping", "from_instance", "to_instance", "from_field")
            .union(row(x["transform_fields"], "port", "mapping", "transformation", "port_type", "expression"))
            .union(row(x["table_attributes"], "attribute", "mapping", "transformation", "name", "value"))
            .union(row(x["instances"], "instance", "mapping", "name", "kind", "type")))


@query("source_sql", """
SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY n_name""")
def source_sql(t):
    return T.source_sql(t.spark, """SELECT n_name, count(*) AS suppliers FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
        WHERE s_acctbal > 0 GROUP BY n_name""", {"supplier": t.supplier, "nation": t.nation})


@query("freshest_partition", "SELECT event_id, ts, value FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def freshest_partition(t):
    return T.freshest_partition(t.events, "ts").select("event_id", "ts", "value")


@query("active_sources", f"""
SELECT recipe, source_1 AS "table", DATE '2024-02-01' - offset_1 AS read_date FROM ({duck(ENTRIES)}) e WHERE active_1
UNION ALL SELECT recipe, source_2, DATE '2024-02-01' FROM ({duck(ENTRIES)}) e""")
def active_sources(t):
    return T.active_sources(nested.entries(t), "2024-02-01")
