"""Queries over a recipe corpus: lineage, registry, conformance and the recipe runner."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.catalog.corpus import FLAT, documents
from weftwork.catalog.registry import duck, query
from weftwork.catalog.views import DIRTY
from weftwork.plans import conformance as K
from weftwork.plans import lineage as N
from weftwork.plans.recipe import run_recipe, run_recipe_dq
from weftwork.session import fresh_path
from weftwork.sources import files

c = F.col


def _nodes(t, *columns, only=None):
    return N.expr_nodes(N.fields(N.steps(documents(t))), columns, only)


@query("recipe_scan", """
SELECT '_ETL_m_S' || CAST(s_suppkey AS VARCHAR) || '.json' AS recipe, CASE s_nationkey % 2 WHEN 0 THEN 'ODS' ELSE 'CDM' END AS layer,
  CASE s_nationkey % 2 WHEN 0 THEN 'ODS' ELSE 'CDM' END || '/m_' || CAST(s_suppkey AS VARCHAR) AS mapping_dir, s_name AS target
FROM supplier""")
def recipe_scan(t):
    """Files one a supplier, with history copies that must not be read."""
    layer = F.when(c("s_nationkey") % 2 == 0, "ODS").otherwise("CDM")
    where = F.concat(layer, F.lit("/m_"), c("s_suppkey").cast("string"))
    name = F.concat(F.lit("_ETL_m_S"), c("s_suppkey").cast("string"), F.lit(".json"))
    text = F.concat(F.lit('{"steps":[{"target":{"name":"'), "s_name", F.lit('","type":"table","fields":[]},"sources":[]}]}'))
    root = fresh_path(t.spark, "recipes")
    files.write_documents(t.supplier.select(F.explode(F.array(
        F.struct(F.concat_ws("/", where, name).alias("path"), text.alias("document")),
        F.struct(F.concat_ws("/", where, F.lit("_history"), name).alias("path"), F.lit("{}").alias("document")),
        F.struct(F.concat_ws("/", where, F.lit("TABLE.json")).alias("path"), F.lit("[]").alias("document")))).alias("x")).select("x.*"), root)
    docs = files.recipe_scan(t.spark, root)
    return docs.select("recipe", "layer", "mapping_dir", F.get_json_object("document", "$.steps[0].target.name").alias("target"))


@query("expr_nodes", FLAT + """
SELECT kind, depth, count(*) AS n, count(DISTINCT recipe) AS recipes FROM (
  SELECT recipe, 'ref' AS kind, length(path) - length(replace(path, 'parameters', '')) AS w, (length(path) - length(replace(path, 'parameters', ''))) // 10 AS depth FROM ref
  UNION ALL SELECT recipe, CASE WHEN is_lookup THEN 'lookup' ELSE 'call' END, 0, (length(path) - length(replace(path, 'parameters', ''))) // 10 FROM calls
  UNION ALL SELECT recipe, 'literal', 0, x FROM live, (VALUES (1), (1), (1), (1), (2), (2)) v(x)) n GROUP BY 1, 2""")
def expr_nodes(t):
    return _nodes(t, "kind", "depth").groupBy("kind", "depth").agg(F.count("*").alias("n"), F.count_distinct("recipe").alias("recipes"))


@query("field_refs", FLAT + """SELECT recipe, step_idx, to_step, to_field, tab AS "table", port AS ref_field, path FROM ref""")
def field_refs(t):
    return N.field_refs(_nodes(t, "path", "source", only=N.REFS))


@query("call_sites", FLAT + "SELECT name, count(*) AS calls, count(DISTINCT recipe) AS recipes FROM calls GROUP BY 1")
def call_sites(t):
    return N.call_counts(N.call_sites(_nodes(t, "path", "name", "output_field")))


@query("formula_archive", FLAT + """
SELECT recipe, 'A' AS field, 'EXP_ARITHMETIC(' || n0 || '.AMT, ' || CASE d WHEN 10 THEN '%' ELSE '*' END || ', 2)' AS formula FROM live
UNION ALL SELECT recipe, 'B', CASE WHEN d = 11 THEN 'MYSTERY_FN' WHEN m = 2 THEN 'TO_CHAR' ELSE 'EXP_IIF' END ||
  '(EXP_COMPARISON(' || n0 || '.AMT, >, 100), ''Y'', ''N'')' FROM live
UNION ALL SELECT recipe, 'C', 'LKP_C(' || n0 || '.KEY)' FROM live""")
def formula_archive(t):
    return N.formula_archive(N.fields(N.steps(documents(t)))).select("recipe", "field", "formula")


# Table DDL of the corpus: every mapping directory carries the DDL of a shared table in one of a few shapes.
def _ddl(t, outer=False):
    docs = documents(t).select("mapping_dir", F.hash("mapping_dir").alias("h"), F.expr("cast(substring(recipe, 9, 7) as int)").alias("k"))
    col = lambda n, ty: F.struct(F.lit("NULLABLE").alias("mode"), F.lit(n).alias("name"), F.lit(ty).alias("type"), F.lit("").alias("description"))
    shapes = [[col("ID", "INT64"), col("NAME", "STRING")], [col("NAME", "STRING"), col("ID", "INT64")], [col("ID", "INT64"), col("NAME", "STRING"), col("AMT", "NUMERIC")]]
    shape = F.when(c("k") % 3 == 0, F.to_json(F.array(*shapes[0]))).when(c("k") % 3 == 1, F.to_json(F.array(*shapes[1]))).otherwise(F.to_json(F.array(*shapes[2])))
    return _ddl_rows(docs.select(F.concat(c("mapping_dir"), F.lit("/T_"), (c("k") % 50).cast("string"), F.lit(".json")).alias("path"), shape.alias("value")), outer)


def _ddl_rows(docs, outer=False):
    """DDL rows with the whole mapping directory, not its last part only."""
    rows = files.ddl_columns(docs.withColumn("path", F.regexp_replace("path", "/(?=[^/]*/[^/]*$)", ":")), outer=outer)
    return rows.withColumn("dir", F.replace("dir", F.lit(":"), F.lit("/")))


_DDL = "(SELECT mapping_dir AS dir, recipe, CAST(ks AS INT) AS k, 'T_' || CAST(CAST(ks AS INT) % 50 AS VARCHAR) AS tab FROM seed)"


@query("usage_registry", FLAT + f"""
SELECT tab AS "table", count(*) FILTER (WHERE role = 'source') AS as_source, count(*) FILTER (WHERE role = 'target') AS as_target,
  count(*) FILTER (WHERE role = 'ddl') AS as_ddl FROM (SELECT DISTINCT table_name AS tab, role, path FROM declared
  UNION ALL SELECT tab, 'ddl', recipe FROM {_DDL}) u GROUP BY 1""")
def usage_registry(t):
    return N.usage_counts(N.usage(documents(t), _ddl(t, outer=True)))


@query("schema_variants", FLAT + f"""
SELECT tab AS "table", CASE WHEN k % 3 = 2 THEN 'AMT NUMERIC, ID INT64, NAME STRING' ELSE 'ID INT64, NAME STRING' END AS "columns",
  count(*) AS n_dirs, min(dir) AS first_dir FROM {_DDL} GROUP BY 1, 2""")
def schema_variants(t):
    return N.variant_summary(N.schema_variants(_ddl(t)))


@query("corpus_summary", FLAT + """
SELECT count(*) FILTER (WHERE m <= 6) AS xml_files, count(*) AS recipe_files, count(*) AS ddl_files, count(*) AS dirs,
  (SELECT string_agg(l, ',' ORDER BY l) FROM (SELECT DISTINCT split_part(mapping_dir, '/', 1) AS l FROM seed)) AS layers FROM seed""")
def corpus_summary(t):
    docs = documents(t)
    months = t.sql(_month_view())
    xml = months.filter("m <= 6").select("path")
    return N.corpus_summary(docs.select("path").union(docs.select(F.concat_ws("/", "mapping_dir", F.lit("T.json")))).union(xml))


def _month_view():
    from weftwork.catalog.corpus import SEED

    return f"SELECT mapping_dir || '/' || CASE WHEN m % 2 = 0 THEN 'map.xml' ELSE 'map.XML' END AS path, m FROM ({SEED}) s"


@query("impact", FLAT + """
SELECT lower(tab) AS "table", count(DISTINCT recipe || '/' || step_idx || '/' || to_field) AS fields, count(DISTINCT recipe) AS recipes FROM ref GROUP BY 1""")
def impact(t):
    return N.impact(N.field_refs(_nodes(t, "path", "source", only=N.REFS)))


@query("kind_pairings", FLAT + """
SELECT s.kind AS source_kind, coalesce(t.kind, '-') AS target_kind, count(*) AS n FROM src s JOIN steps t USING (recipe, step_idx) GROUP BY 1, 2""")
def kind_pairings(t):
    return N.kind_pairings(N.step_sources(N.steps(documents(t)))).withColumn("target_kind", F.coalesce("target_kind", F.lit("-")))


# --- conformance: what each rule must find -------------------------------------

_AT = "'$.steps[' || step_idx || ']"
_KEY2 = "SELECT recipe, '$.steps[2].target.{key}' AS path FROM live WHERE kind2 = '{kind}' AND pri = 1"
_REQUIRED = {
    "typ_sq_001": "SELECT recipe, '$.steps[0].target.selectDistinct' AS path FROM live WHERE d = 1",
    "typ_rtr_001": _KEY2.format(key="groups", kind="router"), "typ_agg_001": _KEY2.format(key="groupByFields", kind="aggregator"),
    "typ_nrm_001": _KEY2.format(key="normalizedFields", kind="normalizer"), "typ_java_001": _KEY2.format(key="javaCode", kind="java"),
    "typ_sp_001": _KEY2.format(key="procedureName", kind="storedProcedure"),
    "typ_rtr_003": "SELECT recipe, '$.steps[3].sources[0].group' AS path FROM live WHERE kind2 = 'router' AND pri = 3",
    "typ_jnr_001": "SELECT recipe, '$.steps[3].sources[0].joinerType' AS path FROM live WHERE kind2 = 'joinerInput' AND pri = 3"}
_UNION_KEY = "SELECT recipe, '$.steps[3].sources[0].unionTables' AS path FROM live WHERE kind2 = 'unionInput' AND pri = 3"
_REACH = """, hop AS (SELECT s.recipe, n.step_idx AS a, s.step_idx AS b FROM src s JOIN named n ON n.recipe = s.recipe AND n.lname = lower(s.name) WHERE n.step_idx <> s.step_idx),
met AS (SELECT recipe, step_idx FROM src WHERE kind = 'table' UNION SELECT hop.recipe, b FROM hop JOIN met ON met.recipe = hop.recipe AND met.step_idx = a)"""
_CLOSURE = """, link AS (SELECT DISTINCT r.recipe, lower(tab) AS a, lower(to_step) AS b FROM ref r JOIN named n ON n.recipe = r.recipe AND n.lname = lower(tab)
  WHERE trim(to_step) <> '' AND lower(tab) <> lower(to_step)),
walk AS (SELECT * FROM link UNION SELECT walk.recipe, walk.a, link.b FROM walk JOIN link ON link.recipe = walk.recipe AND link.a = walk.b)"""

VIOLATIONS = {
    "str_001": "SELECT recipe, '$.steps' AS path FROM seed WHERE d IN (22, 23)",
    "str_002": f"SELECT recipe, {_AT}.target' AS path FROM steps WHERE name IS NULL",
    "str_003": f"SELECT recipe, {_AT}.target.name' AS path FROM steps WHERE trim(name) = ''",
    "str_004": f"SELECT recipe, {_AT}.target.type' AS path FROM steps WHERE trim(type) = ''",
    "str_005": f"SELECT recipe, {_AT}.target.type' AS path FROM steps WHERE kind = 'mystery'",
    "str_006": "SELECT recipe, '$.steps' AS path FROM steps WHERE trim(name) <> '' GROUP BY recipe, name HAVING count(*) > 1",
    "str_007": f"SELECT recipe, {_AT}.target.fields' AS path FROM fld WHERE trim(name) <> '' GROUP BY recipe, step_idx, name HAVING count(*) > 1",
    "str_008": f"SELECT recipe, {_AT}.target.fields[' || field_idx || '].dataType' AS path FROM fld WHERE data_type = 'Text'",
    "str_009": f"SELECT recipe, {_AT}.target.fields[' || field_idx || '].name' AS path FROM fld WHERE trim(name) = ''",
    "typ_req": " UNION ALL ".join([*_REQUIRED.values(), _UNION_KEY]), **_REQUIRED,
    "typ_rtr_002": "SELECT recipe, '$.steps[2].target.groups' AS path FROM live WHERE kind2 = 'router' AND pri = 2",
    "typ_nrm_002": "SELECT recipe, '$.steps[2].target.normalizedFields[0].refSource' AS path FROM live WHERE kind2 = 'normalizer' AND pri = 2",
    "typ_jni_001": "SELECT recipe, '$.steps[2].target.name' AS path FROM live WHERE kind2 = 'joinerInput' AND pri = 1",
    "typ_uni_001": "SELECT recipe, '$.steps[3].sources[0].unionTables[0].fieldMapping' AS path FROM live WHERE kind2 = 'unionInput' AND pri = 2 UNION ALL " + _UNION_KEY,
    "ref_001": """SELECT recipe, path FROM ref r WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.recipe = r.recipe AND n.lname = lower(tab))
      AND NOT EXISTS (SELECT 1 FROM src s WHERE s.recipe = r.recipe AND lower(s.name) = lower(tab))
      AND NOT EXISTS (SELECT 1 FROM sourced s WHERE s.recipe = r.recipe AND s.lname = lower(tab))""",
    "ref_002": """SELECT r.recipe, path FROM ref r JOIN named n ON n.recipe = r.recipe AND n.lname = lower(tab) JOIN live l ON l.recipe = r.recipe
      WHERE NOT EXISTS (SELECT 1 FROM fld f WHERE f.recipe = r.recipe AND f.step_idx = n.step_idx AND lower(f.name) = lower(port))
      AND NOT (n.step_idx = 2 AND kind2 = 'router' AND pri <> 1 AND port IN ('HI.A', 'DEF.A')) AND NOT (n.step_idx = 2 AND kind2 = 'normalizer' AND pri <> 1 AND port = 'N1')
      AND NOT (n.step_idx = 2 AND kind2 = 'storedProcedure' AND port = 'RET')""",
    "ref_003": f"""SELECT recipe, {_AT}.sources[0].name' AS path FROM src s WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.recipe = s.recipe AND n.lname = lower(s.name))
      AND NOT EXISTS (SELECT 1 FROM sourced o WHERE o.recipe = s.recipe AND o.lname = lower(s.name))""",
    "ref_004": "SELECT recipe, path FROM ref WHERE trim(to_step) <> '' AND lower(tab) = lower(to_step)",
    "ref_005": "SELECT recipe, '$.steps[3].target.name' AS path FROM live WHERE d = 24",
    "ref_006": "SELECT DISTINCT w.recipe, '$.steps[' || n.step_idx || '].target' AS path FROM walk w JOIN named n ON n.recipe = w.recipe AND n.lname = w.a WHERE w.a = w.b",
    "flw_001": f"SELECT recipe, {_AT}.target.name' AS path FROM steps s WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.recipe = s.recipe AND met.step_idx = s.step_idx)",
    "flw_002": "SELECT recipe, '$.table.targetTableNames[0]' AS path FROM seed WHERE d IN (22, 23, 24)",
    "flw_003": f"""SELECT recipe, {_AT}.target.name' AS path FROM steps s WHERE trim(name) <> '' AND NOT EXISTS (
      SELECT 1 FROM ref r WHERE r.recipe = s.recipe AND lower(s.name) IN (lower(to_step), lower(tab)))""",
    "flw_004": "SELECT recipe, '$.steps[1].target.fields[2].transformation.condition' AS path FROM live WHERE d = 12",
    "exp_001": "SELECT recipe, path FROM calls WHERE name = 'MYSTERY_FN'",
    "exp_002": "SELECT recipe, '$.steps[1].target.fields[0].transformation.parameters[1].value' AS path FROM live WHERE d = 10",
    "exp_003": "SELECT recipe, '$.steps[1].target.fields[2].transformation.matchPolicy' AS path FROM live WHERE d = 13",
}


def _checking(name: str) -> str:
    return FLAT + {"flw_001": _REACH, "ref_006": _CLOSURE}.get(name, "")


def _check(name: str) -> None:
    @query(f"check_{name}", f"{_checking(name)} SELECT recipe, path FROM ({VIOLATIONS[name]}) v")
    def run(t):
        return K.check(name.upper().replace("_", "-"), documents(t)).select("recipe", "path")


for _name in VIOLATIONS:
    _check(_name)


@query("conformance", FLAT + _REACH + _CLOSURE + """, found AS (""" + " UNION ALL ".join(
    f"SELECT '{n.upper().replace('_', '-')}' AS rule_id, recipe FROM ({s}) x" for n, s in VIOLATIONS.items()) + """)
SELECT rule_id, CASE WHEN rule_id IN ('REF-002', 'REF-003', 'REF-006', 'FLW-001') THEN 'warning' ELSE 'error' END AS severity,
  count(*) AS failures, count(DISTINCT recipe) AS recipes, (SELECT count(*) FROM seed) - count(DISTINCT recipe) AS passed FROM found GROUP BY 1""")
def conformance(t):
    results = K.conformance(documents(t))
    return results.groupBy("rule_id", "severity").agg(
        F.count_if(c("status") == "fail").alias("failures"), F.count_distinct(F.when(c("status") == "fail", c("recipe"))).alias("recipes"),
        F.count_if(c("status") == "pass").alias("passed"))


# --- the recipe runner ------------------------------------------------------------

_REF = lambda s: {"source": s}
_VAL = lambda v: {"value": v}
_CALL = lambda n, *p: {"name": n, "parameters": list(p)}
_PORT = lambda n, ty, x=None: {"name": n, "dataType": ty, **({"transformation": x} if x else {})}
_RATE = {"name": "LKP_NATION", "outputField": "n_name", "table": "NATION", "condition": "n_nationkey = in_KEY", "matchPolicy": "First",
         "parameters": [{"name": "in_KEY", "dataType": "Long", "transformation": _REF("JNR.NATION_ID")}]}
ORDERS_SUMMARY = {
    "table": {"targetTableNames": ["SEGMENT_SUMMARY", "BIG_ORDERS"], "sourceTableNames": ["ORDERS", "CUSTOMER", "NATION"]},
    "steps": [  # targets first: steps are resolved by name
        {"target": {"name": "SEGMENT_SUMMARY", "type": "table", "fields": [
            _PORT("SEGMENT", "String", _REF("AGG.SEGMENT")), _PORT("NATION", "String", _REF("AGG.NATION")), _PORT("N", "Long", _REF("AGG.N")),
            _PORT("TOTAL", "BigDecimal", _CALL("ROUND", _REF("AGG.TOTAL"), _VAL("2"))), _PORT("UNLINKED", "String")]},
         "sources": [{"name": "AGG", "type": "aggregator"}]},
        {"target": {"name": "BIG_ORDERS", "type": "table", "fields": [_PORT("ORDER_ID", "Long", _REF("RTR.BIG.ORDER_ID")), _PORT("BAND", "String", _REF("RTR.BIG.BAND"))]},
         "sources": [{"name": "RTR", "type": "router", "group": "BIG"}]},
        {"target": {"name": "RTR", "type": "router", "fields": [_PORT("ORDER_ID", "Long", _REF("SQ_O.ORDER_ID")), _PORT("AMOUNT", "BigDecimal", _REF("SQ_O.AMOUNT")),
            _PORT("BAND", "String", _CALL("EXP_IIF", _CALL("EXP_COMPARISON", _REF("SQ_O.AMOUNT"), _VAL(">="), _VAL("400000")), _VAL("'HUGE'"), _VAL("'BIG'")))],
            "groups": [{"name": "BIG", "filterCondition": "AMOUNT > 300000", "fields": []}, {"name": "DEFAULT1", "default": True, "fields": []}]},
         "sources": [{"name": "SQ_O", "type": "sourceQualifier"}]},
        {"target": {"name": "AGG", "type": "aggregator", "groupByFields": ["SEGMENT", "NATION"], "fields": [
            _PORT("SEGMENT", "String", _REF("EXP.SEGMENT")), _PORT("NATION", "String", _REF("EXP.NATION")), _PORT("N", "Long", _CALL("EXP_COUNT", _VAL("*"))),
            _PORT("TOTAL", "BigDecimal", _CALL("EXP_SUM", _REF("EXP.AMOUNT")))]}, "sources": [{"name": "EXP", "type": "filter"}]},
        {"target": {"name": "EXP", "type": "filter", "filterCondition": _CALL("EXP_LOGICAL", _CALL("EXP_COMPARISON", _REF("JNR.AMOUNT"), _VAL(">"), _VAL("$$FLOOR")),
                                                                              _VAL(" AND "), _CALL("NOT", _CALL("ISNULL", _REF("JNR.SEGMENT")))),
                    "fields": [_PORT("SEGMENT", "String", _CALL("EXP_UPPER", _REF("JNR.SEGMENT"))), _PORT("NATION", "String", _RATE),
                               _PORT("AMOUNT", "BigDecimal", _REF("JNR.AMOUNT"))]},
         "sources": [{"name": "JNR", "type": "joiner", "joinerTables": ["JNR.MASTER", "JNR.DETAIL"], "joinerType": "Normal Join", "joinerCondition": "CUST = CUST_ID"}]},
        {"target": {"name": "JNR.MASTER", "type": "joinerInput", "fields": [_PORT("CUST", "Long", _REF("CUSTOMER.c_custkey")),
            _PORT("SEGMENT", "String", _REF("CUSTOMER.c_mktsegment")), _PORT("NATION_ID", "Long", _REF("CUSTOMER.c_nationkey"))]},
         "sources": [{"name": "CUSTOMER", "type": "table"}]},
        {"target": {"name": "JNR.DETAIL", "type": "joinerInput", "fields": [_PORT("CUST_ID", "Long", _REF("SQ_O.CUST_ID")), _PORT("AMOUNT", "BigDecimal", _REF("SQ_O.AMOUNT"))]},
         "sources": [{"name": "SQ_O", "type": "sourceQualifier"}]},
        {"target": {"name": "SQ_O", "type": "sourceQualifier", "selectDistinct": False, "sourceFilter": "ORDERS.o_orderstatus <> 'P'", "fields": [
            _PORT("ORDER_ID", "Long", _REF("ORDERS.o_orderkey")), _PORT("CUST_ID", "Long", _REF("ORDERS.o_custkey")),
            _PORT("AMOUNT", "BigDecimal", _CALL("TO_DECIMAL", _CALL("TO_CHAR", _CALL("ROUND", _CALL("TO_DECIMAL", _REF("ORDERS.o_totalprice"), _VAL("4")), _VAL("2")))))]},
         "sources": [{"name": "ORDERS", "type": "table"}]},
    ]}


def _run(t):
    tables = {"ORDERS": t.orders, "CUSTOMER": t.customer, "NATION": t.nation}
    return run_recipe(t.spark, ORDERS_SUMMARY, tables, params={"FLOOR": 1000})


@query("run_recipe", """
SELECT 'summary' AS target, upper(c_mktsegment) AS a, n_name AS b, count(*) AS n, round(sum(round(o_totalprice, 2)::DECIMAL(38,9)), 2)::DOUBLE AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P' AND o_totalprice > 1000 GROUP BY 2, 3
UNION ALL SELECT 'big', CASE WHEN o_totalprice >= 400000 THEN 'HUGE' ELSE 'BIG' END, '', o_orderkey, 0 FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 300000""")
def recipe_rows(t):
    out = _run(t)
    summary = out["SEGMENT_SUMMARY"].select(F.lit("summary").alias("target"), c("SEGMENT").alias("a"), c("NATION").alias("b"), c("N").alias("n"),
                                            c("TOTAL").cast("double").alias("total"))
    big = out["BIG_ORDERS"].select(F.lit("big").alias("target"), c("BAND").alias("a"), F.lit("").alias("b"), c("ORDER_ID").alias("n"), F.lit(0.0).alias("total"))
    return summary.unionByName(big)


# --- functions with computed arguments, and data quality in the runner ------------------

_FN = {  # port → (type, call, checking SQL) over orders; ``cut`` is where the priority's dash stands
    "AFTER": ("String", _CALL("EXP_SUBSTR", _REF("ORDERS.o_orderpriority"), _CALL("EXP_ARITHMETIC", _CALL("EXP_INSTR", _REF("ORDERS.o_orderpriority"), _VAL("'-'")), _VAL("+"), _VAL("1"))),
              "substr(p, instr(p, '-') + 1)"),
    "BEFORE": ("String", _CALL("SUBSTR", _REF("ORDERS.o_orderpriority"), _VAL("1"), _CALL("ARITHMETIC", _CALL("INSTR", _REF("ORDERS.o_orderpriority"), _VAL("'-'")), _VAL("-"), _VAL("1"))),
               "substr(p, 1, greatest(0, instr(p, '-') - 1))"),
    "PADDED": ("String", _CALL("LPAD", _REF("ORDERS.o_orderpriority"), _CALL("ARITHMETIC", _CALL("LENGTH", _REF("ORDERS.o_orderpriority")), _VAL("+"), _VAL("2")), _VAL("'*'")), "'**' || p"),
    "FILLED": ("String", _CALL("RPAD", _REF("ORDERS.o_orderstatus"), _CALL("LENGTH", _REF("ORDERS.o_orderpriority")), _VAL("'.'")), "rpad(o_orderstatus, CAST(length(p) AS INT), '.')"),
    "SAME": ("Boolean", _CALL("REG_MATCH", _REF("ORDERS.o_orderstatus"), _REF("ORDERS.o_orderstatus")), "TRUE"),
    "SWAPPED": ("String", _CALL("REPLACESTR", _VAL("TRUE"), _REF("ORDERS.o_orderpriority"), _REF("ORDERS.o_orderstatus"), _VAL("'_'")), "replace(p, o_orderstatus, '_')"),
    "ANYCASE": ("String", _CALL("REPLACESTR", _VAL("FALSE"), _REF("ORDERS.o_orderpriority"), _VAL("'high'"), _VAL("'low'")), "regexp_replace(p, 'high', 'low', 'gi')"),
    "LASTDASH": ("Integer", _CALL("INSTR", _REF("ORDERS.o_orderpriority"), _VAL("'I'"), _VAL("-1")), "CAST(CASE WHEN instr(reverse(p), 'I') = 0 THEN 0 ELSE length(p) - instr(reverse(p), 'I') + 1 END AS INT)"),
    "DAYSTART": ("Timestamp", _CALL("TRUNC", _REF("ORDERS.o_orderdate")), "CAST(date_trunc('day', o_orderdate) AS TIMESTAMP)"),
    "MONTHTEXT": ("String", _CALL("TO_CHAR", _REF("ORDERS.o_orderdate"), _VAL("'DD-MON-YYYY'")), "strftime(o_orderdate, '%d-%b-%Y')"),
    "MONTHDAY": ("Timestamp", _CALL("TO_DATE", _CALL("UPPER", _CALL("TO_CHAR", _REF("ORDERS.o_orderdate"), _VAL("'DD-MON-YYYY'"))), _VAL("'DD-MON-YYYY'")), "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)"),
    "HALFDAY": ("String", _CALL("TO_CHAR", _REF("ORDERS.o_orderdate"), _VAL("'HH:MI AM'")), "strftime(o_orderdate, '%I:%M %p')"),
}
RECIPE_FUNCTIONS = {"table": {"targetTableNames": ["OUT"], "sourceTableNames": ["ORDERS"]}, "steps": [
    {"target": {"name": "OUT", "type": "table", "fields": [_PORT("ORDER_ID", "Long", _REF("ORDERS.o_orderkey"))] + [_PORT(n, ty, x) for n, (ty, x, _) in _FN.items()]},
     "sources": [{"name": "ORDERS", "type": "table"}]}]}


@query("recipe_functions", "SELECT o_orderkey AS ORDER_ID, " + ", ".join(f"{q} AS {n}" for n, (_, _, q) in _FN.items()) + " FROM (SELECT *, o_orderpriority AS p FROM orders) o")
def recipe_functions(t):
    return run_recipe(t.spark, RECIPE_FUNCTIONS, {"ORDERS": t.orders})["OUT"]


_CHECK = lambda n, *p: {"name": n, "parameters": list(p)}
RECIPE_DQ = {"table": {"targetTableNames": ["LOADED"], "sourceTableNames": ["FEED"], "oakcombe2": {"keys": ["CUST"]}}, "steps": [
    {"target": {"name": "LOADED", "type": "table", "fields": [
        _PORT("ID", "Long", _REF("FEED.o_orderkey")), _PORT("CUST", "Long", _REF("FEED.o_custkey")),
        _PORT("AMOUNT", "BigDecimal", _CHECK("EXP_MAPLEVALE_NUM", _CHECK("EXP_VALIDATION_VARCHAR2_NOT_NULL", _REF("FEED.num_s")))),
        _PORT("DAY", "LocalDate", _CHECK("EXP_MAPLEVALE_DATE_DEFAULT", _REF("FEED.date_s"))),
        _PORT("BIG", "String", _CALL("EXP_IIF", _CALL("EXP_OAKPEAK", _REF("FEED.o_totalprice"), _VAL(">"), _VAL("200000")), _VAL("'Y'"), _VAL("'N'")))]},
     "sources": [{"name": "FEED", "type": "table"}]}]}
_NUMBER, _DATE = "TRY_CAST(trim(num_s) AS DECIMAL(38,9))", "CAST(try_strptime(trim(date_s), ['%Y-%m-%d', '%Y%m%d', '%d/%m/%Y', '%Y.%m.%d', '%d.%m.%Y', '%d-%m-%Y']) AS DATE)"


@query("run_recipe_dq", f"""
WITH v AS (SELECT *, coalesce(trim(num_s), '') = '' AS no_num, coalesce(trim(date_s), '') = '' AS no_date, {_NUMBER} AS n, {_DATE} AS d FROM ({duck(DIRTY)}) x),
g AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM v WHERE NOT no_num AND n IS NOT NULL AND (no_date OR d IS NOT NULL))
SELECT CASE WHEN nth = 1 THEN 'row' ELSE 'duplicate' END AS kind, o_orderkey AS id, CAST(n AS DOUBLE) AS amount, CASE WHEN no_date THEN DATE '1900-01-01' ELSE d END AS day,
  CASE WHEN o_totalprice > 200000 THEN 'Y' ELSE 'N' END AS detail FROM g
UNION ALL SELECT 'error', o_orderkey, NULL, NULL, 'AMOUNT|' || CASE WHEN no_num THEN 'ERROR_NULL|' || coalesce(num_s, '') ELSE 'ERROR_NUMBER|' || num_s END FROM v WHERE no_num OR n IS NULL
UNION ALL SELECT 'error', o_orderkey, NULL, NULL, 'DAY|ERROR_DATE|' || date_s FROM v WHERE NOT no_date AND d IS NULL""")
def recipe_dq(t):
    """Good rows, duplicates of a key and errors of a recipe that validates its feed; names are those of anonymised recipes."""
    out = run_recipe_dq(t.spark, RECIPE_DQ, {"FEED": t.sql(DIRTY)}, order={"LOADED": ["CUST", "ID"]}, keys={"LOADED": ["ID"]})
    row = lambda df, kind: df.select(F.lit(kind).alias("kind"), c("ID").alias("id"), c("AMOUNT").cast("double").alias("amount"), c("DAY").alias("day"), c("BIG").alias("detail"))
    errors = out.errors.select(F.lit("error").alias("kind"), F.get_json_object("key", "$.ID").cast("bigint").alias("id"), F.lit(None).cast("double").alias("amount"),
                               F.lit(None).cast("date").alias("day"), F.concat_ws("|", "field", "code", "raw").alias("detail"))
    return row(out.rows["LOADED"], "row").unionByName(row(out.duplicates["LOADED"], "duplicate")).unionByName(errors)
