"""A recipe corpus derived from the orders: one JSON document an order, of a bounded size.

An order's day of the month decides which single defect its recipe has (none from the
25th on), its month the kind of the third step, its priority a defect of that kind.
`documents` builds the JSON in Spark; `FLAT` states, for the checking SQL, the
flat tables that a correct reading of it must give.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.catalog.registry import Tables, duck
from weftwork.session import spread

DOCUMENTS_A_TASK = 8192  # documents of some 2 kB each; few, so that a task holds the same over small and large tables

SEED = """
SELECT *, CASE d WHEN 8 THEN '' WHEN 9 THEN n0 ELSE e1 END AS n1,
  CASE kind2 WHEN 'router' THEN 'RTR_' WHEN 'aggregator' THEN 'AGG_' WHEN 'normalizer' THEN 'NRM_' WHEN 'java' THEN 'JAVA_'
    WHEN 'storedProcedure' THEN 'SP_' WHEN 'joinerInput' THEN 'JNR_' WHEN 'unionInput' THEN 'UNI_' ELSE 'FIL_' END || ks ||
    CASE WHEN kind2 = 'joinerInput' AND pri <> 1 THEN '.MASTER' ELSE '' END AS n2,
  CASE kind2 WHEN 'router' THEN CASE WHEN d = 19 THEN 'RTR_' || ks || '.LO.A' ELSE 'RTR_' || ks || '.HI.A' END WHEN 'aggregator' THEN 'AGG_' || ks || '.A'
    WHEN 'normalizer' THEN 'NRM_' || ks || '.N1' WHEN 'java' THEN 'JAVA_' || ks || '.A' WHEN 'storedProcedure' THEN 'SP_' || ks || '.RET'
    WHEN 'joinerInput' THEN 'JNR_' || ks || '.A' WHEN 'unionInput' THEN 'UN_' || ks || '.A' ELSE 'FIL_' || ks || '.A' END AS r3,
  CASE d WHEN 14 THEN n0 || '.NOPE' WHEN 15 THEN 'NOWHERE.X' WHEN 16 THEN e1 || '.A' WHEN 17 THEN 'TGT_' || ks || '.KEY' ELSE n0 || '.KEY' END AS r1,
  CASE kind2 WHEN 'joinerInput' THEN 'JNR_' || ks WHEN 'unionInput' THEN 'UN_' || ks WHEN 'router' THEN 'RTR_' || ks WHEN 'aggregator' THEN 'AGG_' || ks
    WHEN 'normalizer' THEN 'NRM_' || ks WHEN 'java' THEN 'JAVA_' || ks WHEN 'storedProcedure' THEN 'SP_' || ks ELSE 'FIL_' || ks END AS s3,
  CASE kind2 WHEN 'joinerInput' THEN 'joiner' WHEN 'unionInput' THEN 'union' ELSE kind2 END AS k3
FROM (SELECT *, '_ETL_m_O' || lpad(ks, 7, '0') || '.json' AS recipe, 'SQ_' || ks AS n0, 'EXP_' || ks AS e1,
        CASE m WHEN 1 THEN 'router' WHEN 2 THEN 'router' WHEN 3 THEN 'aggregator' WHEN 4 THEN 'normalizer' WHEN 5 THEN 'java' WHEN 6 THEN 'storedProcedure'
          WHEN 7 THEN 'joinerInput' WHEN 8 THEN 'unionInput' ELSE 'filter' END AS kind2,
        CASE c % 4 WHEN 0 THEN 'ODS' WHEN 1 THEN 'DWH' WHEN 2 THEN 'CDM' ELSE 'ETL' END || '/m_O' || ks AS mapping_dir
      FROM (SELECT CAST(o_orderkey AS STRING) AS ks, o_custkey AS c, CAST(day(o_orderdate) AS INT) AS d, CAST(month(o_orderdate) AS INT) AS m,
              CAST(substring(o_orderpriority, 1, 1) AS INT) AS pri FROM {orders}) a) b
"""

_RECIPE = "'_ETL_m_O' || lpad(CAST(o_orderkey AS STRING), 7, '0') || '.json'"  # as in SEED

_STEP_0 = ('{"target":{"name":"@n0@","type":"@t0@"@distinct@,"fields":[{"name":"KEY","dataType":"@dt@","transformation":{"source":"ORDERS.KEY"}},'
           '{"name":"@f1@","dataType":"BigDecimal","transformation":{"source":"ORDERS.AMT"}}]},"sources":[{"name":"@s0@","type":"table"}]}')
_STEP_1 = ('{"target":{"name":"@n1@","type":"@t1@","fields":[{"name":"A","dataType":"BigDecimal","transformation":{"name":"EXP_ARITHMETIC",'
           '"parameters":[{"source":"@n0@.AMT"},{"value":"@op@"},{"value":"2"}]}},{"name":"B","dataType":"String","transformation":{"name":"@fn@",'
           '"parameters":[{"name":"EXP_COMPARISON","parameters":[{"source":"@n0@.AMT"},{"value":">"},{"value":"100"}]},{"value":"\'Y\'"},{"value":"\'N\'"}]}},'
           '{"name":"C","dataType":"BigDecimal","transformation":{"name":"LKP_C","outputField":"RATE","table":"CUR","condition":"@cond@",'
           '"matchPolicy":"@policy@","parameters":[{"name":"in_CODE","dataType":"String","transformation":{"source":"@n0@.KEY"}}]}},'
           '{"name":"D","dataType":"String","transformation":{"source":"@r1@"}}]},"sources":[@src1@]}')
_STEP_2 = ('{"target":{"name":"@n2@","type":"@kind2@"@keys2@,"fields":[{"name":"A","dataType":"BigDecimal","transformation":{"source":"@e1@.A"}}]},'
           '"sources":[{"name":"@e1@","type":"filter"}]}')
_STEP_3 = ('{"target":{"name":"TGT_@ks@","type":"table","fields":[{"name":"KEY","dataType":"String","transformation":{"source":"@r3@"}}]},'
           '"sources":[{"name":"@s3@","type":"@k3@"@keys3@}]}')
_DOCUMENT = '{@steps@"table":{"targetTableNames":["@declared@"],"sourceTableNames":["ORDERS","CUR"]}}'


def _filled(template: str):
    """A template with ``@column@`` places as one concatenation."""
    parts = re.split(r"@(\w+)@", template)
    return F.concat(*[F.col(p) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def documents(t: Tables) -> DataFrame:
    """(path, recipe, mapping_dir, layer, document)."""
    choose = lambda text: F.expr(text)
    # The rows of orders are spread before they grow to documents: a small table is one file and so one task. By what SEED
    # makes the recipe, because everything later groups and joins within a recipe. The count reads file footers only.
    thin = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    s = t.spark.sql(SEED, orders=spread(thin, F.expr(_RECIPE), thin.count(), DOCUMENTS_A_TASK)).withColumns({
        "t0": choose("if(m = 1, 'BERYLFALLS', 'sourceQualifier')"), "distinct": choose("""if(d = 1, '', ',"selectDistinct":false')"""),
        "dt": choose("if(d = 2, 'Text', 'String')"), "f1": choose("case d when 3 then ' ' when 4 then 'KEY' else 'AMT' end"),
        "s0": choose("if(d = 5, 'GHOST', 'ORDERS')"), "t1": choose("case d when 6 then 'mystery' when 7 then '' else 'filter' end"),
        "op": choose("if(d = 10, '%', '*')"), "fn": choose("case when d = 11 then 'MYSTERY_FN' when m = 2 then 'TO_CHAR' else 'EXP_IIF' end"),
        "cond": choose("if(d = 12, 'CODE = in_CODE2', 'CODE = in_CODE')"), "policy": choose("if(d = 13, 'Best', 'First')"),
        "src1": choose("""if(d = 18, '', concat('{"name":"', n0, '","type":"sourceQualifier"}'))"""),
        "declared": choose("if(d = 24, 'OTHER', concat('TGT_', ks))"),
        "keys2": choose("""case when pri = 1 then if(kind2 = 'storedProcedure', ',"returnField":"RET"', '')
          when kind2 = 'router' then concat(if(m = 2, ',"greencliff":', ',"groups":'), '[{"name":"HI","filterCondition":"A > 1","default":false,"fields":[{"name":"A"}]},',
            '{"name":"DEF","default":true,"fields":[{"name":"A"}]}', if(pri = 2, ',{"name":"DEF2","default":true,"fields":[]}', ''), ']')
          when kind2 = 'aggregator' then ',"groupByFields":[]' when kind2 = 'normalizer' then concat(',"normalizedFields":[{"name":"N1","refSource":[', if(pri = 2, '', '"A"'), ']}]')
          when kind2 = 'java' then ',"javaCode":"x"' when kind2 = 'storedProcedure' then ',"procedureName":"P","returnField":"RET"' else '' end"""),
        "keys3": choose("""case when kind2 = 'router' then if(pri = 3, '', ',"group":"HI"')
          when kind2 = 'joinerInput' then concat(',"joinerTables":["M","D"],"joinerCondition":"A = B"', if(pri = 3, '', ',"joinerType":"Normal Join"'))
          when kind2 = 'unionInput' then if(pri = 3, '', concat(',"unionTables":[{"name":"', n2, '","fieldMapping":[{"origin":"A","union":"', if(pri = 2, '', 'A'), '"}]}]'))
          else '' end""")})
    extra = F.when(F.col("d") == 20, _filled(',{"target":{"name":"ORPH_@ks@","type":"filter","fields":[]},"sources":[{"name":"ORDERS","type":"table"}]}')).when(
        F.col("d") == 21, ',{"sources":[{"name":"ORDERS","type":"table"}]}').otherwise("")
    body = F.concat_ws(",", *[_filled(x) for x in (_STEP_0, _STEP_1, _STEP_2, _STEP_3)])
    steps = F.when(F.col("d") == 23, "").when(F.col("d") == 22, '"steps":[],').otherwise(F.concat(F.lit('"steps":['), body, extra, F.lit("],")))
    docs = s.withColumn("steps", steps)
    return docs.select(F.concat_ws("/", "mapping_dir", "recipe").alias("path"), "recipe", "mapping_dir",
                       F.split("mapping_dir", "/")[0].alias("layer"), _filled(_DOCUMENT).alias("document"))


# The same corpus as flat tables, for the checking SQL only.
FLAT = f"""
WITH RECURSIVE seed AS ({duck(SEED)}), live AS (SELECT * FROM seed WHERE d NOT IN (22, 23)),
steps AS (
  SELECT recipe, 0 AS step_idx, n0 AS name, CASE WHEN m = 1 THEN 'BERYLFALLS' ELSE 'sourceQualifier' END AS type, 'sourceQualifier' AS kind, d, m, pri FROM live
  UNION ALL SELECT recipe, 1, n1, CASE d WHEN 6 THEN 'mystery' WHEN 7 THEN '' ELSE 'filter' END, CASE d WHEN 6 THEN 'mystery' WHEN 7 THEN '' ELSE 'filter' END, d, m, pri FROM live
  UNION ALL SELECT recipe, 2, n2, kind2, kind2, d, m, pri FROM live
  UNION ALL SELECT recipe, 3, 'TGT_' || ks, 'table', 'table', d, m, pri FROM live
  UNION ALL SELECT recipe, 4, CASE d WHEN 20 THEN 'ORPH_' || ks END, CASE d WHEN 20 THEN 'filter' END, CASE d WHEN 20 THEN 'filter' END, d, m, pri FROM live WHERE d IN (20, 21)),
src AS (
  SELECT recipe, 0 AS step_idx, CASE d WHEN 5 THEN 'GHOST' ELSE 'ORDERS' END AS name, 'table' AS kind FROM live
  UNION ALL SELECT recipe, 1, n0, 'sourceQualifier' FROM live WHERE d <> 18 UNION ALL SELECT recipe, 2, e1, 'filter' FROM live
  UNION ALL SELECT recipe, 3, s3, k3 FROM live UNION ALL SELECT recipe, 4, 'ORDERS', 'table' FROM live WHERE d IN (20, 21)),
fld AS (
  SELECT recipe, 0 AS step_idx, 0 AS field_idx, 'KEY' AS name, CASE d WHEN 2 THEN 'Text' ELSE 'String' END AS data_type, d, m FROM live
  UNION ALL SELECT recipe, 0, 1, CASE d WHEN 3 THEN ' ' WHEN 4 THEN 'KEY' ELSE 'AMT' END, 'BigDecimal', d, m FROM live
  UNION ALL SELECT recipe, 1, i, f, y, d, m FROM live, (VALUES (0, 'A', 'BigDecimal'), (1, 'B', 'String'), (2, 'C', 'BigDecimal'), (3, 'D', 'String')) v(i, f, y)
  UNION ALL SELECT recipe, 2, 0, 'A', 'BigDecimal', d, m FROM live UNION ALL SELECT recipe, 3, 0, 'KEY', 'String', d, m FROM live),
ref AS (
  SELECT recipe, step_idx, to_step, to_field, split_part(source, '.', 1) AS tab, substr(source, instr(source, '.') + 1) AS port,
    '$.steps[' || step_idx || '].target.fields[' || field_idx || '].transformation' || tail AS path FROM (
    SELECT recipe, 0 AS step_idx, n0 AS to_step, 'KEY' AS to_field, 0 AS field_idx, 'ORDERS.KEY' AS source, '' AS tail FROM live
    UNION ALL SELECT recipe, 0, n0, CASE d WHEN 3 THEN ' ' WHEN 4 THEN 'KEY' ELSE 'AMT' END, 1, 'ORDERS.AMT', '' FROM live
    UNION ALL SELECT recipe, 1, n1, 'A', 0, n0 || '.AMT', '.parameters[0]' FROM live
    UNION ALL SELECT recipe, 1, n1, 'B', 1, n0 || '.AMT', '.parameters[0].parameters[0]' FROM live
    UNION ALL SELECT recipe, 1, n1, 'C', 2, n0 || '.KEY', '.parameters[0].transformation' FROM live
    UNION ALL SELECT recipe, 1, n1, 'D', 3, r1, '' FROM live
    UNION ALL SELECT recipe, 2, n2, 'A', 0, e1 || '.A', '' FROM live UNION ALL SELECT recipe, 3, 'TGT_' || ks, 'KEY', 0, r3, '' FROM live) x),
calls AS (
  SELECT recipe, 'A' AS field, 'EXP_ARITHMETIC' AS name, FALSE AS is_lookup, '$.steps[1].target.fields[0].transformation' AS path FROM live
  UNION ALL SELECT recipe, 'B', CASE WHEN d = 11 THEN 'MYSTERY_FN' WHEN m = 2 THEN 'TO_CHAR' ELSE 'EXP_IIF' END, FALSE, '$.steps[1].target.fields[1].transformation' FROM live
  UNION ALL SELECT recipe, 'B', 'EXP_COMPARISON', FALSE, '$.steps[1].target.fields[1].transformation.parameters[0]' FROM live
  UNION ALL SELECT recipe, 'C', 'LKP_C', TRUE, '$.steps[1].target.fields[2].transformation' FROM live),
declared AS (SELECT recipe, CASE d WHEN 24 THEN 'OTHER' ELSE 'TGT_' || ks END AS table_name, 'target' AS role, mapping_dir || '/' || recipe AS path FROM seed
  UNION ALL SELECT recipe, n, 'source', mapping_dir || '/' || recipe FROM seed, (VALUES ('ORDERS'), ('CUR')) v(n)),
named AS (SELECT recipe, lower(name) AS lname, min(step_idx) AS step_idx FROM steps WHERE trim(coalesce(name, '')) <> '' GROUP BY 1, 2),
sourced AS (SELECT recipe, lower(table_name) AS lname FROM declared WHERE role = 'source')
"""
