"""Recipe runner over every step kind, history jobs, and small metadata checks."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from weftwork.plans import conformance as K
from weftwork.plans import history as H
from weftwork.plans import lineage as N
from weftwork.plans.recipe import register_call, run_recipe

REF = lambda s: {"source": s}
VAL = lambda v: {"value": v}
CALL = lambda n, *p: {"name": n, "parameters": list(p)}
PORT = lambda n, t, x=None: {"name": n, "dataType": t, **({"transformation": x} if x else {})}


def step(name, kind, fields, sources, **keys):
    return {"target": {"name": name, "type": kind, "fields": fields, **keys}, "sources": sources}


def src(name, kind, **keys):
    return {"name": name, "type": kind, **keys}


def run(spark, steps, tables, **kw):
    return run_recipe(spark, {"steps": steps, "table": {}}, tables, **kw)


@pytest.fixture
def tables(spark):
    return {"A": spark.createDataFrame([(1, 10, "x", 1, 2), (2, 20, "y", 3, None), (3, None, "y", 5, 6)], "id int, v int, g string, q1 int, q2 int"),
            "B": spark.createDataFrame([(1, "one"), (9, "nine")], "bid int, label string"),
            "BANDS": spark.createDataFrame([(0, 10, "low"), (11, 99, "high")], "lo int, hi int, band string")}


def test_normalizer_union_and_sequence(spark, rows, tables):
    steps = [
        step("OUT", "table", [PORT("ID", "Long", REF("U.ID")), PORT("Q", "Long", REF("U.Q")), PORT("N", "Long", CALL("SequenceGenerator"))],
             [src("U", "union", unionTables=[{"name": "U1", "fieldMapping": [{"origin": "ID1", "union": "ID"}, {"origin": "Q1", "union": "Q"}]},
                                             {"name": "U2", "fieldMapping": [{"origin": "ID2", "union": "ID"}]}])]),
        step("U1", "unionInput", [PORT("ID1", "Long", REF("NRM.ID")), PORT("Q1", "Long", REF("NRM.Q"))], [src("NRM", "normalizer")]),
        step("U2", "EARLYGLADE", [PORT("ID2", "Long", REF("B.bid"))], [src("B", "table")]),
        step("NRM", "normalizer", [PORT("ID_in", "Long", REF("A.id")), PORT("Q_in1", "Long", REF("A.q1")), PORT("Q_in2", "Long", REF("A.q2"))], [src("A", "table")],
             normalizedFields=[{"name": "ID", "refSource": ["ID_in"]}, {"name": "Q", "refSource": ["Q_in1", "Q_in2"], "generatedColumnId": True}])]
    out = run(spark, steps, tables, order={"OUT": ["U.ID", "U.Q"]})["OUT"]
    assert rows(out, "ID", "Q") == [(1, 1), (1, 2), (1, None), (2, 3), (2, None), (3, 5), (3, 6), (9, None)]
    assert sorted(r["N"] for r in out.collect()) == list(range(1, 9))


def test_detail_outer_joiner_java_procedure_and_range_lookup(spark, rows, tables):
    lookup = {"name": "LKP", "outputField": "band", "table": "BANDS", "condition": "lo <= in_V AND hi >= in_V", "matchPolicy": "First",
              "parameters": [{"name": "in_V", "dataType": "Integer", "transformation": REF("J.V")}]}
    steps = [
        step("T", "table", [PORT("ID", "Long", REF("SP.ID")), PORT("TWICE", "Long", REF("SP.RET")), PORT("LABEL", "String", REF("SP.LABEL")), PORT("BAND", "String", REF("SP.BAND"))],
             [src("SP", "storedProcedure")]),
        step("SP", "CEDARWICK2", [PORT("ID", "Long", REF("J2.ID")), PORT("LABEL", "String", REF("J2.LABEL")), PORT("BAND", "String", REF("J2.BAND"))],
             [src("J2", "java")], procedureName="TWICE", returnField="RET"),
        step("J2", "java", [PORT("ID", "Long", REF("J.ID")), PORT("LABEL", "String", CALL("NVL", REF("J.LABEL"), VAL("'-'"))), PORT("BAND", "String", lookup)],
             [src("J", "joiner", joinerTables=["J.MASTER", "J.DETAIL"], joinerType="Detail Outer Join", joinerCondition="BID = ID")], javaCode="…"),
        step("J.MASTER", "joinerInput", [PORT("ID", "Long", REF("A.id")), PORT("V", "Integer", REF("A.v"))], [src("A", "table")]),
        step("J.DETAIL", "ASHPATH2", [PORT("BID", "Long", REF("B.bid")), PORT("LABEL", "String", REF("B.label"))], [src("B", "table")])]

    def emit(row):
        if row["ID"] != 3:
            yield row

    out = run(spark, steps, tables, code={"J2": (emit, "ID bigint, LABEL string, BAND string"), "TWICE": lambda i, l, b: i * 2})["T"]
    assert rows(out) == [(1, 2, "one", "low"), (2, 4, "-", "high")]


def test_router_default_aggregator_last_distinct_and_join(spark, rows, tables):
    register_call("EXP_SHOUT", lambda x: F.concat(F.upper(x), F.lit("!")))
    steps = [
        step("REST", "table", [PORT("G", "String", CALL("EXP_SHOUT", REF("R.D.G")))], [src("R", "router", group="D")]),
        step("AGGT", "table", [PORT("G", "String", REF("AG.G")), PORT("LASTV", "Long", REF("AG.LASTV")), PORT("S", "Long", REF("AG.S"))], [src("AG", "aggregator")]),
        step("PAIRS", "table", [PORT("L", "String", REF("B.label"))], [src("A", "table"), src("B", "table")], userDefinedJoin="A.id = B.bid"),
        step("R", "router", [PORT("V", "Long", REF("SQ.V")), PORT("G", "String", REF("SQ.G"))], [src("SQ", "sourceQualifier")],
             greencliff=[{"name": "HI", "filterCondition": "V > 5", "fields": []}, {"name": "D", "default": True, "fields": []}]),
        step("AG", "aggregator", [PORT("G", "String", REF("SQ.G")), PORT("LASTV", "Long", REF("SQ.V")), PORT("S", "Long", CALL("EXP_SUM", REF("SQ.V")))],
             [src("SQ", "sourceQualifier")], groupByFields=["G"]),
        step("SQ", "BERYLFALLS", [PORT("V", "Long", REF("A.v")), PORT("G", "String", REF("A.g"))], [src("A", "table")], selectDistinct=True)]
    out = run(spark, steps, tables, order={"AG": ["SQ.V"]})
    assert rows(out["REST"]) == [("Y!",)] and rows(out["AGGT"]) == [("x", 10, 10), ("y", 20, 20)] and rows(out["PAIRS"]) == [("one",)]


def test_sql_query_step_with_parameter(spark, rows, tables):
    steps = [step("T", "table", [PORT("ID", "Long", REF("A.id"))], [src("A", "table")], sqlQuery="SELECT * FROM {A} WHERE id >= $$LOW")]
    assert rows(run(spark, steps, tables, params={"LOW": 2})["T"]) == [(2,), (3,)]


def test_unknown_function_is_an_error(spark, tables):
    with pytest.raises(ValueError):
        run(spark, [step("T", "table", [PORT("X", "Long", CALL("Undefined", REF("A.id")))], [src("A", "table")])], tables)


RUNS = [("r1", "2026-07-01", "3m 30sec", "SUCCESS"), ("r1", "2026-07-02", "8m 15sec", "FAILED"), ("r1", "2026-07-04", "x", ""), ("r2", "2026-07-02", "", "RUNNING")]


@pytest.fixture
def runs(spark):
    return spark.createDataFrame([(r, date.fromisoformat(d), t, s, f"j{i}", "c", f"{d}T00:00Z") for i, (r, d, t, s) in enumerate(RUNS)],
                                 "recipe_filename string, run_date date, avg_job_duration_in_mins_sec string, status string, job_id string, cluster_name string, app_start_iso string")


def test_rollup_and_status(spark, rows, runs):
    entries = spark.createDataFrame([("r1", "ODS", 1), ("r1", "CDM", 2)], "recipe string, layer string, entry_order int")
    rollup = H.recipe_rollup(runs, entries)
    one, two = sorted(rollup.collect(), key=lambda r: r["recipe_filename"])
    assert (one["layer"], one["ok"], one["ko"], one["latest_status"]) == ("ODS", 1, 1, "")
    assert (one["avg_min"], one["p50_min"], one["p95_min"]) == (5.875, 3.5, 8.25)
    assert (two["layer"], two["avg_min"], two["p50_min"]) == ("UNKNOWN", None, None)
    assert rows(H.status_at(rollup, "2026-07-02")) == [("r1", "KO"), ("r2", "PENDING")]
    assert rows(H.status_at(rollup, "2026-07-03")) == [("r1", "PENDING"), ("r2", "PENDING")]


def test_nearest_date_tie_takes_the_earlier(spark, rows):
    days = spark.createDataFrame([(date(2026, 7, 1),), (date(2026, 7, 3),), (date(2026, 7, 9),)], "run_date date")
    asked = spark.createDataFrame([(date(2026, 7, 2),), (date(2026, 7, 8),), (date(2020, 1, 1),)], "requested date")
    assert rows(H.nearest_date(asked, days)) == [(date(2020, 1, 1), date(2026, 7, 1)), (date(2026, 7, 2), date(2026, 7, 1)), (date(2026, 7, 8), date(2026, 7, 9))]


def test_workflow_gaps_and_running(spark, runs):
    clusters = spark.createDataFrame([("w1", "r1"), ("w2", "r2"), ("w3", "none")], "workflow string, recipe string")
    got = {(r["workflow"], str(r["run_date"])): (r["status"], r["duration_s"]) for r in H.workflow_runs(runs, clusters).collect()}
    assert len(got) == 9 and got["w1", "2026-07-02"] == ("failed", 495) and got["w2", "2026-07-02"] == ("success", 0) and got["w3", "2026-07-01"] == ("skipped", 0)
    tasks = {r["recipe_filename"]: r for r in H.task_stats(runs, clusters.select("recipe")).collect()}
    assert tasks["r1"]["history"] == ["OK", "KO", "PENDING"] and (tasks["r1"]["p50"], tasks["r1"]["avg_time_s"]) == (210, 353)
    assert tasks["r2"]["history"] == ["PENDING", "RUNNING", "PENDING"] and tasks["none"]["p95"] == 0


def docs(spark, *texts):
    return spark.createDataFrame([(f"ODS/m{i}/_ETL_{i}.json", f"_ETL_{i}.json", f"ODS/m{i}", "ODS", t) for i, t in enumerate(texts)],
                                 "path string, recipe string, mapping_dir string, layer string, document string")


def test_broken_documents_are_findings_not_failures(spark, rows):
    bad = docs(spark, "not json", '{"steps": "x"}', '{"steps": []}', "{}", '{"steps":[{"target":{"name":"T","type":"table","fields":[]},"sources":[]}]}')
    assert [r[0] for r in rows(K.check("STR-001", bad), "recipe")] == [f"_ETL_{i}.json" for i in range(4)]


def test_clean_recipe_passes_every_rule(spark):
    text = ('{"steps":[{"target":{"name":"T","type":"table","fields":[{"name":"A","dataType":"String","transformation":{"source":"S.A"}}]},'
            '"sources":[{"name":"S","type":"table"}]}],"table":{"targetTableNames":["t"],"sourceTableNames":["S"]}}')
    results = K.conformance(docs(spark, text))
    assert results.count() == len(K.RULES) == 35 and results.filter("status = 'fail'").count() == 0
    assert K.validity(results).first()["valid"]


def test_rendering_and_refs_split_at_the_first_dot(spark, rows):
    text = ('{"steps":[{"target":{"name":"T","type":"table","fields":[{"name":"A","dataType":"String","transformation":{"name":"EXP_X","parameters":'
            '[{"source":"R.G.P"},{"name":"in_K","dataType":"String","transformation":{"name":"L","outputField":"o","parameters":[]}},{"value":"1"}]}}]},"sources":[]}]}')
    fields = N.fields(N.steps(docs(spark, text)))
    assert N.formula_archive(fields).first()["formula"] == "EXP_X(R.G.P, L(), 1)"
    assert rows(N.field_refs(N.expr_nodes(fields)), "table", "ref_field", "path") == [("R", "G.P", "$.steps[0].target.fields[0].transformation.parameters[0]")]
    assert N.expr_nodes(fields).filter("kind = 'lookup'").first()["path"].endswith("parameters[1].transformation")


def test_rename_counts_shared_parts(spark, rows):
    df = spark.createDataFrame([("m", "STG_REGION_SCORE_D", "X9_L_D_SCORE", 0), ("m", "STG_REGION_SCORE_D", "FF_CLOCK", 1), ("n", "DWH_X", "stg_y", 0)],
                               "mapping string, target string, source string, pos int")
    assert rows(N.rename_sources(df), "new_target", "new_source") == [("DWH_X", "ODS_Y"), ("ODS_REGION_SCORE_D", "FF_CLOCK"), ("ODS_REGION_SCORE_D", "STG_REGION_SCORE_D")]
