"""Answers that were once wrong: names, deep trees, runs without id or date, constants, maps."""

import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weftwork.operators import windows as W
from weftwork.plans import history as H
from weftwork.plans import lineage as N
from weftwork.plans.recipe import _constant, run_recipe


def recipe(spark, tree):
    text = '{"steps":[{"target":{"name":"T","type":"table","fields":[{"name":"A","dataType":"String","transformation":' + tree + '}]},"sources":[]}]}'
    docs = spark.createDataFrame([("p", "r", "m", "ODS", text)], "path string, recipe string, mapping_dir string, layer string, document string")
    return N.fields(N.steps(docs))


@pytest.mark.parametrize("depth", [3, 400, 3000, 12000])
def test_trees_of_any_depth(spark, depth):
    tree = '{"name":"F","parameters":[' * depth + '{"source":"S.X"}' + "]}" * depth
    # Spark's own JSON reader ends at a thousand nested levels, so the deepest trees come as the text of a field.
    field = recipe(spark, tree) if depth < 450 else spark.createDataFrame([("r", 0, "T", 0, "A", "String", tree)], "recipe string, step_idx int, step string, field_idx int, name string, data_type string, transformation string")
    nodes = N.expr_nodes(field)
    deepest = nodes.orderBy(F.desc("depth")).first()
    assert nodes.count() == depth + 1 and (deepest["depth"], deepest["source"]) == (depth, "S.X")
    assert N.formula_archive(field).first()["formula"] == "F(" * depth + "S.X" + ")" * depth


@pytest.mark.parametrize("text", ['{"a": [1, {"b": "x,]}:"}, [], {}], "c": {"d": null}, "e": true}', "[]", ' {"k" : [ "\\u00e9" , -1.5e3 ] } ', '"s"', "{", '{"a"}', "[1,]x", "[1}", "", "]"])
def test_deep_loading_reads_what_the_library_reads(text):
    try:
        want = json.loads(text)
    except ValueError:
        want = None
    assert N._load_deep(text) == want


def test_json_values_keep_their_spelling(spark):
    field = recipe(spark, '{"name":"IIF","parameters":[{"value":true},{"value":false},{"value":1.0},{"value":"True"},{"value":12}]}')
    assert [r["value"] for r in N.expr_nodes(field).filter("depth = 1").orderBy("param_idx").collect()] == ["true", "false", "1.0", "True", "12"]
    assert N.formula_archive(field).first()["formula"] == "IIF(true, false, 1.0, True, 12)"


def test_lineage_of_names_beyond_words(spark):
    connectors = spark.createDataFrame([("m", "SQ", p, "EXP", p) for p in ("PRECIO$", "AÑO", "K#1", "NO")] + [("m", "EXP", "OUT", "TGT", "T")],
                                       "mapping string, from_instance string, from_field string, to_instance string, to_field string")
    ports = spark.createDataFrame([("m", "EXP", p, None) for p in ("PRECIO$", "AÑO", "K#1", "NO")] +
                                  [("m", "EXP", "OUT", "PRECIO$*AÑO+K#1 || 'NO, it''s NO' /* NO\nNO */ -- NO\n // NO")], "mapping string, transformation string, name string, expression string")
    instances = spark.createDataFrame([("m", "SQ", "SQ", "SOURCE"), ("m", "EXP", "EXP", "TRANSFORMATION"), ("m", "TGT", "TGT", "TARGET")], "mapping string, name string, transformation string, type string")
    got = {(r["source_instance"], r["source_field"]) for r in N.connector_lineage(connectors, ports, instances).collect()}
    assert got == {("SQ", "PRECIO$"), ("SQ", "AÑO"), ("SQ", "K#1")}


def test_runs_without_job_id_or_date(spark):
    day = date(2026, 7, 1)
    runs = spark.createDataFrame([("r", day, "SUCCESS", None, "1m 0s"), ("s", day, "FAILED", None, None), ("s", day, "SUCCESS", "j1", "2m 0s"), ("s", day, "FAILED", "j2", "3m 0s"), ("r", None, "FAILED", "j3", None)],
                                 "recipe_filename string, run_date date, status string, job_id string, avg_job_duration_in_mins_sec string")
    tasks = spark.createDataFrame([("r",), ("s",), ("t",)], "recipe string")
    assert {r["recipe_filename"]: r["history"] for r in H.task_stats(runs, tasks).collect()} == {"r": ["OK"], "s": ["KO"], "t": ["PENDING"]}


def test_constants():
    assert _constant("'O''Brien'") == "O'Brien" and _constant("''") == "" and _constant("-7") == -7
    assert _constant("9223372036854775808") == Decimal("9223372036854775808") and _constant("9223372036854775807") == 9223372036854775807


def test_last_row_of_an_aggregator_needs_an_order(spark):
    target = {"name": "AGG", "type": "aggregator", "groupByFields": ["K"], "fields": [{"name": n, "dataType": "String", "transformation": {"source": f"T.{n}"}} for n in ("K", "V")]}
    doc = {"steps": [{"target": target, "sources": [{"name": "T", "type": "table"}]}, {"target": {"name": "OUT", "type": "table", "fields": [{"name": "K", "dataType": "String", "transformation": {"source": "AGG.K"}}]},
                                                                                    "sources": [{"name": "AGG", "type": "aggregator"}]}]}
    table = spark.createDataFrame([("a", "x")], "K string, V string")
    with pytest.raises(ValueError, match="order"):
        run_recipe(spark, doc, {"T": table})
    assert run_recipe(spark, doc, {"T": table}, order={"AGG": ["T.V"]})["OUT"].collect()[0]["K"] == "a"


def test_duplicates_of_a_table_with_a_map(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 1}), (1, {"a": 1}), (2, None)], "k int, m map<string,int>")
    out = W.flag_duplicates(df, ["k"], ["k"], "f")
    assert out.schema["m"].dataType == df.schema["m"].dataType
    assert sorted((r["k"], r["f"]) for r in out.collect()) == [(1, "N"), (1, "Y"), (1, "Y"), (2, "N")]
