"""Work that must not be repeated, and what the driver and one task may hold."""

import re

from pyspark.sql import functions as F

from weftwork import session
from weftwork.plans import conformance as K
from weftwork.plans import lineage as N

DOCS = [("r1", '{"steps":[{"target":{"name":"SQ","type":"sourceQualifier"},"sources":[{"name":"T","type":"joiner","joinerTables":["A"]},{"type":"nope"}]}]}'),
        ("r2", '{"steps":[{"target":{"name":"X","type":"what"}}]}'), ("r3", "{}"), (None, "no document")]


def docs(spark):
    return spark.createDataFrame(DOCS, "recipe string, document string")


def test_row_rules_of_a_rule_parse_a_document_once(spark):
    for rule in ("TYP-REQ", "TYP-JNR-001", "STR-005"):
        text = K.check(rule, docs(spark))._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall("LogicalRDD|LocalRelation", text)) == 1, rule


def test_steps_and_sources_in_one_pass(spark, rows):
    assert rows(K.check("TYP-REQ", docs(spark)), "recipe", "path") == [
        ("r1", "$.steps[0].sources[0].joinerCondition"), ("r1", "$.steps[0].sources[0].joinerType"), ("r1", "$.steps[0].target.selectDistinct")]
    assert rows(K.check("STR-005", docs(spark)), "recipe", "path") == [("r1", "$.steps[0].sources[1].type"), ("r2", "$.steps[0].target.type")]


def test_spread_follows_the_rows(spark):
    df = spark.range(1000)
    assert session.spread(df, "id", 1000, 10).rdd.getNumPartitions() == 100
    assert session.spread(df, "id", 1, 10).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_broadcast_limit(spark):
    key = session.BROADCAST
    before = spark.conf.get(key)
    try:
        for given, then in ((str(session.BROADCAST_DEFAULT), str(session.BROADCAST_LIMIT)), ("-1", "-1"), ("5m", "5m")):
            spark.conf.set(key, given)
            session.tune(spark)
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, before)


def test_nodes_of_wanted_columns_equal_the_whole(spark, rows):
    field = spark.createDataFrame([("r", 0, "S", i, "F", t) for i, t in enumerate((
        '{"source":"A.B"}', '{"source":""}', '{"value":false}', '{"value":1.0} ', '{"name":0,"parameters":[{"value":"x"},7,{"name":"p","transformation":{"source":"C.D"}}]}',
        '{"broken"', '{"a":1}{"b":2}', '{"source":5}', '{}'))], "recipe string, step_idx int, step string, field_idx int, name string, transformation string")
    whole = N.expr_nodes(field)
    part = N.expr_nodes(field, ("kind", "source", "value"))
    assert part.columns == ["recipe", "step_idx", "step", "field_idx", "field", "kind", "source", "value"]
    assert rows(part) == rows(whole, *part.columns)
    assert rows(part.filter("field_idx < 4 OR field_idx > 4"), "field_idx", "kind", "source", "value") == [
        (0, "ref", "A.B", None), (1, "empty", "", None), (2, "literal", None, "false"), (3, "literal", None, "1.0"),
        (7, "ref", "5", None), (8, "empty", None, None)]


def test_a_day_is_one_snapshot_file(spark):
    from weftwork.catalog import nested
    from weftwork.catalog.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    files = spark.read.text(nested.snapshot_files(t), recursiveFileLookup=True).select(F.input_file_name().alias("f")).distinct()
    days = nested.runs(t).select("run_date").distinct().count()
    assert files.count() == days


def test_lineage_through_a_cycle_ends(spark, rows):
    links = [("m", "S", "A", "E", "A"), ("m", "E", "B", "F", "A"), ("m", "F", "A", "E", "C"), ("m", "E", "A", "T", "X"), ("m", "F", "A", "T", "Y")]
    connectors = spark.createDataFrame(links, "mapping string, from_instance string, from_field string, to_instance string, to_field string")
    ports = spark.createDataFrame([("m", "EXP", "A", None), ("m", "EXP", "C", None), ("m", "EXP", "B", "C + A")],
                                  "mapping string, transformation string, name string, expression string")
    instances = spark.createDataFrame([("m", "E", "EXP", "TRANSFORMATION"), ("m", "T", "T", "TARGET"), ("m", "S", "S", "SOURCE")],
                                      "mapping string, name string, transformation string, type string")
    assert rows(N.connector_lineage(connectors, ports, instances)) == [("m", "T", "X", "S", "A"), ("m", "T", "Y", "S", "A")]


def test_nodes_of_plain_references_equal_those_of_the_parser(spark, rows):
    """The same trees spelled plainly, which Arrow reads, and with a blank, which the parser reads."""
    plain = ['{"source":"A.B"}', '{"source":"äß.ü"}', '{"source":"A"}', '{"source":"."}', '{"source":"x.y}"}']
    other = ['{"source":"a\\n.b"}', '{"source":"a\\u0041.b"}', '{"source":""}', '{"source":7.5}', '{"source":"A.B","value":"1"}', '{"source":["a.b"]}',
             '{"name":"f","parameters":[{"source":"C.D"},{"name":"p","transformation":{"source":"E.F","parameters":[{"source":"G.H"}]}},{"value":"v.w"},3]}']
    field = lambda texts: spark.createDataFrame([("r", i, None, i + 1, "F", t) for i, t in enumerate(texts)],
                                                "recipe string, step_idx int, step string, field_idx int, name string, transformation string")
    spaced = [t.replace('{"source":', '{"source": ', 1) for t in plain]
    assert rows(N.expr_nodes(field(plain))) == rows(N.expr_nodes(field(spaced)))
    texts = field(plain + other)
    for columns in (None, ("path", "source"), ("source", "kind")):
        dotted = N.expr_nodes(texts, columns, only=N.REFS)
        assert rows(dotted) == rows(N.expr_nodes(texts).filter("instr(source, '.') > 0"), *dotted.columns)
    lookups = field(plain + ['{"name":"L","outputField":"o","condition":"c","parameters":[{"name":"f","parameters":[{"name":"M","output\\u0046ield":null}]}]}', '{"name":"f","value":"outputField"}'])
    found = N.expr_nodes(lookups, ("path", "kind", "condition"), only=N.LOOKUPS)
    assert found.count() == 2 and rows(found) == rows(N.expr_nodes(lookups).filter("kind = 'lookup'"), *found.columns)


def test_references_carry_no_other_nodes_to_spark(spark):
    tree = '{"name":"f","parameters":[{"value":"1"},{"name":"g","parameters":[{"source":"A.B"}]}]}'
    docs_ = spark.createDataFrame([("r", '{"steps":[{"target":{"name":"T","fields":[{"name":"X","transformation":%s}]}}]}' % tree)], "recipe string, document string")
    assert [r.source for r in K.Corpus(docs_, (), K.NODE_COLUMNS["REF-004"], K.ONLY["REF-004"]).nodes.collect()] == ["A.B"]  # four rows before


def test_fine_settings_give_way_to_those_of_the_session(spark):
    keys = [session.INITIAL_PARTITIONS, *session.TASK_BYTES]
    before = {k: spark.conf.get(k, None) for k in [*keys, *(f"weftwork.{k}" for k in keys)]}
    files = "spark.sql.files.maxPartitionBytes"
    try:
        for k in before:
            spark.conf.unset(k)
        for fine in (True, False, True):
            session.tune(spark, fine)
            assert (spark.conf.get(files).rstrip("b") == str(16 << 20)) is fine
            assert (int(spark.conf.get(session.INITIAL_PARTITIONS)) >= session.FINE_PARTITIONS) is fine
        spark.conf.set(files, "5m")
        spark.conf.set(session.INITIAL_PARTITIONS, "7")
        for fine in (False, True):
            session.tune(spark, fine)
            assert spark.conf.get(files) == "5m" and spark.conf.get(session.INITIAL_PARTITIONS) == "7"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
