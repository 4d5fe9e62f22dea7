"""Work that grew faster than the input, and the results that its new forms must keep."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from weftwork.operators import joins as J
from weftwork.operators import windows as W
from weftwork.plans import conformance as K
from weftwork.plans import lineage as N
from weftwork.session import stage
from weftwork.sources.files import ddl_columns

TREE = '{"name":"f","parameters":[{"source":"SQ.A"},{"source":"X.B"}]}'
DOCS = [("r1", '{"steps":[{"target":{"name":"SQ","type":"table","fields":[{"name":"A","dataType":"String","transformation":%s}]},"sources":[{"name":"T","type":"table"}]},'
               '{"target":{"name":"sq","type":"router","weststone":[{"name":"B","transformation":{"source":"sq.nope"}}],"groups":[{"name":"G","fields":[{"name":"P"}]}]}}],'
               '"table":{"targetTableNames":["OTHER"],"sourceTableNames":["T"]}}' % TREE),
        ("r1", '{"steps":[{"target":{"name":"Y","type":"table","fields":[{"name":"A","transformation":{"source":"Y.A"}},{"transformation":{"source":"SQ.Z"}}]}}]}'),
        ("r2", '{"steps":[{"target":{"name":"S","type":"table","fields":[{"name":"F","transformation":{"a":tru}}]},"sources":[]},{"target":{"name":"S","type":"table"}}]}'),
        ("r3", '{"steps":[{"target":{"name":"S","type":"table","fields":"x","groups":7},"sources":"y"},{"target":"z"},{"target":{"name":"s","type":"table","selectDistinct":"no"}}],"table":[]}'),
        ("r4", '{"steps":[{"target":{"name":["a",1],"type":"table","fields":[{"name":{"x":1},"transformation":{"source":"Q.R"}},3]}}],"table":{"targetTableNames":"T"}}'),
        ("r5", '{"steps":[{"target":{"name":"cut","type":"table"}},{"target":{"na'), (None, '{"steps":[{"target":{"name":"N","type":"table"}}]}'), ("r6", None), ("r7", "no document")]


def docs(spark):
    return spark.createDataFrame(DOCS, "recipe string, document string")


@pytest.mark.parametrize("rule", K.PARTS)
def test_rules_find_the_same_in_wanted_parts(spark, rows, rule):
    """whole, broken and odd documents, two of one name"""
    assert rows(K.check(rule, docs(spark))) == rows(K.RULES[rule](K.Corpus(docs(spark))))


def test_rules_parse_no_trees_they_do_not_read(spark):
    """F16, F18: before, the text of every tree was spelled anew"""
    for rule in ("STR-006", "REF-005"):
        plan = K.check(rule, docs(spark))._jdf.queryExecution().optimizedPlan().toString()
        narrow = [p for p in re.findall(r"from_json\(StructField.{0,400}", plan) if "_corrupt" in p[:400]]
        assert narrow and not any("transformation" in p for p in narrow), rule


def _side(spark, n, name, other):
    return spark.range(n).select((F.col("id") % 40).alias(name), (F.col("id") % 7).alias(other))


def test_rows_without_partner_need_no_pairs(spark, monkeypatch):
    """before, an outer join wrote all its pairs to find the rows left over"""
    written = []
    real = J.stage
    monkeypatch.setattr(J, "stage", lambda df, label, *more: written.append(label) or real(df, label, *more))
    master, detail = _side(spark, 60, "lo", "a"), _side(spark, 90, "v", "b").withColumn("v", F.col("v") - 10)
    for op, holds in (("<>", lambda a, b: a != b), ("<=", lambda a, b: a <= b), (">", lambda a, b: a > b)):
        out = J.joiner(master, detail, [("lo", "<", "v"), ("a", op, "b")], J.FULL_OUTER)
        m, d = [tuple(r) for r in master.collect()], [tuple(r) for r in detail.collect()]
        want = [(*x, *y) for x in m for y in d if x[0] < y[0] and holds(x[1], y[1])]
        want += [(*x, None, None) for x in m if not any(x[0] < y[0] and holds(x[1], y[1]) for y in d)]
        want += [(None, None, *y) for y in d if not any(x[0] < y[0] and holds(x[1], y[1]) for x in m)]
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert "met" not in written


def test_columns_named_like_cells(spark):
    master, detail = spark.createDataFrame([(1, 2)], "level int, cell int"), spark.createDataFrame([(3, 4)], "v int, tile int")
    assert J.joiner(master, detail, [("level", "<", "v")], J.FULL_OUTER).collect() == [(1, 2, 3, 4)]


def test_duplicates_of_few_rows_are_shuffled_once(spark, monkeypatch):
    """before, all rows were shuffled three times and sorted as structs; keys of many rows are still not sorted"""
    df = spark.range(300).select(F.when(F.col("id") % 11 != 0, F.col("id") % 11).alias("k"), (F.col("id") % 3).cast("double").alias("v"), (F.col("id") % 5).cast("string").alias("s"))
    plan = W.flag_duplicates(df, ["k"], ["v"], "f")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan
    count = lambda: {tuple(r)[:4]: r.n for r in W.flag_duplicates(df, ["k"], ["v"], "f").groupBy("k", "v", "s", "f").agg(F.count("*").alias("n")).collect()}
    few = count()
    assert sum(few.values()) == 300 and sum(n for (_, _, _, f), n in few.items() if f == "N") == 11
    monkeypatch.setattr(W, "FEW", 27)
    assert count() == few


def test_usage_of_documents_of_one_name(spark, rows):
    """parsed for the declared tables alone"""
    found = spark.createDataFrame([(r, f"d{i}/{r}", f"d{i}", t) for i, (r, t) in enumerate(DOCS)], "recipe string, path string, mapping_dir string, document string")
    ddl = spark.createDataFrame([("d0", "T"), ("d0", "T"), ("d9", "U")], "dir string, table string")
    assert rows(N.usage(found, ddl), "table", "role", "path") == [
        ("OTHER", "target", "d0/r1"), ("OTHER", "target", "d1/r1"), ("T", "ddl", "d0/r1"), ("T", "source", "d0/r1"), ("T", "source", "d1/r1")]


def test_usage_counts_tables_whose_ddl_has_no_columns(spark, rows):
    """before, a DDL file without columns, or none that can be read, was left out"""
    found = spark.createDataFrame([("r1", "d0/r1", "d0", "{}"), ("r2", "d9/r2", "d9", "{}")], "recipe string, path string, mapping_dir string, document string")
    files = spark.createDataFrame([("x/d0/T.json", '[{"name":"A","type":"INT64"},{"name":"B"}]'), ("x/d0/E.json", "[]"), ("x/d0/O.json", "{}"), ("x/d9/B.json", "[{")], "path string, value string")
    ddl = ddl_columns(files, outer=True)
    assert rows(N.usage(found, ddl), "table", "role", "path") == [("B", "ddl", "d9/r2"), ("E", "ddl", "d0/r1"), ("O", "ddl", "d0/r1"), ("T", "ddl", "d0/r1")]
    assert rows(ddl_columns(files), "table", "pos", "column") == [("O", 0, None), ("T", 0, "A"), ("T", 1, "B")]


def test_shuffle_files_end_with_their_job(spark):
    """before, the shuffles of all jobs stayed until the driver collected garbage"""
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, df = files(), spark.range(1000).repartition(3, "id")
    stage(df, "shuffled")
    assert df.groupBy("id").count().count() == 1000
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before


def test_mappings_are_walked_at_once(spark, rows, monkeypatch):
    """before, all targets of all mappings took one step a round, and each round was shuffled and written"""
    r = random.Random(3)
    links = [(f"m{r.randrange(12)}", f"i{r.randrange(4)}", f"f{r.randrange(3)}", f"i{r.randrange(5)}", f"f{r.randrange(3)}") for _ in range(150)] + [(None, "i0", "f0", "i4", "f0")]
    ports = [(f"m{r.randrange(12)}", f"t{r.randrange(3)}", f"f{r.randrange(3)}", r.choice([None, "f0 + F1", "f1 /* f0 */ || 'f2'", "x(f2, f0)"])) for _ in range(90)] + [("m1", "t0", None, "f0"), ("m1", None, "f0", "f1")]
    places = [(f"m{m}", f"i{i}", f"t{i % 3}", "Target" if i >= 3 else "SOURCE") for m in range(12) for i in range(5) for _ in range(1 + i % 2)] + [(None, "i4", "t0", "TARGET"), ("m2", None, "t1", "TARGET")]
    links += [("m3", f"i{i}", "g", f"i{i + 1}", "g") for i in range(4)] + [("m3", "i4", "g", "i1", "g")]
    tables = (spark.createDataFrame(links, "mapping string, from_instance string, from_field string, to_instance string, to_field string"),
              spark.createDataFrame(ports, "mapping string, transformation string, name string, expression string"),
              spark.createDataFrame(places, "mapping string, name string, transformation string, type string"))
    written = []
    monkeypatch.setattr(N, "stage", lambda df, label, *more: (written.append(label), stage(df, label, *more))[1])
    found = rows(N.connector_lineage(*tables))
    assert written == ["origins"] and len(found) > 20
    assert found == rows(N._origins_by_joins(*tables))
    monkeypatch.setattr(N, "MAPPING_ROWS", 25)  # some mappings are larger, some not
    assert found == rows(N.connector_lineage(*tables))
