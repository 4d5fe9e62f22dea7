"""Scans of files written by the tests, and streaming over them."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from weftwork.sources import files
from weftwork.sources import tables as T
from weftwork.sources import targets as W
from weftwork.streaming.feeds import append_stream, stream_snapshots

HEADER = "cluster_name,recipe_filename,job_id,app_start_iso,avg_job_duration_in_mins_sec,status,message\n"


def put(root, path, text, encoding="utf-8"):
    f = root / path
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text(text, encoding=encoding)


def snapshots(root):
    put(root, "2026_07_01/b.csv", HEADER + 'c1,_ETL_a.json,j1,2026-07-01T04:12:22Z,14m 05sec,FAILED,"worker gone, job stopped"\nc2,_ETL_b.json,j2\n')
    put(root, "2026_07_02/b.csv", HEADER + 'c1,_ETL_a.json,j3,2026-07-02T04:12:22Z,10m 00sec,SUCCESS,"say ""hi"""\n')
    put(root, "2026_07_03/b.csv", "status,extra,recipe_filename,cluster_name,job_id\nSUCCESS,?,_ETL_c.json,c3,j4\n")
    put(root, "notes/b.csv", HEADER + "x,x,x,x,x,x,x\n")


def test_snapshot_scan(spark, rows, tmp_path):
    snapshots(tmp_path)
    out = files.snapshot_scan(spark, str(tmp_path))
    assert rows(out, "job_id", "run_date", "status", "message") == [
        ("j1", date(2026, 7, 1), "FAILED", "worker gone, job stopped"), ("j2", date(2026, 7, 1), "", ""),
        ("j3", date(2026, 7, 2), "SUCCESS", 'say "hi"'), ("j4", date(2026, 7, 3), "SUCCESS", "")]
    assert rows(out.filter("job_id = 'j4'"), "cluster_name", "recipe_filename", "app_start_iso") == [("c3", "_ETL_c.json", "")]


def test_snapshot_cells_may_hold_line_breaks(spark, rows, tmp_path):
    put(tmp_path, "2026_07_01/b.csv", HEADER + 'c1,_ETL_a.json,j1,x,1m 00sec,FAILED,"two\nlines"\n')
    assert rows(files.snapshot_scan(spark, str(tmp_path)), "job_id", "message") == [("j1", "two\nlines")]


def short_snapshots(root):
    put(root, "2026_07_01/b.csv", "job_id,recipe_filename\nj1,_ETL_a.json\n")
    put(root, "2026_07_02/b.csv", "cluster_name,status\nc2,FAILED\nrecipe_filename,cluster_name\n")
    put(root, "2026_07_03/b.csv", "other\nx\n")
    put(root, "2026_07_04/b.csv", HEADER)
    put(root, "notes/wide.csv", ",".join(f"x{i}" for i in range(70)) + "\n")


def test_snapshot_headers_may_lack_any_column(spark, rows, tmp_path):
    short_snapshots(tmp_path)
    want = [("", "", "", "", date(2026, 7, 3)), ("", "_ETL_a.json", "j1", "", date(2026, 7, 1)),
            ("c2", "", "", "FAILED", date(2026, 7, 2)), ("recipe_filename", "", "", "cluster_name", date(2026, 7, 2))]
    columns = ["cluster_name", "recipe_filename", "job_id", "status", "run_date"]
    assert rows(files.snapshot_scan(spark, str(tmp_path)), *columns) == want
    out = f"{tmp_path}-stream"
    append_stream(stream_snapshots(spark, str(tmp_path)), lambda df: df, out).awaitTermination()
    assert rows(spark.read.parquet(out), *columns) == want


def test_snapshot_cells_beyond_the_declared_columns_are_no_silent_loss(spark, rows, tmp_path):
    put(tmp_path, "2026_07_01/b.csv", ",".join([f"x{i}" for i in range(64)] + ["job_id", "status"]) + "\n" + "," * 64 + "j1,FAILED\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        files.snapshot_scan(spark, str(tmp_path)).collect()
    assert rows(files.snapshot_scan(spark, str(tmp_path), columns=66), "job_id", "status") == [("j1", "FAILED")]
    with pytest.raises(Exception, match="MALFORMED_CSV_RECORD"):
        append_stream(stream_snapshots(spark, str(tmp_path)), lambda df: df, f"{tmp_path}-stream").awaitTermination()


def test_reusable_transformations_of_a_folder(spark, rows, tmp_path):
    put(tmp_path, "m.xml", """<POWERMART><FOLDER NAME="f"><TRANSFORMATION NAME="EXP_SHARED" TYPE="Expression"><TRANSFORMFIELD NAME="x" PORTTYPE="OUTPUT" EXPRESSION="1"/></TRANSFORMATION>
<MAPPINGVARIABLE NAME="$$G" DATATYPE="string" ISPARAM="YES" DEFAULTVALUE="d"/><MAPPING NAME="m"><TRANSFORMATION NAME="EXP" TYPE="Expression"><TRANSFORMFIELD NAME="y"/></TRANSFORMATION>
<MAPPINGVARIABLE NAME="$$L" DATATYPE="string" ISPARAM="NO" DEFAULTVALUE=""/></MAPPING></FOLDER></POWERMART>""".replace(' NAME="', ' NAME="'))
    x = files.mapping_xml_scan(spark, str(tmp_path), encoding="UTF-8")
    assert rows(x["transform_fields"], "mapping", "transformation", "name") == [("m", "EXP", "y"), (None, "EXP_SHARED", "x")]
    assert rows(x["variables"], "mapping", "name", "default", "is_parameter") == [("m", "$$L", "", False), (None, "$$G", "d", True)]


def test_stream_reads_each_file_once(spark, rows, tmp_path):
    snapshots(tmp_path / "in")
    out = str(tmp_path / "out")
    flow = lambda df: df.filter(F.col("status") != "").select("job_id", "run_date", F.lower("status").alias("s"))
    append_stream(stream_snapshots(spark, str(tmp_path / "in")), flow, out).awaitTermination()
    put(tmp_path / "in", "2026_07_04/b.csv", HEADER + "c1,_ETL_a.json,j9,2026-07-03T00:00:00Z,1m 00sec,SUCCESS,\n")
    append_stream(stream_snapshots(spark, str(tmp_path / "in")), flow, out).awaitTermination()
    assert rows(spark.read.parquet(out), "job_id", "s") == [("j1", "failed"), ("j3", "success"), ("j4", "success"), ("j9", "success")]


GOOD = ("INSERT INTO control VALUES ('ODS', 'd', '{0}', 'wf', 'T', {1}, [STRUCT('S, ''q''', true, -30), STRUCT('S2', false, 0)],\n ['L(1)', 'L]2'], "
        "[STRUCT('T', 'APPEND')], [STRUCT('T', 'DAILY', 'D', '')])")


def test_control_scan(spark, tmp_path):
    put(tmp_path, "ODS/statements.sql", "-- note\n" + GOOD.format("r1", 2) + ";\n" + GOOD.format("r2", "two") + "\n" +
        "INSERT INTO control VALUES ('ODS', 'unbalanced', [STRUCT('x'\n" + GOOD.format("r3", 7).replace("[STRUCT('T', 'APPEND')]", "[]"))
    put(tmp_path, "ELSEWHERE/statements.sql", GOOD.format("r9", 1))
    entries, skipped = files.control_scan(spark, str(tmp_path))
    got = {r["recipe"]: r for r in entries.collect()}
    assert set(got) == {"r1", "r3"} and skipped.count() == 2
    assert [tuple(s) for s in got["r1"]["sources"]] == [("S, 'q'", True, -30), ("S2", False, 0)]
    assert got["r1"]["lookup_tables"] == ["L(1)", "L]2"] and got["r3"]["targets_write_mode"] == [] and got["r3"]["execution_order"] == 7
    active = T.active_sources(entries, "2024-01-31").filter("recipe = 'r1'").collect()
    assert [(r["table"], r["read_date"]) for r in active] == [("S, 'q'", date(2024, 3, 1))]


def test_recipe_and_ddl_scan(spark, rows, tmp_path):
    put(tmp_path, "ODS/m1/_ETL_m1.json", "{}")
    put(tmp_path, "ODS/m1/_history/_ETL_m1.json", "{}")
    put(tmp_path, "CDM/deep/er/m2/_ETL_m2.json", '{"x": "é"}')
    put(tmp_path, "ODS/m1/T1.json", '[{"mode":"NULLABLE","name":"A","type":"INT64","description":""},\n{"mode":"NULLABLE","name":"B","type":"STRING","description":"b"}]')
    docs = files.recipe_scan(spark, str(tmp_path))
    assert rows(docs, "path", "layer", "document") == [("CDM/deep/er/m2/_ETL_m2.json", "CDM", '{"x": "é"}'), ("ODS/m1/_ETL_m1.json", "ODS", "{}")]
    assert rows(files.ddl_scan(spark, str(tmp_path)), "dir", "table", "pos", "column") == [("m1", "T1", 0, "A"), ("m1", "T1", 1, "B")]


XML = """<?xml version="1.0" encoding="Windows-1252"?>
<ROOT><FOLDER NAME="F"><SOURCE NAME="S1"><SOURCEFIELD DATATYPE="string" NAME="ID" PRECISION="20" SCALE="0" NULLABLE="NOTNULL"/>
<SOURCEFIELD DATATYPE="number" NAME="Año" PRECISION="18" SCALE="2" NULLABLE="NULL"/></SOURCE>
<TARGET NAME="T1"><TARGETFIELD DATATYPE="varchar2" NAME="ID" PRECISION="20" SCALE="0" NULLABLE="NOTNULL"/></TARGET>
<MAPPING NAME="m1"><TRANSFORMATION NAME="RTR" TYPE="Router"><TRANSFORMFIELD DATATYPE="string" NAME="ID" PORTTYPE="INPUT"/>
<TRANSFORMFIELD DATATYPE="string" NAME="ID1" PORTTYPE="OUTPUT" GROUP="G1" EXPRESSION="upper(ID)"/><GROUP NAME="G1" TYPE="OUTPUT" EXPRESSION="ID = 1"/>
<TABLEATTRIBUTE NAME="Tracing Level" VALUE="Normal"/></TRANSFORMATION><INSTANCE NAME="RTR" TRANSFORMATION_NAME="RTR" TRANSFORMATION_TYPE="Router" TYPE="TRANSFORMATION"/>
<CONNECTOR FROMINSTANCE="S1" FROMINSTANCETYPE="Source Definition" FROMFIELD="ID" TOINSTANCE="RTR" TOINSTANCETYPE="Router" TOFIELD="ID"/></MAPPING></FOLDER></ROOT>
"""


@pytest.mark.parametrize("name", ["m.xml", "M.XML"])
def test_mapping_xml_scan(spark, rows, tmp_path, name):
    put(tmp_path, f"ODS/{name}", XML, "windows-1252")
    x = files.mapping_xml_scan(spark, str(tmp_path))
    assert rows(x["source_fields"], "owner", "name", "nullable") == [("S1", "Año", True), ("S1", "ID", False)]
    assert rows(x["target_fields"], "owner", "name") == [("T1", "ID")]
    assert rows(x["groups"], "transformation", "name", "expression") == [("RTR", "G1", "ID = 1")]
    assert rows(x["transform_fields"], "name", "expression", "group") == [("ID", None, None), ("ID1", "upper(ID)", "G1")]
    assert rows(x["connectors"], "mapping", "from_instance", "to_field") == [("m1", "S1", "ID")]
    assert rows(x["table_attributes"], "name", "value") == [("Tracing Level", "Normal")]


def test_declared_types(spark):
    assert T.spark_type("NUMBER(p,s)", 18, 0) == "bigint" and T.spark_type("number(p,s)", 19, 0) == "decimal(19,0)"
    assert T.spark_type("number(p)", 5) == "bigint" and T.spark_type("date/time", port=True) == "timestamp"
    with pytest.raises(ValueError):
        T.spark_type("blob")
    with pytest.raises(ValueError):
        T.table_source(spark, "NATION", "/root/testdata/sf0.001", ["nope"])


def test_feed_names():
    now = datetime(2024, 3, 1, 10, 11, 12)
    assert W.feed_name("a_$$Date.csv", now) == "a_20240229.csv" and W.feed_name("a_YYYYMMDD", now) == "a_20240301"
    assert W.feed_name("a_DDMMYYYYHH24MMSS", now) == "a_01032024101112"


def test_write_modes_refuse_what_they_cannot_do(spark, tmp_path):
    with pytest.raises(ValueError):
        W.write_target(spark.range(1), str(tmp_path / "x"), W.DELTA_PARTITIONED)
    with pytest.raises(ValueError):
        W.write_target(spark.range(1), str(tmp_path / "x"), "NO_SUCH_MODE")


def test_daily_partition_key(spark, rows):
    df = spark.createDataFrame([(datetime(2024, 5, 6, 7, 8),)], "ts timestamp_ntz")
    assert rows(W.partition_by(df, W.DAILY, "ts"), "PARTITION_KEY") == [(date(2024, 5, 6),)]
    assert W.partition_by(df, W.UNKNOWN, "ts").columns == ["ts"]
