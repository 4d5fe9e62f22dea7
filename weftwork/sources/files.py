"""Scans of metadata files: snapshots, recipes, DDL, mapping XML, control statements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork import session as _session  # noqa: F401  lets functions of this package travel to workers

# Columns of a job-history snapshot.
SNAPSHOT_COLUMNS = ["cluster_name", "recipe_filename", "job_id", "app_start_iso",
                    "avg_job_duration_in_mins_sec", "status", "message"]
# End of a dated file's path.
DATED = r"(\d{4}_\d{2}_\d{2})/[^/]*$"
# Layer directories of control statements.
CONTROL_LAYERS = ["STG", "ODS", "ETL", "DWH", "RDM", "QDM", "CDM", "OUTPUT"]
# Tokens that stand for a step kind or a key in anonymised recipes.
TYPE_ALIASES = {"BERYLFALLS": "sourceQualifier", "EARLYGLADE": "unionInput",
                "ASHPATH2": "joinerInput", "CEDARWICK2": "storedProcedure"}
KEY_ALIASES = {"greencliff": "groups", "weststone": "fields", "oakcombe2": "dq2"}


def snapshot_scan(spark: SparkSession, root: str, columns: int = 64) -> DataFrame:
    """All dated snapshots below ``root``; the date is in the directory name, a missing cell is ''.

    Each file's first record is its header, whatever it holds. Columns are taken by its names, in any order; a column that
    a header lacks is ''. Quoted cells may hold line breaks. ``columns`` is the largest number of columns a file may have; a wider one is an error.
    """
    cells = [f"_c{i}" for i in range(columns)]

    def read(header: bool) -> DataFrame:
        return (spark.read.schema(", ".join(f"{x} string" for x in cells)).option("recursiveFileLookup", True).option("multiLine", True)
                .option("escape", '"').option("maxColumns", columns).option("header", header).csv(root)
                .filter(F.col("_metadata.file_path").rlike(DATED))  # other files are not opened
                .select(F.col("_metadata.file_path").alias("_file"), F.array(*cells).alias("_cells")))

    return _dated(named_cells(read(True), read(False)))


def named_cells(rows: DataFrame, records: DataFrame) -> DataFrame:
    """(file, cells) data rows, and all records of the same files → the snapshot columns and the file.

    A multi-line file is one split, read in order, so the smallest number in a file is its first record.
    """
    places = F.struct(*[F.array_position("_cells", n).alias(n) for n in SNAPSHOT_COLUMNS])
    headers = records.withColumn("_n", F.monotonically_increasing_id()).groupBy("_file").agg(F.min_by(places, "_n").alias("_at"))  # one row a file
    at = lambda n: F.when(F.col(f"_at.{n}") > 0, F.element_at("_cells", F.col(f"_at.{n}").cast("int")))
    return rows.join(headers, "_file").select("_file", *[at(n).alias(n) for n in SNAPSHOT_COLUMNS])


def _dated(rows: DataFrame) -> DataFrame:
    day = F.regexp_extract("_file", DATED, 1)
    return (rows.withColumn("run_date", F.try_to_timestamp(day, F.lit("yyyy_MM_dd")).cast("date")).drop("_file")
            .filter(F.col("run_date").isNotNull()).fillna("", SNAPSHOT_COLUMNS))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the session's default file system where it has none, as Spark's own readers take it."""
    if "://" in path:
        return path
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return re.sub(r"^file:/+", "file:///", full)


def _list_level(batches: Iterator[pd.DataFrame], recursive: bool) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        for path, is_dir in zip(batch["path"], batch["is_dir"]):
            if not is_dir:
                yield pd.DataFrame({"path": [path], "is_dir": [False]})
                continue
            store, inner = fs.FileSystem.from_uri(path)
            found = store.get_file_info(fs.FileSelector(inner, recursive=recursive))
            scheme = path.split("://")[0] if "://" in path else "file"
            host = path.split("://", 1)[1].split("/", 1)[0] if "://" in path and store.type_name == "hdfs" else ""
            yield pd.DataFrame({"path": [f"{scheme}://{host}{i.path}" for i in found],
                                "is_dir": [i.type == fs.FileType.Directory for i in found]})


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below ``root``, listed by tasks.

    Spark's own readers skip names that start with an underscore, which recipe
    files do, so they cannot list these. The first two directory levels are
    spread over tasks before the rest is walked.
    """
    uri = qualified(spark, root)
    start = spark.createDataFrame([(uri.rstrip("/"), True)], "path string, is_dir boolean")
    schema = start.schema
    shallow = lambda b: _list_level(b, recursive=False)
    deep = lambda b: _list_level(b, recursive=True)
    two = start.mapInPandas(shallow, schema).repartition("path").mapInPandas(shallow, schema)
    files = two.repartition("path").mapInPandas(deep, schema)
    return files.filter(~F.col("is_dir")).select("path").distinct()


def _read_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        for path in batch["path"]:
            store, inner = fs.FileSystem.from_uri(path)
            with store.open_input_stream(inner) as f:
                yield pd.DataFrame({"path": [path], "document": [f.read().decode("utf-8")]})


def recipe_scan(spark: SparkSession, root: str) -> DataFrame:
    """Every ``_ETL_*.json`` below ``root`` outside ``_history``: (path, recipe, mapping_dir, layer, document)."""
    prefix = qualified(spark, root).rstrip("/") + "/"
    paths = list_files(spark, root).filter(
        F.col("path").rlike(r"/_ETL_[^/]*\.json$") & ~F.col("path").contains("/_history/"))
    docs = paths.repartition("path").mapInPandas(_read_text, "path string, document string")
    return with_paths(docs.withColumn("path", F.expr(f"substring(path, {len(prefix) + 1})")))


def with_paths(docs: DataFrame) -> DataFrame:
    """Add recipe, mapping_dir and layer to documents that carry a path relative to the corpus root."""
    return docs.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("recipe"),
        F.regexp_replace("path", r"/[^/]*$", "").alias("mapping_dir"),
        F.regexp_replace(F.split("path", "/")[0], r"^layer=", "").alias("layer"), "document")


def ddl_scan(spark: SparkSession, root: str) -> DataFrame:
    """Table DDL files (names not starting with ``_``): (dir, table, pos, column, type, mode, description)."""
    shape = "array<struct<mode:string,name:string,type:string,description:string>>"
    docs = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))
    return ddl_columns(docs, shape)


def ddl_columns(docs: DataFrame, shape: str = "array<struct<mode:string,name:string,type:string,description:string>>", outer: bool = False) -> DataFrame:
    """DDL files (path, value) as rows of `ddl_scan`; ``outer``: a file without columns has one row, its columns NULL."""
    parts, unfold = F.split("path", "/"), F.posexplode_outer if outer else F.posexplode
    # Names are cut once a document, not once a column.
    named = docs.select(F.element_at(parts, -2).alias("dir"), F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("table"), "value")
    return (named.select("dir", "table", unfold(F.from_json("value", shape)).alias("pos", "c"))
            .select("dir", "table", "pos", F.col("c.name").alias("column"), F.col("c.type").alias("type"),
                    F.col("c.mode").alias("mode"), F.col("c.description").alias("description")))


_FIELD = "array<struct<_NAME:string,_DATATYPE:string,_PRECISION:string,_SCALE:string,_NULLABLE:string>>"
_PORT = ("array<struct<_NAME:string,_DATATYPE:string,_PORTTYPE:string,_PRECISION:string,_SCALE:string,"
         "_EXPRESSION:string,_EXPRESSIONTYPE:string,_GROUP:string,_REF_SOURCE_FIELD:string>>")
_TRANSFORMATION = (f"array<struct<_NAME:string,_TYPE:string,TRANSFORMFIELD:{_PORT},"
                   "TABLEATTRIBUTE:array<struct<_NAME:string,_VALUE:string>>,"
                   "GROUP:array<struct<_NAME:string,_TYPE:string,_EXPRESSION:string>>>>")
_VARIABLE = "array<struct<_NAME:string,_DATATYPE:string,_DEFAULTVALUE:string,_ISPARAM:string>>"
_INSTANCE = "array<struct<_NAME:string,_TRANSFORMATION_NAME:string,_TRANSFORMATION_TYPE:string,_TYPE:string>>"
_CONNECTOR = ("array<struct<_FROMINSTANCE:string,_FROMINSTANCETYPE:string,_FROMFIELD:string,"
              "_TOINSTANCE:string,_TOINSTANCETYPE:string,_TOFIELD:string>>")


def mapping_xml_scan(spark: SparkSession, root: str, encoding: str = "windows-1252",
                     names: str = "*.{xml,XML}") -> dict[str, DataFrame]:
    """Mapping XML files flattened to one table an element kind.

    ``source_fields``, ``target_fields``, ``transform_fields``, ``table_attributes``,
    ``groups``, ``instances``, ``connectors`` and ``variables``. Each asks the reader for its own
    element and fields only. Reusable transformations and variables of a folder have a NULL mapping.
    """
    def read(tag: str, shape: str) -> DataFrame:
        return (spark.read.format("xml").schema(shape).option("rowTag", tag).option("encoding", encoding)
                .option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root))

    def owned(tag: str, element: str) -> DataFrame:
        return (read(tag, f"_NAME string, {element} {_FIELD}")
                .select(F.col("_NAME").alias("owner"), F.posexplode(element).alias("pos", "f"))
                .select("owner", "pos", F.col("f._NAME").alias("name"), F.col("f._DATATYPE").alias("data_type"),
                        F.col("f._PRECISION").alias("precision"), F.col("f._SCALE").alias("scale"),
                        (F.upper("f._NULLABLE") != "NOTNULL").alias("nullable")))

    def of_mapping(shape: str, element: str, folder: bool = False) -> DataFrame:
        tags = ("MAPPING", "MAPPLET") + (("FOLDER",) if folder else ())  # reusable ones stand in the folder itself, without a mapping
        inside = [read(tag, f"_NAME string, {element} {shape}")
                  .select((F.lit(None).cast("string") if tag == "FOLDER" else F.col("_NAME")).alias("mapping"), F.explode(element).alias("e")) for tag in tags]
        return reduce(DataFrame.unionByName, inside)

    steps = of_mapping(_TRANSFORMATION, "TRANSFORMATION", folder=True).select(
        "mapping", F.col("e._NAME").alias("transformation"), F.col("e._TYPE").alias("kind"), "e.*")
    ports = steps.select("mapping", "transformation", "kind", F.posexplode("TRANSFORMFIELD").alias("pos", "f"))
    return {
        "source_fields": owned("SOURCE", "SOURCEFIELD"),
        "target_fields": owned("TARGET", "TARGETFIELD"),
        "transform_fields": ports.select(
            "mapping", "transformation", "kind", "pos", F.col("f._NAME").alias("name"),
            F.col("f._DATATYPE").alias("data_type"), F.col("f._PORTTYPE").alias("port_type"),
            F.col("f._EXPRESSION").alias("expression"), F.col("f._GROUP").alias("group"),
            F.col("f._REF_SOURCE_FIELD").alias("ref_source_field")),
        "table_attributes": steps.select("mapping", "transformation", F.explode("TABLEATTRIBUTE").alias("a")).select(
            "mapping", "transformation", F.col("a._NAME").alias("name"), F.col("a._VALUE").alias("value")),
        "groups": steps.select("mapping", "transformation", F.explode("GROUP").alias("g")).select(
            "mapping", "transformation", F.col("g._NAME").alias("name"), F.col("g._TYPE").alias("type"),
            F.col("g._EXPRESSION").alias("expression")),
        "variables": of_mapping(_VARIABLE, "MAPPINGVARIABLE", folder=True).select(
            "mapping", F.col("e._NAME").alias("name"), F.col("e._DATATYPE").alias("data_type"), F.col("e._DEFAULTVALUE").alias("default"),
            (F.upper("e._ISPARAM") == "YES").alias("is_parameter")),
        "instances": of_mapping(_INSTANCE, "INSTANCE").select(
            "mapping", F.col("e._NAME").alias("name"), F.col("e._TRANSFORMATION_NAME").alias("transformation"),
            F.col("e._TRANSFORMATION_TYPE").alias("kind"), F.col("e._TYPE").alias("type")),
        "connectors": of_mapping(_CONNECTOR, "CONNECTOR").select(
            "mapping", F.col("e._FROMINSTANCE").alias("from_instance"), F.col("e._FROMFIELD").alias("from_field"),
            F.col("e._TOINSTANCE").alias("to_instance"), F.col("e._TOFIELD").alias("to_field")),
    }


def control_scan(spark: SparkSession, root: str, statement: str = "INSERT INTO") -> tuple[DataFrame, DataFrame]:
    """Control statements → (entries, skipped).

    The text reader cuts the files at ``statement``, so a file of any size is
    split over tasks. One pattern describes a whole well-formed row; a row that does not
    fit it goes to ``skipped`` with its file. Only the known layer directories are read.
    """
    raw = (spark.read.option("lineSep", statement).option("recursiveFileLookup", True).text(root)
           .select(F.col("_metadata.file_path").alias("path"), "value"))
    layer_dir = F.regexp_extract("path", r"/(?:layer=)?([^/=]+)/[^/]*$", 1)
    return control_rows(raw.filter(layer_dir.isin(CONTROL_LAYERS)))


def control_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse (path, value) rows, one statement each, after its opening words."""
    text, flag, number = r"'([^']*(?:''[^']*)*)'", r"(true|false)", r"([+-]?\d+)"
    bare = lambda p: p.replace("([^'", "(?:[^'").replace("(true", "(?:true").replace("([+-]", "(?:[+-]")
    record = lambda *kinds: r"STRUCT\s*\(\s*" + r"\s*,\s*".join(kinds) + r"\s*\)"
    listed = lambda item: r"\[\s*((?:" + bare(item) + r"(?:\s*,\s*" + bare(item) + r")*)?)\s*\]"
    kinds = [record(text, flag, number), text, record(text, text), record(text, text, text, text)]
    row = (r"(?s)^[^(]*\(\s*" + r"\s*,\s*".join([text] * 5 + [number] + [listed(k) for k in kinds]) + r"\s*\)")

    found = raw.filter(F.col("value").rlike(r"(?s)^[^(']*VALUES\s*\(")).withColumn("_ok", F.col("value").rlike(row))
    good = found.filter("_ok")
    part = lambda i: F.regexp_extract("value", row, i)
    plain = lambda c: F.replace(c, F.lit("''"), F.lit("'"))

    def items(group: int, item: str, fields: list[tuple[str, str]]):
        columns = [F.regexp_extract_all(part(group), F.lit(item), F.lit(i + 1)) for i in range(len(fields))]
        zipped = F.arrays_zip(*[c.alias(f"x{i}") for i, c in enumerate(columns)])
        return F.transform(zipped, lambda z: F.struct(*[
            (plain(z[f"x{i}"]) if t == "string" else z[f"x{i}"].cast(t)).alias(n) for i, (n, t) in enumerate(fields)]))

    entries = good.select(
        plain(part(1)).alias("layer"), plain(part(2)).alias("mapping_xml_dir"), plain(part(3)).alias("recipe"),
        plain(part(4)).alias("workflow"), plain(part(5)).alias("target"), part(6).cast("int").alias("execution_order"),
        items(7, kinds[0], [("table", "string"), ("active", "boolean"), ("day_offset", "int")]).alias("sources"),
        F.transform(F.regexp_extract_all(part(8), F.lit(text), F.lit(1)), plain).alias("lookup_tables"),
        items(9, kinds[2], [("target_table", "string"), ("write_mode", "string")]).alias("targets_write_mode"),
        items(10, kinds[3], [("target_table", "string"), ("partition_type", "string"), ("partition_key", "string"),
                             ("subpartition_key", "string")]).alias("target_partition"))
    return entries, found.filter(~F.col("_ok")).select("path", F.col("value").alias("statement"))


def write_documents(docs: DataFrame, root: str) -> None:
    """Write (path, document) rows as files named exactly ``root/path``, each by the task that holds the row."""
    uri = qualified(docs.sparkSession, root).rstrip("/")

    def write(rows) -> None:
        from pyarrow import fs

        for row in rows:
            store, inner = fs.FileSystem.from_uri(f"{uri}/{row['path']}")
            store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(inner) as f:
                f.write(row["document"].encode("utf-8"))

    docs.select("path", "document").foreachPartition(write)
