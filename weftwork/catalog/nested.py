"""Nested inputs built by Spark from the shared flat views: control entries and snapshot files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.catalog.registry import Tables
from weftwork.catalog.views import ENTRIES, RUNS
from weftwork.session import fresh_path

c = F.col


def entries(t: Tables) -> DataFrame:
    """Control entries with their struct arrays."""
    source = lambda name, active, offset: F.struct(c(name).alias("table"), active.alias("active"), offset.alias("day_offset"))
    return t.sql(ENTRIES).select(
        "entry_order", "layer", "mapping_xml_dir", "recipe", "workflow", "target", "execution_order",
        F.array(source("source_1", c("active_1"), c("offset_1")), source("source_2", F.lit(True), F.lit(0))).alias("sources"),
        F.array("lookup_1").alias("lookup_tables"),
        F.array(F.struct(c("target").alias("target_table"), "write_mode")).alias("targets_write_mode"),
        F.array(F.struct(c("target").alias("target_table"), "partition_type", F.lit("LOAD_DATE").alias("partition_key"),
                         F.lit("NONE").alias("subpartition_key"))).alias("target_partition"))


def runs(t: Tables) -> DataFrame:
    return t.sql(RUNS)


def snapshot_files(t: Tables) -> str:
    """The runs written as one CSV directory a day; returns the root.

    A day's runs are brought together first: else each task would write a file a day, and the driver lists all files.
    """
    root = fresh_path(t.spark, "snapshots")
    cols = ["cluster_name", "recipe_filename", "job_id", "app_start_iso", "avg_job_duration_in_mins_sec", "status", "message"]
    (runs(t).select(F.date_format("run_date", "yyyy_MM_dd").alias("day"), *cols).hint("rebalance", "day").write.partitionBy("day")
     .option("header", True).option("escape", '"').option("emptyValue", "").csv(root))
    return root


def control_files(t: Tables) -> str:
    """The entries written as control statements, one directory a layer, with some rows broken on purpose; returns the root."""
    root = fresh_path(t.spark, "control")
    q = lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    flat = t.sql(ENTRIES)
    text = F.concat(
        F.lit("INSERT INTO control_config VALUES ("),
        F.concat_ws(", ", q(c("layer")), q(F.concat("mapping_xml_dir", F.lit("/o'dir, x"))), q(c("recipe")), q(c("workflow")), q(c("target")),
                    F.when(c("execution_order") == 3, "three").otherwise(c("execution_order").cast("string")),
                    F.concat(F.lit("[STRUCT("), q(c("source_1")), F.lit(", "), c("active_1").cast("string"), F.lit(", "), c("offset_1").cast("string"),
                             F.lit("), STRUCT("), q(c("source_2")), F.lit(", true, 0)]")),
                    F.when(c("lookup_1") == "LKP_0", "[]").otherwise(F.concat(F.lit("["), q(c("lookup_1")), F.lit("]"))),
                    F.concat(F.lit("[STRUCT("), q(c("target")), F.lit(", "), q(c("write_mode")), F.lit(")]")),
                    F.concat(F.lit("[STRUCT("), q(c("target")), F.lit(", "), q(c("partition_type")), F.lit(", 'LOAD_DATE', '')]"))),
        F.lit(")"))
    flat.select("layer", text.alias("value")).write.partitionBy("layer").text(root)
    return root
