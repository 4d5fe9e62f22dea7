"""Daily files as a stream.

History and source feeds arrive as dated files. Operators without state
(projection, filter, router, validation, normalizer without generated key,
lookups against a static table) use no action, so the same function serves
a batch and a stream; these helpers read new files and append results exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftwork.sources.files import SNAPSHOT_COLUMNS, _dated


def stream_snapshots(spark: SparkSession, root: str, max_files: int = 1000, columns: int = 64) -> DataFrame:
    """The rows of `snapshot_scan` for files as they appear, columns taken by each file's header.

    A daily file is read as one text, so that its header is at hand without state; a quoted line break is not supported here.
    ``columns`` is the largest number of columns a file may have; a wider one is an error.
    """
    files = (spark.readStream.schema("value string").format("text").option("wholetext", True).option("recursiveFileLookup", True)
             .option("maxFilesPerTrigger", max_files).load(root).select(F.col("_metadata.file_path").alias("_file"), "value"))
    cells = ", ".join(f"c{i} string" for i in range(columns))
    parsed = lambda line: F.from_csv(line, F.lit(cells), {"escape": '"', "maxColumns": str(columns)})
    as_array = lambda row: F.array(*[row[f"c{i}"] for i in range(columns)])
    lines = files.withColumn("_lines", F.filter(F.split("value", r"\r?\n"), lambda x: x != ""))
    rows = (lines.withColumn("_header", as_array(parsed(F.col("_lines")[0])))
            .select("_file", "_header", F.explode(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))).alias("_line"))
            .withColumn("_cells", as_array(parsed(F.col("_line")))))
    at = lambda n: F.when(F.array_position("_header", n) > 0, F.element_at("_cells", F.array_position("_header", n).cast("int")))
    return _dated(rows.select("_file", *[at(n).alias(n) for n in SNAPSHOT_COLUMNS]))


def append_stream(rows: DataFrame, flow: Callable[[DataFrame], DataFrame], path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Apply a stateless ``flow`` to what has arrived and append to the table at ``path``; reruns add only new files.

    What has been read is noted in ``checkpoint``, by default a hidden folder of the table itself, so every run goes on from the last.
    """
    return (flow(rows).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint or f"{path.rstrip('/')}/_checkpoint")
            .trigger(availableNow=True).start(path))
