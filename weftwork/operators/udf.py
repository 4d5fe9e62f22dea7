"""Steps with user code. Batches cross to Python as Arrow; rows stay partitioned as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from weftwork import session as _session  # noqa: F401  lets functions of this package travel to workers


def row_code(df: DataFrame, fn: Callable[[dict], Iterator[dict]], schema: str, inputs: list[str] | None = None) -> DataFrame:
    """Per-row user code that may emit no, one or many rows; only ``inputs`` are sent to Python.

    Values are plain Python ones: NULL is None, integers stay exact. A field that a row leaves out is NULL.
    """
    fed = df.select(*(inputs or df.columns))
    shape = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for given in batch.to_pylist() for row in fn(given)]
            if out:
                yield pa.RecordBatch.from_pylist(out, shape)

    return fed.mapInArrow(run, schema)


def procedure(df: DataFrame, fn: Callable[..., Column] | Callable[..., pd.Series], inputs: list[str], return_field: str,
              return_type: str | None = None) -> DataFrame:
    """Passive procedure: one value a row. ``fn`` is a Column function, or with ``return_type`` a pandas one."""
    call = fn if return_type is None else F.pandas_udf(fn, return_type)
    return df.withColumn(return_field, call(*[F.col(c) for c in inputs]))
