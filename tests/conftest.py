import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from weftwork.session import tune

    session = (SparkSession.builder.master("local[*]").appName("tests").config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples, NULLs last."""
    def collect(df, *columns):
        out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(out, key=lambda r: [(v is None, str(type(v)), str(v)) if not isinstance(v, (int, float)) or isinstance(v, bool)
                                          else (False, "", v) for v in r])
    return collect
