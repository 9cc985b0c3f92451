import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from itemrec.runtime import prepare  # noqa: E402
from itemrec.sources.views import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.maxMetadataStringLength", "5000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return prepare(session)


@pytest.fixture
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def column(spark):
    """Values of one expression over literal rows, in row order."""
    from pyspark.sql import functions as F

    def evaluate(build, values, kind):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]

    return evaluate
