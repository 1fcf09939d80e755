import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    root = tempfile.mkdtemp(prefix="spark-tests-")
    builder = SparkSession.builder.master("local[4]").appName("tests")
    for key, value in {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.local.dir": root, "spark.sql.warehouse.dir": f"{root}/warehouse", "spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
