import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def graph(spark):
    from vertexloom.graph import Graph

    def make(edges, ids=None, weighted=False, missing="create"):
        schema = "src long, dst long" + (", weight double" if weighted else "")
        vertices = None if ids is None else spark.createDataFrame([(i,) for i in ids], "id long")
        return Graph(vertices, spark.createDataFrame(edges, schema), missing)

    return make
