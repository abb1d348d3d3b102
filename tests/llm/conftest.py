import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import helpers  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(helpers.rows(), helpers.SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], helpers.SCHEMA)
