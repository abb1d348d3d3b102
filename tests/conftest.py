from __future__ import annotations

import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from pyspark.sql import types as T  # noqa: E402

from rows import wall  # noqa: E402
from teleledger import schema  # noqa: E402
from teleledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", **{
        "spark.sql.shuffle.partitions": "2",
        # Tables of a few rows: compiling a plan costs more than running it.
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.default.parallelism": "2",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Rows of a model table from dicts; missing fields are null."""
    def build(table: str, rows: list[dict], extra: T.StructType | None = None):
        fields = wall(schema.TABLES[table]())
        if extra is not None:
            fields = T.StructType(fields.fields + extra.fields)
        return spark.createDataFrame([tuple(r.get(n) for n in fields.names) for r in rows], fields)

    return build
