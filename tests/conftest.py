import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpuscope.session import build_session

    session = build_session("tests", 8)
    session.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluates column expressions on one row of named values."""
    from pyspark.sql import functions as F

    def run(expression, **values):
        frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
        return frame.select(expression.alias("out")).first().out

    return run
