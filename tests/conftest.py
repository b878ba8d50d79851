import os

import pytest

os.environ.setdefault("PYTHONHASHSEED", "0")


@pytest.fixture(scope="session")
def spark():
    from rippleframe.session import build_session

    session = build_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """DataFrame from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
