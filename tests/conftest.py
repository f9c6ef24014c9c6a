import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paperloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "paperloom-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="paperloom-tests-"),
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """Rows of dictionaries as a DataFrame with a given schema."""

    def make(schema: str, *rows):
        return spark.createDataFrame(list(rows), schema)

    return make
