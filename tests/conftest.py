import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marginloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="4g")


@pytest.fixture
def frame(spark):
    """Build a DataFrame from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
