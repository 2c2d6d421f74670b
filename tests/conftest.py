import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rentroll.session import spark_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = spark_session(4, "tests", "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
