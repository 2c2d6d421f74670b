import pytest

from rentroll.llm import shared


@pytest.fixture(autouse=True, scope="session")
def workers(spark):
    shared.reachable(spark)
