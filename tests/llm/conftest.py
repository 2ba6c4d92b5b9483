import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from conftest_llm import SCHEMA, corpus  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1] or "") for r in corpus()]


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
