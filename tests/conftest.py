import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vicinia.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4,
        "vicinia-tests",
        **{"spark.default.parallelism": "2", "spark.sql.shuffle.partitions": "3"},
    )
    yield session
    session.stop()
