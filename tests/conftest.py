import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siltstone import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", "tests", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()
