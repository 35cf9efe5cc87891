"""One session for all tests."""

import pytest

from veilspark.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
