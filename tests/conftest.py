import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from fleetgauge import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session.build(
        "local[8]", "tests", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    found.sparkContext.setLogLevel("OFF")
    yield found
    found.stop()
