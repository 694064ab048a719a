import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusloom.session import local_session, ship_by_value  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    ship_by_value()
    return local_session(cpus=os.environ.get("TEST_CPUS", "4"), shuffle_partitions=4)
