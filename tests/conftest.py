import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from demandloom.session import local_session
    s = local_session(8, "demandloom-tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
