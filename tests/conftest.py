import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tessera.core import session

    s = session("tests", "8", **{"spark.sql.shuffle.partitions": "2"})
    yield s
    s.stop()
