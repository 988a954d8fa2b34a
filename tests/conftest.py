import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from attestra.session import local, ship

    s = local(cores=4, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
